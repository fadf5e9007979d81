"""Ask limits: accepted asks in a sliding window and on a day. Refused asks don't count, so each key is a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidemark import config

_DAY = 86_400_000_000


def decide(times: list[int], recent: list[int], day: int, used: int, window_s: int, most: int, daily: int) -> tuple[list[str], list[int], int, int]:
    """Verdicts of asks (microseconds, ascending) and the state after them: accepted in the window, day, accepted on it."""
    out = []
    for t in times:
        recent = [r for r in recent if r > t - window_s * 1_000_000]
        if t // _DAY != day:
            day, used = t // _DAY, 0
        verdict = "window" if len(recent) >= most else "daily" if used >= daily else "ok"
        if verdict == "ok":
            recent.append(t)
            used += 1
        out.append(verdict)
    return out, recent, day, used


def limited(asks: DataFrame, window_s: int = config.ASK_WINDOW_SECONDS, most: int = config.ASK_WINDOW_MAX, daily: int = config.ASK_DAILY_MAX) -> DataFrame:
    """asks (ip, ts, event_id) with verdict: ok, window or daily. Rows of a key are read in order as a stream."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent, day, used = object(), [], -1, 0
        for batch in batches:
            verdicts, ips, times = [], batch["ip"].tolist(), batch["us"].tolist()
            edges = [0, *(i for i in range(1, len(ips)) if ips[i] != ips[i - 1]), len(ips)]
            for a, b in zip(edges, edges[1:]):
                if a < b and ips[a] != last:
                    last, recent, day, used = ips[a], [], -1, 0
                v, recent, day, used = decide(times[a:b], recent, day, used, window_s, most, daily)
                verdicts += v
            yield batch.drop(columns="us").assign(verdict=verdicts)

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ordered = asks.select("ip", "event_id", micros.alias("us")).repartition("ip").sortWithinPartitions("ip", "us", "event_id")
    return ordered.mapInPandas(judge, f"ip {dict(asks.dtypes)['ip']}, event_id {dict(asks.dtypes)['event_id']}, verdict string")


class _Judge(StatefulProcessor):
    """Asks of one key wait until the watermark has passed them; then they are judged in event order."""

    def __init__(self, window_s: int, most: int, daily: int) -> None:
        self.rule = window_s, most, daily

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_id long, us long", "n int")  # asks not judged yet, each once
        self.judged = handle.getValueState("judged", "recent array<bigint>, day bigint, used bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        for frame in rows:
            micros = frame["ts"].to_numpy("datetime64[us]").astype("int64")
            for event, us in zip(frame["event_id"].tolist(), micros.tolist(), strict=True):
                self.waiting.updateValue((event, us), (1,))
                self.handle.registerTimer(us // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reached = timerValues.getCurrentWatermarkInMs()
        asks = sorted((us, event) for event, us in self.waiting.keys())
        ready = [x for x in asks if x[0] < reached * 1000]
        recent, day, used = self.judged.get() if self.judged.exists() else ([], -1, 0)
        if ready:
            verdicts, recent, day, used = decide([us for us, _ in ready], list(recent), day, used, *self.rule)
            self.judged.update((recent, day, used))
            for us, event in ready:
                self.waiting.removeKey((event, us))
            self.handle.registerTimer((day + 2) * _DAY // 1000)
            yield pd.DataFrame({"ip": key[0], "event_id": [e for _, e in ready], "verdict": verdicts})
        elif not asks and day >= 0 and reached >= (day + 2) * _DAY // 1000:
            self.judged.clear()  # nothing that was accepted up to that day counts any more

    def close(self) -> None:
        pass


def limited_stream(asks: DataFrame, window_s: int = config.ASK_WINDOW_SECONDS, most: int = config.ASK_WINDOW_MAX, daily: int = config.ASK_DAILY_MAX, late: str = "10 minutes") -> DataFrame:
    """As `limited` on a stream (ip, ts timestamp, event_id long), for asks that come in any order and again.

    An ask is judged once the watermark has passed it, after all that came before it in time, so the verdicts are those of
    the batch over the same rows; an ask that is later than `late` is not judged, and one that comes again within that counts
    once. The state of a key goes when a day has passed without asks. Windows of up to a day are remembered.
    """
    asks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(asks.dtypes)
    judged = asks.withWatermark("ts", late).groupBy("ip")
    return judged.transformWithStateInPandas(_Judge(window_s, most, daily), f"ip {kinds['ip']}, event_id bigint, verdict string", "Append", "EventTime")


def daily_quota(asks: DataFrame, daily: int = config.ASK_DAILY_MAX) -> DataFrame:
    """ip, day, asks and how many of them a daily quota alone accepts."""
    return asks.groupBy("ip", F.to_date("ts").alias("day")).agg(F.count("*").alias("asks")).withColumn("accepted", F.least("asks", F.lit(daily)).cast("long"))
