"""The registered queries of this subpackage, op1 to op13, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, clusters, codes, decontamination, media, minhash, mixing, piecewise, quality, repeats, secrets, sharding, toxicity
from tidemark.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_manifest(table(spark, sf_dir, "documents"), n_shards=8)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.drop_repeats(table(spark, sf_dir, "documents")))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.masks_as_text(chat.neighbours(table(spark, sf_dir, "conversations")))


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.media_table(table(spark, sf_dir, "documents")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.train(docs, toxicity.train_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, weights, threshold=0.3)
    return scored.select("doc_id", (toxicity.fold() == 2).alias("held_out"), "score", "predicted")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = piecewise.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return piecewise.digest(piecewise.decoded(tokens.drop("text")))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_decontamination": op2_decontamination,
        "op3_quality": op3_quality,
        "op4_repeats": op4_repeats,
        "op5_chat": op5_chat,
        "op6_webp": op6_webp,
        "op7_secrets": op7_secrets,
        "op8_mixing": op8_mixing,
        "op9_minhash": op9_minhash,
        "op10_toxicity": op10_toxicity,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_clusters": op12_clusters,
        "op13_codes": op13_codes,
    }


OP1_SQL = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
sized AS (
  SELECT doc_id, (len(b) + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM raw, tab),
steps AS (
  SELECT DISTINCT coalesce(doc_id, 0) AS id, n, coalesce(doc_id, 0)::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM documents, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT id, n, k2, j, floor((j + 1) * (2147483648::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM steps WHERE j < n)),
jumps AS (SELECT id, n, max(b) AS shard FROM steps GROUP BY id, n),
placed AS (
  SELECT s.*, a.shard::INT AS shard, g.shard::INT AS grown_shard,
    ((coalesce(doc_id, 0) % 2147483647) * 48271 + (text_crc32 % 2147483647) * 69621) % 2147483647 AS h
  FROM sized s JOIN jumps a ON a.id = coalesce(doc_id, 0) AND a.n = 8 JOIN jumps g ON g.id = coalesce(doc_id, 0) AND g.n = 9)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard FROM placed
"""


#: Turns in order, the first place where the sides differ, and what stands before and after it.
OP5_SQL = """
WITH r AS (
  SELECT conv_id >> 1 AS pair_id, (conv_id & 1)::INT AS side, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, count(*) AS n
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role, text) - 1 AS sub, greatest(0, turn // 4096) AS range,
    '<|im_start|>' || replace(role, '<|im_', '<\\|im_') || chr(10) AS head, replace(text, '<|im_', '<\\|im_') || '<|im_end|>' || chr(10) AS body FROM r),
odd AS (
  SELECT pair_id, min({'turn': turn, 'sub': sub}) AS cut FROM (
    SELECT pair_id, turn, sub FROM o GROUP BY pair_id, turn, sub, role, text HAVING count(*) < 2) GROUP BY pair_id),
parts AS (
  SELECT pair_id, range, floor(coalesce(sum(count(*)) OVER (PARTITION BY pair_id ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 8192)::BIGINT AS part FROM o GROUP BY pair_id, range),
p AS (
  SELECT o.*, part, sub // 4096 AS part_of_turn, cut IS NULL OR {'turn': turn, 'sub': sub} < cut AS shared FROM o JOIN parts USING (pair_id, range) LEFT JOIN odd USING (pair_id)),
m AS (
  SELECT *, (sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part, part_of_turn, side, shared ORDER BY turn, sub))::BIGINT AS past FROM p)
SELECT pair_id, part, part_of_turn, sum(n - 1)::BIGINT AS repeated_rows,
  coalesce(string_agg(head || body, '' ORDER BY turn, sub) FILTER (shared AND side = 0), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY turn, sub) FILTER (NOT shared AND side = 0), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY turn, sub) FILTER (NOT shared AND side = 1), '') AS rejected,
  (count(*) FILTER (shared AND side = 0))::INT AS prompt_turns, (count(*) FILTER (NOT shared AND side = 0))::INT AS chosen_turns, (count(*) FILTER (NOT shared AND side = 1))::INT AS rejected_turns,
  coalesce(string_agg((past - length(body)) || ':' || past, ',' ORDER BY turn, sub) FILTER (NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((past - length(body)) || ':' || past, ',' ORDER BY turn, sub) FILTER (NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY 1, 2, 3
"""

#: Word shingles, all pairs that share one, and the components of the links by repeated minima.
OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
share AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM share JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT sym.b, r FROM reach JOIN sym ON sym.a = d WHERE r < sym.b)
SELECT n.doc_id, n AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept FROM n JOIN reach ON d = n.doc_id GROUP BY n.doc_id, n
"""


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds one after another; products of whole numbers in double are exact."""
    near = "SELECT rid, any_value(p.v) AS v, arg_min(c.k, (list_inner_product(c.v, c.v) - 2 * list_inner_product(p.v, c.v), c.k)) AS k FROM pts p, c{i} c GROUP BY rid"
    step = """a{i} AS MATERIALIZED ({near}),
m{i} AS (SELECT k, list(x ORDER BY pos) AS v FROM (SELECT k, pos, floor(sum(x) / count(*)) AS x FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY k, pos) GROUP BY k),
c{j} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k)),"""
    steps = "\n".join(step.format(i=i, j=i + 1, near=near.format(i=i)) for i in range(rounds))
    return f"""
WITH pts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INT AS k, v FROM pts QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), v) <= {k}),
{steps}
z AS MATERIALIZED ({near.format(i=rounds)}),
d AS (SELECT vec_id, z.k AS cluster, (list_inner_product(z.v, z.v) - 2 * list_inner_product(z.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS distance,
  sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM z JOIN pts USING (rid) JOIN c{rounds} c ON c.k = z.k)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM d
"""


def _op13_sql(entries: int = 256, rounds: int = 4) -> str:
    near = "SELECT rid, p, any_value(x.v) AS v, arg_min(c.k, (list_inner_product(c.v, c.v) - 2 * list_inner_product(x.v, c.v), c.k)) AS k FROM x JOIN c{i} c USING (p) GROUP BY rid, p"
    step = """a{i} AS MATERIALIZED ({near}),
m{i} AS (SELECT p, k, list(x ORDER BY pos) AS v FROM (SELECT p, k, pos, floor(sum(x) / count(*)) AS x FROM (SELECT p, k, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY p, k, pos) GROUP BY p, k),
c{j} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (p, k)),"""
    steps = "\n".join(step.format(i=i, j=i + 1, near=near.format(i=i)) for i in range(rounds))
    return f"""
WITH pts AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM pts, (SELECT unnest(range(4)) AS p)),
c0 AS MATERIALIZED (SELECT p, (rid - 1)::INT AS k, v FROM x WHERE rid <= {entries}),
{steps}
z AS MATERIALIZED ({near.format(i=rounds)}),
d AS (SELECT rid, string_agg(printf('%02x', z.k), '' ORDER BY p) AS code,
  sum(list_inner_product(z.v, z.v) - 2 * list_inner_product(z.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS error FROM z JOIN c{rounds} c USING (p, k) GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM d JOIN pts USING (rid), h
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op5_chat": OP5_SQL, "op9_minhash": OP9_SQL, "op12_clusters": _op12_sql(), "op13_codes": _op13_sql()}
