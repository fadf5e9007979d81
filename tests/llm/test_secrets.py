import hashlib
import random
import re

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import secrets


def brute(text):
    """The three rules by the letter: all leftmost non-overlapping matches, then the failing ones are dropped."""
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


piece = st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ": ", '"', "'", "  ", "abcdef", "AKIA", "Z9Z9Z9Z9Z9Z9Z9Z9", "deadbeef", "0123456789abcdef", "\n", "ſ", "é", "K", "x-y.z"])


@settings(max_examples=300, deadline=None)
@given(st.lists(piece, max_size=14))
def test_base_spans_match_the_rules(parts):
    text = "".join(parts)
    assert secrets.base_sha256(text) == hashlib.sha256(brute(text).encode()).hexdigest()


def test_a_failing_match_still_takes_its_text():
    assert secrets.base_spans("secret=token: abcdefgh") == []
    assert secrets.base_spans("token: abcdefgh") == [(0, "assign", 15)]


def test_novelty_reports_random_strings_only():
    names = b"load_settings\ncustomer_account_settings_page\nrender_page"
    c = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(names, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    rule = secrets.Novelty()
    text = "the login for the host is qX7+bT2/Lp9kQz4RmW8vNs3Y and the login page is at customer_account_settings_page"
    spans = secrets.novel_spans(text, [], c, rule)
    assert [text[s:e] for s, _, e in spans] == ["qX7+bT2/Lp9kQz4RmW8vNs3Y"]
    seen = "qX7+bT2/Lp9kQz4RmW8vNs3Y " + text
    assert secrets.novel_spans(seen, [], c, rule) == []


def test_strings_on_both_sides_of_a_word():
    c, rule, key = zstandard.ZstdCompressor(level=9, write_content_size=False), secrets.Novelty(), "qX7+bT2/Lp9kQz4RmW8vNs3YaB5cD6eF"
    for gap in (1, 50, 62, 63, 64):
        after, before = f"the token{'.' * gap}{key} end", f"{key}{'.' * gap}token it is"
        found = [[t[s:e] for s, _, e in secrets.novel_spans(t, [], c, rule)] for t in (after, before)]
        assert found == ([[key], [key]] if gap < 64 else [[], []])


def plain_novel(text, compressor, rule):
    """Every run of candidate signs of a text, held against every sensitive word."""
    out = []
    words = [m.span() for m in secrets._SENSITIVE.finditer(text)]
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        for a, b in words:
            start, end = (max(m.start(), b), m.end()) if m.end() > b else (m.start(), min(m.end(), a))
            near = start < b + rule.reach if m.end() > b else end > a - rule.reach
            if near and end - start >= 16 and secrets._classes(text[start:end]) >= rule.min_classes:
                around = text[max(0, start - rule.context) : start] + text[end : end + rule.context]
                cost = secrets.marginal_bytes(around.encode(), text[start:end].encode(), compressor)
                if cost >= rule.min_bytes and cost >= rule.min_share * (end - start):
                    out.append((start, "novel", end))
    return sorted(set(out))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["token", " ", ". ", "the login for ", "qX7+bT2/Lp9kQz4RmW8v", "Zz9Yy8Xx7Ww6Vv5Uu4Tt", "plain words here ", "secret "]), max_size=12))
def test_novel_spans_match_a_plain_search(parts):
    c, rule = zstandard.ZstdCompressor(level=9, write_content_size=False), secrets.Novelty()
    text = " ".join(parts)
    assert sorted(secrets.novel_spans(text, [], c, rule)) == plain_novel(text, c, rule)


def test_query_over_odd_rows(spark):
    long = "x " * 200000 + "password=0123456789abcdef01234567"
    rows = [(1, "é password = 'hunter22x'"), (2, None), (3, ""), (None, "token=abcdefg"), (5, long), (5, long), (6, "AKIA" + "A" * 15 + " AKIA" + "B" * 16)]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, spans string, start int")
    got = secrets.digest(secrets.find_spans(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows).get(r.doc_id) or ""
        assert r.base_sha256 == hashlib.sha256(brute(text).encode()).hexdigest()
    by = {r.doc_id: r for r in got}
    assert by[1].spans == "assign:2:23" and by[2].spans == "" and by[6].n_access == 1
    assert by[5].n_assign == 1 and by[5].n_hex == 1 and by[5].spans.startswith("assign:400000:")
    assert secrets.find_spans(docs.limit(0)).count() == 0


def test_identifiers_are_counted_over_all_rows(spark):
    docs = spark.createDataFrame([("user_name = loadFile(x)",), ("user_name plain words",), (None,)], "text string")
    assert [tuple(r) for r in secrets.identifiers(docs).collect()] == [("user_name", 2), ("loadFile", 1)]


def test_spans_that_are_taken():
    r = random.Random(1)
    for _ in range(300):
        spans = [(a, a + r.randrange(1, 9)) for a in (r.randrange(60) for _ in range(r.randrange(8)))]
        taken = secrets.Taken(spans)
        for a in range(60):
            b = a + r.randrange(1, 6)
            assert taken.meets(a, b) == any(s < b and a < e for s, e in spans)
        for s, e in [(100, 103), (90, 95), (95, 100)]:
            assert not taken.meets(s, e)
            taken.add(s, e)
            assert taken.meets(s, e)


def test_planted_secrets_are_found_and_names_are_not(spark):
    r = random.Random(2)
    sign = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    fresh = lambda n, of=sign: "".join(r.choice(of) for _ in range(n))
    names = [f"{word()}_{word()}_{word()}_id" for _ in range(120)]
    forms = ["Authorization: Bearer {}", "the credential for this host is {} until May", "login with {} only", 'private_key -> "{}"', "{} is my new pwd", "access-key ({})", "passphrase\n  {}", "secret handed over, then {}"]
    shapes = [lambda: fresh(32), lambda: fresh(20), lambda: fresh(40, sign + "+/") + "=", lambda: fresh(24, "ABCDEF0123456789"), lambda: f"{fresh(12)}-{fresh(12)}", lambda: "sk_live_" + fresh(24)]
    docs, planted = [], set()
    for d in range(600):
        around = [" ".join(r.choice((word(), r.choice(names))) for _ in range(r.randrange(20, 60))) for _ in range(2)]
        value = r.choice(shapes)() if d % 2 else r.choice(names)  # a name of the corpus is nothing new
        text = f"{around[0]} {r.choice(forms).format(value)} {around[1]}"
        docs.append((d, text))
        if d % 2:
            planted.add((d, text.index(value), text.index(value) + len(value)))
    found = {(row.doc_id, s.start, s.end) for row in secrets.find_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect() for s in row.spans}
    hit = {(d, a, b) for d, a, b in planted if any(e == d and s < b and a < f for e, s, f in found)}
    wrong = {d for d, _, _ in found if d % 2 == 0}
    assert len(hit) >= 0.9 * len(planted), (len(hit), len(planted))
    assert len(wrong) <= 0.02 * 300, len(wrong)
