"""Source divergence (operator 13) against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedge.llm import terms
from sedge.llm.divergence import divergence, share

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string"


def brute(rows, least, smooth=5, top=50):
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOW))
        held[lang].update(set(found))
        counts[lang, source].update(found)
        groups.add((lang, source))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        peers = sorted((s for x, s in groups if x == lang), key=str.encode)
        whole = sum((counts[lang, s] for s in peers), Counter())

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + smooth * len(kept)
            return {t: 1 + 10**9 * (c[t] + smooth) // total for t in kept}

        p, q = share(counts[lang, source]), share(whole)
        pairs = [(s, sum(abs(p[t] - x) for t, x in share(counts[lang, s]).items())) for s in peers if s != source]
        told = [(t, p[t] - q[t]) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", told, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, t, v, k) for k, (t, v) in enumerate(items[:most], 1)}
    return out


def same(spark, rows, least, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"doc_id": "n"}).selectExpr("*", "1 AS high", "2 AS term")
    got = [tuple(r) for r in divergence(df, least, **more).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, least, **more)


def test_terms_of_all_lengths(spark):
    rng = np.random.default_rng(3)
    words = [
        "a", "B", "naïve", "éé", "eightchr", "NineChars", "sixteencharsword", "seventeencharswor", "x" * 31, "x" * 32, "x" * 33,
        "日本語の文章" * 40, "y" * 5000, "Ä", "ÿ\U0001f600", "pp", "p",
    ]
    rows = []
    for i in range(400):
        text = rng.choice([" ", "0", "\n", "[", "\x7f"]).join(rng.choice(words, rng.integers(0, 12)))
        rows.append((i, text, ["en", "fr", None][rng.integers(3)], ["s", "t", "u", None, ""][rng.integers(5)]))
    rows += [(1, None, "en", "none"), (1, None, "en", "none"), (None, "a a", "alone", "one"), (3, "", None, None)]
    rows += [(5, "b " * 300_000 + "last", "en", "long")]
    same(spark, rows, 30)
    same(spark, rows, 1, smooth=2, top=3)


def test_more_sources_than_a_block(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choice(words, 6)), "en", f"s{i % 300}") for i in range(600)]
    same(spark, rows, 2)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "one", "en", "s"), (2, None, "en", "t")]])
def test_next_to_nothing(spark, rows):
    same(spark, rows, 2)


def test_runs_of_parts_are_merged():
    texts = pa.array(["one two one", "two", "one longerthaneightb"])
    a, b = (list(terms.count_terms(texts, np.array([0, 0, g]))) for g in (0, 1))
    (whole, *rest) = terms.merged(a + b)
    assert not rest and int(whole.n.sum()) == 12
    assert len({(int(x), int(y), int(g)) for x, y, g in zip(whole.high, whole.low, whole.group, strict=True)}) == len(whole.n)


def test_shares_are_exact_at_any_size(spark):
    cases = [(n, t, k) for n in (0, 1, 7 * 10**9, 4 * 10**18 + 1) for t in (n, n + 3, 4 * 10**18 + 7) for k in (1, 10**12)] + [(0, 0, 0)]
    df = spark.createDataFrame([c for c in cases if c[0] <= c[1]], "n bigint, total bigint, kept bigint")
    for r in df.select("*", share(F.col("n"), F.col("total"), F.col("kept"), 5).alias("p")).collect():
        assert r.p == (1 + 10**9 * (r.n + 5) // (r.total + 5 * r.kept) if r.kept else 0)
