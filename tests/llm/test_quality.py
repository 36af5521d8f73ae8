import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sedge.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def texts():
    random.seed(4)
    out = [None, "", " \n\t ", "a", "a b c d e a b c d e", "x " * 50, "É ß # | <a>\n\nÉ ß # | <a>", "w x y", "1 2 3 # $ % abc"]
    out += [" ".join(random.choice("ab\n") for _ in range(random.randint(0, 40))) for _ in range(60)]
    return [*out, " ".join(f"w{i % 7000}" for i in range(20_000))]


def test_measures(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "a b", 1), (0, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    got = quality.evaluate(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == Counter((i, *brute(t)) for i, t, _ in rows)


def test_policies_and_ablation(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string")
    ledger = quality.evaluate(df).cache()
    base = quality.apply_policy(ledger, quality.BASE).where("kept").count()
    full = quality.apply_policy(ledger, quality.STANDARD)
    assert base >= full.where("kept").count()
    bits = [r.fail_bits for r in ledger.collect()]
    for r in quality.ablation(ledger, quality.STANDARD).collect():
        bit = 1 << quality.RULE_NAMES.index(r.rule)
        assert r.n_rejected == sum(b != 0 for b in bits)
        assert (r.n_fails, r.n_alone) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits))


def test_filter_keeps_columns(spark):
    df = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again", 7), (2, "no", 8)], "doc_id bigint, text string, n_words int")
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, df.first().text, 7)]
    assert quality.quality_filter(df.where(F.lit(False))).count() == 0
