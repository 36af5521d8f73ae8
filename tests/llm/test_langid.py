import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from conftest import DATA
from sedge.llm import langid
from sedge.llm.common import documents
from sedge.llm.queries import op4_language_id


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 400, 5)
        of = np.repeat(np.arange(5), sizes)
        scores = rng.normal(0, 4, (len(of), 3)).astype(np.float32)
        labels = langid.viterbi(scores.__getitem__, of, 3, 3.0)
        for d in range(5):
            s, mine = scores[of == d].astype(float), labels[of == d]
            v = s[0].copy()
            for t in range(1, len(s)):
                v = np.maximum(v, v.max() - 3.0) + s[t]
            got = s[np.arange(len(s)), mine].sum() - 3.0 * (np.diff(mine) != 0).sum()
            assert abs(got - v.max()) < 1e-2


def test_held_out_accuracy(spark):
    got = op4_language_id(spark, DATA).join(documents(spark, DATA), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_spans_and_scripts(spark):
    rows = [("the cat and the dog went home", "en"), ("le chat et le chien sont ici", "fr"), ("кошка и собака дома", "ru")] * 30
    model = langid.train(spark.createDataFrame([*rows, (None, "en"), ("x", None)], "text string, lang string"))
    assert model.languages == ["en", "fr", "ru"]
    mixed = "the dog and the cat went home " * 4 + "le chien et le chat sont ici " * 4 + "собака и кошка дома"
    odd = [(1, mixed), (2, None), (3, "12 !"), (4, ""), (None, "the cat"), (4, "le chat"), (5, "漢字")]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in odd], "doc_id bigint, text string, score double")
    s = langid.spans(df.where("doc_id = 1"), model, 4.0).orderBy("first_word").collect()
    assert [(r.lang, r.n_words) for r in s] == [("en", 28), ("fr", 28), ("ru", 4)]
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect()]
    assert got[1:6] == [(2, "und"), (3, "und"), (4, "und"), (None, "en"), (4, "fr")] and got[6][1] in model.languages


def test_nothing_to_learn(spark):
    none = langid.train(spark.createDataFrame([], "text string, lang string"))
    df = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    assert [tuple(r) for r in langid.predict(df, none).collect()] == [(1, "und", 0.0)]
    assert langid.predict(df.where("false"), none).count() == 0


def test_many_languages():
    """More languages than a byte tells apart."""
    scores = np.full((300, 200), -5.0, dtype=np.float32)
    scores[:, 150] = 0
    assert set(langid.viterbi(scores.__getitem__, np.repeat([0, 1], 150), 200, 3.0)) == {150}


def test_memory_does_not_grow_with_the_square_of_the_languages():
    rng = np.random.default_rng(2)
    names = [f"l{i:03}" for i in range(300)]
    model = langid.Model(names, rng.normal(0, 1, (langid.BUCKETS, 300)).astype(np.float32), np.zeros((len(langid.NAMES), 300), dtype=np.float32))
    text = " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(30_000))
    tracemalloc.start()
    found, score = model.predict([text, "short one", ""], 12.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and found[2] == "und" and 0 < score[0] <= 1
    few = langid.Model(names[:3], model.weights[:, :3], model.uses[:, :3])
    x, labels = few.label([text[:6000], text[6000:6500]], 12.0)
    again = langid.viterbi(lambda w: few.word_scores(x, w), x.text_of_word, 3, 12.0)
    assert (labels == again).all()


def test_ties_go_to_the_first_language():
    model = langid.Model(["aa", "bb"], np.zeros((langid.BUCKETS, 2), dtype=np.float32), np.zeros((len(langid.NAMES), 2), dtype=np.float32))
    assert model.predict(["one two", "x"], 1.0) == (["aa", "aa"], [1.0, 1.0])


def brute_letters(text):
    """(bucket, script) of the letters of each word."""
    letter = lambda c: ("A" <= c) and ord(c) < 0x33480 and c.isalpha()
    low = lambda c: (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if letter(c) else 0
    script = lambda c: [s for a, s in langid.SCRIPTS if a <= ord(c)][-1]
    padded, words = f"\n{text}\n", []
    for i in range(1, len(padded) - 1):
        if letter(padded[i]):
            a, b, c = (low(x) for x in padded[i - 1 : i + 2])
            h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
            h ^= h >> 15
            if not letter(padded[i - 1]):
                words.append([])
            words[-1].append(((h * 0x2C1B3C6D & 0xFFFFFFFF) >> 16, script(padded[i])))
    return words


def test_query_like_brute_force(spark):
    """Training and prediction of the registered query, letter by letter, over the whole table."""
    docs = documents(spark, DATA).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    cut = {r.doc_id: brute_letters(r.text or "") for r in docs}
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for r in docs:
        if not held(r.doc_id) and r.lang is not None and r.text is not None:
            for w in cut[r.doc_id]:
                counts[r.lang].update(b for b, _ in w)
                scripts[r.lang].update(s for _, s in w)
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) for x in langs}
    weight = lambda x, b: math.log((counts[x][b] + 0.5) / (total[x] + 0.5 * langid.BUCKETS))
    uses = lambda x, s: scripts[x][s] >= 0.001 * max(sum(scripts[x].values()), 1)
    got = {r.doc_id: r for r in op4_language_id(spark, DATA).collect()}
    assert set(got) == set(cut)
    for i, words in cut.items():
        assert got[i].held_out == held(i)
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        paths = []  # of each language: score, letters of each language
        for w in words:
            behind = [sum(langid.FAR_BEHIND for _, s in w if not uses(x, s)) for x in langs]
            own = [sum(weight(x, b) for b, _ in w) + (0 if max(behind) < 0 else behind[k]) for k, x in enumerate(langs)]
            if not paths:
                paths = [(own[k], [len(w) * (j == k) for j in range(len(langs))]) for k in range(len(langs))]
                continue
            best = max(range(len(langs)), key=lambda k: paths[k][0])  # noqa: B023
            new = []
            for k in range(len(langs)):
                before = paths[k] if paths[k][0] >= paths[best][0] - 12.0 else (paths[best][0] - 12.0, paths[best][1])
                new.append((before[0] + own[k], [n + len(w) * (j == k) for j, n in enumerate(before[1])]))
            paths = new
        letters = max(paths, key=lambda p: p[0])[1]
        assert got[i].lang_pred == langs[letters.index(max(letters))], i
        assert abs(got[i].score - max(letters) / sum(letters)) < 1e-9, i


def test_a_very_long_text(spark):
    model = langid.train(spark.createDataFrame([("abc abd", "x"), ("xyz xyw", "y")] * 5, "text string, lang string"))
    df = spark.createDataFrame([(1, "abc abd " * 200_000 + "xyz"), (2, "xyz")], "doc_id bigint, text string")
    assert [r.lang_pred for r in langid.predict(df, model).orderBy("doc_id").collect()] == ["x", "y"]
