"""The quality classifier (operator 11): the network against loops and numeric gradients, and its accuracy held out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.llm import convolution as net_of
from sedge.llm import quality_classifier as qc


def brute_score(net, text):
    """Every window of every chunk, one by one."""
    size, starts = len(text), [0]
    if size > 512:
        starts = [*range(0, size - 512, 448), size - 512]
    data = list(text) + [256] * (512 - size)
    tops = []
    for a in starts:
        windows = np.stack([net.bytes_[data[a + p : a + p + 8]].ravel() for p in range(505)])
        tops.append(np.maximum((windows @ net.filters).max(axis=0) - net.bounds, 0))
    pooled = np.concatenate([np.max(tops, axis=0), np.mean(tops, axis=0)])
    logit = np.tanh(pooled @ net.inner + net.inner_bias) @ net.outer + net.bias[0]
    return 1 / (1 + np.exp(-logit))


def test_whole_texts_against_loops():
    net = net_of.Network.fresh(np.random.default_rng(4))
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 511, 512, 513, 960, 961, 5000)]
    assert np.allclose(net.score(texts), [brute_score(net, t) for t in texts], atol=1e-4)
    end = texts[-1][:-8] + b"\xff" * 8
    assert net.score([end]) != net.score([texts[-1]])  # the last bytes count


def test_gradients():
    rng = np.random.default_rng(6)
    net = net_of.Network.fresh(rng)
    texts = [net_of.chunks(bytes(rng.integers(97, 102, n, dtype=np.uint8))) for n in (30, 700, 2000)]
    symbols, first, label = np.concatenate(texts), np.cumsum([0, *map(len, texts)])[:-1], np.array([0, 1, 1], dtype=np.float32)

    def loss():
        logit = net.combine(net.answers(symbols), first)[0].astype(np.float64)
        return np.mean(np.log1p(np.exp(-np.where(label > 0, logit, -logit))))

    for w, g in zip(net.weights(), net.gradients(symbols, first, label), strict=True):
        for i in np.argsort(-np.abs(g).ravel())[:3]:
            place, h = np.unravel_index(i, w.shape), 2e-3
            was = w[place]
            w[place] = was + h
            up = loss()
            w[place] = was - h
            down = loss()
            w[place] = was
            assert (up - down) / (2 * h) == pytest.approx(g[place], rel=0.1, abs=2e-4)


def junk(rng, i):
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(3, 300))]
    return "!! ".join(words) if i % 3 == 0 else " ".join(words)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, junk(rng, i), int(i % 3 != 0)) for i in range(300)]
    labels = spark.createDataFrame(
        [(i, y) for i, _, y in rows] + [(None, 1), (5, None), (7, 1), (7, 0), (12345, 1)], "doc_id bigint, label int"
    )
    more = [(1, None), (1, None), (None, "x"), (900, ""), (901, "a!! " * 200_000), (7, "other")]
    docs = spark.createDataFrame([(i, t, "n", 0.5) for i, t in [(i, t) for i, t, _ in rows] + more], "doc_id bigint, text string, label string, score double")
    net = qc.train(docs, labels.where(~qc.held_out(F.col("doc_id"))), steps=150)
    scores = qc.score(docs, net)
    assert scores.count() == len(rows) + len(more)
    got = scores.where(qc.held_out(F.col("doc_id"))).join(labels.where("doc_id < 300 and doc_id <> 7").dropna(), "doc_id")
    right = [(r.score >= 0.3) == r.label for r in got.collect()]
    assert len(right) > 40 and np.mean(right) > 0.95
    empty = {r.score for r in scores.collect() if r.doc_id in (900,)} | {min(r.score for r in scores.collect() if r.doc_id == 1)}
    assert all(0 <= x <= 1 for x in empty)
    again = qc.train(docs, labels.where(~qc.held_out(F.col("doc_id"))), steps=150)
    assert all(np.array_equal(a, b) for a, b in zip(net.weights(), again.weights(), strict=True))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert qc.train(docs, none) is None
    assert [r.score for r in qc.score(docs, None).collect()] == [0.5, 0.5]
    assert qc.score(docs.limit(0), net_of.Network.fresh(np.random.default_rng(1))).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, label int")
    assert all(r.score > 0.5 for r in qc.score(docs, qc.train(docs, one, steps=20)).collect())
