"""Shapley values of trees against the definition: all subsets of eight features."""

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import functions as F

from sedge.operators import ml, tree_shap
from sedge.operators.tree_shap import Explainer, leaves_of


def grown(rng, depth, n_features):
    """A random tree whose paths meet features again, and whose leaves lie at different depths."""
    nodes = []

    def grow(d):
        i = len(nodes)
        nodes.append([-1, -1, 0, 0.0, rng.normal()])
        if d and rng.random() < 0.85:
            nodes[i][2:4] = int(rng.integers(n_features)), float(rng.integers(-2, 3)) / 2
            nodes[i][0] = grow(d - 1)
            nodes[i][1] = grow(d - 1)
        return i

    grow(depth)
    return [np.array(c) for c in zip(*nodes, strict=True)]


def predicted(tree, x):
    left, right, feature, cut, value = tree
    i = 0
    while left[i] >= 0:
        i = left[i] if x[feature[i]] <= cut[i] else right[i]
    return value[i]


def brute(trees, x, background):
    m = len(x)

    def worth(s):
        mixed = background.copy()
        mixed[:, list(s)] = x[list(s)]
        return np.mean([[predicted(t, r) for t in trees] for r in mixed])

    v = {s: worth(s) for k in range(m + 1) for s in combinations(range(m), k)}
    out = np.zeros(m)
    for s in v:
        for j in set(range(m)) - set(s):
            out[j] += factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (v[tuple(sorted((*s, j)))] - v[s])
    return out, v[()]


def test_against_all_subsets():
    rng = np.random.default_rng(1)
    trees = [grown(rng, 6, 8) for _ in range(4)] + [[np.array([-1]), np.array([-1]), np.array([0]), np.array([0.0]), np.array([2.5])]]
    background = rng.integers(-3, 4, (7, 8)) / 2  # values that equal thresholds, and equal rows
    background[5] = background[4]
    rows = np.vstack([rng.integers(-3, 4, (5, 8)) / 2, background[:1]])
    explainer = Explainer([leaves_of(*t) for t in trees], background)
    got = explainer.explain(rows)
    for x, mine in zip(rows, got, strict=True):
        want, base = brute(trees, x, background)
        assert np.allclose(mine, want, atol=1e-12) and np.isclose(base, explainer.base)
        assert np.isclose(mine.sum() + base, np.mean([predicted(t, x) for t in trees]), atol=1e-12)


def test_forest_adds_up_and_nulls(spark):
    rng = np.random.default_rng(2)
    data = [(i, *map(float, rng.normal(size=3).round(2)), int(i % 3 == 0)) for i in range(120)]
    data += [(500, None, 0.5, None, 1), (501, 0.1, None, 0.0, 0)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, y int")
    model = ml.fit_forest(df, ["a", "b", "c"], "y", trees=7, depth=5)
    found = tree_shap.shapley_values(model, df, df.where("id < 60"), ["a", "b", "c"], "id", most_background=50)
    sums = found.groupBy("id").agg((F.sum("shap") + F.max("base_value")).alias("s"), F.count("*").alias("n"))
    gap = sums.join(ml.predictions(model, df, ["a", "b", "c"], "id", "y"), "id").agg(
        F.max(F.abs(F.col("s") - F.col("y_pred_proba_class_1"))), F.min("n"), F.count("*")
    )
    worst, least, n = gap.first()
    assert worst < 1e-9 and least == 3 and n == 122
    assert tree_shap.shapley_values(model, df.limit(0), df, ["a", "b", "c"], "id").count() == 0
