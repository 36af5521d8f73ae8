"""Ward's linkage against merging the nearest two clusters one after the other."""

import random
from itertools import combinations

import numpy as np
import pytest

from sedge.operators.linkage import flat_clusters, ward


def plain_ward(names, d):
    """(set, set, height) of each merge, heights from the centres' rule over the parts' squared distances."""
    clusters = [frozenset([n]) for n in names]
    d2 = {frozenset([frozenset([a]), frozenset([b])]): x * x for (a, b), x in d.items()}
    while len(clusters) > 1:
        x, y = min(combinations(clusters, 2), key=lambda p: d2[frozenset(p)])
        between, new = d2[frozenset([x, y])], x | y
        yield x, y, between**0.5
        clusters = [c for c in clusters if c not in (x, y)]
        for c in clusters:
            parts = sum((len(p) + len(c)) * d2[frozenset([p, c])] for p in (x, y))
            d2[frozenset([new, c])] = (parts - len(c) * between) / (len(new) + len(c))
        clusters.append(new)


@pytest.mark.parametrize("n, points", [(2, False), (13, True), (24, False)])
def test_ward(spark, n, points):
    random.seed(n)
    names = [f"f{i}" for i in range(n)]
    at = np.random.default_rng(n).normal(size=(n, 3))
    d = {(a, b): float(np.linalg.norm(at[int(a[1:])] - at[int(b[1:])])) if points else random.random() for a, b in combinations(names, 2)}
    merges = list(plain_ward(names, d))
    heights = sorted(h for *_, h in merges)
    thresholds = [0.0, *((a + b) / 2 for a, b in zip(heights, heights[1:], strict=False)), heights[-1] + 1]
    pairs = spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "f1 string, f2 string, distance double")
    found = flat_clusters(ward(pairs), thresholds).toPandas()
    for t, part in found.groupby("threshold"):
        groups = {frozenset([f]) for f in names}
        for x, y, h in merges:
            if h <= t:
                groups = {g for g in groups if not g <= (x | y)} | {x | y}
        assert {frozenset(g) for g in part.groupby("cluster").feature.apply(list)} == groups
    assert len(found) == n * len(thresholds)


def test_ward_of_equal_distances_and_of_none(spark):
    pairs = spark.createDataFrame([(a, b, 0.0) for a, b in combinations("abcdef", 2)], "f1 string, f2 string, distance double")
    assert {r.cluster for r in flat_clusters(ward(pairs), [0.0]).collect()} == {1}
    assert ward(pairs.limit(0)).count() == 0
