"""Exact interventional Shapley values of forests, from the trees themselves.

A leaf is reached if every feature on its path lies in an interval. For a row and a background row each such feature is
met by both, by one of them or by neither; if neither meets one, the leaf counts for no mixture of the two. Else, with u
features that only the row meets and v that only the background row meets, the leaf's value is a game whose Shapley
values are known: value * (u - 1)! v! / (u + v)! for each of the u, and less value * u! (v - 1)! / (u + v)! for each of the v.

So rows matter to a leaf only by which features they meet, a few bits. Background rows are counted by these bits once, and
the rows of a batch are looked up by theirs: a leaf costs a comparison for each row and feature on its path, and a small
table of patterns by patterns, not a walk for each row and background row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.operators.sampling import order_of
from sedge.sources.code import ship
from sedge.sources.scratch import scratch_path

#: Rows that are explained together.
BATCH = 4096


@dataclass
class Leaf:
    """value, and for each feature on the path the interval (low, high] that leads here."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def met(self, x: np.ndarray) -> np.ndarray:
        """rows x features: whether each lies in its interval."""
        own = x[:, self.features]
        return (own > self.low) & (own <= self.high)


def leaves_of(left: np.ndarray, right: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> list[Leaf]:
    """The leaves of one tree, given by arrays over its nodes; the root is node 0, and leaves have left < 0. Values of at
    most the threshold go left."""
    out, open_ = [], [(0, {})]
    while open_:
        node, bounds = open_.pop()
        if left[node] < 0:
            names = sorted(bounds)
            low, high = (np.array([bounds[f][i] for f in names], dtype=np.float64) for i in (0, 1))
            out.append(Leaf(float(value[node]), np.array(names, dtype=np.int64), low, high))
            continue
        f, t = int(feature[node]), float(threshold[node])
        low, high = bounds.get(f, (-np.inf, np.inf))
        open_.append((int(left[node]), bounds | {f: (low, min(high, t))}))
        open_.append((int(right[node]), bounds | {f: (max(low, t), high)}))
    return out


def _patterns(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a boolean matrix, and which of them each row is."""
    code = met @ (1 << np.arange(met.shape[1], dtype=np.int64))
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return met[first].astype(np.float64), which


def _bits(codes: np.ndarray, n: int) -> np.ndarray:
    """The patterns that numbers stand for, one bit for each of n features."""
    return (codes[:, None].astype(np.int64) >> np.arange(n) & 1).astype(np.float64)


def _small(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as their largest takes."""
    return numbers.astype(np.min_scalar_type(int(numbers.max())))


class Explainer:
    """leaves: each leaf that has a value, with the patterns of its background rows as numbers, and how many have each. A
    pattern is a few bytes and not a row of floats, as each worker holds those of all leaves: the most, of 100 trees of
    depth 10 and 500 rows, are 51 million patterns, which a batch unpacks leaf by leaf."""

    def __init__(self, trees: list[list[Leaf]], background: np.ndarray):
        if not len(background):
            raise ValueError("no background rows")
        self.n_features, self.n_background, self.share = background.shape[1], len(background), 1 / len(trees)
        self.base, self.leaves, deepest = 0.0, [], 1
        for leaf in (leaf for tree in trees for leaf in tree):
            met = leaf.met(background)
            self.base += leaf.value * self.share * met.all(axis=1).mean()
            deepest = max(deepest, len(leaf.features) + 1)
            if len(leaf.features) and leaf.value:
                codes, counts = np.unique(met @ (1 << np.arange(met.shape[1], dtype=np.int64)), return_counts=True)
                self.leaves.append((leaf, _small(codes), _small(counts)))
        u, v = np.meshgrid(np.arange(deepest), np.arange(deepest), indexing="ij")
        ln = np.vectorize(lambda n: lgamma(n + 1))
        with np.errstate(invalid="ignore"):
            self.own = np.where(u > 0, np.exp(ln(np.maximum(u - 1, 0)) + ln(v) - ln(u + v)), 0)
            self.other = np.where(v > 0, np.exp(ln(u) + ln(np.maximum(v - 1, 0)) - ln(u + v)), 0)

    def explain(self, x: np.ndarray) -> np.ndarray:
        """rows x features. A row's values add up to its prediction less `base`."""
        out = np.zeros((len(x), self.n_features))
        for leaf, codes, counts in self.leaves:
            b, weight = _bits(codes, len(leaf.features)), counts / self.n_background
            a, which = _patterns(leaf.met(x))
            only_a, only_b = (a @ (1 - b).T).astype(np.int64), ((1 - a) @ b.T).astype(np.int64)
            reached = ((1 - a) @ (1 - b).T == 0) * weight * (leaf.value * self.share)
            values = a * ((reached * self.own[only_a, only_b]) @ (1 - b)) - (1 - a) * ((reached * self.other[only_a, only_b]) @ b)
            out[:, leaf.features] += values[which]
        return out


def forest_leaves(spark: SparkSession, model) -> list[list[Leaf]]:
    """The trees of a fitted forest for two classes; a leaf's value is its share of class 1. The model is written to the
    shared folder, as its nodes can be read from there as a table; there are as many as the model has nodes."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    trees: dict[int, list] = {}
    for r in nodes:
        if r.split.numCategories > 0:
            raise ValueError("splits by category are not explained")
        trees.setdefault(r.treeID, []).append(r)
    out = []
    for own in trees.values():
        place = {r.id: i for i, r in enumerate(own)}
        left, right = (np.array([place.get(c, -1) for c in x]) for x in ([r.leftChild for r in own], [r.rightChild for r in own]))
        cut = np.array([r.split.leftCategoriesOrThreshold[0] if r.leftChild >= 0 else np.nan for r in own])
        share = np.array([r.impurityStats[1] / sum(r.impurityStats) for r in own])
        out.append(leaves_of(left, right, np.array([r.split.featureIndex for r in own]), cut, share))
    return out


def shapley_values(
    model, rows: DataFrame, background: DataFrame, columns: list[str], key: str, most_background: int = 500, seed: int = 42
) -> DataFrame:
    """key, feature, shap and base_value for every row and feature: exact interventional values of the probability of class 1
    against at most `most_background` background rows, the first in hash order. Null features count as 0."""
    spark = rows.sparkSession
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    held = background.orderBy(order_of(key, seed), key).limit(most_background).select(values).collect()
    explainer = Explainer(forest_leaves(spark, model), np.array([list(r) for r in held], dtype=np.float64).reshape(-1, len(columns)))
    sent = spark.sparkContext.broadcast(explainer)  # as large as the model, and its leaves' patterns of the background
    names = pa.array(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = sent.value, len(columns)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]])
                each = np.repeat(np.arange(part.num_rows), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        names.take(pa.array(np.tile(np.arange(n), part.num_rows))),
                        pa.array(own.explain(x).ravel()),
                        pa.array(np.full(len(each), own.base)),
                    ],
                    names=[key, "feature", "shap", "base_value"],
                )

    ship(spark)
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *values).mapInArrow(run, f"{key} {kind}, feature string, shap double, base_value double")
