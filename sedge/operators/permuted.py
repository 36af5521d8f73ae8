"""How a fitted forest calls rows of which one column at a time is replaced.

A row and its copy with another value of a feature part at the first node that asks for this feature and sends the two to
different sides. So a tree is walked down once for a row, and from there only for copies that have parted, not once for
each feature. Shares of classes are added up tree by tree, as MLlib does: calls are the same as those of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.sources.code import ship
from sedge.sources.scratch import scratch_path

#: Rows that walk together.
BATCH = 4096


@dataclass
class Forest:
    """Arrays over the nodes of all trees. feature is -1 at leaves; below has the left and the right child of each node;
    shares those of the classes; roots are in the order of the trees."""

    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    shares: np.ndarray
    roots: np.ndarray

    def _leaves(self, root: int, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """rows x (features + 1): the leaf of each row with that feature as in z, and in the last column with none."""
        n, k = x.shape
        out, parted = np.empty((n, k + 1), dtype=np.int32), np.zeros((n, k), dtype=bool)
        row, node = np.arange(n), np.full(n, root)  # as they are
        row_, own, node_ = (np.empty(0, dtype=np.int64) for _ in range(3))  # parted, by feature `own`
        last = np.empty(n, dtype=np.int32)
        ends = []
        while len(row) or len(row_):
            f = self.feature[node]
            if (end := f < 0).any():
                last[row[end]] = node[end]
                row, node, f = row[~end], node[~end], f[~end]
            f_ = self.feature[node_]
            if (end := f_ < 0).any():
                ends.append((row_[end], own[end], node_[end]))
                row_, own, node_, f_ = row_[~end], own[~end], node_[~end], f_[~end]
            right_ = ~(np.where(f_ == own, z[row_, f_], x[row_, f_]) <= self.threshold[node_])
            node_ = self.below[node_, right_.view(np.int8)]
            cut = self.threshold[node]
            right, other = ~(x[row, f] <= cut), ~(z[row, f] <= cut)
            new = np.flatnonzero(right != other)
            new = new[~parted[row[new], f[new]]]
            parted[row[new], f[new]] = True
            row_, own = np.concatenate([row_, row[new]]), np.concatenate([own, f[new]])
            node_ = np.concatenate([node_, self.below[node[new], other[new].view(np.int8)]])
            node = self.below[node, right.view(np.int8)]
        out[:] = last[:, None]
        for at, f, leaf in ends:
            out[at, f] = leaf
        return out

    def calls(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """rows x (features + 1): the class of each row with that feature as in z, and in the last column with none."""
        votes = np.zeros((self.shares.shape[1], len(x), x.shape[1] + 1))
        for root in self.roots:
            leaf = self._leaves(root, x, z)
            for k, share in enumerate(self.shares.T):
                votes[k] += share[leaf]
        return votes.argmax(axis=0)


def forest_of(spark: SparkSession, model) -> Forest:
    """The model is written to the shared folder, as its nodes can be read from there as a table; there are as many as the
    model has nodes, of some 60 bytes each."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    node, cut = F.col("nodeData"), F.col("nodeData.split.leftCategoriesOrThreshold")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), (node["split"]["numCategories"] > 0).alias("by_category"), F.get(cut, F.lit(0)).alias("cut"),
        *(F.get(node["impurityStats"], F.lit(k)).alias(f"n{k}") for k in range(model.numClasses)),
    ).toArrow()
    c = {n: nodes[n].to_numpy() for n in nodes.column_names}
    if c["by_category"].any():
        raise ValueError("splits by category are not explained")
    order = np.lexsort((c["id"], c["treeID"]))
    c = {n: v[order] for n, v in c.items()}
    _, roots, which = np.unique(c["treeID"], return_index=True, return_inverse=True)
    if (c["id"] != np.arange(len(which)) - roots[which]).any():
        raise ValueError("nodes are not numbered from 0 in each tree")
    leaf = c["left"] < 0
    stats = np.column_stack([c[f"n{k}"] for k in range(model.numClasses)])
    total = np.add.accumulate(stats, axis=1)[:, -1:]
    return Forest(
        np.where(leaf, -1, c["feature"]).astype(np.int64), c["cut"].astype(np.float64),
        np.column_stack([np.where(leaf, 0, c[n] + roots[which]) for n in ("left", "right")]),
        np.divide(stats, total, out=np.zeros_like(stats), where=total != 0), roots,
    )


def permuted_calls(model, met: DataFrame, columns: list[str]) -> DataFrame:
    """__f (place of a feature in columns, -1: none), __y and how many of the rows with this label (n) are called so (right)
    when the feature's value is that of __new; a few rows for each batch. met: __y, columns and __new."""
    spark = met.sparkSession
    sent = spark.sparkContext.broadcast(forest_of(spark, model))  # as large as the model
    k = len(columns)
    number = lambda c: F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = met.select(
        F.col("__y").cast("long"), *(number(F.col(c)).alias(f"x{i}") for i, c in enumerate(columns)),
        *(number(F.col("__new")[c]).alias(f"z{i}") for i, c in enumerate(columns)),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                y, *values = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, BATCH).columns)
                right = sent.value.calls(np.column_stack(values[:k]), np.column_stack(values[k:])) == y[:, None]
                for label in np.unique(y):
                    own = right[y == label]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.r_[np.arange(k), -1]), pa.array(np.full(k + 1, label)),
                            pa.array(np.full(k + 1, len(own))), pa.array(own.sum(axis=0)),
                        ],
                        names=["__f", "__y", "n", "right"],
                    )

    ship(spark)
    return rows.where("__y IS NOT NULL").mapInArrow(run, "__f long, __y long, n long, right long")
