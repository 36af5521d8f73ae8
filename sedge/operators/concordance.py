"""Kendall's tau-b of every two features without comparing all pairs of rows.

The values of each feature are ranked in ranges (ranks.py) and dealt into blocks of about as many rows; a value of more rows
than that has a block of its own. Of two rows, the signs of their differences in f1 and f2 are counted once: if they share
a block of f1, in that block's task, by merging; if they share one of f2 alone, in that block's task, with blocks in the
place of values of f1; if none, from the counts of pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators.ranks import running
from sedge.sources.code import ship
from sedge.sources.scratch import written


#: Numbers of blocks that a task counts together.
MOST_BLOCKS = 8_000_000


def ties(counts: np.ndarray) -> float:
    c = counts.astype(np.float64)
    return float((c * (c - 1) / 2).sum())


def sign_sum(x: np.ndarray, y: np.ndarray) -> float:
    """The sum of sign(dx) * sign(dy) over all pairs. In the order of x, runs of y are merged that double in length; each y
    of a right run meets the larger ones of the left."""
    n = len(x)
    x, y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    wide = int(y.max(initial=0)) + 1
    tied = [ties(np.unique(k, return_counts=True)[1]) for k in (x, y, x * wide + y)]
    y = y[np.lexsort((y, x))]  # rows of one x are in the order of y, so no two of them are inverted
    place, width, inverted = np.arange(n), 1, 0
    while width < n:
        run, left = place // (2 * width), place // width % 2 == 0
        key = run * wide + y
        held, asked = np.sort(key[left]), key[~left]
        inverted += int((np.searchsorted(held, (run[~left] + 1) * wide) - np.searchsorted(held, asked, side="right")).sum())
        y, width = np.sort(key) % wide, 2 * width
    return n * (n - 1) / 2 - tied[0] - tied[1] + tied[2] - 2.0 * inverted


def _in_blocks(part: pd.DataFrame) -> pd.DataFrame:
    """For one block of one feature: its sums with every later feature, and those of its values with earlier ones' blocks."""
    own = int(part["feature"].iloc[0])
    ranks, blocks = np.stack(part["ranks"].to_list()), np.stack(part["blocks"].to_list())
    rows = []
    for other in range(ranks.shape[1]):
        known = ranks[:, other] >= 0
        mine = ranks[known, own]
        tied = ties(np.unique(mine, return_counts=True)[1])
        if other > own and len(mine):
            rows.append((own, other, 0.0, sign_sum(mine, ranks[known, other]), tied, 0.0))
        elif other < own and len(mine):
            rows.append((other, own, 0.0, sign_sum(blocks[known, other], mine), 0.0, tied))
    return pd.DataFrame(rows, columns=["i", "j", "n", "s", "tied_1", "tied_2"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a task are in each pair of blocks of every two features, counted for MOST_BLOCKS numbers at a time."""

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        blocks = np.concatenate(held)
        wide = int(blocks.max(initial=0)) + 1
        for i in range(blocks.shape[1]):
            for j in range(i + 1, blocks.shape[1]):
                known = (blocks[:, i] >= 0) & (blocks[:, j] >= 0)
                code, n = np.unique(blocks[known, i] * wide + blocks[known, j], return_counts=True)
                pair = [pa.array(np.full(len(code), k, dtype=np.int32)) for k in (i, j)]
                own = [pa.array(b.astype(np.int32)) for b in (code // wide, code % wide)]
                yield pa.RecordBatch.from_arrays([*pair, *own, pa.array(n.astype(np.float64))], names=["i", "j", "b1", "b2", "n"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1))
            size += held[-1].size
        if size >= MOST_BLOCKS:
            yield from counted(held)
            held, size = [], 0
    if held:
        yield from counted(held)


def _between_blocks(cells: pd.DataFrame) -> pd.DataFrame:
    """For two features: the sum over rows that share no block, and ties within the blocks of one value (odd numbers)."""
    first, a = np.unique(cells["b1"], return_inverse=True)
    second, b = np.unique(cells["b2"], return_inverse=True)
    held = np.zeros((len(first) + 1, len(second) + 1))
    held[a + 1, b + 1] = cells["n"]
    before = held.cumsum(axis=0)[:-1]  # of smaller blocks of f1
    below = before.cumsum(axis=1)
    s = (held[1:, 1:] * (below[:, :-1] - (below[:, -1:] - below[:, 1:]))).sum()
    rows, columns = held.sum(axis=1)[1:], held.sum(axis=0)[1:]
    values = (float(held.sum()), s, ties(rows[first % 2 == 1]), ties(columns[second % 2 == 1]))
    return pd.DataFrame([(cells["i"].iloc[0], cells["j"].iloc[0], *values)], columns=["i", "j", "n", "s", "tied_1", "tied_2"])


def kendall(rows: DataFrame, names: list[str], key: str = "id", blocks: int = 512) -> DataFrame:
    """f1 < f2 and tau of every two features of long rows (key, feature, value), one value for each key and feature, over the
    keys that have both; null if either has one value only there. A task holds the rows of one block, a 512th of all (two at most) by
    default, or the counts of two features' pairs of blocks, of which there are (2 * blocks) ** 2 at most."""
    ship(rows.sparkSession)
    names = sorted(names)
    known = rows.select(F.col(key).alias("key"), "feature", F.col("value").cast("double").alias("value")).where("value IS NOT NULL")
    counts = written(known.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = counts.groupBy("feature").agg(F.sum("n").alias("size"))
    n, size = F.col("n"), F.col("size")
    block = 2 * F.floor(F.col("before_n") * blocks / size) + F.when(n * blocks > size, 1).otherwise(0)
    places = running(counts, ["feature"], "value", ["n"]).join(sizes, "feature")
    places = places.select("feature", "value", F.struct(F.col("before_n").alias("rank"), block.alias("block")).alias("at"))
    wide = known.join(places, ["feature", "value"]).groupBy("key").pivot("feature", names).agg(F.first("at"))
    listed = lambda part: F.array(*(F.coalesce(F.col(f"`{f}`.{part}"), F.lit(-1)) for f in names))
    wide = written(wide.select(listed("rank").alias("ranks"), listed("block").alias("blocks")), "blocks")
    schema = "i int, j int, n double, s double, tied_1 double, tied_2 double"
    own = wide.select("*", F.posexplode("blocks").alias("feature", "block")).where("block >= 0 AND block % 2 = 0")
    inside = own.groupBy("feature", "block").applyInPandas(_in_blocks, schema)
    cells = wide.select("blocks").mapInArrow(_cells, "i int, j int, b1 int, b2 int, n double")
    cells = cells.groupBy("i", "j", "b1", "b2").agg(F.sum("n").alias("n"))
    both = inside.unionByName(cells.groupBy("i", "j").applyInPandas(_between_blocks, schema))
    sums = both.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "s", "tied_1", "tied_2")))
    all_pairs, name = F.col("n") * (F.col("n") - 1) / 2, F.array(*map(F.lit, names))
    untied = lambda c: all_pairs - F.col(c)
    return sums.select(
        name[F.col("i")].alias("f1"), name[F.col("j")].alias("f2"),
        F.try_divide(F.col("s"), F.sqrt(untied("tied_1") * untied("tied_2"))).alias("tau"),
    )
