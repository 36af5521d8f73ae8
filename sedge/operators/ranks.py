"""Ranks and running sums over values of any number, and sums over pairs of columns.

Values are counted first. The different ones are then dealt into ranges; a running sum is that of its range's predecessors,
of which there are as many as ranges, and that within its range. No window holds more than one range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.sources.scratch import written


QUARTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}


def equal(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in pairs))


def running(
    counts: DataFrame, by: list[str], value: str, sums: list[str], descending: bool = False, with_range: bool = False
) -> DataFrame:
    """Adds before_{c} for each c of sums: its sum over the values before (below, or above if descending) within `by`.
    counts has one row for each value. with_range: also adds __range, for extreme()."""
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    dealt = counts.repartitionByRange(ranges, *by, order).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    totals = dealt.groupBy(*by, "__range").agg(*(F.sum(c).alias(c) for c in sums))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "__range"]
    offsets = totals.select(
        *(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__of_{c}") for c in sums)
    )
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.join(offsets, equal([(k, f"__{i}") for i, k in enumerate(keys)]))
    before = [(F.col(f"__of_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"before_{c}") for c in sums]
    return met.select(*counts.columns, *before, *(["__range"] if with_range else []))


def extreme(rows: DataFrame, by: list[str], value: str, column: str, how: str, descending: bool = False) -> DataFrame:
    """Adds best_{column}: the least (how: min) or largest (max) of that column over the values up to each one within `by`,
    that one included. rows has one row for each value, with the __range that running() has given it, which goes."""
    best = {"min": F.min, "max": F.max}[how]
    way = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    keys = [*by, "__range"]
    earlier = Window.partitionBy(*by).orderBy(way("__range")).rowsBetween(Window.unboundedPreceding, -1)
    known = rows.groupBy(*keys).agg(best(column).alias("__b")).select(
        *(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), best("__b").over(earlier).alias("__of")
    )
    within = Window.partitionBy(*keys).orderBy(way(value)).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(known, equal([(k, f"__{i}") for i, k in enumerate(keys)]))
    both = (F.least if how == "min" else F.greatest)(F.col("__of"), best(column).over(within))
    return met.select(*(c for c in rows.columns if c != "__range"), both.alias(f"best_{column}"))


def ranked(
    rows: DataFrame, by: list[str], value: str, rank: str = "rank", share: bool = False, lowest: bool = False
) -> DataFrame:
    """Adds the rank of each row's value within `by`, ties sharing their mean rank, or their lowest; as a share of the rows
    if so asked."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    places = running(counts, by, value, ["__n"])
    r = F.col("before___n") + (1 if lowest else (F.col("__n") + 1) / 2)
    if share:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
        sizes = sizes.select(*(F.col(b).alias(f"__s{i}") for i, b in enumerate(by)), "__size")
        on = [(b, f"__s{i}") for i, b in enumerate(by)]
        places = places.join(sizes, equal(on)) if by else places.crossJoin(sizes)  # one row
        r = r / F.col("__size")
    keys = [*by, value]
    places = places.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), r.alias(rank))
    return rows.join(places, equal([(k, f"__k{i}") for i, k in enumerate(keys)])).select(*rows.columns, rank)


def tied_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds to each row, for a whole number that many rows share: rank and rank_down, its mean rank within `by` from below
    and from above, and share and share_min, its mean and its lowest rank over the number of rows.

    Equal numbers are counted first, and windows hold these counts only. For numbers of rows, as counts of values are, they
    are few: k different ones add up to k * (k + 1) / 2 rows at least, so 10^9 rows leave 45,000, and so they are
    broadcast."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    up = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before, n, size = F.coalesce(F.sum("__n").over(up), F.lit(0)), F.col("__n"), F.sum("__n").over(Window.partitionBy(*by))
    keys = [*by, value]
    places = counts.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), (before + (n + 1) / 2).alias("rank"), (size - before - n + (n + 1) / 2).alias("rank_down"),
        ((before + (n + 1) / 2) / size).alias("share"), ((before + 1) / size).alias("share_min"),
    )
    met = rows.join(F.broadcast(places), equal([(k, f"__k{i}") for i, k in enumerate(keys)]))
    return met.select(*rows.columns, "rank", "rank_down", "share", "share_min")


#: Values of a group up to which all of them are in reach of a quantile, and the accuracy of the bounds beyond that: they
#: are so far apart that, with their error, the two values next to a quantile are between them.
SMALL, ACCURACY = 20_000, 100_000
WIDE = 1 / ACCURACY + 2.5 / SMALL


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each of shares: that quantile of value within `by`, exact, and between two values in proportion.
    Nulls do not count; a group of nulls only has no row.

    One aggregation bounds each quantile by approximate ones, whose error is known; one counts what lies below each pair of
    bounds, and one the values between them, which are a few in 10,000 of the group's."""
    v = F.col(value).cast("double")
    known = rows.select(*by, v.alias("__v")).where(F.col("__v").isNotNull())
    names = list(shares)
    at = [min(max(s + side, 0.0), 1.0) for side in (-WIDE, WIDE) for s in shares.values()]
    first = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__size"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", at, ACCURACY).alias("__q"),
    )
    few = F.col("__size") <= SMALL
    place = lambda s: F.lit(float(s)) * (F.col("__size") - 1)
    bound = lambda i, s: F.struct(
        F.lit(i).alias("i"), place(s).alias("place"), F.when(few, F.col("__min")).otherwise(F.col("__q")[i]).alias("lo"),
        F.when(few, F.col("__max")).otherwise(F.col("__q")[i + len(names)]).alias("hi"),
    )
    keys = [f"__k{i}" for i in range(len(by))]
    bounds = first.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.array(*(bound(i, s) for i, s in enumerate(shares.values()))).alias("__b"))
    bounds = written(bounds, "quantile-bounds")
    on = list(zip(by, keys, strict=True))
    met = known.join(bounds, equal(on)) if by else known.crossJoin(bounds)  # one row
    below = met.groupBy(*keys).agg(*(F.count_if(F.col("__v") < F.col("__b")[i]["lo"]).alias(f"__n{i}") for i in range(len(names))))
    below = below.select(*(F.col(k).alias(f"__x{k}") for k in keys), F.array(*(F.col(f"__n{i}") for i in range(len(names)))).alias("__below"))
    near = F.explode(F.filter("__b", lambda b: (b["lo"] <= F.col("__v")) & (F.col("__v") <= b["hi"]))).alias("b")
    held = met.select(*keys, "__v", near).groupBy(*keys, "b.i", "b.place", "__v").agg(F.count(F.lit(1)).alias("__n"))
    held = held.join(below, equal([(k, f"__x{k}") for k in keys])) if by else held.crossJoin(below)  # one row
    up = Window.partitionBy(*keys, "i").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.get("__below", F.col("i")) + F.coalesce(F.sum("__n").over(up), F.lit(0))
    held = held.select(*keys, "i", "place", "__v", "__n", start.alias("start"))
    own = lambda p: F.max(F.when((F.col("start") <= p) & (p < F.col("start") + F.col("__n")), F.col("__v")))
    p = F.col("place")
    ends = held.groupBy(*keys, "i").agg(own(F.floor(p)).alias("low"), own(F.ceil(p)).alias("high"), F.max(p - F.floor(p)).alias("part"))
    low, high, part = F.col("low"), F.col("high"), F.col("part")
    between = F.when(low == high, low).otherwise(low * (1 - part) + high * part)
    out = ends.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, between)).alias(n) for i, n in enumerate(names)))
    return out.select(*(F.col(k).alias(b) for b, k in zip(by, keys, strict=True)), *names)


def quantiles_of(rows: DataFrame, by: list[str], shares: dict[str, dict[str, float]]) -> DataFrame:
    """quantiles() of several columns at once: shares has the names and shares of each column."""
    long = rows.select(*by, *(F.col(c).cast("double").alias(c) for c in shares)).unpivot(by, list(shares), "__c", "__value")
    every = {f"__{c}_{n}": s for c, own in shares.items() for n, s in own.items()}
    found = quantiles(long, [*by, "__c"], "__value", every)
    picked = [F.max(F.when(F.col("__c") == c, F.col(f"__{c}_{n}"))).alias(n) for c, own in shares.items() for n in own]
    return found.groupBy(*by).agg(*picked)


def with_quantiles(summary: DataFrame, rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Adds quantiles() of rows to a summary with one row for each group; null keys are a group too."""
    found = quantiles(rows, by, value, shares).withColumnsRenamed({b: f"__q{i}" for i, b in enumerate(by)})
    on = equal([(b, f"__q{i}") for i, b in enumerate(by)])
    return summary.join(found, on, "left").select(*summary.columns, *shares)


def pair_sums(wide: DataFrame, columns: list[str]) -> DataFrame:
    """For every two columns, f1 before f2 by name: over the rows in which neither is null, their number n and the sums x,
    y, xx, yy and xy. A task adds up all its rows in one table of columns by columns, and hands out that."""
    names = sorted(columns)
    first, second = np.triu_indices(len(names), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, len(names), len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns])
                known = ~np.isnan(x)
                x[~known] = 0
                k = known.astype(np.float64)
                of, squares = x.T @ k, (x * x).T @ k
                held += np.stack([k.T @ k, of, of.T, squares, squares.T, x.T @ x])
        if held[0].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in first]), pa.array([names[i] for i in second]), *(pa.array(h[first, second]) for h in held)],
                names=["f1", "f2", "n", "x", "y", "xx", "yy", "xy"],
            )

    sums = ["n", "x", "y", "xx", "yy", "xy"]
    table = wide.select(*(F.col(c).cast("double").alias(c) for c in names))
    parts = table.mapInArrow(run, "f1 string, f2 string, " + ", ".join(f"{s} double" for s in sums))
    return parts.groupBy("f1", "f2").agg(*(F.sum(s).alias(s) for s in sums)).where("n > 0")


def correlation() -> Column:
    """Pearson's, from the sums of pair_sums()."""
    n, x, y, xx, yy, xy = (F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy"))
    return F.try_divide(n * xy - x * y, F.sqrt((n * xx - x * x) * (n * yy - y * y)))
