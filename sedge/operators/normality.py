"""Shapiro-Wilk's test of normality for any number of values.

Values are counted and ranked in ranges; a value's part of W needs the normal scores of the places that it takes, which
are summed up in portions, so neither a feature nor a value that is there very often is in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.numbers import inverse_normal, two_sided_normal
from sedge.operators.ranks import equal, running
from sedge.sources.code import ship

#: Places whose scores are summed up at once.
PORTION = 1 << 16
#: Fixed values of the approximation (Royston 1992, 1995): weights of the two outermost values by 1 / sqrt(n), from the
#: first power on, and mean and log of the deviation of the transformed W, from power 0 on, for n below 12 and from 12 on.
LAST = [0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
SECOND = [0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_MEAN, SMALL_LOG_SD = [0.5440, -0.39978, 0.025054, -0.0006714], [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN, LARGE_LOG_SD = [-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302]
SMALL_EDGE = [-2.273, 0.459]


def _polynomial(x: Column, factors: list[float]) -> Column:
    out = F.lit(0.0)
    for f in reversed(factors):
        out = out * x + f
    return out


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For places a to b of n: the sums of their normal scores, those of the outermost two on each side aside, and of the
    squares of all."""
    inverse = np.frompyfunc(NormalDist().inv_cdf, 1, 1)
    for batch in batches:
        n, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        each = b - a + 1
        ends = np.cumsum(each)
        place = np.arange(ends[-1]) - np.repeat(ends - each, each) + np.repeat(a, each)
        of = np.repeat(n, each)
        m = inverse((place - 0.375) / (of + 0.25)).astype(np.float64)
        inner = np.where((place > 2) & (place < of - 1), m, 0)
        sums = [np.add.reduceat(x, ends - each) for x in (inner, m * m)]
        yield pa.RecordBatch.from_arrays([batch.column(3), *map(pa.array, sums)], names=["row", "inner", "square"])


def shapiro_wilk(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, w and p_value of the values of each of `by`; nulls do not count. Fewer than 3 values, and equal ones, have neither
    w nor p_value. Beyond 5000 values p_value is an extrapolation, as everywhere."""
    ship(rows.sparkSession)
    v = F.col(value).cast("double")
    counts = rows.where(v.isNotNull()).groupBy(*by, v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    placed = running(counts, by, "v", ["c"])
    means = counts.groupBy(*by).agg(
        F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")
    )
    names = [f"__{i}" for i in range(len(by))]
    means = means.withColumnsRenamed(dict(zip(by, names, strict=True)))
    placed = placed.join(means, equal(list(zip(by, names, strict=True)))).select(*by, "v", "c", "before_c", "n", "mean")
    a, end = F.col("before_c") + 1, F.col("before_c") + F.col("c")
    row = F.struct(*by, (F.col("v") - F.col("mean")).alias("v")).alias("row")
    portions = placed.select("n", F.explode(F.sequence(a, end, F.lit(PORTION).cast("long"))).alias("a"), end.alias("end"), row)
    portions = portions.select("n", "a", F.least(F.col("a") + PORTION - 1, F.col("end")).alias("b"), "row")
    kind = portions.schema["row"].dataType.simpleString()
    scores = portions.mapInArrow(_scores, f"row {kind}, inner double, square double")
    sums = scores.select("row.*", "inner", "square").groupBy(*by).agg(
        F.sum(F.col("inner") * F.col("v")).alias("inner"), F.sum("square").alias("square")
    )
    x, c = F.col("v") - F.col("mean"), F.col("c")
    at = lambda place: F.max(F.when((F.col("before_c") < place) & (place <= end), x))
    n = F.col("n")
    spread = placed.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(x * x * c).alias("ss"), at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"),
        at(n - 1).alias("x3"), at(n).alias("x4"),
    ).withColumnsRenamed(dict(zip(by, names, strict=True)))
    both = sums.join(spread, equal(list(zip(by, names, strict=True))))
    size = n.cast("double")
    u, length = 1 / F.sqrt(size), F.sqrt("square")
    high, next_ = F.col("m4"), F.col("m3")
    both = both.withColumns({"m4": inverse_normal((size - 0.375) / (size + 0.25)), "m3": inverse_normal((size - 1.375) / (size + 0.25))})
    last = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(high / length + u * _polynomial(u, LAST))
    second = F.when(n <= 5, next_ / length).otherwise(next_ / length + u * _polynomial(u, SECOND))
    both = both.withColumns({"a4": last, "a3": second})
    a4, a3 = F.col("a4"), F.col("a3")
    few = (F.col("square") - 2 * high * high) / (1 - 2 * a4 * a4)
    many = (F.col("square") - 2 * high * high - 2 * next_ * next_) / (1 - 2 * a4 * a4 - 2 * a3 * a3)
    scale = F.sqrt(F.when(n <= 5, few).otherwise(many))
    third = F.when(n == 3, 0.0).when(n <= 5, next_ / scale).otherwise(a3)
    part = a4 * (F.col("x4") - F.col("x1")) + F.when(n > 3, third * (F.col("x3") - F.col("x2"))).otherwise(0.0) + F.when(n > 5, F.col("inner") / scale).otherwise(0.0)
    w = F.least(F.lit(1.0), F.try_divide(part * part, F.col("ss")))
    both = both.select(*by, "n", F.when((n >= 3) & (F.col("ss") > 0), w).alias("w"))
    ln, away = F.ln(size), F.ln(1 - F.col("w"))
    edge = _polynomial(size, SMALL_EDGE)
    z_few = (-F.ln(edge - away) - _polynomial(size, SMALL_MEAN)) / F.exp(_polynomial(size, SMALL_LOG_SD))
    z_many = (away - _polynomial(ln, LARGE_MEAN)) / F.exp(_polynomial(ln, LARGE_LOG_SD))
    three = 6 / np.pi * (F.asin(F.sqrt("w")) - np.pi / 3)
    both = both.withColumn("z", F.when(n < 12, z_few).otherwise(z_many))
    half = two_sided_normal(F.col("z")) / 2
    upper = F.when(F.col("z") > 0, half).otherwise(1 - half)
    p = F.when(n == 3, F.greatest(three, F.lit(0.0))).when(F.col("w") >= 1, 1.0).when((n < 12) & (away >= edge), 0.0).otherwise(upper)
    return both.select(*by, "n", "w", F.when(F.col("w").isNotNull(), p).alias("p_value"))
