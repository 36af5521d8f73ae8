"""Mutual information of a continuous feature and a group, from nearest neighbours in one dimension.

For each value: the distance to its k-th nearest neighbour of the same group, and the number of values of any group
within it. The estimate is psi(N) + mean psi(k) - mean psi(n of the group) - mean psi(number within). Equal values are
counted once. Neighbours are found in ranges of the ordered values, each with the k values before and after it, so no window
holds a feature; the numbers within come from running sums at both ends of each interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.numbers import digamma
from sedge.operators.ranks import equal, running
from sedge.sources.scratch import written

#: A distance counts as within the k-th if it is less by more than this share, so that rounding does not decide.
SHORTER = 1 - 1e-9


def _beside(counts: DataFrame, by: list[str], k: int) -> DataFrame:
    """Adds before and after: the k different values (v, n) on either side of each value within `by`, fewer at the ends."""
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(counts.repartitionByRange(ranges, *by, "v").withColumn("__range", F.spark_partition_id()), "mi-ranges")
    keys = [*by, "__range"]
    own = Window.partitionBy(*keys).orderBy("v")
    down = Window.partitionBy(*keys).orderBy(F.desc("v"))
    pair = F.struct("v", "n")
    # the first and last k of every range hold the k before and after each range
    ends = dealt.withColumns({"__up": F.row_number().over(own), "__down": F.row_number().over(down)})
    ends = ends.where((F.col("__up") <= k) | (F.col("__down") <= k))
    whole = Window.partitionBy(*by).orderBy("v")  # over 2 k values of each range
    halo = ends.withColumns(
        {"__b": F.collect_list(pair).over(whole.rowsBetween(-k, -1)), "__a": F.collect_list(pair).over(whole.rowsBetween(1, k))}
    )
    first = halo.where("__up = 1").select(*keys, "__b")
    last = halo.where("__down = 1").select(*keys, "__a")
    names = [f"__{i}" for i in range(len(keys))]
    halo = first.join(last, keys).withColumnsRenamed(dict(zip(keys, names, strict=True)))
    met = dealt.join(halo, equal(list(zip(keys, names, strict=True))))
    near = lambda lo, hi: F.collect_list(pair).over(own.rowsBetween(lo, hi))
    met = met.withColumns({"__ob": near(-k, -1), "__oa": near(1, k)})
    before = F.concat("__b", "__ob")
    size = F.least(F.size(before), F.lit(k))
    return met.select(
        *counts.columns,
        F.slice(before, F.size(before) - size + 1, size).alias("before"),
        F.slice(F.concat("__oa", "__a"), 1, k).alias("after"),
    )


def _distance(k: Column) -> Column:
    """To the k-th of the values before, after and equal (less the value itself), nearest first."""
    near = lambda side: F.transform(side, lambda x: F.struct(F.abs(x["v"] - F.col("v")).alias("d"), x["n"].alias("n")))
    own = F.array(F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n")))
    every = F.array_sort(F.concat(own, near(F.col("before")), near(F.col("after"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d"))
    step = lambda a, x: F.struct(
        (a["n"] + x["n"]).alias("n"), F.when((a["n"] < k) & (a["n"] + x["n"] >= k), x["d"]).otherwise(a["d"]).alias("d")
    )
    return F.aggregate(every, start, step)["d"]


def neighbour_information(rows: DataFrame, by: list[str], k: int = 3, value: str = "value", group: str = "grp") -> DataFrame:
    """mi (in nats, not below 0) for each of `by`. Null values count as 0. Values whose group has no other do not count; in a
    smaller group k is its size less one."""
    given = rows.select(*by, F.col(group).alias("g"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    counts = given.groupBy(*by, "g", "v").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "mi-counts")
    sizes = counts.groupBy(*by, "g").agg(F.sum("n").alias("size")).where("size > 1")
    keys = [*by, "g"]
    names = [f"__g{i}" for i in range(len(keys))]
    sizes = sizes.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    counts = counts.join(sizes, equal(list(zip(keys, names, strict=True)))).select(*keys, "v", "n", "size")
    near = F.least(F.lit(k), F.col("size") - 1)
    r = _distance(near) * SHORTER
    at = _beside(counts, keys, k).select(*by, "n", "size", near.alias("k"), (F.col("v") - r).alias("lo"), (F.col("v") + r).alias("hi"))
    at = written(at, "mi-intervals")
    nothing = F.lit(0).cast("long").alias("n")
    places = (
        counts.select(*by, "v", "n")
        .unionByName(at.select(*by, F.col("lo").alias("v"), nothing))
        .unionByName(at.select(*by, F.col("hi").alias("v"), nothing))
        .groupBy(*by, "v")
        .agg(F.sum("n").alias("n"))
    )
    places = written(running(places, by, "v", ["n"]), "mi-places")

    def met(df: DataFrame, end: str, c: Column) -> DataFrame:
        other = places.select(*(F.col(b).alias(f"__p{i}") for i, b in enumerate(by)), F.col("v").alias("__v"), c.alias(f"at_{end}"))
        return df.join(other, equal([(b, f"__p{i}") for i, b in enumerate(by)] + [(end, "__v")])).select(*df.columns, f"at_{end}")

    at = met(met(at, "lo", F.col("before_n")), "hi", F.col("before_n") + F.col("n"))
    n = F.col("n").cast("double")
    psi = lambda c: n * digamma(F.col(c).cast("double"))
    at = at.withColumn("within", F.col("at_hi") - F.col("at_lo"))
    sums = at.groupBy(*by).agg(F.sum("n").cast("double").alias("all"), F.sum(psi("k") - psi("size") - psi("within")).alias("s"))
    return sums.select(*by, F.greatest(F.lit(0.0), digamma(F.col("all")) + F.col("s") / F.col("all")).alias("mi"))
