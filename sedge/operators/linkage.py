"""Ward's linkage as joins: in each round all pairs of clusters that are nearest to each other merge at once.

Ward's distance to a union is never below the least of those to its parts, so two clusters that are nearest to each other stay
so whatever else merges, and rounds of such pairs make the tree that merging one pair at a time makes. The distances of
pairs are rows; the driver only asks whether any are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.sources.scratch import scratch_path, written


def _mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "d2"))


def _nearest_pairs(d2: DataFrame) -> DataFrame:
    """old, new, between: both ends of each pair that is nearest to each other, the first one's name and their distance.
    Equal distances are told apart by names, the same way from both ends."""
    order = F.struct("d2", F.least("x", "y"), F.greatest("x", "y"))
    nearest = d2.groupBy("x").agg(F.min_by(F.struct("y", "d2"), order).alias("to")).select("x", "to.*")
    back = nearest.select(F.col("x").alias("y"), F.col("y").alias("x"))
    return nearest.join(back, ["x", "y"]).select(F.col("x").alias("old"), F.least("x", "y").alias("new"), F.col("d2").alias("between"))


def _united(d2: DataFrame, merged: DataFrame, sizes: DataFrame, others: DataFrame) -> DataFrame:
    """Squared distances with each x replaced by what it becomes: from those of its parts and that between them. sizes are
    those of x, others those of y."""
    of = lambda t, end, name: t.select(F.col("cluster").alias(end), F.col("size").alias(name))
    parts = d2.join(merged.withColumnRenamed("old", "x"), "x").join(of(sizes, "x", "sx"), "x").join(of(others, "y", "sy"), "y")
    sy = F.max("sy")
    united = (F.sum((F.col("sx") + F.col("sy")) * F.col("d2")) - sy * F.max("between")) / (F.sum("sx") + sy)
    return parts.groupBy("new", "y").agg(F.greatest(united, F.lit(0.0)).alias("d2")).withColumnRenamed("new", "x")


def ward(pairs: DataFrame) -> DataFrame:
    """From the distances of all pairs (f1, f2, distance): feature, round, cluster and height, a row for each round and
    feature; round 0 has each feature by itself, at height 0. A cluster goes by the first name in it. There are at least
    as many rounds as the logarithm of the number of features, each of a few jobs."""
    squared = pairs.select(F.col("f1").alias("x"), F.col("f2").alias("y"), F.pow("distance", F.lit(2.0)).alias("d2"))
    d2 = written(_mirrored(squared), "ward-pairs")
    members = d2.select(F.col("x").alias("feature"), F.col("x").alias("cluster"), F.lit(0.0).alias("height")).distinct()
    members, turn = written(members, "ward-members"), 0
    size = lambda t: t.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("size"))
    # every round is added to one table, so the plan does not grow with them
    rounds = scratch_path(pairs.sparkSession, "ward-rounds")
    added = lambda t, k: t.select("feature", F.lit(k).alias("round"), "cluster", "height").write.mode("append").parquet(rounds)
    added(members, 0)
    while not d2.isEmpty():
        turn += 1
        live = members.select(F.col("cluster").alias("old")).distinct().join(_nearest_pairs(d2), "old", "left")
        merged = live.select("old", F.coalesce("new", "old").alias("new"), F.coalesce("between", F.lit(0.0)).alias("between"))
        merged = written(merged, "ward-merged")
        height = F.greatest("height", F.sqrt("between")).alias("height")
        after = members.join(merged, F.col("cluster") == F.col("old")).select("feature", F.col("new").alias("cluster"), height)
        after = written(after, "ward-members")
        named = lambda end, t=merged: t.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}"))
        apart = d2.join(named("x"), "x").join(named("y"), "y").where("new_x != new_y").select("x", "y", "d2")
        half = _united(apart, merged, size(members), size(members)).select(F.col("y").alias("x"), F.col("x").alias("y"), "d2")
        d2 = written(_mirrored(_united(half, merged, size(members), size(after)).where("x < y")), "ward-pairs")
        members = after
        added(members, turn)
    return pairs.sparkSession.read.parquet(rounds)


def flat_clusters(tree: DataFrame, thresholds: list[float]) -> DataFrame:
    """feature, threshold, cluster: of each feature the last cluster of ward() that is at most as high as the threshold,
    clusters being numbered by name within each threshold."""
    levels = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    held = tree.withColumn("threshold", levels).where(F.col("height") <= F.col("threshold"))
    last = held.groupBy("feature", "threshold").agg(F.max_by("cluster", "round").alias("name"))
    number = F.dense_rank().over(Window.partitionBy("threshold").orderBy("name"))
    return last.select("feature", "threshold", number.alias("cluster"))
