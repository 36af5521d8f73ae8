"""Attribution values (SHAP) and feature selections over folds, and clusters of features by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_absolute(values: DataFrame) -> DataFrame:
    """Per fold and feature the mean absolute attribution. values: fold, feature, value."""
    return values.groupBy("fold", "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))


def over_folds(per_fold: DataFrame) -> DataFrame:
    """feature, mean_abs_shap, std_abs_shap (n - 1) and cv_abs_shap over all folds; a feature that a fold lacks has 0
    there. Zeros need no rows: sums and squares with the number of folds are enough."""
    n_folds = per_fold.agg(F.count_distinct("fold").alias("k")).withColumn("__on", F.lit(1))
    x = F.col("mean_abs")
    sums = per_fold.groupBy("feature").agg(F.sum("mean_abs").alias("s"), F.sum(x * x).alias("q")).withColumn("__on", F.lit(1))
    k = F.col("k")
    both = sums.join(F.broadcast(n_folds), "__on")  # one row
    mean = F.col("s") / k
    std = F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s") / k, F.lit(0.0)) / (k - 1))
    return both.select(
        "feature", mean.alias("mean_abs_shap"), std.alias("std_abs_shap"), F.try_divide(std, mean).alias("cv_abs_shap")
    )


def cumulative(aggregate: DataFrame, column: str = "mean_abs_shap") -> DataFrame:
    """Features by falling value, with their places, running sum and its percentage. A row for each feature."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(column).desc(), "feature")
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    return aggregate.select(
        "feature",
        column,
        F.row_number().over(order).alias("place"),
        F.sum(column).over(up).alias("running"),
        (100 * F.sum(column).over(up) / F.sum(column).over(Window.partitionBy(F.lit(0)))).alias("running_percent"),
    )


def top_per_row(values: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """The n features of largest absolute value of each key, signed, with their places."""
    order = Window.partitionBy(*key).orderBy(F.abs("value").desc(), "feature")
    return values.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def latest_fold(values: DataFrame, key: str) -> DataFrame:
    """Rows of the last fold in which each key is found."""
    last = Window.partitionBy(key)
    return values.withColumn("__last", F.max("fold").over(last)).where(F.col("fold") == F.col("__last")).drop("__last")


def one_standard_error(scores: DataFrame, n_splits: int | None = None) -> DataFrame:
    """The smallest step whose mean score over folds is at least the best mean less its standard error. scores: step, fold,
    score. n_splits: divisor of the error instead of the number of folds."""
    steps = scores.groupBy("step").agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.count("score").alias("n")
    )
    root = F.sqrt(F.lit(float(n_splits)) if n_splits else F.col("n").cast("double"))
    best = steps.agg(
        F.max_by(F.col("mean") - F.col("sd") / root, F.struct("mean", -F.col("step"))).alias("limit"),
        F.max_by("step", F.struct("mean", -F.col("step"))).alias("best_step"),
    ).withColumn("__on", F.lit(1))
    met = steps.withColumn("__on", F.lit(1)).join(F.broadcast(best), "__on")  # one row
    return met.where(F.col("mean") >= F.col("limit")).agg(
        F.min("step").alias("step"), F.first("best_step").alias("best_step"), F.first("limit").alias("limit")
    )


def votes(selections: DataFrame, folds: list[int], min_folds: int = 3, absent_rank: int = 999) -> DataFrame:
    """feature, vote_count, mean and (population) standard deviation of ranks, selected (at least min_folds votes) and the
    list of folds. selections: fold, feature, rank, selected; a fold without the feature gives it absent_rank."""
    k = len(folds)
    rank, chosen = F.col("rank").cast("double"), F.col("selected")
    sums = selections.where(F.col("fold").isin(folds)).groupBy("feature").agg(
        F.count_if(chosen).alias("vote_count"),
        F.count(F.lit(1)).alias("n"),
        F.sum(rank).alias("s"),
        F.sum(rank * rank).alias("q"),
        F.array_join(F.sort_array(F.collect_list(F.when(chosen, F.col("fold")))), ",").alias("selected_in_folds"),
    )
    missing = k - F.col("n")
    s, q = F.col("s") + missing * absent_rank, F.col("q") + missing * float(absent_rank**2)
    return sums.select(
        "feature",
        "vote_count",
        (F.col("vote_count") >= min_folds).alias("selected"),
        (s / k).alias("rfecv_rank_mean"),
        F.sqrt(F.greatest(q / k - (s / k) * (s / k), F.lit(0.0))).alias("rfecv_rank_std"),
        "selected_in_folds",
    )


def name_clusters(members: DataFrame) -> DataFrame:
    """A name for each cluster: its most frequent category (of equals, the alphabetically last) and its strongest member.
    members: cluster, feature, category, shap."""
    counts = members.groupBy("cluster", "category").agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy("cluster").agg(F.max_by("category", F.struct("n", "category")).alias("category"))
    top = members.groupBy("cluster").agg(
        F.max_by("feature", F.struct(F.coalesce("shap", F.lit(0.0)), "feature")).alias("top_feature"),
        F.count(F.lit(1)).alias("size"),
        F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("members"),
    )
    return major.join(top, "cluster").withColumn("name", F.concat_ws(" / ", "category", "top_feature"))


def rank_clusters(members: DataFrame) -> DataFrame:
    """Sum of attributions, size, members with a value, sum per member, coverage and place of each cluster."""
    sums = members.groupBy("cluster").agg(
        F.coalesce(F.sum("shap"), F.lit(0.0)).alias("shap_sum"), F.count(F.lit(1)).alias("size"), F.count("shap").alias("n_valued")
    )
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("shap_sum").desc(), "cluster"))
    return sums.select(
        "*",
        (F.col("shap_sum") / F.col("size")).alias("per_member"),
        (F.col("n_valued") / F.col("size")).alias("coverage"),
        place.alias("place"),
    )


def origins(members: DataFrame) -> DataFrame:
    """How many clusters have how many different categories."""
    each = members.groupBy("cluster").agg(F.count_distinct("category").alias("n_origins"))
    return each.groupBy("n_origins").agg(F.count(F.lit(1)).alias("n_clusters"))


def significant_clusters(tables: list[DataFrame]) -> DataFrame:
    """Clusters with a significant test, and all, over several tables of tests (cluster, significant)."""
    every = tables[0].select("cluster", "significant")
    for t in tables[1:]:
        every = every.unionByName(t.select("cluster", "significant"))
    return every.agg(
        F.count_distinct(F.when(F.col("significant"), F.col("cluster"))).alias("n_significant"),
        F.count_distinct("cluster").alias("n_clusters"),
    )


def top_after_clustering(tests: DataFrame, clusters: DataFrame, n: int = 10, pinned: str | None = None, score: str = "vda") -> DataFrame:
    """The strongest feature of each cluster, by distance of the score from 0.5; the n best. A pinned feature's cluster
    mates are left out; features without a cluster too."""
    met = tests.join(clusters, "feature").where(F.col("cluster").isNotNull()).withColumn("distance", F.abs(F.col(score) - 0.5))
    if pinned is not None:
        mates = met.withColumn("__pinned", F.max(F.col("feature") == pinned).over(Window.partitionBy("cluster")))
        met = mates.where(~F.col("__pinned") | (F.col("feature") == pinned)).drop("__pinned")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("distance").desc(), "feature"))
    best = met.withColumn("__k", place).where("__k = 1").drop("__k")
    return best.orderBy(F.col("distance").desc(), "feature").limit(n)


def nearest_threshold(clusters: DataFrame, threshold: float) -> DataFrame:
    """Of a long cluster table (feature, threshold, cluster) the rows of the nearest threshold, the lower of two."""
    best = clusters.agg(
        F.min_by("threshold", F.struct(F.round(F.abs(F.col("threshold") - threshold), 9), "threshold")).alias("threshold")
    )
    return clusters.join(F.broadcast(best), "threshold")  # one row


def family_top(hits: DataFrame, sizes: DataFrame, top: int = 20, eps: float = 1e-6) -> DataFrame:
    """Mean hits per transcript of each family in either class, log2 of their ratio; the `top` families by summed mean.
    hits: class (0/1), family, n; sizes: class, transcripts."""
    sums = hits.groupBy("class", "family").agg(F.sum("n").alias("n")).join(sizes, "class")
    means = sums.withColumn("mean", F.col("n") / F.col("transcripts"))
    wide = means.groupBy("family").agg(
        *(F.coalesce(F.sum(F.when(F.col("class") == k, F.col("mean"))), F.lit(0.0)).alias(f"mean_{k}") for k in (0, 1))
    )
    ratio = F.log2((F.col("mean_1") + eps) / (F.col("mean_0") + eps))
    total = F.col("mean_0") + F.col("mean_1")
    return wide.withColumn("log2_ratio", ratio).orderBy(F.round(total, 9).desc(), "family").limit(top)


def best_checkpoints(runs: DataFrame, n: int, mode: str = "intent") -> DataFrame:
    """The best run of each dataset by accuracy; n of them: by accuracy (intent) or, as in a program this follows, by the
    datasets' names (as_coded)."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(F.col("acc").desc(), "run"))
    best = runs.withColumn("__k", place).where("__k = 1").drop("__k")
    if mode == "intent":
        return best.orderBy(F.col("acc").desc(), "dataset").limit(n)
    if mode == "as_coded":
        return best.orderBy("dataset").limit(n)
    raise ValueError(f"unknown mode: {mode}")
