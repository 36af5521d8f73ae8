"""What must hold of samples, whichever rows the hash draws: sizes as the table tells them, no id twice, none from elsewhere,
and none in two parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators import sampling as P
from sedge.operators import uncertainty as U
from sedge.plans.uncertainty import _ROC, _scores_long, rounded
from sedge.plans.views import TOOL_PROBS, TRANSCRIPTS, tool_probs, transcripts


def _held(name: str, drawn: DataFrame, source: DataFrame, key: str, other: DataFrame | None = None) -> DataFrame:
    ids = drawn.select(F.col(key).alias("k"))
    unknown = ids.join(source.select(F.col(key).alias("k")).distinct(), "k", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    both = ids.join((drawn.limit(0) if other is None else other).select(F.col(key).alias("k")), "k", "left_semi").agg(F.count(F.lit(1)).alias("n_in_both"))
    sizes = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("n_distinct"))
    return sizes.crossJoin(unknown).crossJoin(both).withColumn("sample", F.lit(name))  # a row each


def samples_hold(spark, d):
    t, p = transcripts(spark, d), tool_probs(spark, d)
    side = lambda rows, part: rows.where(F.col("part") == part)
    balanced, halves = P.balanced_split(p, "id", "coding_class"), P.split(p, "id", 0.9)
    train, test = P.fold_split(P.stratified_folds(p, "id", "coding_class"), 2, "id", "coding_class")
    genes = P.some_groups(t, "transcript_id", "gene_id", 7)
    return reduce(
        DataFrame.unionByName,
        [
            _held("fixed", P.sample(t, "transcript_id", 100), t, "transcript_id"),
            _held("balanced train", side(balanced, "train"), p, "id", side(balanced, "test")),
            _held("balanced test", side(balanced, "test"), p, "id", side(balanced, "train")),
            _held("train of a ratio", side(halves, "train"), p, "id", side(halves, "test")),
            _held("fold train", train, p, "id", test),
            _held("fold test", test, p, "id", train),
            _held("genes", genes, t, "gene_id"),
            _held("one of each gene", P.one_per_group(t, "transcript_id", "gene_id"), t, "gene_id"),
            _held("slices", P.contiguous_folds(p.select("id"), "id").where("fold IS NOT NULL"), p, "id"),
        ],
    )


def kfold_ids(spark, d):
    """Each id with the number of folds it is in, and its class there."""
    f = P.stratified_folds(tool_probs(spark, d), "id", "coding_class")
    return f.groupBy("id").agg(F.count_distinct("fold").alias("n_folds"), F.max("coding_class").alias("coding_class"))


def precision_recall(spark, d):
    return rounded(U.precision_recall_points(_scores_long(spark, d), "p", "real", ["tool"]), 9)


QUERIES = {f.__name__: f for f in (samples_hold, kfold_ids, precision_recall)}
_C = "c AS (SELECT coding_class, count(*) AS n FROM tool_probs GROUP BY ALL), f AS (SELECT coding_class, (n + 3) // 5 AS test, n - (n + 3) // 5 AS train FROM c)"
_SIZES = {
    "fixed": "SELECT least(100, count(*)) FROM transcripts",
    "balanced train": "SELECT count(*) * CAST(floor(min(n) * 0.8) AS BIGINT) FROM c",
    "balanced test": "SELECT sum(n) - count(*) * CAST(floor(min(n) * 0.8) AS BIGINT) FROM c",
    "train of a ratio": "SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM tool_probs",
    "fold train": "SELECT count(*) * min(train) FROM f",
    "fold test": "SELECT sum(test) FROM f",
    "genes": "SELECT 7",
    "one of each gene": "SELECT count(DISTINCT gene_id) FROM transcripts",
    "slices": "SELECT count(*) // 10 * 10 FROM tool_probs",
}
ORACLE_SQL = {
    "samples_hold": f"WITH {TOOL_PROBS}, {TRANSCRIPTS}, {_C} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS sample, CAST(({s}) AS BIGINT) AS n, CAST(({s}) AS BIGINT) AS n_distinct, CAST(0 AS BIGINT) AS n_unknown, CAST(0 AS BIGINT) AS n_in_both"
        for k, s in _SIZES.items()
    ),
    "precision_recall": f"{_ROC} SELECT tool, round(p, 9) AS p, round(CAST(tp / (tp + fp) AS DOUBLE), 9) AS precision, round(CAST(tp / np AS DOUBLE), 9) AS "
    "recall FROM c",
    "kfold_ids": f"WITH {TOOL_PROBS} SELECT id, CAST(1 AS BIGINT) AS n_folds, coding_class FROM tool_probs",
}
