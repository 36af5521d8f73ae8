"""Scores of classifiers over folds, and agreement between them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.ranks import QUARTILES, with_quantiles

MEASURES = ["accuracy", "balanced_accuracy", "precision", "recall", "f1"]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_scores(labels: DataFrame, tools: list[str], real: str = "real", by: list[str] | None = None, average: str = "binary") -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and F1 of each tool within `by`; a division by zero gives 0. macro:
    the mean of both classes' values."""
    by = by or []
    long = labels.unpivot([*by, real], tools, "tool", "call").where(F.col("call").isNotNull() & F.col(real).isNotNull())
    r, c = F.col(real), F.col("call")
    counts = long.groupBy(*by, "tool").agg(
        F.count_if(r & c).alias("tp"), F.count_if(~r & c).alias("fp"), F.count_if(~r & ~c).alias("tn"), F.count_if(r & ~c).alias("fn")
    )
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    p1, r1, p0, r0 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    if average == "binary":
        p, r, f = p1, r1, f1
    elif average == "macro":
        p, r, f = (p1 + p0) / 2, (r1 + r0) / 2, (f1 + f0) / 2
    else:
        raise ValueError(f"unknown average: {average}")
    values = [_ratio(tp + tn, tp + tn + fp + fn), (r1 + r0) / 2, p, r, f]
    return counts.select(*by, "tool", *(v.alias(n) for v, n in zip(values, MEASURES, strict=True)))


def over_folds(scores: DataFrame) -> DataFrame:
    """Mean and standard deviation (n - 1) of each measure over folds."""
    return scores.groupBy("tool").agg(
        *(f(m).alias(f"{m}_{n}") for m in MEASURES for n, f in (("mean", F.avg), ("std", F.stddev_samp)))
    )


def with_totals(scores: DataFrame, measures: list[str]) -> DataFrame:
    """Rows of folds, and under them a row `mean` and a row `std` for each tool."""
    rows = scores.select("tool", F.col("fold").cast("string").alias("fold"), *measures)
    total = lambda f, n: scores.groupBy("tool").agg(*(f(m).alias(m) for m in measures)).withColumn("fold", F.lit(n))
    return rows.unionByName(total(F.avg, "mean")).unionByName(total(F.stddev_samp, "std"))


def best_variant(summary: DataFrame, measure: str = "f1_mean") -> DataFrame:
    """Of tools whose names end alike after the last underscore, the best; of equals, the first by name."""
    base = F.element_at(F.split("tool", "_"), -1)
    place = F.row_number().over(Window.partitionBy("base").orderBy(F.col(measure).desc(), "tool"))
    return summary.withColumn("base", base).withColumn("__k", place).where("__k = 1").drop("__k")


def stability(summary: DataFrame) -> DataFrame:
    """Coefficient of variation of F1 over folds, and rank by mean F1."""
    ranked = F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.col("f1_mean").desc()))  # a row for each tool
    return summary.select("tool", F.try_divide("f1_std", "f1_mean").alias("f1_cv"), ranked.alias("f1_rank"))


def n_correct(labels: DataFrame, tools: list[str], real: str = "real") -> Column:
    return reduce(add, ((F.col(t) == F.col(real)).cast("int") for t in tools))


def consensus_counts(labels: DataFrame, tools: list[str], real: str = "real") -> DataFrame:
    """n_correct by real class, wide."""
    rows = labels.select(n_correct(labels, tools, real).alias("n_correct"), F.col(real).alias("r"))
    return rows.groupBy("n_correct").agg(F.count_if("r").alias("coding"), F.count_if(~F.col("r")).alias("noncoding"))


def consensus_shares(labels: DataFrame, tools: list[str], real: str = "real") -> DataFrame:
    """Percentage of each class that all, none or some tools call right."""
    k = n_correct(labels, tools, real)
    kind = F.when(k == len(tools), "All").when(k == 0, "None").otherwise("Ambiguous")
    counts = labels.groupBy(F.col(real).alias("real"), kind.alias("consensus")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("real")))


def combinations(labels: DataFrame, tools: list[str], top: int | None = None) -> DataFrame:
    """How many rows have each combination of calls; top: only the most frequent ones."""
    counts = labels.groupBy(*tools).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), *tools).limit(top) if top else counts


def set_totals(labels: DataFrame, tools: list[str]) -> DataFrame:
    return labels.agg(*(F.count_if(t).alias(t) for t in tools)).unpivot([], tools, "tool", "n")


def vote_histogram(labels: DataFrame, tools: list[str], probability: str, real: str = "real") -> DataFrame:
    """Rows by number of coding votes and real class, and the mean probability for each number of votes."""
    votes = reduce(add, (F.col(t).cast("int") for t in tools))
    return labels.groupBy(votes.alias("n_votes")).agg(
        F.count_if(real).alias("coding"), F.count_if(~F.col(real)).alias("noncoding"), F.avg(probability).alias("mean_prob")
    )


def length_summary(rows: DataFrame, by: str, length: str = "length") -> DataFrame:
    sums = rows.groupBy(by).agg(F.count(length).alias("n"), F.avg(length).alias("mean"), F.stddev_samp(length).alias("sd"))
    return with_quantiles(sums, rows, [by], length, QUARTILES)


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """Counts of values but null, and their percentages."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def null_counts(rows: DataFrame) -> DataFrame:
    found = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns))
    return found.unpivot([], rows.columns, "column", "n_null")


def constant_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column and whether it has at most one value but null: its minimum is its maximum."""
    same = rows.agg(*(F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns))
    return same.unpivot([], columns, "column", "constant")


def classification_report(predicted: DataFrame, real: str = "y_true", called: str = "y_pred") -> DataFrame:
    """The report of a classifier of classes 0 and 1, a row for each class and for accuracy, macro avg and weighted avg:
    name, precision, recall, f1_score (0 where not defined) and support. Accuracy stands as f1_score in its row."""
    y, p = F.col(real).cast("int"), F.col(called).cast("int")
    count = lambda a, b: F.count_if((y == a) & (p == b)).cast("double")
    cells = predicted.agg(*(count(a, b).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")

    def of(k: int) -> list[Column]:
        right, wrong, lost = F.col(f"c{k}{k}"), F.col(f"c{1 - k}{k}"), F.col(f"c{k}{1 - k}")
        return [share(right, right + wrong), share(right, right + lost), share(2 * right, 2 * right + wrong + lost), right + lost]

    zero, one = of(0), of(1)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3], strict=True)]
    weighted = [share(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3], strict=True)]
    none, right = F.lit(None).cast("double"), share(F.col("c00") + F.col("c11"), total)
    lines = {"0": zero, "1": one, "accuracy": [none, none, right, total], "macro avg": [*macro, total], "weighted avg": [*weighted, total]}
    fields = ("precision", "recall", "f1_score", "support")
    rows = [F.struct(F.lit(n).alias("name"), *(c.alias(f) for c, f in zip(x, fields, strict=True))) for n, x in lines.items()]
    return cells.select(F.explode(F.array(*rows)).alias("r")).select("r.name", "r.precision", "r.recall", "r.f1_score", F.col("r.support").cast("long").alias("support"))
