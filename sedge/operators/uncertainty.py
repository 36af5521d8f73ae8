"""Uncertainty of an ensemble of binary classifiers, and groups of rows by it.

Everything about single rows is one projection. Thresholds are percentiles, exact ones from values ranked in
ranges (ranks.py); they are joined back by class (or by a constant), a table of a few rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.numbers import binary_entropy
from sedge.operators.ranks import QUARTILES, quantiles, quantiles_of, with_quantiles
from sedge.operators.stats import mann_whitney, with_p

CLASS_LABELS = {0: "lncRNA", 1: "coding"}


def row_mean(columns: list[str]) -> Column:
    return reduce(add, (F.col(c) for c in columns)) / len(columns)


def uncertainty_metrics(probs: DataFrame, tools: list[str]) -> DataFrame:
    """Adds {tool}_entropy, H_exp (their mean), H_pred (entropy of the mean probability) and I_bald, their difference.
    A row with a null probability has null metrics."""
    each = {f"{t}_entropy": binary_entropy(F.col(t)) for t in tools}
    return (
        probs.withColumns(each)
        .withColumn("H_exp", row_mean(list(each)))
        .withColumn("H_pred", binary_entropy(row_mean(tools)))
        .withColumn("I_bald", F.col("H_pred") - F.col("H_exp"))
    )


def ensemble_entropy(probs: DataFrame, tools: list[str]) -> DataFrame:
    mean = row_mean(tools)
    return probs.withColumns(
        {"mean_prob": mean, "mean_inv_prob": 1 - mean, "entropy": binary_entropy(mean)}
    )


def entropy_groups(
    metrics: DataFrame,
    mode: str = "overall",
    low: float = 10,
    high: float = 90,
    column: str = "H_pred",
    second: str | None = "I_bald",
    second_high: float | None = None,
    class_column: str = "coding_class",
    strict: bool = False,
    default: str = "middle",
    accuracy: int | None = None,
) -> DataFrame:
    """Adds entropy_group. Low: at most the low percentile of `column`; high: at least its high percentile and, if there
    is a second column, at least its own. A row that is both is high. By class, percentiles are taken within each class
    and labels end in it. strict compares with < and >. accuracy: approximate percentiles in one pass; this moves group
    edges."""
    if mode not in ("overall", "class_separated"):
        raise ValueError("mode must be overall or class_separated")
    missing = {column, *([class_column] if mode == "class_separated" else [])} - set(metrics.columns)
    if missing:
        raise ValueError(f"no such column: {', '.join(sorted(missing))}")
    use_second = second is not None and second in metrics.columns
    by = F.col(class_column) if mode == "class_separated" else F.lit(0)
    keyed = metrics.withColumn("__by", by)
    known = keyed.where(F.col("__by").isNotNull())
    shares = {"__low": low / 100, "__high": high / 100}
    upper = {"__second": (high if second_high is None else second_high) / 100}
    if accuracy:
        rough = lambda c, of: [F.percentile_approx(c, share, accuracy).alias(n) for n, share in of.items()]
        thresholds = known.groupBy("__by").agg(*rough(column, shares), *(rough(second, upper) if use_second else []))
    else:
        thresholds = quantiles_of(known, ["__by"], {column: shares} | ({second: upper} if use_second else {}))
    c = F.col(column)
    is_low = c < F.col("__low") if strict else c <= F.col("__low")
    is_high = c > F.col("__high") if strict else c >= F.col("__high")
    if use_second:
        s = F.col(second)
        is_high &= s > F.col("__second") if strict else s >= F.col("__second")
    label = F.lit("")
    if mode == "class_separated":
        named = reduce(lambda a, kv: a.when(F.col("__by") == kv[0], kv[1]), CLASS_LABELS.items(), F)
        label = F.concat(F.lit("_"), named.otherwise(F.col("__by").cast("string")))
    group = (
        F.when(is_high, F.concat(F.lit("high"), label)).when(is_low, F.concat(F.lit("low"), label)).otherwise(default)
    )
    return (
        keyed.join(thresholds, "__by", "left")
        .withColumn("entropy_group", group)
        .drop("__by", "__low", "__high", "__second")
    )


def low_and_high(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = F.col("entropy_group")
    return groups.where(g.startswith("low")), groups.where(g.startswith("high"))


def group_summary(groups: DataFrame, class_column: str = "coding_class") -> DataFrame:
    return groups.groupBy(class_column, "entropy_group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("H_pred").alias("mean_H_pred"), F.avg("I_bald").alias("mean_I_bald")
    )


def class_summary(metrics: DataFrame, column: str = "H_pred", class_column: str = "coding_class") -> DataFrame:
    """Median, quartiles and their distance (iqr) by class, and U, VDA and p of class 1 against 0, nulls left out."""
    counts = metrics.groupBy(class_column).agg(F.count(column).alias("n"))
    rows = metrics.select(F.lit("u").alias("__by"), F.col(column).alias("value"), F.col(class_column).alias("grp"))
    u = with_p(mann_whitney(rows, ["__by"], drop_constant=False, drop_nulls=True, ties=True))
    tests = u.select(F.lit(1).alias("__on"), F.col("statistic").alias("u_stat"), "vda", "p_value")
    summary = with_quantiles(counts, metrics, [class_column], column, QUARTILES)
    return summary.withColumns({"iqr": F.col("q3") - F.col("q1"), "__on": F.lit(1)}).join(tests, "__on", "left").drop("__on")  # one row


def comparisons(groups: DataFrame, id_column: str, class_column: str = "coding_class") -> DataFrame:
    """Membership in the contrasts of group labels, long: comparison, side (1 or 2), id. Low against high of all rows and
    of each class, and coding against lncRNA within the low and the high rows."""
    g, k = F.col("entropy_group"), F.col(class_column)
    low, high = g.startswith("low"), g.startswith("high")
    side = F.when(low, 1).when(high, 2)
    kind = F.when(k == 1, 1).otherwise(2)
    item = lambda name, s, on: F.when(on, F.struct(F.lit(name).alias("comparison"), s.alias("side")))
    every = F.array(
        item("low_vs_high", side, low | high),
        item("low_vs_high_coding", side, (low | high) & (k == 1)),
        item("low_vs_high_lncRNA", side, (low | high) & (k == 0)),
        item("coding_vs_lncRNA_low", kind, low),
        item("coding_vs_lncRNA_high", kind, high),
    )
    return groups.select(F.col(id_column).alias("id"), F.explode(F.array_compact(every)).alias("x")).select(
        "x.comparison", "x.side", "id"
    )


def tool_agreement(
    metrics: DataFrame, tools: list[str], low: float = 0.2, high: float = 0.8, extreme: int = 2, real: str = "coding_class",
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of uncertainty_metrics(), with its key and carried columns: mean, variance and standard deviation (n - 1) and
    range of the tools' probabilities, the ensemble's call, the true label, and strong calls below `low` and above `high`.
    Extreme disagreement: at least `extreme` strong calls on either side; extreme agreement: as many on one side and
    none on the other; majority agreement: more than half of all tools strong on one side. A null probability is no
    strong and no moderate call; statistics are over the others."""
    total = lambda f: reduce(add, (F.when(f(F.col(t)), 1).otherwise(0) for t in tools))
    known = lambda f: reduce(add, (F.coalesce(f(F.col(t)), F.lit(0.0)) for t in tools))
    n = total(lambda p: p.isNotNull())
    mean = F.try_divide(known(lambda p: p), n)
    m = F.col("mean_prob")
    coding, noncoding = F.col("n_strong_coding"), F.col("n_strong_lnc")
    majority = len(tools) // 2 + 1
    added = (
        metrics.withColumn("mean_prob", mean)
        .withColumn("variance", F.when(n > 1, known(lambda p: (p - m) * (p - m)) / (n - 1)))
        .withColumn("std", F.sqrt("variance"))
        .withColumn("range", F.greatest(*tools) - F.least(*tools))
        .withColumn("ensemble_prob", m)
        .withColumn("ensemble_pred", F.coalesce((m > 0.5).cast("int"), F.lit(0)))
        .withColumn("true_label", F.col(real))
        .withColumn("n_strong_lnc", total(lambda p: p < low))
        .withColumn("n_strong_coding", total(lambda p: p > high))
        .withColumn("n_moderate", total(lambda p: (p >= low) & (p <= high)))
        .withColumn("extreme_disagreement", (noncoding >= extreme) & (coding >= extreme))
        .withColumn("extreme_agreement", ((noncoding >= extreme) & (coding == 0)) | ((coding >= extreme) & (noncoding == 0)))
        .withColumn("majority_agreement", (noncoding >= majority) | (coding >= majority))
    )
    names = [
        "mean_prob", "variance", "std", "range", "ensemble_prob", "ensemble_pred", "true_label", "n_strong_lnc", "n_strong_coding",
        "n_moderate", "extreme_disagreement", "extreme_agreement", "majority_agreement",
    ]
    return added.select(*carried, "H_pred", "H_exp", "I_bald", *names)


def correctness_groups(probs: DataFrame, tools: list[str], real: str = "coding_class") -> DataFrame:
    """Adds mean_prob and correctness of the call mean_prob > 0.5."""
    called = F.col("mean_prob") > 0.5
    return probs.withColumn("mean_prob", row_mean(tools)).withColumn(
        "correctness", F.when(called == (F.col(real) == 1), "correct").otherwise("incorrect")
    )


def accuracy_by_threshold(
    metrics: DataFrame, tools: list[str], steps: list[int], column: str = "H_pred", second: str = "I_bald"
) -> DataFrame:
    """For each step t: rows at most the t-th percentile of `column` are low, at least the (100 - t)-th of it and of
    `second` high; number, accuracy and balanced accuracy of the ensemble's calls in each group. Every row
    is met with the percentiles by a join on a constant with one row for each step."""
    above = lambda name: {f"{name}_{t}": (100 - t) / 100 for t in steps}
    found = quantiles_of(metrics, [], {column: {f"low_{t}": t / 100 for t in steps} | above("high"), second: above("second")})
    listed = lambda name: F.array(*(F.col(f"{name}_{t}") for t in steps)).alias(name)
    edges = found.select(
        F.explode(F.arrays_zip(F.array(*map(F.lit, steps)).alias("step"), listed("low"), listed("high"), listed("second"))).alias("e")
    )
    edges = edges.select("e.*").withColumn("__on", F.lit(1))
    rows = metrics.select(
        F.lit(1).alias("__on"), column, second, (F.col("coding_class") == 1).alias("real"), (row_mean(tools) > 0.5).alias("called")
    )
    group = (
        F.when((F.col(column) >= F.col("high")) & (F.col(second) >= F.col("second")), "high")
        .when(F.col(column) <= F.col("low"), "low")
        .otherwise("middle")
    )
    real, called = F.col("real"), F.col("called")
    counts = (
        rows.join(F.broadcast(edges), "__on")  # a row for each step
        .groupBy("step", group.alias("entropy_group"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(real & called).alias("tp"),
            F.count_if(~real & ~called).alias("tn"),
            F.count_if(real).alias("p"),
        )
    )
    sens, spec = F.try_divide("tp", "p"), F.try_divide(F.col("tn"), F.col("n") - F.col("p"))
    return counts.select(
        "step",
        "entropy_group",
        "n",
        ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
        F.when(sens.isNull(), spec).when(spec.isNull(), sens).otherwise((sens + spec) / 2).alias("balanced_accuracy"),
    )


def calibration(rows: DataFrame, p: str, real: str, bins: int = 10, by: str = "linear") -> DataFrame:
    """bin, n, confidence (mean p) and accuracy (share of real) of bins of equal width or (quantile) of equal size. Bin i
    holds values above edge i up to edge i + 1; a value equal to the first quantile edge is in none, as in the
    right-closed binning of the sources of this measure."""
    v = F.col(p)
    if by == "linear":
        binned = rows.select(
            v.alias("p"), F.col(real).cast("double").alias("real"), F.least(F.ceil(v * bins) - 1, F.lit(bins - 1)).alias("bin")
        )
    elif by == "quantile":
        ends = quantiles(rows, [], p, {f"e{i}": i / bins for i in range(bins + 1)})
        # equal quantiles are one edge
        edges = ends.select(F.array_sort(F.array_distinct(F.array(*ends.columns))).alias("edges"), F.lit(1).alias("__on"))
        place = F.size(F.filter("edges", lambda e: e < v)) - 1
        binned = rows.withColumn("__on", F.lit(1)).join(edges, "__on").select(
            v.alias("p"), F.col(real).cast("double").alias("real"), place.cast("bigint").alias("bin")
        )
    else:
        raise ValueError(f"unknown kind of bins: {by}")
    return (
        binned.where(F.col("bin") >= 0)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("real").alias("accuracy"))
    )


def calibration_error(calibrated: DataFrame, rows: int | Column | None = None) -> DataFrame:
    """The expected calibration error: gaps weighed by their bins' shares of all `rows`, those in no bin included; without
    a number of these, of the rows in bins."""
    n = F.col("n")
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    whole = F.sum(n) if rows is None else F.lit(rows)
    return calibrated.agg((F.sum(n * gap) / whole).alias("ece"))


def bootstrap_accuracy(rows: DataFrame, bin_column: str, real: str, called: str, n_boot: int = 100, seed: int = 42) -> DataFrame:
    """Mean and percentile interval of the balanced accuracy in each bin over `n_boot` resamples of all rows, each with
    replacement and as large as the table. Rows matter only by bin, truth and call, so a resample is a draw of how many rows
    fall into each such cell: they are counted once, and all resamples are drawn from the counts, with the very
    distribution that drawing the rows has. A class that a bin lacks in a resample does not count, nor a resample without
    rows in the bin. There are as many cells as four times the bins."""
    kind = rows.schema[bin_column].dataType.simpleString()
    cells = rows.where(F.col(real).isNotNull() & F.col(called).isNotNull()).groupBy(
        F.col(bin_column).alias("bin"), F.col(real).cast("boolean").alias("real"), F.col(called).cast("boolean").alias("called")
    ).agg(F.count(F.lit(1)).alias("n"))

    def draw(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bin", "ascending"), ("real", "ascending"), ("called", "ascending")])
        bins = table["bin"].combine_chunks().dictionary_encode(null_encoding="encode")
        bins = bins.combine_chunks() if isinstance(bins, pa.ChunkedArray) else bins
        n, of = table["n"].to_numpy(), bins.indices.to_numpy(zero_copy_only=False)
        was, said = (table[c].to_numpy() for c in ("real", "called"))
        drawn = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), n_boot)
        k = len(bins.dictionary)

        def total(which: np.ndarray) -> np.ndarray:
            out = np.zeros((n_boot, k))
            np.add.at(out.T, of[which], drawn[:, which].T)
            return out

        with np.errstate(invalid="ignore", divide="ignore"):
            right = np.stack([total(was & said) / total(was), total(~was & ~said) / total(~was)])
            share = np.nansum(right, axis=0) / (~np.isnan(right)).sum(axis=0)
        rows = [(float(np.mean(x)), *np.percentile(x, [2.5, 97.5]).tolist()) if len(x) else (None,) * 3 for x in (c[~np.isnan(c)] for c in share.T)]
        mean, low, high = zip(*rows, strict=True)
        return pa.table({bin_column: bins.dictionary, "mean": pa.array(mean, pa.float64()), "low": pa.array(low, pa.float64()), "high": pa.array(high, pa.float64())})

    return cells.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(draw, f"{bin_column} {kind}, mean double, low double, high double")


def roc_points(rows: DataFrame, score: str, real: str, by: list[str]) -> DataFrame:
    """Cumulated true and false positives at each different score, from the highest down, within `by`: tp and fp, those of
    the scores above (tp0, fp0), positives and negatives in all."""
    from sedge.operators.ranks import running

    seen = rows.groupBy(*by, score).agg(
        F.count_if(F.col(real)).alias("__real"), F.count_if(~F.col(real)).alias("__other")
    )
    whole = seen.groupBy(*by).agg(F.sum("__real").alias("positives"), F.sum("__other").alias("negatives"))
    summed = running(seen, by, score, ["__real", "__other"], descending=True)
    return summed.join(whole, by).select(
        *by,
        score,
        (F.col("before___real") + F.col("__real")).alias("tp"),
        (F.col("before___other") + F.col("__other")).alias("fp"),
        F.col("before___real").alias("tp0"),
        F.col("before___other").alias("fp0"),
        "positives",
        "negatives",
    )


def precision_recall_points(rows: DataFrame, score: str, real: str, by: list[str]) -> DataFrame:
    """Precision and recall of calls at or above each different score, within `by`."""
    tp, fp = F.col("tp"), F.col("fp")
    return roc_points(rows, score, real, by).select(
        *by, score, F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, F.col("positives")).alias("recall")
    )


def roc_auc(rows: DataFrame, score: str, real: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve: positives' rank sum, over different scores."""
    area = (F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2
    points = roc_points(rows, score, real, by).withColumn("area", area)
    return points.groupBy(*by).agg((F.sum("area") / F.max("positives") / F.max("negatives")).alias("auc"))


def cutoff_sweep(rows: DataFrame, score: str, real: str, step: float = 0.001) -> DataFrame:
    """Counts and measures at cutoffs 0, step, ..., 1 for calls score >= cutoff. Scores are first counted by the highest
    cutoff they reach, so the sums that run over the cutoffs read at most one row for each."""
    from pyspark.sql import Window

    steps = round(1 / step)
    reach = F.floor(F.round(F.col(score) / step, 9)).cast("int")
    seen = rows.groupBy(reach.alias("k")).agg(F.count_if(F.col(real)).alias("p"), F.count_if(~F.col(real)).alias("n"))
    spine = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    whole = spine.join(seen, "k", "left").fillna(0, ["p", "n"]).withColumn("__one", F.lit(0))  # steps + 1 rows
    up = Window.partitionBy("__one").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("__one")
    tp, fp = F.sum("p").over(up), F.sum("n").over(up)
    counts = whole.select(
        (F.col("k") * step).alias("cutoff"),
        tp.alias("tp"),
        fp.alias("fp"),
        (F.sum("n").over(every) - fp).alias("tn"),
        (F.sum("p").over(every) - tp).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns(
        {
            "sensitivity": F.try_divide(tp, tp + fn),
            "specificity": F.try_divide(tn, tn + fp),
            "precision": F.try_divide(tp, tp + fp),
            "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
            "mcc": F.try_divide(tp * tn - fp * fn, root),
        }
    ).withColumn("youden", F.col("sensitivity") + F.col("specificity") - 1)


def optimal_cutoffs(sweep: DataFrame) -> DataFrame:
    """strategy and cutoff: the best by each measure (the lowest of equals), the one that balances sensitivity and
    specificity, and 0.5; the balanced one is final."""
    best = lambda c: F.max_by("cutoff", F.struct(F.round(c, 9), -F.col("cutoff")))
    found = sweep.agg(
        best(F.col("accuracy")).alias("accuracy"),
        best(F.col("youden")).alias("youden"),
        best(F.col("f1")).alias("f1"),
        best(F.col("mcc")).alias("mcc"),
        best(-F.abs(F.col("sensitivity") - F.col("specificity"))).alias("balanced"),
    ).withColumn("default", F.lit(0.5))
    names = ["accuracy", "youden", "f1", "mcc", "balanced", "default"]
    return found.unpivot([], names, "strategy", "cutoff").withColumn("final", F.col("strategy") == "balanced")
