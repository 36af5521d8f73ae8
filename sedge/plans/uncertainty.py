"""Queries about uncertainty, each with SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators import uncertainty as U
from sedge.plans.views import TOOL_PROBS, TOOLS, tool_probs


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of sums do not tell engines apart."""
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _h(x: str) -> str:
    return f"CASE WHEN {x} <= 0 OR {x} >= 1 THEN 0.0 ELSE -({x} * ln({x}) + (1 - {x}) * ln(1 - {x})) / ln(2) END"


MEAN = "(" + " + ".join(TOOLS) + f") / {len(TOOLS)}"
METRICS_SQL = (
    f"{TOOL_PROBS}, e AS (SELECT *, {MEAN} AS m, "
    + ", ".join(f"{_h(t)} AS {t}_entropy" for t in TOOLS)
    + " FROM tool_probs), metrics AS (SELECT *, ("
    + " + ".join(f"{t}_entropy" for t in TOOLS)
    + f") / {len(TOOLS)} AS H_exp, {_h('m')} AS H_pred FROM e), "
    "u AS (SELECT *, H_pred - H_exp AS I_bald FROM metrics)"
)


def _metrics(spark, d):
    return U.uncertainty_metrics(tool_probs(spark, d), TOOLS)


def _groups_sql(by_class: bool) -> str:
    by, label = ("coding_class", "CASE coding_class WHEN 0 THEN '_lncRNA' ELSE '_coding' END") if by_class else ("0", "''")
    return (
        f"{METRICS_SQL}, t AS (SELECT {by} AS k, quantile_cont(H_pred, 0.1) AS lo, quantile_cont(H_pred, 0.9) AS hi, "
        f"quantile_cont(I_bald, 0.9) AS se FROM u GROUP BY ALL), g AS (SELECT u.*, CASE WHEN H_pred >= hi AND I_bald >= se "
        f"THEN 'high' || {label} WHEN H_pred <= lo THEN 'low' || {label} ELSE 'middle' END AS entropy_group "
        f"FROM u JOIN t ON k = {by})"
    )


STEPS = list(range(5, 50, 5))


def uncertainty_metrics(spark, d):
    return rounded(_metrics(spark, d).drop(*TOOLS))


def ensemble_entropy(spark, d):
    return rounded(U.ensemble_entropy(tool_probs(spark, d), TOOLS).select("id", "mean_prob", "mean_inv_prob", "entropy"))


def entropy_groups_overall(spark, d):
    return U.entropy_groups(_metrics(spark, d)).select("id", "entropy_group")


def entropy_groups_by_class(spark, d):
    return U.entropy_groups(_metrics(spark, d), "class_separated").select("id", "entropy_group")


def entropy_groups_strict(spark, d):
    return U.entropy_groups(_metrics(spark, d), strict=True, default="other").select("id", "entropy_group")


def entropy_group_summary(spark, d):
    return rounded(U.group_summary(U.entropy_groups(_metrics(spark, d))))


def class_summary(spark, d):
    return rounded(U.class_summary(_metrics(spark, d)).drop("p_value"))


def group_comparisons(spark, d):
    groups = U.entropy_groups(_metrics(spark, d), "class_separated")
    return U.comparisons(groups, "id")


def tool_agreement(spark, d):
    """Of probabilities of which some are missing."""
    gaps = {t: F.when(F.pmod(F.col("id"), F.lit(7 + j)) != 0, F.col(t)) for j, t in enumerate(TOOLS)}
    return rounded(U.tool_agreement(_metrics(spark, d).withColumns(gaps), TOOLS, carried=("id",)))


def correctness_groups(spark, d):
    return rounded(U.correctness_groups(tool_probs(spark, d), TOOLS).select("id", "mean_prob", "correctness"))


def accuracy_vs_threshold(spark, d):
    return rounded(U.accuracy_by_threshold(_metrics(spark, d), TOOLS, STEPS))


def calibration_linear(spark, d):
    rows = tool_probs(spark, d).withColumn("m", U.row_mean(TOOLS))
    return rounded(U.calibration(rows, "m", "coding_class"))


def calibration_quantile(spark, d):
    rows = tool_probs(spark, d).withColumn("m", U.row_mean(TOOLS))
    return rounded(U.calibration(rows, "m", "coding_class", by="quantile"))


def calibration_error(spark, d):
    rows = tool_probs(spark, d).withColumn("m", U.row_mean(TOOLS))
    return rounded(U.calibration_error(U.calibration(rows, "m", "coding_class", by="quantile"), rows.count()))


def bootstrap_accuracy(spark, d):
    rows = tool_probs(spark, d).withColumn("m", U.row_mean(TOOLS)).select(
        "id",
        F.least(F.floor(F.col("m") * 5), F.lit(4)).alias("bin"),
        (F.col("coding_class") == 1).alias("real"),
        (F.col("m") > 0.5).alias("called"),
    )
    return rounded(U.bootstrap_accuracy(rows, "bin", "real", "called"))


def _scores_long(spark, d):
    return tool_probs(spark, d).unpivot(["id", "coding_class"], TOOLS, "tool", "p").withColumn(
        "real", F.col("coding_class") == 1
    )


def roc_auc(spark, d):
    return rounded(U.roc_auc(_scores_long(spark, d), "p", "real", ["tool"]))


def roc_points(spark, d):
    points = U.roc_points(_scores_long(spark, d), "p", "real", ["tool"])
    return rounded(
        points.select(
            "tool",
            F.round("p", 9).alias("p"),
            (F.col("tp") / F.col("positives")).alias("sensitivity"),
            (F.col("fp") / F.col("negatives")).alias("false_positive_rate"),
            (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        ),
        9,
    )


def _ensemble(spark, d):
    return tool_probs(spark, d).select(U.row_mean(TOOLS).alias("m"), (F.col("coding_class") == 1).alias("real"))


def cutoff_sweep(spark, d):
    return rounded(U.cutoff_sweep(_ensemble(spark, d), "m", "real"))


def optimal_cutoffs(spark, d):
    return rounded(U.optimal_cutoffs(U.cutoff_sweep(_ensemble(spark, d), "m", "real")))


QUERIES = {
    f.__name__: f
    for f in (
        uncertainty_metrics, ensemble_entropy, entropy_groups_overall, entropy_groups_by_class, entropy_groups_strict,
        entropy_group_summary, class_summary, group_comparisons, tool_agreement, correctness_groups,
        accuracy_vs_threshold, calibration_linear, calibration_quantile, calibration_error, bootstrap_accuracy, roc_auc,
        roc_points, cutoff_sweep, optimal_cutoffs,
    )
}

_COUNT = lambda c: "(" + " + ".join(f"CASE WHEN {c.format(t)} THEN 1 ELSE 0 END" for t in TOOLS) + ")"
_CALIB = (
    "SELECT bin, count(*) AS n, round(avg(m), 6) AS confidence, round(avg(CAST(coding_class AS DOUBLE)), 6) AS accuracy "
    "FROM b WHERE bin >= 0 GROUP BY bin"
)
_LINEAR = (
    f"WITH {TOOL_PROBS}, b AS (SELECT m, coding_class, CAST(least(ceil(m * 10) - 1, 9) AS BIGINT) AS bin "
    f"FROM (SELECT *, {MEAN} AS m FROM tool_probs))"
)
_QUANTILE = (
    f"WITH {TOOL_PROBS}, r AS (SELECT *, {MEAN} AS m FROM tool_probs), q AS (SELECT list_distinct(quantile_cont(m, ["
    + ", ".join(str(i / 10) for i in range(11))
    + "])) AS q FROM r), b AS (SELECT m, coding_class, CAST(len(list_filter(q, lambda x: x < m)) - 1 AS BIGINT) AS bin FROM r, q)"
)
_ROC = (
    f"WITH {TOOL_PROBS}, l AS (UNPIVOT tool_probs ON {', '.join(TOOLS)} INTO NAME tool VALUE p), s AS (SELECT tool, p, "
    "count(*) FILTER (coding_class = 1) AS a, count(*) FILTER (coding_class = 0) AS b FROM l GROUP BY tool, p), "
    "c AS (SELECT tool, p, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER (PARTITION BY tool) AS np, "
    "sum(b) OVER (PARTITION BY tool) AS nn FROM s WINDOW w AS (PARTITION BY tool ORDER BY p DESC))"
)
_SWEEP = (
    f"WITH {TOOL_PROBS}, r AS (SELECT {MEAN} AS m, coding_class = 1 AS real FROM tool_probs), k AS (SELECT unnest("
    "range(0, 1001)) AS k), s AS (SELECT k * 0.001::DOUBLE AS cutoff, "
    "count(*) FILTER (real AND j >= k) AS tp, count(*) FILTER (NOT real AND j >= k) AS fp, "
    "count(*) FILTER (NOT real AND j < k) AS tn, count(*) FILTER (real AND j < k) AS fn "
    "FROM k, (SELECT *, floor(round(m / 0.001::DOUBLE, 9)) AS j FROM r) GROUP BY k), "
    "w AS (SELECT *, tp::DOUBLE / nullif(tp + fn, 0) AS sensitivity, tn::DOUBLE / nullif(tn + fp, 0) AS specificity, "
    "tp::DOUBLE / nullif(tp + fp, 0) AS precision, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy, "
    "2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * "
    "(tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc FROM s)"
)


def _best(measure: str) -> str:
    return f"(SELECT cutoff FROM w WHERE {measure} IS NOT NULL ORDER BY round({measure}, 9) DESC, cutoff LIMIT 1)"


ORACLE_SQL = {
    "uncertainty_metrics": f"WITH {METRICS_SQL} SELECT id, coding_class, "
    + ", ".join(f"round({t}_entropy, 6) AS {t}_entropy" for t in TOOLS)
    + ", round(H_exp, 6) AS H_exp, round(H_pred, 6) AS H_pred, round(I_bald, 6) AS I_bald FROM u",
    "ensemble_entropy": f"WITH {METRICS_SQL} SELECT id, round(m, 6) AS mean_prob, round(1 - m, 6) AS mean_inv_prob, "
    "round(H_pred, 6) AS entropy FROM u",
    "entropy_groups_overall": f"WITH {_groups_sql(False)} SELECT id, entropy_group FROM g",
    "entropy_groups_by_class": f"WITH {_groups_sql(True)} SELECT id, entropy_group FROM g",
    "entropy_groups_strict": f"WITH {METRICS_SQL}, t AS (SELECT quantile_cont(H_pred, 0.1) AS lo, quantile_cont(H_pred, 0.9) "
    "AS hi, quantile_cont(I_bald, 0.9) AS se FROM u) SELECT id, CASE WHEN H_pred > hi AND I_bald > se THEN 'high' "
    "WHEN H_pred < lo THEN 'low' ELSE 'other' END AS entropy_group FROM u, t",
    "entropy_group_summary": f"WITH {_groups_sql(False)} SELECT coding_class, entropy_group, count(*) AS n, "
    "round(avg(H_pred), 6) AS mean_H_pred, round(avg(I_bald), 6) AS mean_I_bald FROM g GROUP BY ALL",
    "class_summary": f"WITH {METRICS_SQL}, r AS (SELECT coding_class AS k, rank() OVER (ORDER BY H_pred) + (count(*) OVER (PARTITION BY H_pred) "
    "- 1) / 2 AS r FROM u), w AS (SELECT sum(r) FILTER (k = 1) - count(*) FILTER (k = 1) * (count(*) FILTER (k = 1) + 1) / 2 AS x, "
    "count(*) FILTER (k = 1)::DOUBLE * count(*) FILTER (k = 0) AS nn FROM r), q AS (SELECT coding_class, count(H_pred) AS n, "
    "quantile_cont(H_pred, 0.5) AS median, quantile_cont(H_pred, 0.25) AS q1, quantile_cont(H_pred, 0.75) AS q3 FROM u GROUP BY ALL) SELECT "
    "coding_class, n, round(median, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, "
    "round(CAST(x AS DOUBLE), 6) AS u_stat, round(x / nn, 6) AS vda FROM q, w",
    "group_comparisons": f"WITH {_groups_sql(True)}, x AS (SELECT id, coding_class AS k, entropy_group[1:3] = 'low' AS low "
    "FROM g WHERE entropy_group <> 'middle'), "
    "y AS (SELECT 'low_vs_high' AS comparison, CASE WHEN low THEN 1 ELSE 2 END AS side, id FROM x UNION ALL "
    "SELECT CASE k WHEN 1 THEN 'low_vs_high_coding' ELSE 'low_vs_high_lncRNA' END, CASE WHEN low THEN 1 ELSE 2 END, id FROM x "
    "UNION ALL SELECT CASE WHEN low THEN 'coding_vs_lncRNA_low' ELSE 'coding_vs_lncRNA_high' END, CASE k WHEN 1 THEN 1 ELSE "
    "2 END, id FROM x) SELECT * FROM y",
    "tool_agreement": f"WITH {METRICS_SQL}, g AS (SELECT id, coding_class, H_pred, H_exp, I_bald, "
    + ", ".join(f"CASE WHEN id % {7 + j} <> 0 THEN {t} END AS {t}" for j, t in enumerate(TOOLS))
    + f" FROM u), l AS (SELECT id, x FROM (SELECT id, unnest([{', '.join(TOOLS)}]) AS x FROM g) WHERE x IS NOT NULL), s AS (SELECT id, avg(x) "
    "AS mean_prob, var_samp(x) AS variance, max(x) - min(x) AS range, count(*) FILTER (x < 0.2) AS a, count(*) FILTER (x > 0.8) AS b, "
    "count(*) FILTER (x >= 0.2 AND x <= 0.8) AS m FROM l GROUP BY id), w AS (SELECT g.*, mean_prob, variance, range, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(m, 0) AS m FROM g LEFT JOIN s USING (id)) SELECT id, round(H_pred, 6) AS H_pred, round(H_exp, 6) AS H_exp, "
    "round(I_bald, 6) AS I_bald, round(mean_prob, 6) AS mean_prob, round(variance, 6) AS variance, round(sqrt(variance), 6) AS std, "
    "round(range, 6) AS range, round(mean_prob, 6) AS ensemble_prob, CASE WHEN mean_prob > 0.5 THEN 1 ELSE 0 END AS ensemble_pred, "
    "coding_class AS true_label, a AS n_strong_lnc, b AS n_strong_coding, m AS n_moderate, a >= 2 AND b >= 2 AS extreme_disagreement, "
    "(a >= 2 AND b = 0) OR (b >= 2 AND a = 0) AS extreme_agreement, a >= 5 OR b >= 5 AS majority_agreement FROM w",
    "correctness_groups": f"WITH {TOOL_PROBS} SELECT id, round({MEAN}, 6) AS mean_prob, CASE WHEN ({MEAN} > 0.5) = "
    "(coding_class = 1) THEN 'correct' ELSE 'incorrect' END AS correctness FROM tool_probs",
    "accuracy_vs_threshold": f"WITH {METRICS_SQL}, edges AS ("
    + " UNION ALL ".join(
        f"SELECT {s} AS step, quantile_cont(H_pred, {s / 100}) AS lo, quantile_cont(H_pred, {(100 - s) / 100}) AS hi, "
        f"quantile_cont(I_bald, {(100 - s) / 100}) AS se FROM u"
        for s in STEPS
    )
    + "), g AS (SELECT step, CASE WHEN H_pred >= hi AND I_bald >= se THEN 'high' WHEN H_pred <= lo THEN 'low' ELSE 'middle' "
    "END AS entropy_group, coding_class = 1 AS r, m > 0.5 AS c FROM u, edges), n AS (SELECT step, entropy_group, count(*) AS n, "
    "count(*) FILTER (r = c) AS ok, count(*) FILTER (r AND c)::DOUBLE / nullif(count(*) FILTER (r), 0) AS se, "
    "count(*) FILTER (NOT r AND NOT c)::DOUBLE / nullif(count(*) FILTER (NOT r), 0) AS sp FROM g GROUP BY ALL) "
    "SELECT step, entropy_group, n, round(ok / n, 6) AS accuracy, "
    "round(CASE WHEN se IS NULL THEN sp WHEN sp IS NULL THEN se ELSE (se + sp) / 2 END, 6) AS balanced_accuracy FROM n",
    "calibration_linear": f"{_LINEAR} {_CALIB}",
    "calibration_quantile": f"{_QUANTILE} {_CALIB}",
    "calibration_error": f"{_QUANTILE}, c AS (SELECT count(*) AS n, avg(m) AS p, avg(CAST(coding_class AS DOUBLE)) AS a FROM b "
    "WHERE bin >= 0 GROUP BY bin) SELECT round(sum(n * abs(a - p)) / (SELECT count(*) FROM b), 6) AS ece FROM c",
    "roc_auc": f"{_ROC}, x AS (SELECT tool, np, nn, (fp - coalesce(lag(fp) OVER w, 0)) * (tp + coalesce(lag(tp) OVER w, 0)) "
    "/ 2 AS area FROM c WINDOW w AS (PARTITION BY tool ORDER BY p DESC)) SELECT tool, round(CAST(sum(area) / max(np) / "
    "max(nn) AS DOUBLE), 6) AS auc FROM x GROUP BY tool",
    "roc_points": f"{_ROC} SELECT tool, round(p, 9) AS p, round(CAST(tp / np AS DOUBLE), 9) AS sensitivity, "
    "round(CAST(fp / nn AS DOUBLE), 9) AS false_positive_rate, round(CAST(tp / (tp + fp) AS DOUBLE), 9) AS precision FROM c",
    "cutoff_sweep": f"{_SWEEP} SELECT round(cutoff, 6) AS cutoff, tp, fp, tn, fn, round(sensitivity, 6) AS sensitivity, "
    "round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(accuracy, 6) AS accuracy, "
    "round(f1, 6) AS f1, round(mcc, 6) AS mcc, round(sensitivity + specificity - 1, 6) AS youden FROM w",
    "optimal_cutoffs": f"{_SWEEP}, o AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS strategy, {_best(m)} AS cutoff"
        for n, m in (
            ("accuracy", "accuracy"), ("youden", "sensitivity + specificity - 1"), ("f1", "f1"), ("mcc", "mcc"),
            ("balanced", "-abs(sensitivity - specificity)"),
        )
    )
    + " UNION ALL SELECT 'default', 0.5) SELECT strategy, round(CAST(cutoff AS DOUBLE), 6) AS cutoff, "
    "strategy = 'balanced' AS final FROM o",
}
