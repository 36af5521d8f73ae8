"""Queries about tests, each with SQL that gives the same where SQL has the functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions.numbers import f_tail
from sedge.operators import information, normality
from sedge.operators import stats as S
from sedge.operators.ranks import tied_ranks
from sedge.plans.uncertainty import rounded
from sedge.plans.views import (
    CATEGORIES, FEATURES_LONG, LINE_FEATURES, TOOL_LABELS, TOOL_PROBS, TOOLS, categories, features_long, line_features,
    table, tool_labels, tool_probs,
)

BY = ["feature"]


def _long(spark, d):
    return features_long(spark, d).select("id", "feature", "value", F.col("coding_class").alias("grp"))


def mwu_stats(spark, d):
    return rounded(S.mann_whitney(_long(spark, d), BY))


def mwu_lines(spark, d):
    return rounded(S.mann_whitney(line_features(spark, d), BY))


def mwu_pvalues(spark, d):
    return rounded(S.adjusted(S.with_p(S.mann_whitney(_long(spark, d), BY, ties=True))), 9)


def cliffs_delta(spark, d):
    both = S.cliffs_delta(S.mann_whitney(_long(spark, d), BY)).select("feature", "cliffs_delta")
    return rounded(both.join(S.cliffs_delta_ref(_long(spark, d), BY), "feature"))


def chi2_stats(spark, d):
    return rounded(S.chi_square(S.contingency(categories(spark, d), BY), BY))


def chi2_pvalues(spark, d):
    return rounded(S.with_chi_p(S.chi_square(S.contingency(categories(spark, d), BY), BY)), 9)


def chi2_plus_half(spark, d):
    tests = S.chi_square(S.contingency(categories(spark, d), BY), BY, plus=0.5, yates=False)
    return rounded(tests.select("feature", "statistic", F.sqrt(F.col("statistic") / F.col("n")).alias("phi")))


def odds_haldane(spark, d):
    return rounded(S.haldane_odds(S.contingency(categories(spark, d), BY), BY))


def contingency_table(spark, d):
    return S.contingency(categories(spark, d), BY)


def _p_family(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_orderkey") % 5).alias("family"),
        F.col("o_orderkey").alias("test"),
        (F.pmod(F.col("o_totalprice").cast("decimal(18,2)") * 100, F.lit(9973)).cast("double") / 9973).alias("p_value"),
    )


def _adjusted(method):
    def run(spark, d):
        out = S.adjusted(_p_family(spark, d), by=["family"], method=method, alpha=0.05)
        return rounded(out, 9)

    run.__name__ = {"fdr_bh": "bh_fdr", "fdr_by": "by_fdr"}.get(method, method)
    return run


def _contrasts(spark, d):
    rows = features_long(spark, d).select(
        "feature",
        F.when(F.col("id") % 11 != 0, F.col("value")).alias("value"),
        F.when(F.col("coding_class") == 0, F.concat(F.lit("n"), F.col("id") % 2)).otherwise(F.concat(F.lit("c"), F.col("id") % 2)).alias("label"),
    )
    contrasts = spark.createDataFrame([("n", "n0", "n1"), ("c", "c0", "c1"), ("nc", "n0", "c0")], "name string, g1 string, g2 string")
    return S.contrast_tests(rows, contrasts)


def contrast_mwu(spark, d):
    return rounded(_contrasts(spark, d).drop("z", "p_value", "p_fdr", "sig_fdr05", "logp_score"))


def contrast_pvalues(spark, d):
    return rounded(_contrasts(spark, d).select("name", "feature", "p_value", "p_fdr", "sig_fdr05", "logp_score"), 9)


def f_test_pvalues(spark, d):
    return rounded(S.f_tests(_long(spark, d), BY), 9)


def normality_tests(spark, d):
    """Whether each feature is normal in either class, and whether its variances are equal."""
    rows = _long(spark, d)
    w = normality.shapiro_wilk(rows, ["feature", "grp"]).groupBy("feature").agg(
        *(F.max(F.when(F.col("grp") == g, F.col("p_value"))).alias(f"normality_{g}_p") for g in (0, 1))
    )
    spread = S.levene(rows, BY).select("feature", f_tail(F.col("f"), F.col("df1"), F.col("df2")).alias("levene_p"))
    both = (F.col("normality_0_p") > 0.05) & (F.col("normality_1_p") > 0.05)
    return rounded(w.join(spread, "feature").withColumns({"normal_both": both, "equal_var": F.col("levene_p") > 0.05}), 9)


def neighbour_information(spark, d):
    return rounded(information.neighbour_information(_long(spark, d).where("feature IN ('f8', 'f9', 'f10', 'f11')"), BY))


def anova_f(spark, d):
    rows = table(spark, d, "embeddings").select(
        F.col("label").alias("grp"), *(F.col("embedding")[j].cast("double").alias(f"f{j}") for j in range(8, 24))
    ).unpivot(["grp"], [f"f{j}" for j in range(8, 24)], "feature", "value")
    return rounded(S.anova_f(rows, BY))


def levene(spark, d):
    return rounded(S.levene(_long(spark, d), BY))


def mutual_information(spark, d):
    return rounded(S.mutual_information(_long(spark, d), BY))


def spearman_matrix(spark, d):
    return rounded(S.spearman(features_long(spark, d)))


def spearman_tools(spark, d):
    long = tool_probs(spark, d).unpivot(["id"], TOOLS, "feature", "value")
    return rounded(S.spearman(long))


def kendall_matrix(spark, d):
    return rounded(S.kendall(features_long(spark, d).select("id", "feature", "value")))


def kappa_matrix(spark, d):
    return rounded(S.cohen_kappa(tool_labels(spark, d), "id", TOOLS))


def midranks(spark, d):
    """Values of each feature ranked by how many rows have them."""
    counts = line_features(spark, d).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return rounded(tied_ranks(counts, BY, "n").drop("n").withColumn("value", F.round("value", 4)))


def composite_rank(spark, d):
    tests = S.mann_whitney(_long(spark, d), BY).select("feature", "abs_vda", F.abs("z").alias("abs_z"))
    return rounded(S.composite_rank(tests, ["abs_vda", "abs_z"]))


def cat_frequency(spark, d):
    return rounded(S.frequency_by_group(categories(spark, d), BY))


def _elements(spark, d):
    v = F.round(F.col("value") * 100)
    rows = line_features(spark, d).where("feature IN ('discount', 'tax')").select(
        "feature", "grp", F.when(v != 3, v).alias("value"), F.when(v > 0, v * v - 3 * v).alias("coverage")
    )
    return S.element_statistics(rows, BY, coverage="coverage")


P_COLUMNS = ["p_value", "p_value_coverage", "p_chi2"]


def element_statistics(spark, d):
    return rounded(_elements(spark, d).drop(*P_COLUMNS))


def element_pvalues(spark, d):
    """The p-values of element_statistics, corrected as one family."""
    tests = _elements(spark, d).select("feature", *P_COLUMNS)
    return rounded(tests.join(S.pooled_adjusted(tests, "feature", P_COLUMNS), "feature"), 9)


METHODS = ("fdr_bh", "fdr_by", "holm", "bonferroni")
QUERIES = {
    f.__name__: f
    for f in (
        mwu_stats, mwu_lines, mwu_pvalues, cliffs_delta, chi2_stats, chi2_pvalues, chi2_plus_half, odds_haldane,
        contingency_table, *map(_adjusted, METHODS), contrast_mwu, anova_f, levene, mutual_information, spearman_matrix,
        spearman_tools, kendall_matrix, kappa_matrix, midranks, composite_rank, cat_frequency, element_statistics,
        element_pvalues, contrast_pvalues, f_test_pvalues, normality_tests, neighbour_information,
    )
}

_LONG = f"{FEATURES_LONG}, l AS (SELECT id, feature, value, coding_class AS grp FROM features_long)"


def _u(source: str, by: str = "feature") -> str:
    """CTEs that end in u, from rows of `source`, row by row."""
    return (
        f"r AS (SELECT {by}, grp, value, rank() OVER (PARTITION BY {by} ORDER BY value) + (count(*) OVER (PARTITION BY {by}, "
        f"value) - 1) / 2 AS k FROM {source}), ties AS (SELECT {by}, sum(t * t * t - t) AS ties, count(*) AS vals FROM (SELECT "
        f"{by}, value, CAST(count(*) AS DOUBLE) AS t FROM {source} GROUP BY ALL) GROUP BY ALL), s AS (SELECT {by}, "
        f"count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp = 1) AS n2, sum(k) FILTER (grp = 1) AS r2 FROM r GROUP BY ALL), "
        f"w AS (SELECT *, r2 - n2 * (n2 + 1) / 2 AS u, n1::DOUBLE * n2 AS nn, (n1 + n2)::DOUBLE AS n FROM s JOIN ties USING ({by}) "
        f"WHERE vals > 1), u AS (SELECT {by}, n1, n2, u AS statistic, greatest(abs(u - nn / 2) - 0.5, 0) * sign(u - nn / 2) / "
        f"nullif(sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))), 0) AS z, u / nn AS vda, abs(u / nn - 0.5) AS abs_vda FROM w)"
    )


_U = "round(CAST(statistic AS DOUBLE), 6) AS statistic, round(z, 6) AS z, round(vda, 6) AS vda, round(abs_vda, 6) AS abs_vda"
_CELLS = (
    f"WITH {CATEGORIES}, c AS (SELECT feature, coalesce(value, 0) AS value, grp, count(*) AS n FROM categories GROUP BY ALL), "
    "k AS (SELECT a.feature, a.value, b.grp, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT feature, value FROM c) a "
    "JOIN (SELECT DISTINCT feature, grp FROM c) b USING (feature) LEFT JOIN c USING (feature, value, grp))"
)


def _chi(plus: str, yates: bool) -> str:
    gap = "abs(o - e) - least(0.5, abs(o - e))" if yates else "abs(o - e)"
    return (
        f"{_CELLS}, x AS (SELECT *, n + {plus} AS o FROM k), y AS (SELECT *, (sum(o) OVER (PARTITION BY feature, value))::DOUBLE * "
        "(sum(o) OVER (PARTITION BY feature, grp)) / (sum(o) OVER (PARTITION BY feature)) AS e, "
        "row_number() OVER (PARTITION BY feature ORDER BY value, grp) AS i FROM x), z AS (SELECT feature, "
        f"sum(({gap}) ** 2 / e) AS chi, sum(o)::DOUBLE AS total, (max(n) FILTER (i = 1) + 0.5) * (max(n) FILTER (i = 4) + 0.5) / "
        "((max(n) FILTER (i = 2) + 0.5) * (max(n) FILTER (i = 3) + 0.5)) AS odds FROM y GROUP BY feature)"
    )


def _adjust_sql(method: str) -> str:
    raw = {
        "fdr_bh": "min(p_value * n / k) OVER (PARTITION BY family ORDER BY k DESC)",
        "fdr_by": "min(p_value * n / k * h) OVER (PARTITION BY family ORDER BY k DESC)",
        "holm": "max(p_value * (n - k + 1)) OVER (PARTITION BY family ORDER BY k)",
        "bonferroni": "p_value * n",
    }[method]
    return (
        "WITH f AS (SELECT o_orderkey % 5 AS family, o_orderkey AS test, CAST((CAST(o_totalprice AS DECIMAL(18, 2)) * 100) % 9973 "
        "AS DOUBLE) / 9973 AS p_value FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY "
        "family ORDER BY p_value, test) AS k, count(*) OVER (PARTITION BY family) AS n FROM f), h AS (SELECT *, "
        "list_sum(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / i)) AS h FROM k), a AS (SELECT *, "
        f"least({raw}, 1.0) AS adj FROM h) SELECT family, test, round(p_value, 9) AS p_value, round(adj, 9) AS adj_p, "
        "adj < 0.05 AS significant FROM a"
    )


def _corr(source: str) -> str:
    return (
        f"k AS (SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, "
        f"value) - 1) / 2 AS r FROM {source}) SELECT a.feature AS f1, b.feature AS f2, round(corr(a.r, b.r), 6) AS rho "
        "FROM k a JOIN k b ON a.id = b.id AND a.feature < b.feature GROUP BY ALL"
    )


def _anova(rows: str) -> str:
    return (
        f"g AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, sum(value) AS s FROM {rows} GROUP BY ALL), t AS (SELECT "
        "feature, sum(s) / sum(n) AS m, count(*) AS k, sum(n) AS n FROM g GROUP BY ALL), b AS (SELECT feature, sum(g.n * (g.m - "
        "t.m) ** 2) AS b FROM g JOIN t USING (feature) GROUP BY ALL), w AS (SELECT feature, sum((value - m) ** 2) AS w FROM "
        f"{rows} JOIN g USING (feature, grp) GROUP BY ALL) SELECT feature, round((b / (k - 1)) / (w / (n - k)), 6) AS f, "
        "k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM t JOIN b USING (feature) JOIN w USING (feature)"
    )


_LABELLED = (
    f"WITH {FEATURES_LONG}, x AS (SELECT feature, value, CASE coding_class WHEN 0 THEN 'n' ELSE 'c' END || (id % 2) AS label FROM "
    "features_long WHERE id % 11 <> 0), c(name, g1, g2) AS (VALUES ('n', 'n0', 'n1'), ('c', 'c0', 'c1'), ('nc', 'n0', 'c0')), m AS (SELECT "
    "name, feature, value, label = g1 AS one, rank() OVER w + (count(*) OVER (PARTITION BY name, feature, value) - 1) / 2 AS k FROM x JOIN c "
    "ON label IN (g1, g2) WINDOW w AS (PARTITION BY name, feature ORDER BY value)), u AS (SELECT name, feature, count(*) FILTER (one) AS n1, "
    "count(*) FILTER (NOT one) AS n2, sum(k) FILTER (one) AS r1, quantile_cont(value, 0.5) FILTER (one) AS m1, quantile_cont(value, 0.5) FILTER "
    "(NOT one) AS m2 FROM m GROUP BY ALL), v AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u_stat, u_stat / (n1::DOUBLE * n2) AS vda, (2 * r1 / (n1::DOUBLE * "
    "(n1 + n2)) - 1) * sign(m1 - m2) AS delta, m1 - m2 AS md FROM u WHERE n1 > 50 AND n2 > 50), e AS (SELECT *, abs(delta) AS effect_size, "
    "abs(vda - 0.5) AS vda_deviation, abs(md) / coalesce(stddev_samp(md) OVER (PARTITION BY name), 1) AS norm_diff FROM v), f AS (SELECT *, "
    "(rank() OVER (ORDER BY effect_size) + rank() OVER (ORDER BY vda_deviation) + rank() OVER (ORDER BY norm_diff)) / 3 / count(*) OVER () AS "
    "meta_rank FROM e)"
)
ORACLE_SQL = {
    "mwu_stats": f"WITH {_LONG}, {_u('l')} SELECT feature, n1, n2, {_U} FROM u",
    "mwu_lines": f"WITH {LINE_FEATURES}, {_u('line_features')} SELECT feature, n1, n2, {_U} FROM u",
    "cliffs_delta": f"WITH {_LONG}, {_u('l')}, m AS (SELECT feature, quantile_cont(value, 0.5) FILTER (grp = 0) AS m1, "
    "quantile_cont(value, 0.5) FILTER (grp = 1) AS m2, sum(k) FILTER (grp = 0) AS r1 FROM r GROUP BY ALL) SELECT feature, "
    "round(vda * 2 - 1, 6) AS cliffs_delta, round((2 * r1 / (n1::DOUBLE * (n1 + n2)) - 1) * sign(m1 - m2), 6) AS "
    "cliffs_delta_ref FROM u JOIN m USING (feature)",
    "chi2_stats": f"{_chi('0', True)} SELECT feature, round(chi, 6) AS statistic, CAST(1 AS BIGINT) AS dof, total AS n, "
    "round(sqrt(chi / total), 6) AS cramers_v, round(odds, 6) AS odds_ratio FROM z",
    "chi2_plus_half": f"{_chi('0.5', False)} SELECT feature, round(chi, 6) AS statistic, round(sqrt(chi / total), 6) AS phi FROM z",
    "odds_haldane": f"{_CELLS}, i AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value, grp) AS i FROM k), p AS "
    "(SELECT feature, max(n) FILTER (i = 1) AS a, max(n) FILTER (i = 2) AS b, max(n) FILTER (i = 3) AS c, max(n) FILTER (i = 4) "
    "AS d, CASE WHEN min(n) = 0 THEN 0.5 ELSE 0 END AS x FROM i GROUP BY ALL) SELECT feature, round(CAST((a + x) * (d + x) / "
    "((b + x) * (c + x)) AS DOUBLE), 6) AS odds_ratio FROM p",
    "contingency_table": f"{_CELLS} SELECT * FROM k",
    **{{"fdr_bh": "bh_fdr", "fdr_by": "by_fdr"}.get(m, m): _adjust_sql(m) for m in METHODS},
    "contrast_mwu": f"{_LABELLED} SELECT name, feature, n1, n2, round(CAST(u_stat AS DOUBLE), 6) AS u_stat, round(vda, 6) AS vda, round(CAST(delta AS "
    "DOUBLE), 6) AS cliffs_delta, round(m1, 6) AS median_g1, round(m2, 6) AS median_g2, round(md, 6) AS median_diff, round(vda * 100, 6) AS "
    "cles_pct, round(CAST(effect_size AS DOUBLE), 6) AS effect_size, round(vda_deviation, 6) AS vda_deviation, round(norm_diff, 6) AS norm_diff, "
    "round(CAST(meta_rank AS DOUBLE), 6) AS meta_rank FROM f",
    "neighbour_information": f"WITH {_LONG}, x AS (SELECT id, feature, grp, value, count(*) OVER (PARTITION BY feature, grp) AS size, count(*) OVER "
    "(PARTITION BY feature) AS n FROM l WHERE feature IN ('f8', 'f9', 'f10', 'f11')), d AS (SELECT a.feature, a.id, a.value, a.size, a.n, abs(a.value "
    "- b.value) AS d, row_number() OVER (PARTITION BY a.feature, a.id ORDER BY abs(a.value - b.value)) AS i FROM x a JOIN x b ON a.feature = "
    "b.feature AND a.grp = b.grp AND a.id <> b.id), r AS (SELECT feature, id, value, size, n, d * (1 - 1e-9) AS r, least(3, size - 1) AS k FROM d "
    "WHERE i = least(3, size - 1)), m AS (SELECT r.feature, r.id, any_value(r.size) AS size, any_value(r.n) AS n, any_value(k) AS k, count(*) AS m "
    "FROM r JOIN x ON x.feature = r.feature AND abs(x.value - r.value) <= r.r GROUP BY r.feature, r.id), p AS (SELECT x, "
    "coalesce(sum(1::DOUBLE / x) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS psi FROM range(1, (SELECT max(n) + 2 FROM x)) t(x)) "
    "SELECT feature, round(greatest(0, max(pn.psi) + avg(pk.psi - ps.psi - pm.psi)), 6) AS mi FROM m JOIN p pn ON pn.x = n JOIN p pk ON pk.x = k JOIN p ps "
    "ON ps.x = size JOIN p pm ON pm.x = m.m GROUP BY feature",
    "anova_f": "WITH e AS (SELECT label AS grp, "
    + ", ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) AS f{j}" for j in range(8, 24))
    + f" FROM embeddings), x AS (UNPIVOT e ON {', '.join(f'f{j}' for j in range(8, 24))} INTO NAME feature VALUE value), {_anova('x')}",
    "levene": f"WITH {_LONG}, md AS (SELECT feature, grp, quantile_cont(value, 0.5) AS md FROM l GROUP BY ALL), x AS (SELECT "
    f"feature, grp, abs(value - md) AS value FROM l JOIN md USING (feature, grp)), {_anova('x')}",
    "mutual_information": f"WITH {_LONG}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY ALL), c AS "
    "(SELECT feature, least(floor((value - lo) / (hi - lo) * 10), 9) AS bin, grp, CAST(count(*) AS DOUBLE) AS n FROM l JOIN e "
    "USING (feature) GROUP BY ALL), s AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY "
    "feature, bin) AS x, sum(n) OVER (PARTITION BY feature, grp) AS y FROM c) SELECT feature, round(sum(n / t * ln(n * t / (x * "
    "y))), 6) AS mi FROM s GROUP BY feature",
    "spearman_matrix": f"WITH {FEATURES_LONG}, {_corr('features_long')}",
    "spearman_tools": f"WITH {TOOL_PROBS}, x AS (UNPIVOT tool_probs ON {', '.join(TOOLS)} INTO NAME feature VALUE value), {_corr('x')}",
    "kendall_matrix": f"WITH {FEATURES_LONG}, s AS (SELECT a.feature, a.id AS i, b.id AS j, sign(a.value - b.value) AS s FROM "
    "features_long a JOIN features_long b ON a.feature = b.feature AND a.id < "
    "b.id) SELECT a.feature AS f1, b.feature AS f2, round(sum(a.s * b.s)::DOUBLE / sqrt(sum(a.s * a.s)::DOUBLE * sum(b.s * b.s)), 6) "
    "AS tau FROM s a JOIN s b ON a.i = b.i AND a.j = b.j AND a.feature < b.feature GROUP BY ALL",
    "kappa_matrix": f"WITH {TOOL_LABELS}, l AS (UNPIVOT tool_labels ON {', '.join(TOOLS)} INTO NAME tool VALUE call), c AS (SELECT "
    "a.tool AS tool_1, b.tool AS tool_2, count(*)::DOUBLE AS n, count(*) FILTER (a.call = b.call) AS s, count(*) FILTER (a.call) "
    "AS x, count(*) FILTER (b.call) AS y FROM l a JOIN l b ON a.id = b.id AND a.tool < b.tool GROUP BY ALL), e AS (SELECT *, "
    "(x * y + (n - x) * (n - y)) / (n * n) AS e FROM c) SELECT tool_1, tool_2, round((s / n - e) / (1 - e), 6) AS kappa FROM e",
    "midranks": f"WITH {LINE_FEATURES}, c AS (SELECT feature, value, count(*) AS n FROM line_features GROUP BY ALL) SELECT feature, "
    "round(value, 4) AS value, rank() OVER (PARTITION BY feature ORDER BY n) + (count(*) OVER (PARTITION BY feature, n) - 1) / 2 AS "
    "rank, rank() OVER (PARTITION BY feature ORDER BY n DESC) + (count(*) OVER (PARTITION BY feature, n) - 1) / 2 AS rank_down, "
    "round((rank() OVER (PARTITION BY feature ORDER BY n) + (count(*) OVER (PARTITION BY feature, n) - 1) / 2) / count(*) OVER "
    "(PARTITION BY feature), 6) AS share, round(rank() OVER (PARTITION BY feature ORDER BY n) / count(*) OVER (PARTITION BY "
    "feature), 6) AS share_min FROM c",
    "composite_rank": f"WITH {_LONG}, {_u('l')}, a AS (SELECT feature, abs_vda, abs(z) AS abs_z FROM u), b AS (SELECT *, (abs_vda - "
    "min(abs_vda) OVER ()) / (max(abs_vda) OVER () - min(abs_vda) OVER ()) AS x, (abs_z - min(abs_z) OVER ()) / (max(abs_z) OVER "
    "() - min(abs_z) OVER ()) AS y FROM a), c AS (SELECT *, (x + y) / 2 AS composite FROM b) SELECT feature, round(abs_vda, 6) AS "
    "abs_vda, round(abs_z, 6) AS abs_z, round(x, 6) AS abs_vda_scaled, round(y, 6) AS abs_z_scaled, round(composite, 6) AS "
    "composite, round((rank() OVER (ORDER BY composite) + (count(*) OVER (PARTITION BY composite) - 1) / 2) / count(*) OVER (), 6) "
    "AS composite_share, rank() OVER (ORDER BY composite DESC) + (count(*) OVER (PARTITION BY composite) - 1) / 2 AS "
    "composite_rank FROM c",
    "cat_frequency": f"WITH {CATEGORIES} SELECT feature, grp, round(avg(CAST(value AS DOUBLE)) * 100, 6) AS percent FROM categories "
    "GROUP BY ALL",
    "element_statistics": f"WITH {LINE_FEATURES}, e AS (SELECT feature, grp, CASE WHEN round(value * 100) <> 3 THEN round(value * 100) END AS value, "
    "CASE WHEN round(value * 100) > 0 THEN round(value * 100) ** 2 - 3 * round(value * 100) END AS coverage FROM line_features WHERE feature IN "
    "('discount', 'tax')), "
    + ", ".join(
        f"{n} AS (SELECT feature, count(*) FILTER (grp = 1) AS n1, sum(k) FILTER (grp = 1) - n1 * (n1 + 1) / 2 AS u, u / (n1::DOUBLE * count(*) FILTER (grp "
        f"= 0)) AS vda FROM (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY {c}) + (count(*) OVER (PARTITION BY feature, {c}) - 1) / 2 "
        f"AS k FROM e WHERE {c} IS NOT NULL) GROUP BY feature)"
        for n, c in (("uv", "value"), ("uc", "coverage"))
    )
    + ", s AS (SELECT feature, "
    + ", ".join(
        f"avg({c}) FILTER (grp = {g}) AS mean{n}_{g}, stddev_samp({c}) FILTER (grp = {g}) AS sd{n}_{g}"
        for n, c in (("", "value"), ("_coverage", "coverage"))
        for g in (0, 1)
    )
    + ", count(value) AS n, count(*) FILTER (grp = 1 AND value > 0) + 0.5::DOUBLE AS a, count(*) FILTER (grp = 1 AND value = 0) + 0.5::DOUBLE AS b, "
    "count(*) FILTER (grp = 0 AND value > 0) + 0.5::DOUBLE AS c, count(*) FILTER (grp = 0 AND value = 0) + 0.5::DOUBLE AS d, 100 * avg(CAST(value > 0 AS "
    "INT)) FILTER (grp = 0) AS percent_0, 100 * avg(CAST(value > 0 AS INT)) FILTER (grp = 1) AS percent_1, (a * d - b * c) ** 2 * (a + b + c + d) / "
    "((a + b) * (c + d) * (a + c) * (b + d)) AS chi FROM e GROUP BY feature) SELECT feature, "
    + ", ".join(f"round({x}{n}_{g}, 6) AS {x}{n}_{g}" for n in ("", "_coverage") for g in (0, 1) for x in ("mean", "sd"))
    + ", round(percent_0, 6) AS percent_0, round(percent_1, 6) AS percent_1, round(chi, 6) AS chi2, round(a * d / (b * c), 6) AS odds_ratio, "
    "round(sqrt(chi / n), 6) AS phi, round(CAST(uv.u AS DOUBLE), 6) AS statistic, round(uv.vda, 6) AS vda, round(CAST(uc.u AS DOUBLE), 6) AS "
    "statistic_coverage, round(uc.vda, 6) AS vda_coverage FROM s JOIN uv USING (feature) JOIN uc USING (feature)",
}
