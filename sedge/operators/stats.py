"""Hypothesis tests on many features at once, in long form: one row per (feature, group, value).

Values are first counted by feature, value and group, and the different ones ranked in ranges (ranks.py).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.numbers import chi_square_tail, digamma, exact_u, f_tail, share_rank, two_sided_normal
from sedge.operators import concordance
from sedge.operators.ranks import correlation, equal, extreme, pair_sums, quantiles, ranked, running
from sedge.sources.scratch import written


def mann_whitney(
    rows: DataFrame, by: list[str], value: str = "value", group: str = "grp", drop_constant: bool = True, drop_nulls: bool = False,
    ties: bool = False,
) -> DataFrame:
    """Mann-Whitney U of group 1 against group 0 within `by`; null values count as 0, or do not count. n1, n2, statistic
    (U of group 1), z (with ties and a continuity correction of 0.5), vda (chance that a value of group 1 is larger, ties
    half) and abs_vda, its distance from 0.5; with ties, also the sum of t^3 - t over equal values. Features of one value
    only are left out, unless drop_constant is off."""
    v = F.col(value).cast("double")
    given = rows.where(v.isNotNull()) if drop_nulls else rows
    seen = (
        given.select(*by, F.coalesce(v, F.lit(0.0)).alias("v"), F.col(group).alias("g"))
        .groupBy(*by, "v")
        .agg(F.count_if(F.col("g") == 0).alias("a"), F.count_if(F.col("g") == 1).alias("b"))
        .withColumn("t", F.col("a") + F.col("b"))
        .where(F.col("t") > 0)
    )
    rank = F.col("before_t") + (F.col("t") + 1) / 2
    t = F.col("t").cast("double")
    sums = (
        running(seen, by, "v", ["t"])
        .withColumn("rank", rank)
        .groupBy(*by)
        .agg(
            F.sum("a").alias("n1"),
            F.sum("b").alias("n2"),
            F.sum(F.col("rank") * F.col("b")).alias("rank_sum"),
            F.sum(t * t * t - t).alias("ties"),
            F.count(F.lit(1)).alias("values"),
        )
    )
    if drop_constant:
        sums = sums.where(F.col("values") > 1)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("rank_sum") - n2 * (n2 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    away = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) * F.signum(u - n1 * n2 / 2)
    return sums.select(
        *by,
        "n1",
        "n2",
        u.alias("statistic"),
        F.try_divide(away, sigma).alias("z"),
        F.try_divide(u, n1 * n2).alias("vda"),
        F.abs(F.try_divide(u, n1 * n2) - 0.5).alias("abs_vda"),
        *([F.col("ties")] if ties else []),
    )


def group_medians(rows: DataFrame, by: list[str], value: str, group: str, first: str, second: str) -> DataFrame:
    """by, and the medians of groups 0 and 1 as `first` and `second`."""
    each = quantiles(rows, [*by, group], value, {"__median": 0.5})
    of = lambda g: F.max(F.when(F.col(group) == g, F.col("__median")))
    return each.groupBy(*by).agg(of(0).alias(first), of(1).alias(second))


#: Values of U at most for which its distribution is counted out.
MOST_U = 2_000_000


def with_p(tests: DataFrame, small: int = 8) -> DataFrame:
    """Adds p_value, two-sided: of the exact distribution of U where there are no ties and a group has at most `small`
    values (and U at most MOST_U), else of the normal one. tests: mann_whitney() with ties, which goes."""
    n1, n2 = F.col("n1"), F.col("n2")
    exact = (F.col("ties") == 0) & (F.least(n1, n2) <= small) & (n1 * n2 <= MOST_U)
    few = lambda c: F.when(exact, F.col(c))
    counted = exact_u(few("statistic"), few("n1"), few("n2"))
    return tests.withColumn("p_value", F.coalesce(counted, two_sided_normal(F.col("z")))).drop("ties")


def cliffs_delta(tests: DataFrame) -> DataFrame:
    """Adds cliffs_delta, 2 * vda - 1."""
    return tests.withColumn("cliffs_delta", F.col("vda") * 2 - 1)


def cliffs_delta_ref(rows: DataFrame, by: list[str], value: str = "value", group: str = "grp") -> DataFrame:
    """A variant seen in use: (2 R1 / (n1 (n1 + n2)) - 1) with the sign of the difference of medians, R1 being the rank
    sum of group 0. Not the textbook measure."""
    u = mann_whitney(rows, by, value, group, drop_constant=False)
    medians = group_medians(rows, by, value, group, "m1", "m2")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    r1 = (n1 + n2) * (n1 + n2 + 1) / 2 - (F.col("statistic") + n2 * (n2 + 1) / 2)
    return u.join(medians, by).select(
        *by, ((2 * r1 / (n1 * (n1 + n2)) - 1) * F.signum(F.col("m1") - F.col("m2"))).alias("cliffs_delta_ref")
    )


def contingency(rows: DataFrame, by: list[str], value: str = "value", group: str = "grp") -> DataFrame:
    """Counts by feature, value and group, with zeros where a feature's value and group do not meet. A null value counts as
    0."""
    own = F.coalesce(F.col(value), F.lit(0).cast(rows.schema[value].dataType))
    seen = rows.groupBy(*by, own.alias("value"), F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    values, groups = seen.select(*by, "value").distinct(), seen.select(*by, "grp").distinct()
    return values.join(groups, by).join(seen, [*by, "value", "grp"], "left").fillna(0, ["n"])


def _tables(counts: DataFrame, by: list[str]) -> DataFrame:
    """Of each feature's table: rows and columns, the first value and group, and its total."""
    sides = lambda c: counts.select(*by, c).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(f"n_{c}"), F.min(c).alias(f"first_{c}"))
    totals = counts.groupBy(*by).agg(F.sum("o").alias("total"), F.min("n").alias("least"))
    return sides("value").join(sides("grp"), by).join(totals, by)


def _corner(row: int, column: int, c: Column) -> Column:
    """Of a 2 x 2 table, one cell."""
    at = lambda name, k: (F.col(name) == F.col(f"first_{name}")) if k == 1 else (F.col(name) != F.col(f"first_{name}"))
    return F.max(F.when(at("value", row) & at("grp", column), c))


def chi_square(counts: DataFrame, by: list[str], plus: float = 0.0, yates: bool = True) -> DataFrame:
    """Chi-square of contingency(): statistic, dof, n, cramers_v and, for 2 x 2 tables, odds_ratio with 0.5 in every
    cell. Such tables are corrected by Yates unless yates is off; `plus` is added to every cell first. Tables of one row
    or column are left out. Sums of rows and columns are joined, so a feature may have any number of values."""
    cells = counts.withColumn("o", F.col("n") + F.lit(float(plus)))
    sums = lambda c: cells.groupBy(*by, c).agg(F.sum("o").alias(f"of_{c}"))
    r, k = F.col("n_value"), F.col("n_grp")
    cells = cells.join(_tables(cells, by).where((r > 1) & (k > 1)), by).join(sums("value"), [*by, "value"]).join(sums("grp"), [*by, "grp"])
    e = F.col("of_value") * F.col("of_grp") / F.col("total")
    gap = F.abs(F.col("o") - e)
    small = (r == 2) & (k == 2) & F.lit(yates)
    gap = F.when(small, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    at = lambda i, j: _corner(i, j, F.col("o") - plus + 0.5)
    out = cells.groupBy(*by).agg(
        F.sum(gap * gap / e).alias("statistic"),
        F.max((r - 1) * (k - 1)).cast("long").alias("dof"),
        F.max("total").alias("n"),
        F.max(F.least(r, k)).alias("k"),
        (at(1, 1) * at(2, 2) / (at(1, 2) * at(2, 1))).alias("odds"),
    )
    return out.select(
        *by,
        "statistic",
        "dof",
        "n",
        F.sqrt(F.col("statistic") / (F.col("n") * (F.col("k") - 1))).alias("cramers_v"),
        F.when((F.col("dof") == 1), F.col("odds")).alias("odds_ratio"),
    )


def with_chi_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", chi_square_tail(F.col("statistic"), F.col("dof").cast("double")))


def haldane_odds(counts: DataFrame, by: list[str]) -> DataFrame:
    """Odds ratio of 2 x 2 tables, with 0.5 in every cell only if one is zero."""
    cells = counts.withColumn("o", F.col("n"))
    cells = cells.join(_tables(cells, by).where("n_value = 2 AND n_grp = 2"), by)
    x = F.col("n") + F.when(F.col("least") == 0, 0.5).otherwise(0.0)
    ratio = _corner(1, 1, x) * _corner(2, 2, x) / (_corner(1, 2, x) * _corner(2, 1, x))
    return cells.groupBy(*by).agg(ratio.alias("odds_ratio"))


def adjusted(
    tests: DataFrame, p: str = "p_value", by: list[str] | None = None, method: str = "fdr_bh", alpha: float = 0.01
) -> DataFrame:
    """Adds adj_p and significant (adj_p < alpha) for a family of tests (within `by`): fdr_bh, fdr_by, holm or bonferroni.
    Equal p-values have equal adjusted ones, so the different ones are counted and dealt into ranges: a family of any size
    is in no single task. Null p-values are no tests, and have null."""
    by = by or []
    counts = tests.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    names = [f"__s{i}" for i in range(len(by))]
    sizes = sizes.withColumnsRenamed(dict(zip(by, names, strict=True)))
    placed = running(counts, by, "__p", ["__c"], with_range=True)
    placed = placed.join(sizes, equal(list(zip(by, names, strict=True)))) if by else placed.crossJoin(sizes)  # one row
    x, n, before, c = F.col("__p"), F.col("__n"), F.col("before___c"), F.col("__c")
    raw = {
        "fdr_bh": x * n / (before + c),
        "fdr_by": x * n / (before + c) * (digamma(n.cast("double") + 1) - digamma(F.lit(1.0))),
        "holm": x * (n - before),
        "bonferroni": x * n,
    }
    if method not in raw:
        raise ValueError(f"unknown method: {method}")
    placed = placed.select(*by, "__p", "__range", raw[method].alias("adj"))
    if method == "bonferroni":
        placed = placed.drop("__range").withColumnRenamed("adj", "best_adj")
    else:
        up = method == "holm"
        placed = extreme(placed, by, "__p", "adj", "max" if up else "min", descending=not up)
    placed = placed.select(*(F.col(b).alias(f"__k{i}") for i, b in enumerate(by)), "__p", F.least("best_adj", F.lit(1.0)).alias("adj_p"))
    on = equal([*((b, f"__k{i}") for i, b in enumerate(by)), (p, "__p")])
    return tests.join(placed, on, "left").select(*tests.columns, "adj_p", (F.col("adj_p") < alpha).alias("significant"))


def jointly_adjusted(tables: dict[str, DataFrame], p: str = "p_value", method: str = "fdr_bh", alpha: float = 0.01) -> DataFrame:
    """One family over several tables of tests, told apart by `family`."""
    parts = [t.withColumn("family", F.lit(k)) for k, t in tables.items()]
    return adjusted(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), p, None, method, alpha)


def pooled_adjusted(wide: DataFrame, key: str, columns: list[str], method: str = "fdr_bh", alpha: float = 0.01) -> DataFrame:
    """One family over several p-value columns of a table: key and, for each column, its adjusted value {c}_adj."""
    long = wide.unpivot([key], columns, "column", "p_value")
    done = adjusted(long, "p_value", None, method, alpha)
    return done.groupBy(key).agg(*(F.max(F.when(F.col("column") == c, F.col("adj_p"))).alias(f"{c}_adj") for c in columns))


def contrast_tests(rows: DataFrame, contrasts: DataFrame, more_than: int = 50) -> DataFrame:
    """Mann-Whitney of every contrast (name, g1, g2) of group labels for every feature, nulls left out, where both groups
    have more than `more_than` values of it. n1, n2, u_stat and vda (of the first group), p_value, cliffs_delta (as
    cliffs_delta_ref() has it), the medians and their difference, cles_pct, effect_size, vda_deviation, norm_diff (the
    difference over its deviation among the contrast's features), p_fdr and sig_fdr05 within the contrast, meta_rank (the
    mean share of the lowest ranks of the three sizes over all tests) and logp_score (-log10 of p_fdr, 10 at most).
    contrasts is a short table."""
    known = rows.where(F.col("value").isNotNull()).select("feature", "label", F.col("value").cast("double").alias("value"))
    met = known.join(contrasts, (F.col("label") == F.col("g1")) | (F.col("label") == F.col("g2"))).select(
        "name", "feature", "value", F.when(F.col("label") == F.col("g1"), 1).otherwise(0).alias("grp")
    )
    by = ["name", "feature"]
    u = mann_whitney(met, by, drop_constant=False, ties=True).where((F.col("n1") > more_than) & (F.col("n2") > more_than))
    tests = with_p(u).join(group_medians(met, by, "value", "grp", "median_g2", "median_g1"), by)
    n1, n2 = F.col("n2").cast("double"), F.col("n1").cast("double")  # group 1 of the test is the first of the contrast
    rank_sum = F.col("statistic") + n1 * (n1 + 1) / 2
    away = F.col("median_g1") - F.col("median_g2")
    tests = tests.select(
        *by, F.col("n2").alias("n1"), F.col("n1").alias("n2"), F.col("statistic").alias("u_stat"), "z", "p_value", "vda",
        ((2 * rank_sum / (n1 * (n1 + n2)) - 1) * F.signum(away)).alias("cliffs_delta"), "median_g1", "median_g2",
        away.alias("median_diff"),
    )
    tests = written(adjusted(tests, by=["name"]).withColumnRenamed("adj_p", "p_fdr").drop("significant"), "contrast-tests")
    spread = tests.groupBy("name").agg(
        F.coalesce(F.stddev_samp("median_diff"), F.lit(1.0)).alias("sd"), F.count(F.lit(1)).alias("tests")
    )
    size = F.abs("median_diff")
    norm = F.when(F.col("sd") > 0, size / F.col("sd")).when(size > 0, F.lit(float("inf")))
    sized = tests.join(spread, "name").select(
        *tests.columns,
        (F.col("vda") * 100).alias("cles_pct"),
        F.abs(F.coalesce("cliffs_delta", F.lit(0.0))).alias("effect_size"),
        F.abs(F.col("vda") - 0.5).alias("vda_deviation"),
        norm.alias("norm_diff"),
        F.when(F.col("tests") > 1, F.col("p_fdr") <= 0.05).otherwise(F.col("p_fdr") < 0.05).alias("sig_fdr05"),
        (-F.log10(F.greatest("p_fdr", F.lit(1e-10)))).alias("logp_score"),
    )
    sizes = sized.unpivot(by, ["effect_size", "vda_deviation", "norm_diff"], "size", "v").where(F.col("v").isNotNull())
    ranks = ranked(sizes, ["size"], "v", "share", share=True, lowest=True)
    return sized.join(ranks.groupBy(*by).agg(F.avg("share").alias("meta_rank")), by)


def anova_f(rows: DataFrame, by: list[str], value: str = "value", group: str = "grp") -> DataFrame:
    """F statistic of a one-way analysis of variance, from count, sum and sum of squares of each group about the mean of
    the feature, and its degrees of freedom."""
    v = F.col("v")
    centred = rows.select(*by, F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(v.isNotNull())
    means = centred.groupBy(*by).agg(F.avg("v").alias("mean"))
    groups = (
        centred.join(means, by)
        .withColumn("v", v - F.col("mean"))
        .groupBy(*by, "g")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(v * v).alias("q"))
    )
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    sums = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(s * s / n).alias("b"), F.sum(q - s * s / n).alias("w"), F.sum("s").alias("t")
    )
    between, df1, df2 = F.col("b") - F.col("t") * F.col("t") / F.col("n"), F.col("k") - 1, F.col("n") - F.col("k")
    return sums.select(
        *by, F.try_divide(between / df1, F.col("w") / df2).alias("f"), df1.alias("df1"), df2.alias("df2")
    )


def f_tests(rows: DataFrame, by: list[str], value: str = "value", group: str = "grp", method: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """anova_f() of values with nulls as 0, with p_value, p_fdr over all features and significant_fdr (p_fdr < alpha)."""
    filled = rows.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    tests = anova_f(filled, by, value, group)
    tests = tests.withColumn("p_value", f_tail(F.col("f"), F.col("df1"), F.col("df2")))
    return adjusted(tests, method=method, alpha=alpha).withColumnsRenamed({"adj_p": "p_fdr", "significant": "significant_fdr"})


def levene(rows: DataFrame, by: list[str], value: str = "value", group: str = "grp") -> DataFrame:
    """Levene's test about medians: the analysis of variance of distances from the group's median."""
    medians = quantiles(rows, [*by, group], value, {"__median": 0.5})
    away = rows.join(medians, [*by, group]).withColumn(value, F.abs(F.col(value) - F.col("__median")))
    return anova_f(away, by, value, group)


def mutual_information(rows: DataFrame, by: list[str], bins: int = 10, value: str = "value", group: str = "grp") -> DataFrame:
    """Mutual information of a binned feature and the group, in nats: the plug-in estimate over bins of equal width. It is
    deterministic and needs no neighbours, unlike estimates over nearest neighbours, from which it differs."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    cells = rows.join(ends, by).groupBy(*by, F.coalesce(place, F.lit(0)).alias("bin"), F.col(group).alias("g")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    total = lambda *k: F.sum("n").over(Window.partitionBy(*by, *k))
    cells = cells.select(*by, "n", total().alias("t"), total("bin").alias("x"), total("g").alias("y"))
    n, t = F.col("n"), F.col("t")
    return cells.groupBy(*by).agg(F.sum(n / t * F.ln(n * t / (F.col("x") * F.col("y")))).alias("mi"))


def features_of(rows: DataFrame, most: int = 2000) -> list[str]:
    """The features of long rows, at most `most`; their number does not grow with the data."""
    names = sorted(r.feature for r in rows.select("feature").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} features")
    return names


def pearson(rows: DataFrame, key: str = "id") -> DataFrame:
    """Pearson correlation of every two features of long rows (key, feature, value), one value for each key and feature: f1 <
    f2 and r, over the keys that have both. Values are taken as they are: centre large ones first (standardised())."""
    names = features_of(rows)
    wide = rows.groupBy(key).pivot("feature", names).agg(F.first("value"))
    return pair_sums(wide, names).select("f1", "f2", correlation().alias("r"))


def spearman(rows: DataFrame, key: str = "id") -> DataFrame:
    """Spearman correlation of every two features of long rows (key, feature, value): f1 < f2 and rho. Ranks are taken
    once for each feature; pairs are summed up in each task."""
    shares = ranked(rows.select(key, "feature", "value"), ["feature"], "value", "share", share=True)
    return pearson(shares.select(key, "feature", (F.col("share") - 0.5).alias("value")), key).withColumnRenamed("r", "rho")


def kendall(rows: DataFrame, key: str = "id", blocks: int = 512) -> DataFrame:
    """Kendall's tau-b of every two features of long rows (key, feature, value): f1 < f2 and tau."""
    return concordance.kendall(rows, features_of(rows), key, blocks)


def cohen_kappa(labels: DataFrame, key: str, tools: list[str]) -> DataFrame:
    """Cohen's kappa of every two tools' boolean calls."""
    counts = pair_sums(labels.select(*(F.col(t).cast("int").alias(t) for t in tools)), tools)
    n, y1, y2 = F.col("n"), F.col("x"), F.col("y")
    same = n - y1 - y2 + 2 * F.col("xy")
    expected = (y1 * y2 + (n - y1) * (n - y2)) / (n * n)
    return counts.select(
        F.col("f1").alias("tool_1"), F.col("f2").alias("tool_2"), F.try_divide(same / n - expected, 1 - expected).alias("kappa")
    )


def pairwise_results(
    numbers: DataFrame, flags: DataFrame, alpha: float = 0.01, method: str = "fdr_bh"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The combined run over two groups (grp 0 and 1): Mann-Whitney of each number, chi-square of each flag, one family of
    adjusted p-values over both, and the percentage of each flag by group."""
    u = with_p(mann_whitney(numbers, ["feature"], ties=True))
    c = with_chi_p(chi_square(contingency(flags, ["feature"]), ["feature"]))
    both = jointly_adjusted({"mannwhitney": u.select("feature", "p_value"), "chi2": c.select("feature", "p_value")}, method=method, alpha=alpha)
    of = lambda t, name: t.join(both.where(F.col("family") == name).select("feature", "adj_p", "significant"), "feature")
    shares = frequency_by_group(flags, ["feature"])
    shares = shares.groupBy("feature").agg(*(F.max(F.when(F.col("grp") == g, F.col("percent"))).alias(f"group{g + 1}") for g in (0, 1)))
    return of(u, "mannwhitney"), of(c, "chi2"), shares


def composite_rank(scores: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds {c}_scaled (0 to 1) for each score, their mean `composite`, its share rank and its rank from the top."""
    family = Window.partitionBy(*(by or [F.lit(0)]))
    low = lambda c: F.min(c).over(family)
    scaled = {
        f"{c}_scaled": F.coalesce(F.try_divide(F.col(c) - low(c), F.max(c).over(family) - low(c)), F.lit(0.0)) for c in columns
    }
    out = scores.withColumns(scaled).withColumn("__by", F.lit(0))
    out = out.withColumn("composite", reduce(lambda a, b: a + b, map(F.col, scaled)) / len(columns))
    keys = by or ["__by"]
    from sedge.functions.numbers import midrank

    return (
        out.withColumn("composite_share", share_rank("composite", keys))
        .withColumn("composite_rank", midrank("composite", keys, descending=True))
        .drop("__by")
    )


def frequency_by_group(rows: DataFrame, by: list[str], value: str = "value", group: str = "grp") -> DataFrame:
    """Percentage of 1 among 0/1 values."""
    return rows.groupBy(*by, group).agg((F.avg(F.col(value).cast("double")) * 100).alias("percent"))


def element_statistics(rows: DataFrame, by: list[str], value: str = "value", group: str = "grp", coverage: str | None = None) -> DataFrame:
    """A row per feature, nulls left out: mean, sd and percentage above 0 of either group (1: coding), U and VDA of group 1
    with p, and chi-square (0.5 added to every cell of above 0 and 0, no correction) of having any, with odds ratio, phi over
    the number of values, and p. coverage: a column of which mean, sd, U, VDA and p are given as well. Features of which a
    group has no value have no tests."""
    g = lambda k, c: F.when(F.col(group) == k, c)
    v = F.col(value).cast("double")

    def moments(c: Column, name: str) -> list[Column]:
        return [f(g(k, c)).alias(f"{n}{name}_{k}") for k in (0, 1) for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]

    sums = rows.groupBy(*by).agg(
        *moments(v, ""),
        *((F.avg(g(k, (v > 0).cast("int"))) * 100).alias(f"percent_{k}") for k in (0, 1)),
        *(F.count(g(k, v)).alias(f"n_{k}") for k in (0, 1)),
        *((F.count_if((F.col(group) == k) & c) + 0.5).alias(f"{n}_{k}") for k in (0, 1) for n, c in (("hit", v > 0), ("none", v == 0))),
        *(moments(F.col(coverage).cast("double"), "_coverage") if coverage else []),
    )
    a, b, c, d = (F.col(x) for x in ("hit_1", "none_1", "hit_0", "none_0"))
    cross = a * d - b * c
    both = (F.col("n_0") > 0) & (F.col("n_1") > 0)
    chi = cross * cross * (a + b + c + d) / ((a + b) * (c + d) * (a + c) * (b + d))
    sums = sums.select(
        *by, *(c for c in sums.columns if c.startswith(("mean", "sd", "percent"))), F.when(both, chi).alias("chi2"),
        F.when(both, a * d / (b * c)).alias("odds_ratio"), F.when(both, F.sqrt(chi / (F.col("n_0") + F.col("n_1")))).alias("phi"),
    )
    sums = sums.withColumn("p_chi2", chi_square_tail(F.col("chi2"), F.when(F.col("chi2").isNotNull(), 1.0)))
    for column, name in ((value, ""), (coverage, "_coverage")):
        if column:
            u = with_p(mann_whitney(rows, by, column, group, drop_constant=False, drop_nulls=True, ties=True)).where("n1 > 0 AND n2 > 0")
            sums = sums.join(u.select(*by, *(F.col(c).alias(f"{c}{name}") for c in ("statistic", "vda", "p_value"))), by, "left")
    return sums


def odds(c: Column) -> Column:
    return c / (1 - c)
