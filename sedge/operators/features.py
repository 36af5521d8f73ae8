"""Feature matrices: which columns are features, scaling, residuals, and clusters of correlated features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

from sedge.operators.scores import constant_columns
from sedge.sources.scratch import written

#: What marks a categorical column, such columns by name, and names that are none all the same.
CATEGORICAL_PARTS = ("_has_", "_present")
CATEGORICAL_NAMES = ("ORF_frame_l_cpat",)
NOT_CATEGORICAL = ("motif_types_present",)


def numeric_columns(schema: StructType) -> list[str]:
    """Numbers; booleans are none."""
    return [f.name for f in schema if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]


def feature_columns(
    schema: StructType, suffixes: list[str], metadata: list[str], probabilities: list[str], removed: list[str] | None = None, lengths: list[str] | None = None
) -> list[str]:
    """Numeric columns with one of the suffixes that are neither metadata, probabilities nor removed; of columns that
    hold the length, only the first."""
    gone = {*metadata, *probabilities, *(removed or []), *(lengths or [])[1:]}
    return [c for c in numeric_columns(schema) if c not in gone and (c in (lengths or [])[:1] or any(c.endswith(s) for s in suffixes))]


def categorical_and_continuous(columns: list[str]) -> tuple[list[str], list[str]]:
    """By name; continuous ones sorted."""
    kind = lambda c: c not in NOT_CATEGORICAL and (c in CATEGORICAL_NAMES or any(p in c for p in CATEGORICAL_PARTS))
    return [c for c in columns if kind(c)], sorted(c for c in columns if not kind(c))


def to_numbers(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Text to numbers, true and false to 1 and 0; what is neither becomes null."""
    t = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    number = lambda c: F.when(t(c) == "true", 1.0).when(t(c) == "false", 0.0).otherwise(F.col(c).cast("string").try_cast("double"))
    return rows.withColumns({c: number(c) for c in columns})


def probabilities(rows: DataFrame, columns: list[str], inverted: list[str]) -> DataFrame:
    """P(coding) columns; those of tools that give P(noncoding) are turned round."""
    return rows.withColumns({c: 1 - F.col(c) if c in inverted else F.col(c) for c in columns})


def standardised(rows: DataFrame, by: str = "feature") -> DataFrame:
    """Long values less their mean over their population standard deviation; what is null or not finite becomes 0."""
    v = F.when(F.isnan("value") | (F.abs("value") == F.lit(float("inf"))), None).otherwise(F.col("value"))
    of = rows.groupBy(F.col(by).alias("__by")).agg(F.avg(v).alias("__mean"), F.stddev_pop(v).alias("__sd"))
    z = F.try_divide(v - F.col("__mean"), F.col("__sd"))
    return rows.join(of, F.col(by).eqNullSafe(F.col("__by"))).select(*rows.columns, F.coalesce(z, F.lit(0.0)).alias("z"))


def residuals(rows: DataFrame, length: str = "length") -> DataFrame:
    """Long values less what a straight line on the length explains; null counts as 0, and a constant feature stays."""
    v = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    known = rows.withColumn("value", v)
    fits = known.groupBy("feature").agg(
        F.regr_slope("value", length).alias("b"), F.regr_intercept("value", length).alias("a"), (F.min("value") == F.max("value")).alias("constant")
    )
    fitted = F.when(F.col("constant") | F.col("b").isNull(), 0.0).otherwise(F.col("a") + F.col("b") * F.col(length))
    return known.join(fits, "feature").withColumn("residual", F.col("value") - fitted).drop("a", "b", "constant")


def colour(rows: DataFrame, column: str, how: str) -> DataFrame:
    """log, sqrt, percentile (share rank of ties' mean) or none."""
    from sedge.operators.ranks import ranked

    if how == "percentile":
        return ranked(rows, [], column, "colour", share=True)
    c = F.col(column)
    made = {"log": F.log10(c + 1), "sqrt": F.sqrt(c), "none": c.cast("double")}
    if how not in made:
        raise ValueError(f"unknown transform: {how}")
    return rows.withColumn("colour", made[how])


def distances(correlations: DataFrame) -> DataFrame:
    """1 - |rho| of each pair; an undefined correlation gives 0."""
    d = 1 - F.abs("rho")
    return correlations.withColumn("distance", F.when(d.isNull() | F.isnan(d), 0.0).otherwise(d))


def silhouette(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """threshold, n_clusters and mean silhouette of clusters (feature, threshold, cluster) by the distances of pairs.
    A member alone has 0; where there is one cluster, or one for each feature, there is none."""
    both = pairs.select(F.col("f1").alias("f"), F.col("f2").alias("g"), "distance")
    both = both.unionByName(both.select(F.col("g").alias("f"), F.col("f").alias("g"), "distance"))
    own = clusters.select(F.col("feature").alias("f"), "threshold", F.col("cluster").alias("cf"))
    other = clusters.select(F.col("feature").alias("g"), "threshold", F.col("cluster").alias("cg"))
    means = both.join(own, "f").join(other, ["g", "threshold"]).groupBy("threshold", "f", "cf", "cg").agg(F.avg("distance").alias("d"))
    each = means.groupBy("threshold", "f").agg(
        F.max(F.when(F.col("cf") == F.col("cg"), F.col("d"))).alias("a"), F.min(F.when(F.col("cf") != F.col("cg"), F.col("d"))).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    s = F.when(a.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    scores = each.where(b.isNotNull()).groupBy("threshold").agg(F.avg(s).alias("silhouette"))
    sizes = clusters.groupBy("threshold").agg(F.count_distinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n"))
    return sizes.join(scores, "threshold", "left").select(
        "threshold", "n_clusters",
        F.when((F.col("n_clusters") > 1) & (F.col("n_clusters") < F.col("n")), F.col("silhouette")).alias("silhouette"),
    )


def best_threshold(scores: DataFrame, fallback: float = 0.25) -> DataFrame:
    best = F.max_by("threshold", F.struct(F.round("silhouette", 9), -F.col("threshold")))
    return scores.where(F.col("silhouette").isNotNull()).agg(F.coalesce(best, F.lit(fallback)).alias("threshold"))


def representatives(clusters: DataFrame) -> DataFrame:
    """The first member of each cluster, by name."""
    return clusters.groupBy("threshold", "cluster").agg(F.min("feature").alias("feature"))


def top_variance(rows: DataFrame, n: int = 6) -> DataFrame:
    v = rows.groupBy("feature").agg(F.var_samp("value").alias("variance"))
    return v.orderBy(F.round("variance", 12).desc(), "feature").limit(n)


def _yeo_johnson(x: Column, l: Column) -> Column:
    positive = F.when(F.abs(l) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, l) - 1) / l)
    negative = F.when(F.abs(l - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - l) - 1) / (2 - l))
    return F.when(x >= 0, positive).otherwise(negative)


def yeo_johnson_lambdas(rows: DataFrame, points: int = 16, close: float = 1e-6, widest: float = 64.0) -> DataFrame:
    """feature and lambda, by maximum likelihood, of all features at once: each round sets a row of lambdas against each
    other in one aggregation, and goes on between the neighbours of the best, or further out if that is the first or the
    last. The lambdas of a round are what is broadcast: Spark does not know the size of a table made of rows, and would send
    the values to the driver instead where these are small enough. A round narrows the interval `points` / 2 times; it ends when all are narrower than `close`, and gives features
    without a spread 1. Only the intervals, a row for each feature, come to the driver."""
    spark = rows.sparkSession
    known = written(rows.where(F.col("value").isNotNull()).select("feature", F.col("value").cast("double").alias("value")), "yj-values")
    logs = known.groupBy("feature").agg(F.sum(F.signum("value") * F.log1p(F.abs("value"))).alias("logs"), F.stddev_pop("value").alias("sd"))
    found = {r.feature: (r.logs, -2.0, 2.0) if r.sd else (r.logs, 1.0, 1.0) for r in logs.collect()}
    x = F.col("value")
    while any(b - a > close for _, a, b in found.values()):
        open_ = [(f, a, (b - a) / points) for f, (_, a, b) in found.items() if b - a > close]
        bounds = spark.createDataFrame(open_, "feature string, a double, step double")
        at = [F.col("a") + F.lit(i) * F.col("step") for i in range(points + 1)]
        sums = known.join(F.broadcast(bounds), "feature").groupBy("feature").agg(
            F.count(x).alias("n"), *(F.var_pop(_yeo_johnson(x, l)).alias(f"v{i}") for i, l in enumerate(at))
        )
        for r in sums.collect():
            logs_, a, b = found[r.feature]
            step = (b - a) / points
            spread = [r[f"v{i}"] for i in range(points + 1)]
            fits = [-r.n / 2 * math.log(v) + (a + i * step - 1) * logs_ if 0 < v < math.inf else -math.inf for i, v in enumerate(spread)]
            best = max(range(points + 1), key=lambda i: fits[i])
            if best in (0, points) and b - a >= 4 and b - a < widest:  # nothing yet on one side
                a, b = (a - (b - a), b) if best == 0 else (a, b + (b - a))
            else:
                a, b = a + max(best - 1, 0) * step, a + min(best + 1, points) * step
            found[r.feature] = logs_, a, b
    return spark.createDataFrame([(f, (a + b) / 2) for f, (_, a, b) in found.items()], "feature string, lambda double")


def yeo_johnson(rows: DataFrame) -> DataFrame:
    """Adds the Yeo-Johnson transform of each feature's values, with the lambda of the largest likelihood."""
    return rows.join(F.broadcast(yeo_johnson_lambdas(rows)), "feature").withColumn("transformed", _yeo_johnson(F.col("value"), F.col("lambda")))


def feature_matrix(
    base: DataFrame, key: str, label: str, columns: list[str], further: list[DataFrame | None], ids: DataFrame | None = None,
    representatives: DataFrame | None = None,
) -> DataFrame:
    """key, label (as a whole number) and features, one row for each row of base (among ids, if given): `columns` of base as
    numbers, null and text counting as 0 and constant ones left out, and then those of the further tables (key and
    features; None: not there), matched by key, with 0 where there is no match. A column whose name is taken is left out.
    representatives (feature): these and all categorical columns alone are kept, categorical ones first."""
    rows = base if ids is None else base.join(ids.select(key).distinct(), key, "left_semi")
    rows = to_numbers(rows.select(key, F.col(label).cast("int").alias(label), *columns), columns).fillna(0.0, columns)
    constant = constant_columns(rows, columns).where("constant").collect() if columns else []  # a row for each column
    names = [c for c in columns if c not in {r.column for r in constant}]
    out = rows.select(key, label, *names)
    for table in further:
        if table is None:
            continue
        fresh = [c for c in table.columns if c != key and c not in {label, *names}]
        out = out.join(table.select(key, *(F.col(c).cast("double").alias(c) for c in fresh)), key, "left")
        names += fresh
    if representatives is not None:
        wanted = [r.feature for r in representatives.select("feature").distinct().where(F.col("feature").isin(names)).collect()]
        categorical = [c for c in names if c in CATEGORICAL_NAMES or any(p in c for p in CATEGORICAL_PARTS)]
        names = [*categorical, *(c for c in names if c in wanted and c not in categorical)]
    return out.select(key, label, *names).fillna(0.0, names)


def tsne_bytes(n: int, perplexity: float) -> int:
    """What t-SNE of n rows takes, as a guard before anything of that kind is collected."""
    return math.ceil(208 * n * perplexity + 1285 * n + 126e6)
