"""Models on feature matrices, by MLlib, and what is read off them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.permuted import permuted_calls
from sedge.operators.sampling import stratified_folds, with_place
from sedge.sources.scratch import written


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="error").transform(rows.fillna(0.0, columns))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows over classes times rows of the class; rows of no class go. The counts, one for each class, come to
    the driver, so that what a fit reads again and again has no joins."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    total, weight = sum(sizes.values()), F.lit(None).cast("double")
    for k, n in sizes.items():
        weight = F.when(F.col(label) == F.lit(k), F.lit(total / (len(sizes) * n))).otherwise(weight)
    return rows.where(F.col(label).isNotNull()).withColumn("weight", weight)


def dealt_out(rows: DataFrame, *by: str) -> DataFrame:
    """rows in as many parts as there are cores, however few the input's files and row groups are. More parts would cost a
    fit more than they give: each has statistics of all nodes of a level of its own."""
    return rows.repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism), *by)


def fit_forest(train: DataFrame, columns: list[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42):
    """A forest of weighted classes. Parts and their order are told by the values, and so are the rows that a tree draws.
    Rows keep the nodes that they are in, which gives the same forest; else all trees go to every task of every level."""
    told = class_weights(train.select(label, *columns), label).withColumn("__h", F.xxhash64(*columns, label))
    parts = dealt_out(told, "__h").sortWithinPartitions("__h")
    return RandomForestClassifier(
        featuresCol="__x", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True
    ).fit(assembled(parts, columns).select(label, "__x", "weight"))


def predictions(model, rows: DataFrame, columns: list[str], key: str, label: str) -> DataFrame:
    p = vector_to_array("probability")
    out = model.transform(assembled(rows, columns))
    return out.select(
        key, F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
        p[0].alias("y_pred_proba_class_0"), p[1].alias("y_pred_proba_class_1"),
    )


def balanced_accuracy(predicted: DataFrame) -> float:
    y, p = F.col("y_true"), F.col("y_pred")
    row = predicted.agg(
        F.avg(F.when(y == 1, (p == 1).cast("int"))).alias("a"), F.avg(F.when(y == 0, (p == 0).cast("int"))).alias("b")
    ).first()
    return ((row[0] or 0.0) + (row[1] or 0.0)) / 2


def dealt_anew(rows: DataFrame, columns: list[str], key: str, label: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Each row in each repeat (__r): label as __y, its columns, and in __new the columns of the row that has its place in
    another hash order. Rows meet by a merge in as many parts as there are cores: no side of it goes to the driver, whatever
    its size, and no few tasks score all. Which columns there are does not change who meets whom."""
    place = lambda s: with_place(rows.withColumn("__all", F.lit(0)), key, ["__all"], s).drop("size", "__all")
    other = [
        place(seed + 1 + r).select("place", F.lit(r).alias("__r"), F.struct(*(F.col(c).cast("double").alias(c) for c in columns)).alias("__new"))
        for r in range(repeats)
    ]
    given = place(seed).select("place", F.col(label).alias("__y"), *columns)
    return dealt_out(given, "place").join(dealt_out(reduce(DataFrame.unionByName, other), "place").hint("merge"), "place").drop("place")


def _importance(model, met: DataFrame, columns: list[str]) -> DataFrame:
    """permutation_importance() of rows that have met their new values. A repeat has all rows, so the mean over repeats is
    that over all its rows together."""
    share = lambda k: F.coalesce(F.try_divide(F.sum(F.when(F.col("__y") == k, F.col("right"))), F.sum(F.when(F.col("__y") == k, F.col("n")))), F.lit(0.0))
    scores = permuted_calls(model, met, columns).groupBy("__f").agg(((share(0) + share(1)) / 2).alias("score"))
    base = F.max(F.when(F.col("__f") == -1, F.col("score"))).over(Window.partitionBy(F.lit(0)))  # a row for each feature, and one
    lost = scores.withColumn("lost", base - F.col("score")).where("__f >= 0")
    names = F.array(*map(F.lit, columns))
    return lost.select(F.get(names, F.col("__f").cast("int")).alias("feature"), F.greatest(F.col("lost"), F.lit(0.0)).alias("importance"))


def permutation_importance(
    model, rows: DataFrame, columns: list[str], key: str, label: str, repeats: int = 5, seed: int = 42
) -> DataFrame:
    """feature and the mean loss of balanced accuracy, not below 0, when its column is dealt out anew, `repeats` times. In
    each repeat a row gets the values of the row that has its place in another hash order; `permuted` has how the model calls it with
    each of them."""
    return _importance(model, dealt_anew(rows, columns, key, label, repeats, seed), columns)


def _chain(
    train: DataFrame, test: DataFrame | None, columns: list[str], key: str, label: str, step: int, least: int, trees: int,
    depth: int, repeats: int,
) -> list[tuple[int, float | None, list[str]]]:
    """Ever smaller sets of features, with their scores on the test rows if there are any. The `step` features of the least
    permutation importance on the training rows go first; of equal ones the last by name. Rows meet their new values once
    for all sets."""
    left, out = list(columns), []
    met = written(dealt_anew(train, columns, key, label, repeats), "elimination-met") if len(left) > least else None
    while True:
        model = fit_forest(train, left, label, trees=trees, depth=depth)
        out.append((len(left), None if test is None else balanced_accuracy(predictions(model, test, left, key, label)), list(left)))
        if len(left) <= least:
            return out
        lost = {r.feature: r.importance for r in _importance(model, met, left).collect()}
        order = sorted(left, key=lambda c: (-lost[c], c))
        kept = set(order[: max(least, len(left) - step)])
        left = [c for c in left if c in kept]


def recursive_elimination(
    train: DataFrame, test: DataFrame, columns: list[str], key: str, label: str, step: int = 1, least: int = 1, trees: int = 100,
    depth: int = 10, repeats: int = 5,
) -> DataFrame:
    """Scores of ever smaller sets of features, those of the least permutation importance on the training rows going first:
    step (number of features), score (balanced accuracy on the test rows), features. A fit and two jobs for each set, of
    which a row for each feature comes to the driver."""
    out = _chain(train, test, columns, key, label, step, least, trees, depth, repeats)
    return train.sparkSession.createDataFrame(out, "step int, score double, features array<string>")


@dataclass
class Elimination:
    """scores: repeat, fold, step (number of features), score and features. steps: step, mean and std of its scores, and
    whether it is chosen by the best mean (the smallest of equal ones) and by the one-standard-error rule. selection:
    feature, rank (1: in the best set; the higher, the earlier it went), selected, selected_by_max and cluster (1 and up for
    selected features in order of rank, else 0)."""

    scores: DataFrame
    steps: DataFrame
    selection: DataFrame


def cross_validated_elimination(
    rows: DataFrame, columns: list[str], key: str, label: str, folds: int = 5, cv_repeats: int = 1, step: int = 5,
    one_error: bool = True, trees: int = 100, depth: int = 10, repeats: int = 5, seed: int = 42, parallelism: int = 4,
) -> Elimination:
    """Elimination in each of `folds` stratified folds, dealt anew `cv_repeats` times, and then over all rows down to the
    chosen number. The chains of fits do not depend on each other, so `parallelism` of them run at a time, each fit being
    distributed. The standard error is that of `folds` scores, whatever the repeats. Only scores and importances come to
    the driver."""
    spark = rows.sparkSession
    dealt = rows.select(key, label, *columns)
    for r in range(cv_repeats):
        dealt = stratified_folds(dealt, key, label, folds, seed + r).withColumnRenamed("fold", f"__fold{r}")
    dealt = written(dealt, "elimination-folds")

    def one(place: tuple[int, int]) -> list[tuple]:
        r, k = place
        side = F.col(f"__fold{r}") == k
        return [(r, k, *x) for x in _chain(dealt.where(~side), dealt.where(side), columns, key, label, step, 1, trees, depth, repeats)]

    with ThreadPool(parallelism) as pool:
        scores = [x for part in pool.map(one, [(r, k) for r in range(cv_repeats) for k in range(1, folds + 1)], 1) for x in part]
    of = {n: [s for _, _, m, s, _ in scores if m == n] for n in sorted({x[2] for x in scores})}
    means = {n: sum(x) / len(x) for n, x in of.items()}
    stds = {n: (sum((s - means[n]) ** 2 for s in x) / len(x)) ** 0.5 for n, x in of.items()}
    best = min(of, key=lambda n: (-means[n], n))
    near = min(n for n in of if means[n] >= means[best] - stds[best] / folds**0.5)
    chain = _chain(dealt, None, columns, key, label, step, best, trees, depth, repeats)
    rank = {c: 1 + sum(c not in left for _, _, left in chain) for c in columns}
    order = sorted(columns, key=lambda c: rank[c])
    chosen = order[: near if one_error and near < best else best]
    return Elimination(
        spark.createDataFrame(scores, "repeat int, fold int, step int, score double, features array<string>"),
        spark.createDataFrame(
            [(n, means[n], stds[n], n == best, n == near) for n in of],
            "step int, mean double, std double, chosen_by_max boolean, chosen_by_error boolean",
        ),
        spark.createDataFrame(
            [(c, rank[c], c in chosen, rank[c] == 1, chosen.index(c) + 1 if c in chosen else 0) for c in columns],
            "feature string, rank int, selected boolean, selected_by_max boolean, cluster int",
        ),
    )


def cluster_elimination(rows: DataFrame, members: dict[str, list[str]], key: str, label: str, **settings) -> Elimination:
    """cross_validated_elimination() over clusters of features, each standing as the mean of its members, which are scaled
    alike."""
    means = {c: reduce(lambda a, b: a + b, (F.coalesce(F.col(f), F.lit(0.0)) for f in own)) / len(own) for c, own in members.items()}
    return cross_validated_elimination(rows.select(key, label, *(m.alias(c) for c, m in means.items())), list(members), key, label, **settings)


def principal_components(rows: DataFrame, columns: list[str], key: str, k: int | None = None, variance: float | None = None, whiten: bool = False):
    """key and components (an array) of centred columns, and the share of variance of each. MLlib does not centre. Signs
    mean nothing. variance: as many components as explain that share."""
    means = rows.agg(*(F.avg(c).alias(c) for c in columns)).first()
    centred = rows.select(key, *((F.coalesce(F.col(c), F.lit(means[c])) - F.lit(means[c])).alias(c) for c in columns))
    model = PCA(k=k or len(columns), inputCol="__x", outputCol="__pc").fit(assembled(centred, columns))
    shares = list(model.explainedVariance.toArray())
    n = len(shares)
    if variance is not None:
        total = 0.0
        for n, s in enumerate(shares, 1):
            total += s
            if total >= variance:
                break
    parts = F.slice(vector_to_array("__pc"), 1, n)
    out = model.transform(assembled(centred, columns)).select(key, parts.alias("components"))
    if whiten:
        sd = out.agg(*(F.stddev_samp(F.col("components")[i]).alias(str(i)) for i in range(n))).first()
        out = out.select(key, F.array(*(F.try_divide(F.col("components")[i], F.lit(sd[i])) for i in range(n))).alias("components"))
    return out, shares[:n], model


def loadings(model, columns: list[str], top: int = 10) -> list[tuple[str, float]]:
    """Features of the largest sums of absolute loadings."""
    sums = abs(model.pc.toArray()).sum(axis=1)
    return sorted(((c, float(s)) for c, s in zip(columns, sums, strict=True)), key=lambda x: (-x[1], x[0]))[:top]


def logistic(train: DataFrame, columns: list[str], label: str):
    return LogisticRegression(featuresCol="__x", labelCol=label, regParam=0.0, maxIter=100).fit(assembled(train, columns))
