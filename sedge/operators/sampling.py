"""Splits and samples, by order of a hash of the id and a seed: the same rows whatever the partitions, no random state.

Places within a class come from windows partitioned by class and a slice of the hash, and from counts of the slices, so
a class is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256


def order_of(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def with_place(rows: DataFrame, key: str, by: list[str], seed: int = 42) -> DataFrame:
    """Adds place, 0 and up within `by`, in hash order, and size, the rows within `by`."""
    h = order_of(key, seed)
    hashed = rows.withColumn("__h", h).withColumn("__s", F.shiftright("__h", 56))
    counts = hashed.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *by, "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(*by)).alias("size")
    )
    within = F.row_number().over(Window.partitionBy(*by, "__s").orderBy("__h", key)) - 1
    placed = hashed.withColumn("__k", within).join(starts, [*by, "__s"])
    return placed.withColumn("place", F.col("__start") + F.col("__k")).drop("__h", "__s", "__k", "__start")


def stratified_folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold (1 to k), equally many of each class in each."""
    return with_place(rows, key, [label], seed).withColumn("fold", (F.col("place") % k + 1).cast("int")).drop("place", "size")


def fold_split(folds: DataFrame, fold: int, key: str, label: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training rows of the other folds, as many of each class as the smallest has, and test rows as they are."""
    train, test = folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold)
    least = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least")).withColumn("__on", F.lit(1))
    placed = with_place(train, key, [label], seed + fold).withColumn("__on", F.lit(1))
    chosen = placed.join(F.broadcast(least), "__on").where(F.col("place") < F.col("least"))  # one row
    return chosen.drop("place", "size", "least", "__on"), test


def split(rows: DataFrame, key: str, share: float, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Adds part: train for the first int(size * share) rows within `by`, test for the others."""
    placed = with_place(rows.withColumn("__all", F.lit(0)), key, by or ["__all"], seed)
    return placed.withColumn(
        "part", F.when(F.col("place") < F.floor(F.col("size") * share), "train").otherwise("test")
    ).drop("place", "size", "__all")


def balanced_split(rows: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds part: train for int(smallest class * share) rows of each class, test for the others."""
    placed = with_place(rows, key, [label], seed).withColumn("__on", F.lit(1))
    least = placed.agg(F.min("size").alias("__least")).withColumn("__on", F.lit(1))
    met = placed.join(F.broadcast(least), "__on")  # one row
    return met.withColumn("part", F.when(F.col("place") < F.floor(F.col("__least") * share), "train").otherwise("test")).drop(
        "place", "size", "__least", "__on"
    )


def one_per_group(rows: DataFrame, key: str, group: str, seed: int = 42) -> DataFrame:
    """One row of each group, the first in hash order."""
    first = F.min(F.struct(order_of(key, seed).alias("h"), F.col(key).alias("k")))
    chosen = rows.groupBy(group).agg(first.alias("f")).select(group, F.col("f.k").alias(key))
    return rows.join(chosen, [group, key], "left_semi").dropDuplicates([group])  # rows may repeat the key


def gene_split(rows: DataFrame, key: str, group: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds part: of one row of each group, within each label, the first int(n * share) in hash order are test and the others
    train; rows of their groups that were not taken are leftover."""
    chosen = one_per_group(rows, key, group, seed).select(key, label)
    placed = with_place(chosen, key, [label], seed)
    part = F.when(F.col("place") < F.floor(F.col("size") * share), "test").otherwise("train")
    return rows.join(placed.select(key, part.alias("part")), key, "left").fillna("leftover", ["part"])


def some_groups(rows: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """One row of each of n groups; an error if there are fewer."""
    groups = rows.select(group).distinct().orderBy(order_of(group, seed)).limit(n)
    if groups.count() < n:
        raise ValueError(f"fewer than {n} groups")
    return one_per_group(rows.join(groups, group, "left_semi"), key, group, seed)


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(order_of(key, seed), key).limit(n)


def disjoint_classes(rows: DataFrame, key: str, gene: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """Rows of genes with one class only, one of each gene, n of each class, half train and half test."""
    clear = rows.groupBy(gene).agg(F.count_distinct(label).alias("k")).where("k = 1").select(gene)
    single = one_per_group(rows.join(clear, gene, "left_semi"), key, gene, seed)
    placed = with_place(single, key, [label], seed).where(F.col("place") < n)
    return placed.withColumn("part", F.when(F.col("place") < n // 2, "train").otherwise("test")).drop("place", "size")


def proportional(rows: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows, of each class in proportion, rounded half to even."""
    placed = with_place(rows, key, [label], seed).withColumn("__on", F.lit(1))
    total = rows.agg(F.count(F.lit(1)).alias("__total")).withColumn("__on", F.lit(1))
    met = placed.join(F.broadcast(total), "__on")  # one row
    return met.where(F.col("place") < F.bround(n * F.col("size") / F.col("__total"))).drop("place", "size", "__total", "__on")


def contiguous_folds(rows: DataFrame, key: str, k: int = 10, seed: int = 42) -> DataFrame:
    """Adds fold (0 to k - 1) of equal contiguous slices in hash order; what is left over has none, as have fewer than k rows."""
    placed = with_place(rows.withColumn("__all", F.lit(0)), key, ["__all"], seed)
    fold = F.floor(F.try_divide("place", F.floor(F.col("size") / k))).cast("int")
    return placed.withColumn("fold", F.when(fold < k, fold)).drop("place", "size", "__all")


def augmented(rows: DataFrame, key: str, sequence: str, copies: int, seed: int = 42) -> DataFrame:
    """`copies` copies of each row with one base put in, at a place and of a kind that the hash tells; ids get
    _augmented_{i}_{seed}."""
    each = rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    h = F.xxhash64(F.col(key), F.col("__i"), F.lit(seed))
    at = F.pmod(h, F.length(sequence) + 1).cast("int") + 1
    base = F.element_at(F.array(*map(F.lit, "ACGT")), (F.pmod(F.shiftright(h, 32), F.lit(4)) + 1).cast("int"))
    return each.withColumn(sequence, F.overlay(F.col(sequence), base, at, F.lit(0))).withColumn(
        key, F.concat(F.col(key).cast("string"), F.lit("_augmented_"), F.col("__i"), F.lit(f"_{seed}"))
    ).drop("__i")
