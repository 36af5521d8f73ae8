"""Exact dedup (operator 8): a persistent digest index, bucketed and sorted by hash.

New data is reduced to one row per digest, set against the index by a sort-merge anti-join, and what is new is
appended. The index is a bucketed table, so its side of that join is not shuffled. While each bucket is one sorted file it
is not sorted either; after many appends, `compact()` restores that.

A batch has a name, and each digest of the index the batch that brought it. A batch that failed half-way, or is given
again, finds its own digests there and is decided as it was before.

Defined results: a null text counts as empty; a null doc_id is smaller than any other; rows repeated with the same
doc_id and text count each, and one of them stays; an empty table gives an empty result and leaves the index as it was.
A very long text is only hashed, in the scan. Other columns are not read; exact_dedup() returns them as they were, and takes
names for its own that they have not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.common import lower_ascii, own_names, quoted, scratch_path, written


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256))


#: With this setting Spark knows that a bucket of one sorted file is sorted.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: Equal rows that one task makes at most.
PORTION = 1024


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SORTED_BUCKETS)
    spark.conf.set(SORTED_BUCKETS, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_BUCKETS, before)


class DigestIndex:
    """The digests of all data seen so far: (digest, keep_id, batch), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = 32):
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def frame(self) -> DataFrame:
        return self.spark.table(self.table)

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")  # one file per bucket, from tasks that hold whole buckets
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.table)
        )

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The rows of groups, one for each digest, whose digest is not in the index."""
        return groups.hint("merge").join(self.frame().select("digest"), "digest", "left_anti")

    def decide(self, batch: DataFrame, name: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Append what is new in batch. Return a row for each doc_id and digest of its rows: doc_id, digest, keep_id (the
        row that stays, of this batch or an earlier one), group_size (rows of this batch with that digest), repeats (rows
        with that digest and doc_id), kept (one of these stays). name: the batch's; give one where it may come again.

        Within the batch the largest doc_id stays; a digest known before keeps its earlier row.
        """
        name = uuid.uuid4().hex if name is None else name
        # Rows are counted by digest and id before any of them is shuffled by digest alone.
        rows = written(
            batch.select(F.col(doc_id).cast("bigint").alias("doc_id"), digest(F.col(text)).alias("digest"))
            .groupBy("digest", "doc_id")
            .agg(F.count(F.lit(1)).alias("n")),
            "digest-rows",
        )
        groups = written(
            rows.groupBy("digest").agg(F.max("doc_id").alias("max_id"), F.sum("n").alias("group_size")),
            "digest-groups",
        )
        with _sorted_buckets(self.spark):
            fresh = written(self.fresh(groups), "digest-fresh")  # read in full before the table it is set against grows
            self._append(fresh.select("digest", F.col("max_id").alias("keep_id"), F.lit(name).alias("batch")))
            resolved = written(
                groups.hint("merge")
                .join(self.frame(), "digest")
                .select("digest", "keep_id", "group_size", (F.col("batch") == name).alias("is_new")),
                "digest-resolved",
            )
        # Both sides are shuffled by digest here, so a digest that holds much of the data is split at run time.
        kept = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return (
            rows.hint("merge")
            .join(resolved, "digest")
            .select("doc_id", "digest", "keep_id", "group_size", F.col("n").alias("repeats"), kept.alias("kept"))
        )

    def ingest(self, batch: DataFrame, name: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """The same with a row for each row of batch; of equal ones, one is kept."""
        decided = self.decide(batch, name, doc_id, text)
        number = lambda a, b, by=1: F.explode(F.sequence(a, b, F.lit(by).cast("bigint"))).alias("i")
        one, n, i = F.lit(1).cast("bigint"), F.col("repeats"), F.col("i")
        few = decided.where(n <= PORTION).select("*", number(one, n))
        # A row that is there very often is made anew in portions, which are dealt to many tasks.
        many = decided.where(n > PORTION).select("*", number(one, n, PORTION)).repartition("digest", "doc_id", "i")
        many = many.select(*decided.columns, number(i, F.least(i + PORTION - 1, n)))
        return few.unionByName(many).withColumn("kept", F.col("kept") & (i == 1)).drop("i")

    def forget(self) -> None:
        """Take the index out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def compact(self) -> "DigestIndex":
        """Rewrite the index with one sorted file per bucket, as a new table under the same name with the suffix _c."""
        other = DigestIndex(self.spark, f"{self.table}_c", f"{self.path}_c", self.buckets)
        other._append(self.frame())
        return other


def new_index(spark: SparkSession, buckets: int = 32) -> DigestIndex:
    """An empty index in the shared folder, for data that is deduplicated against itself only; forget() it in the end."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", scratch_path(spark, "digest-index"), buckets)


def exact_dedup(batch: DataFrame, index: DigestIndex | None = None, name: str | None = None) -> DataFrame:
    """The rows of batch that stay, with their columns: those that decide() keeps. Without an index, the batch is
    deduplicated against itself."""
    own = index or new_index(batch.sparkSession)
    decided = own.decide(batch, name)
    if index is None:
        own.forget()
    own_digest, digest_, id_, repeats = own_names(batch.columns, "own", "digest", "id", "repeats")
    kept = decided.where("kept").select(
        F.col("digest").alias(digest_), F.col("doc_id").alias(id_), F.col("repeats").alias(repeats)
    )
    kept = written(kept, "digest-kept")
    rows = batch.withColumn(own_digest, digest(F.col("text")))
    same = (F.col(own_digest) == F.col(digest_)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_))
    at = rows.hint("merge").join(kept, same)
    # Rows that repeat both digest and id are rare; of those any one stays.
    if kept.where(F.col(repeats) > 1).isEmpty():
        return at.select(quoted(batch.columns))
    once = at.where(F.col(repeats) == 1)
    repeated = at.where(F.col(repeats) > 1).dropDuplicates([digest_])
    return once.unionByName(repeated).select(quoted(batch.columns))
