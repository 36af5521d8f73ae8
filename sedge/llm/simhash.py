"""SimHash near-dedup (operator 5): multi-index hashing over 64-bit fingerprints.

Two fingerprints that differ in at most three bits differ in at most one within one of their two 32-bit halves. So each
distinct fingerprint is put into a table under both halves, and looks up the Hamming ball of radius one around each of
its halves; what the table returns is verified by the complete distance. Of two halves that differ in one bit, one has
it set: only balls downwards are enumerated, 17 look-ups on average instead of 33, and each pair is met from one side.

A half that more than `crowded` fingerprints share gets another exact treatment, in which no pairs are made. Let x and y
differ in at most three bits, y being in the crowded bucket. In the other half there is then a value z at most one bit
from y, and at most two bits from x if x has the same first half, one if not. All that lie that near to one z are
within three bits of each y there, so each x is linked to the smallest such y alone. A z has at most 529 + 32 * 33
fingerprints about it, however large the bucket is.

Links are made between distinct fingerprints only; copies never multiply them.

Texts whose sets of shingles have a similarity (Jaccard) of 0.8 differ in about 15 % of all bits, so segments that are
equal, or within a small ball, would take hundreds of keys a document. Where such similarities count (keep_one, the
pipeline's stage), the links above are candidates beside others; see similar.py.

Defined results: a null text has no words and fingerprint zero, and so has any text without words; fingerprints of
equal texts are equal, so rows repeated, or with equal ids, come out alike; a null doc_id is kept as null, and a
component in which all ids are null has a null component_id; an empty table gives an empty result. A very long text is
hashed in blocks, and a row of its hashes is all that is held of it. Other columns are not read, but keep_one() returns
them as they were; its own start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import own_names, quoted, written
from sedge.llm.components import components
from sedge.llm.fingerprint import fingerprints, shingle_rows
from sedge.llm.similar import similar_roots

#: Fixed by the two halves: three bits cannot put two into both.
MOST_BITS = 3
HALF = 0xFFFFFFFF
BALL_1 = [0, *(1 << i for i in range(32))]
BALL_2 = [*BALL_1, *((1 << i) | (1 << j) for i in range(32) for j in range(i))]


def _half(s: Column, fp: Column) -> Column:
    return F.when(s == 0, fp.bitwiseAND(F.lit(HALF))).otherwise(F.shiftrightunsigned(fp, 32))


def _table(fps: DataFrame) -> DataFrame:
    return fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).withColumn(
        "half", _half(F.col("s"), F.col("fp"))
    )


def _probes(table: DataFrame) -> DataFrame:
    """Each half itself, and with each of its set bits cleared."""
    half = F.col("half")
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(half, i) == 1)
    down = F.transform(set_bits, lambda i: half.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return table.select("fp", "s", half.alias("own"), F.explode(F.concat(F.array(half), down)).alias("half"))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _verified(probes: DataFrame, table: DataFrame) -> DataFrame:
    met = probes.withColumnRenamed("fp", "x").hint("merge").join(table.withColumnRenamed("fp", "y"), ["s", "half"])
    x, y = F.col("x"), F.col("y")
    once = (F.col("own") != F.col("half")) | (x > y)
    return met.where(once & (x != y) & (_distance(x, y) <= MOST_BITS)).select(*_pair(x, y)).distinct()


def _crowded_links(probes: DataFrame, table: DataFrame) -> DataFrame:
    """Links of all probes into crowded buckets, without pairs."""
    around = lambda masks: F.array(*(F.lit(m).cast("long") for m in masks))
    masks = F.when(F.col("own") == F.col("half"), around(BALL_2)).otherwise(around(BALL_1))
    rest = _half(1 - F.col("s"), F.col("fp"))
    near = probes.select("fp", "s", "half", rest.alias("rest"), F.explode(masks).alias("mask")).select(
        "fp", "s", "half", F.col("rest").bitwiseXOR(F.col("mask")).alias("z")
    )
    centres = table.select("fp", "s", "half", rest.alias("rest"), F.explode(around(BALL_1)).alias("mask")).select(
        "fp", "s", "half", F.col("rest").bitwiseXOR(F.col("mask")).alias("z")
    )
    lowest = centres.groupBy("s", "half", "z").agg(F.min("fp").alias("y"))
    return (
        near.join(lowest, ["s", "half", "z"])
        .where(F.col("fp") != F.col("y"))
        .select(*_pair(F.col("fp"), F.col("y")))
        .distinct()
    )


def links(fps: DataFrame, crowded: int = 64) -> DataFrame:
    """u and v: enough pairs of distinct fingerprints at most three bits apart to connect all that are linked."""
    table = _table(fps)
    probes = _probes(table)
    full = written(
        table.groupBy("s", "half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("s", "half"),
        "simhash-crowded",
    )
    if full.isEmpty():
        return _verified(probes, table)
    on = ["s", "half"]
    # probes of crowded buckets find nothing in what is left of the table, so they need no join of their own
    return _verified(probes, table.join(full, on, "left_anti")).unionByName(
        _crowded_links(probes.join(full, on), table.join(full, on))
    )


def near_duplicates(docs: DataFrame, width: int = 3, crowded: int = 64) -> DataFrame:
    """doc_id, h (a hash of the text), fp, root (a fingerprint that stands for the component) and component_id, the
    smallest doc_id that the row's fingerprint reaches, for each row of docs."""
    rows = written(fingerprints(docs, width), "simhash-rows")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    roots = components(links(fps.select("fp"), crowded)).withColumnRenamed("node", "fp")
    known = written(
        fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots"
    )
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = written(known.join(least, "root").select("fp", "root", "component_id"), "simhash-labels")
    return rows.hint("merge").join(labels, "fp").select("doc_id", "h", "fp", "root", "component_id")


def similar_texts(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, crowded: int = 64, small: int = 16, block: int = 256
) -> DataFrame:
    """doc_id, h (a hash of the text) and root for each row of docs: rows have one root if links between sets of shingles
    that are that similar connect them. small, block: see similar.py."""
    rows = written(shingle_rows(docs, width, similarity), "simhash-rows")
    near64 = written(links(rows.select("fp").distinct(), crowded), "simhash-links")
    roots = written(similar_roots(docs, rows, near64, width, similarity, small, block), "simhash-similar")
    return (
        rows.select("doc_id", "h", "node").hint("merge").join(roots, "node", "left")
        .select("doc_id", "h", F.coalesce("root", "node").alias("root"))
    )


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of similar texts, with its columns: the one of the smallest doc_id, nulls last; of rows
    with that doc_id, the one whose text has the smallest hash; of equal ones, any one."""
    found = similar_texts(docs, width, similarity).groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h", "n")).alias("w"))
    id_, h, n, root, own = own_names(docs.columns, "id", "h", "n", "root", "own")
    first = first.select(
        F.col("w.doc_id").alias(id_), F.col("w.h").alias(h), F.col("w.n").alias(n), F.col("root").alias(root)
    )
    rows = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(h))
    at = rows.hint("merge").join(first, same)
    once = at.where(F.col(n) == 1)
    repeated = at.where(F.col(n) > 1).dropDuplicates([root])
    return once.unionByName(repeated).select(quoted(docs.columns))
