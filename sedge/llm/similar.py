"""Texts whose sets of shingles are similar, for the pipeline's near-dedup stage: SimHash look-ups and exact sets.

A node is a set of shingles; texts with equal sets are one node. Candidates are nodes whose 64-bit fingerprints the
multi-index look-ups of simhash.py link, and nodes that share a key (fingerprint.first_keys). Every link is decided by the
sets themselves, so none is false.

Keys may be crowded: by a group of copies, or by a passage that many texts hold. All pairs are made in keys of at most
`small` nodes. Of a larger key each node is compared with one member, the nearest to the key's majority, which is the
original where all are copies of one; what is linked then needs no pairs. Of keys that this leaves in several components,
those outside the largest are compared with all others of the key in bounded blocks, each pair of blocks a group of its own, in
which no rows of pairs are made. Where more than a block of nodes is outside, the key's members first get finer keys, and
these are treated in the same way, as texts that share no more than a passage seldom have them alike.

A node is told by a 64-bit hash of its set, so two of n different sets become one with a chance below n * n / 2**65.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import ship, written
from sedge.llm.components import components
from sedge.llm.fingerprint import finer_rows, shingle_sets

#: Shingles of the sets in a block, about, and columns of a table of them that are counted at once.
BLOCK_SHINGLES, COLUMNS = 1 << 20, 4096


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _met(rows: DataFrame) -> DataFrame:
    """key, node, size, root and n (nodes of the key) of the keys that nodes of several roots share."""
    keyed = written(rows.select("node", "size", "root", F.explode("keys").alias("key")).distinct(), "similar-keyed")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b"))
    return written(keyed.hint("merge").join(shared.where("a < b").select("key", "n"), "key"), "similar-met")


def _centres(crowded: DataFrame, sets: DataFrame, sample: int = 64) -> DataFrame:
    """key and y: of each key the member nearest to the majority, bit by bit, of about `sample` of them."""

    def majority(table: pa.Table) -> pa.Table:
        words = table["wide"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        bits = np.unpackbits(words.view(np.uint8).reshape(table.num_rows, -1), axis=1, bitorder="little")
        most = np.packbits((2 * bits.sum(0, dtype=np.int64) > len(bits)).astype(np.uint8), bitorder="little").view("<i8")
        return pa.table([table["key"][:1], pa.array([most], pa.list_(pa.int64()))], names=["key", "middle"])

    members = written(crowded.select("key", "node", "n").hint("merge").join(sets.select("node", "wide"), "node"), "similar-members")
    some = members.where(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / sample)) == 0).select("key", "wide")
    middles = written(some.groupBy("key").applyInArrow(majority, "key bigint, middle array<bigint>"), "similar-middles")
    bits = F.zip_with("wide", "middle", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    away = F.aggregate(bits, F.lit(0), lambda x, y: x + y)
    near = members.hint("merge").join(middles, "key").select("key", F.struct(away.alias("away"), "node").alias("m"))
    return written(near.groupBy("key").agg(F.min("m.away").alias("away"), F.min("m").alias("m")).select("key", F.col("m.node").alias("y")), "similar-centres")


def _candidates(met: DataFrame, sets: DataFrame, ratio: Fraction, small: int) -> DataFrame:
    """u and v: all pairs of a key of `small` nodes at most, and of larger keys each node with the key's centre; without
    those of one root, and those whose sizes alone say that they are not similar."""
    few = met.where(F.col("n") <= small).drop("n")
    ends = [F.col(c).alias(f"{c}_y") for c in ("node", "size", "root")]
    pairs = few.hint("merge").join(few.select("key", *ends), "key").where("node < node_y")
    sized = lambda d: d.where(
        (F.col("root") != F.col("root_y"))
        & (ratio.denominator * F.least("size", "size_y") >= ratio.numerator * F.greatest("size", "size_y"))
    ).select(*_pair(F.col("node"), F.col("node_y")))
    out = sized(pairs)
    crowded = met.where(F.col("n") > small)
    if not crowded.isEmpty():
        centres = _centres(crowded, sets)
        middle = crowded.hint("merge").join(centres, "key").where("node = y").select("key", *ends)
        out = out.unionByName(sized(crowded.hint("merge").join(middle, "key").where("node <> node_y")))
    return out.distinct()


def _verified(pairs: DataFrame, sets: DataFrame, ratio: Fraction) -> DataFrame:
    """u and v of the pairs whose sets are that similar."""
    for end, to in (("u", "a"), ("v", "b")):
        pairs = pairs.hint("merge").join(sets.select(F.col("node").alias(end), F.col("shingles").alias(to)), end)
    common = F.size(F.array_intersect("a", "b"))
    return pairs.where(ratio.denominator * common >= ratio.numerator * (F.size("a") + F.size("b") - common)).select("u", "v")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with root: that of roots, or the node itself."""
    own = roots.withColumnRenamed("root", "__root")
    return nodes.hint("merge").join(own, "node", "left").withColumn("root", F.coalesce("__root", "node")).drop("__root")


def _open_keys(crowded: DataFrame, block: int) -> DataFrame:
    """key, main (its largest component), and of its members inside and outside of that the blocks m and r, for keys of
    several components. crowded: key, node, size, root."""
    parts = crowded.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    keys = parts.groupBy("key").agg(
        F.max(F.struct("c", "root", "s")).alias("x"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("k")
    )
    blocks = lambda c, s: F.greatest(F.ceil(c / block), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    x = lambda c: F.col(f"x.{c}")
    m, r = blocks(x("c"), x("s")), blocks(F.col("c") - x("c"), F.col("s") - x("s"))
    return keys.where("k > 1").select("key", x("root").alias("main"), m.alias("m"), r.alias("r"))


def _in_blocks(crowded: DataFrame, open_keys: DataFrame, sets: DataFrame, ratio: Fraction) -> DataFrame:
    """u and v: links that connect all similar members of one key that are in different components."""

    def compared(table: pa.Table) -> pa.Table:
        first, node = table["first"].to_numpy(), table["node"].to_numpy()
        names, root = np.unique(table["root"].to_numpy(), return_inverse=True)
        lists = table["shingles"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        row, shingle = np.repeat(np.arange(len(node)), sizes), np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        x = np.flatnonzero(first)
        y = x if first.all() else np.flatnonzero(~first)
        in_x, in_y = (np.bincount(shingle[np.isin(row, z)], minlength=shingle.max(initial=-1) + 1) for z in (x, y))
        both = (in_x > 1) if y is x else (in_x > 0) & (in_y > 0)
        column = (np.cumsum(both) - 1)[shingle] if len(shingle) else shingle
        used = np.flatnonzero(both[shingle]) if len(shingle) else shingle
        used = used[np.argsort(column[used], kind="stable")]
        row, column = row[used], column[used]
        common = np.zeros((len(x), len(y)), dtype=np.float32)
        for at in range(0, int(both.sum()), COLUMNS):
            a, b = np.searchsorted(column, (at, at + COLUMNS))
            has = np.zeros((len(node), COLUMNS), dtype=np.float32)
            has[row[a:b], column[a:b] - at] = 1
            common += has[x] @ has[y].T
        common = common.astype(np.int64)
        union = sizes[x][:, None] + sizes[y][None, :] - common
        i, j = np.nonzero((ratio.denominator * common >= ratio.numerator * union) & (root[x][:, None] != root[y][None, :]))
        i, j = x[i], y[j]
        parent = list(range(len(names)))

        def top(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        kept = []
        for k in np.unique(root[i] * len(names) + root[j], return_index=True)[1].tolist():
            a, b = top(int(root[i[k]])), top(int(root[j[k]]))
            if a != b:
                parent[a] = b
                kept.append(k)
        i, j = node[i[kept]], node[j[kept]]
        return pa.table([np.maximum(i, j), np.minimum(i, j)], names=["u", "v"])

    inside, o = F.col("root") == F.col("main"), F.col("own")
    own = F.pmod(F.xxhash64("node", "key"), F.when(inside, F.col("m")).otherwise(F.col("r"))).cast("int")
    placed = crowded.select("key", "node", "root").hint("merge").join(open_keys, "key").withColumn("own", own)
    of = lambda with_main, first, i, j: F.struct(
        F.lit(with_main).alias("with_main"), F.lit(first).alias("first"), i.alias("i"), j.alias("j")
    )
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # The members outside meet those of the largest component, and each other.
    to = F.when(inside, F.transform(upto("r"), lambda i: of(True, False, i, o))).otherwise(
        F.concat(
            F.transform(upto("m"), lambda j: of(True, True, o, j)),
            F.transform(upto("r"), lambda k: of(False, o <= k, F.least(o, k), F.greatest(o, k))),
        )
    )
    dealt = written(placed.select("key", "node", "root", F.explode(to).alias("t")).select("key", "node", "root", "t.*"), "similar-dealt")
    ship(crowded.sparkSession)
    return (
        dealt.hint("merge")
        .join(sets.select("node", "shingles"), "node")
        .groupBy("key", "with_main", "i", "j")
        .applyInArrow(compared, "u bigint, v bigint")
        .distinct()
    )


def _grown(roots: DataFrame, found: DataFrame) -> DataFrame:
    """node and root with the links of found beside those of roots."""
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))


def similar_roots(
    docs: DataFrame, rows: DataFrame, near64: DataFrame, width: int, similarity: float, small: int = 16, block: int = 256
) -> DataFrame:
    """node and root, for every node that is linked to another but the roots. rows: the shingle_rows() of docs; near64:
    links between fingerprints."""
    ratio = Fraction(similarity).limit_denominator(10**6)
    own = written(rows.groupBy("node").agg(F.min("h").alias("h"), F.first("size").alias("size"), F.first("keys").alias("keys")), "similar-nodes")
    met = _met(own.select("node", "size", "keys", F.col("node").alias("root")))
    nodes = rows.select("fp", "node").distinct()
    lowest = nodes.groupBy("fp").agg(F.min("node").alias("y"))
    lowest = written(lowest, "similar-lowest")
    of = lambda end: lowest.select(F.col("fp").alias(end), F.col("y").alias(f"y_{end}"))
    looked_up = nodes.join(lowest, "fp").where("node <> y").select(*_pair(F.col("node"), F.col("y"))).unionByName(
        near64.join(of("u"), "u").join(of("v"), "v").select(*_pair(F.col("y_u"), F.col("y_v")))
    )
    looked_up = written(looked_up.distinct(), "similar-looked-up")
    asked = met.select("node").union(looked_up.select("u")).union(looked_up.select("v")).distinct().join(own.select("node", "h"), "node")
    texts = docs.select(F.xxhash64("text").alias("h"), "text").join(asked, "h").select("node", "text").dropDuplicates(["node"])
    sets = written(shingle_sets(texts, width), "similar-sets")
    pairs = written(_candidates(met, sets, ratio, small).unionByName(looked_up).distinct(), "similar-pairs")
    roots = components(written(_verified(pairs, sets, ratio), "similar-found"))
    crowded = written(_rooted(met.where(F.col("n") > small).drop("root"), roots), "similar-crowded")
    open_keys = written(_open_keys(crowded, block), "similar-open")
    if open_keys.isEmpty():
        return roots
    more = [_in_blocks(crowded, open_keys.where("r = 1"), sets, ratio)]
    wide_open = open_keys.where("r > 1")
    if not wide_open.isEmpty():
        inside = crowded.join(wide_open.select("key"), "key", "left_semi").select("node").distinct()
        finer = finer_rows(sets.hint("merge").join(inside, "node", "left_semi"), similarity)
        met = _met(_rooted(finer, roots))
        found = written(_verified(_candidates(met, sets, ratio, small), sets, ratio), "similar-finer")
        roots = _grown(roots, found)
        crowded = written(_rooted(met.where(F.col("n") > small).drop("root"), roots), "similar-crowded")
        more.append(_in_blocks(crowded, written(_open_keys(crowded, block), "similar-open"), sets, ratio))
    last = written(more[0].unionByName(more[1]) if len(more) > 1 else more[0], "similar-last")
    return roots if last.isEmpty() else _grown(roots, last)
