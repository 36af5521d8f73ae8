"""Conversation prefix trie (operator 12): every distinct beginning of the conversations, with what it is worth to share.

A conversation's path is the row of the SHA-256 digests of its turns, so a beginning is a prefix of a path and paths in
order of their bytes hold the conversations of each node next to each other. A sample of the paths, about as many for
each turn, gives splitters; shards between them are sorted by path and id. A node that is no prefix of a splitter has
all its conversations in one shard, which finishes it. The others, the skeleton, are the trie of the splitters' paths,
which every task gets: each shard adds up its part of a skeleton node and of all below it, and sums and minima over the
shards finish these. Splitters hold an id beside their path, so that any number of equal conversations are split as well.

The sampled paths are `SKELETON_BYTES` on average at most, whatever the table holds: the share that is sampled is set by
what all paths would take, and of a path at most `SPLITTER_TURNS` turns count, which still splits all but what agrees in
these. Beyond what that allows, some 10^9 turns of short conversations, shards hold more turns.
A list of ids that end at a skeleton node is hashed as a stream, in portions that its shards hand out in order.

Defined results: rows without a conversation's id belong to none and are left out; a null role or text is empty; a null
turn comes first, and equal turns are in the order of their digests; repeated rows are turns of their own; an empty
table has no node; other columns are not read, so their names do not matter. Very long texts are read for their digests
and lengths alone. The digests of one conversation must fit a row of 2 GB, 60 million turns; one beyond a shard's usual
size is a shard by itself.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import ship, written

WIDTH = 32
#: Turns of a shard, on average; bytes of sampled paths at most; turns of a sampled path that count.
SHARD_TURNS, SKELETON_BYTES, SPLITTER_TURNS = 20_000, 1 << 26, 1024
#: Paths in a sample for each shard; ids in a portion of a list.
SAMPLES, PORTION = 8, 1024
NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)
#: Of a shard: finished nodes (kind 0; above: the skeleton node they hang on, if any), parts of skeleton nodes (1; above:
#: their number) and portions of ids that end at one (2).
PART = f"kind int, above bigint, shard int, portion int, ids binary, weight bigint, {NODE}"


def paths(conversations: DataFrame, base: Column | None = None, shared: Column | None = None) -> DataFrame:
    """conv_id, path and chars (code points of each turn's text) of every conversation; with base and shared, each is
    first rebuilt: the first `shared` turns (at most 5) of conversation `base`, then its own after as many."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    ).alias("t")
    rows = conversations.select(F.col("conv_id").cast("bigint"), "turn", "role", "text").where(F.col("conv_id").isNotNull())
    if base is None:
        own = rows.select("conv_id", turn).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    else:
        own = (
            rows.select(base.alias("base"), "conv_id", turn)
            .repartition("base")
            .groupBy("base", "conv_id")
            .agg(F.sort_array(F.collect_list("t")).alias("t"))
        )
        first = own.where(F.col("conv_id") == F.col("base")).select("base", F.slice("t", 1, 5).alias("first"))
        h = shared.cast("int")
        none = F.slice("t", 1, 0)
        own = own.join(first, "base", "left").withColumn(
            "t",
            F.concat(
                F.when(h > 0, F.slice(F.coalesce("first", none), F.lit(1), h)).otherwise(none),
                F.slice("t", h + 1, F.size("t")),
            ),
        )
    path = F.unhex(F.array_join(F.transform("t", lambda x: x["digest"]), ""))
    return own.select("conv_id", path.alias("path"), F.transform("t", lambda x: x["chars"]).alias("chars"))


def choose_splitters(rows: DataFrame, shard_turns: int) -> list[tuple[bytes, int]]:
    """Places between shards: paths with ids, ascending. Sampled by a hash of the id, so always the same."""
    weight = F.least(F.size("chars") + 1, F.lit(SPLITTER_TURNS)).cast("long")
    turns, size = rows.agg(F.sum(weight), F.sum(weight * weight * WIDTH)).first()
    shards = -(-(turns or 0) // shard_turns)
    if shards < 2:
        return []
    share = min(1.0, SAMPLES * shards / turns, SKELETON_BYTES / size)
    odds = weight * F.lit(share)
    sample = rows.where((F.shiftrightunsigned(F.xxhash64("conv_id"), 11) / F.lit(float(1 << 53))) < odds)
    found = sample.select(F.substring("path", 1, WIDTH * SPLITTER_TURNS), "conv_id").collect()
    places = sorted((bytes(p), c) for p, c in found)
    at = [len(places) * k // shards for k in range(1, shards)]
    return sorted({places[i] for i in at}) if places else []


class Skeleton:
    """The trie of the splitters' paths, numbered in preorder; the root is 0."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.depth, self.above = [0], [-1]
        self.numbers: list[list[int]] = []  # of each splitter: those of its prefixes, the root first
        before, own = b"", [0]
        for path, _ in splitters:
            d = common(before, path)
            own = own[: d + 1]
            for k in range(d + 1, len(path) // WIDTH + 1):
                self.depth.append(k)
                self.above.append(own[-1])
                own.append(len(self.depth) - 1)
            self.numbers.append(own)
            before = path

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def beside(self, shard: int) -> list[tuple[bytes, list[int]]]:
        """The splitters about a shard, with their numbers. A node in it that is a prefix of any is one of these."""
        return [(self.splitters[i][0], self.numbers[i]) for i in (shard - 1, shard) if 0 <= i < len(self.splitters)]


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b)) // WIDTH
    if not n:
        return 0
    x, y = (np.frombuffer(v, dtype=np.uint64, count=n * WIDTH // 8).reshape(n, -1) for v in (a, b))
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


def _hash(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


NOTHING = hashlib.sha256(b"").hexdigest()


def build(table: pa.Table, shard: int, skeleton: Skeleton) -> pa.Table:
    """All nodes of one shard; see PART. Rows of nodes are in preorder, which is row by row what each path adds to the
    one before it."""
    table = table.sort_by([("path", "ascending"), ("conv_id", "ascending")]).combine_chunks()
    own = table["path"].to_pylist()
    conv = table["conv_id"].to_numpy().astype(np.int64)
    n = len(own)
    lens = np.array([len(p) // WIDTH for p in own], dtype=np.int64)
    chars = table["chars"].combine_chunks()
    chars = (chars.combine_chunks() if isinstance(chars, pa.ChunkedArray) else chars).flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(lens) - lens  # of each row's turns
    words = np.frombuffer(b"".join(own) or bytes(WIDTH), dtype=np.uint64).reshape(-1, WIDTH // 8)

    # turns that each row shares with the one before
    lcp = np.zeros(n, dtype=np.int64)
    both = np.minimum(lens[1:], lens[:-1])
    if both.sum():
        row = np.repeat(np.arange(1, n), both)
        k = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
        other = (words[start[row] + k] != words[start[row - 1] + k]).any(axis=1)
        lcp[1:] = both
        np.minimum.at(lcp, row[other], k[other])

    # The root belongs to row 0, as if the row before had even that not in common.
    since = lcp.copy()
    since[0] = -1
    fresh = lens - since
    base = np.cumsum(fresh) - fresh
    row = np.repeat(np.arange(n), fresh)
    depth = np.arange(len(row)) - base[row] + since[row] + 1
    m = len(row)

    # the first row after a node's rows: the next that shares fewer turns than the node is deep
    levels = [since]
    while 2 ** len(levels) <= n:
        a, half = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.minimum(a[: n - 2 * half + 1], a[half : n - half + 1]))
    end = row + 1
    open_ = np.flatnonzero((end < n) & (since[np.minimum(end, n - 1)] >= depth))
    at, deep = end[open_], depth[open_]
    for k in range(len(levels) - 1, -1, -1):
        fits = at + 2**k <= n
        ok = fits & (levels[k][np.where(fits, at, 0)] >= deep)
        at = at + ok * 2**k
    end[open_] = at

    bounds = np.stack([row, end], axis=1).ravel()
    least = np.minimum.reduceat(np.append(conv, np.iinfo(np.int64).max), bounds)[::2]
    n_convs = end - row
    order = np.argsort(depth, kind="stable")  # by depth and place
    key = depth[order] * m + order
    above = np.full(m, -1)
    inner = np.flatnonzero(depth > 0)
    above[inner] = order[np.searchsorted(key, (depth[inner] - 1) * m + inner) - 1]
    children = np.bincount(above[inner], minlength=m)
    after = np.append(base, m)[end]  # the first node after those below
    last = np.where(depth > 0, chars[start[row] + np.maximum(depth, 1) - 1] if len(chars) else 0, 0)

    # the skeleton's nodes: of the splitters beside the shard, what they share with a row of it
    number = np.full(m, -1)
    number[0] = 0
    for path, numbers in skeleton.beside(shard):
        i = bisect_right(own, path)
        for r in {max(i - 1, 0), min(i, n - 1)}:
            for d in range(1, common(own[r], path) + 1):
                # the node of row r at depth d: the last of that depth up to the end of r's own
                x = order[np.searchsorted(key, d * m + base[r] + fresh[r] - 1, side="right") - 1]
                number[x] = numbers[d]
    is_skeleton = number >= 0

    def below(x: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(x))
        return sums[after] - sums[:m]

    leaf = (children == 0) & ~is_skeleton
    saved = np.where(is_skeleton, n_convs, n_convs - 1) * last
    leaves, worth = below(leaf), below(saved)
    outside = np.bincount(above[inner][~is_skeleton[inner]], minlength=m)

    # rows that end at a node are the first of its rows, alike and in order of id
    closing = np.flatnonzero(depth == lens[row])
    head = np.flatnonzero((lcp != lens) | (lens != np.append(-1, lens[:-1])) | (np.arange(n) == 0))
    alike = np.append(head, n)
    sha = np.full(m, NOTHING, dtype=object)
    portions = []
    for x in closing.tolist():
        a = row[x]
        ids = conv[a : alike[np.searchsorted(alike, a, side="right")]]
        if is_skeleton[x]:
            portions += [(int(number[x]), k, ids[k * PORTION : (k + 1) * PORTION].tobytes()) for k in range(-(-len(ids) // PORTION))]
        else:
            sha[x] = _hash(ids)

    done, parts = np.flatnonzero(~is_skeleton), np.flatnonzero(is_skeleton)
    up = above[done]
    hung = is_skeleton[up]
    ints = lambda x, mask=None: pa.array(np.asarray(x, dtype=np.int64), pa.int64(), mask=mask)
    none = lambda k, kind: pa.nulls(k, kind)
    a, b, c = len(done), len(parts), len(portions)

    def joined(*columns: pa.Array) -> pa.Array:
        return pa.concat_arrays(columns)

    return pa.table(
        {
            "kind": pa.array(np.repeat(np.array([0, 1, 2], dtype=np.int32), [a, b, c])),
            "above": joined(ints(number[up], ~hung), ints(number[parts]), ints([p[0] for p in portions])),
            "shard": pa.array(np.full(a + b + c, shard, dtype=np.int32)),
            "portion": joined(none(a + b, pa.int32()), pa.array([p[1] for p in portions], pa.int32())),
            "ids": joined(none(a + b, pa.binary()), pa.array([p[2] for p in portions], pa.binary())),
            "weight": joined(none(a, pa.int64()), ints(last[parts]), none(c, pa.int64())),
            "conv_id": joined(ints(least[done]), ints(least[parts]), none(c, pa.int64())),
            "depth": joined(ints(depth[done]), ints(depth[parts]), none(c, pa.int64())),
            "parent_conv_id": joined(ints(least[up], hung), none(b + c, pa.int64())),
            "n_convs": joined(ints(n_convs[done]), ints(n_convs[parts]), none(c, pa.int64())),
            "n_children": joined(ints(children[done]), ints(outside[parts]), none(c, pa.int64())),
            "n_leaves": joined(ints(leaves[done]), ints(leaves[parts]), none(c, pa.int64())),
            "saved_tokens": joined(ints(worth[done]), ints(worth[parts]), none(c, pa.int64())),
            "ends_sha256": joined(pa.array(sha[done], pa.string()), none(b + c, pa.string())),
        }
    )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of lists whose portions come in order: of each node a hash is open while its portions come."""
    node, sha = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([sha.hexdigest()])], names=["above", "sha"])

    for batch in batches:
        for x, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = ",".join(map(str, np.frombuffer(ids, dtype=np.int64).tolist())).encode()
            if x == node:
                sha.update(b"," + text)
                continue
            if node is not None:
                yield out()
            node, sha = x, hashlib.sha256(text)
    if node is not None:
        yield out()


def _finish(skeleton: Skeleton, parts: list) -> list[tuple]:
    """The skeleton's nodes from the sums of their parts."""
    m = len(skeleton.depth)
    above = np.array(skeleton.above)
    size = np.ones(m, dtype=np.int64)  # nodes of the skeleton below each, itself included: preorder puts them next
    for x in range(m - 1, 0, -1):
        size[above[x]] += size[x]
    after = np.arange(m) + size
    conv, n_convs, outside, leaves, worth, weight = (np.zeros(m, dtype=np.int64) for _ in range(6))
    for r in parts:
        x = r.above
        conv[x], n_convs[x], outside[x], leaves[x], worth[x], weight[x] = r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.weight
    children = outside + np.bincount(above[1:], minlength=m)
    bare, once = (np.append(0, np.cumsum(v)) for v in (children == 0, weight))
    leaves += bare[after] - bare[:m]
    worth -= once[after] - once[:m]
    up = [None if a < 0 else int(conv[a]) for a in above]
    return list(
        zip(
            range(m), conv.tolist(), skeleton.depth, up, n_convs.tolist(), children.tolist(), leaves.tolist(), worth.tolist(), strict=True
        )
    )


def prefix_trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each node, of conversations as paths() gives them: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    spark = rows.sparkSession
    ship(spark)
    rows = written(rows, "paths")
    skeleton = Skeleton(choose_splitters(rows, shard_turns))
    held = spark.sparkContext.broadcast(skeleton)  # bounded by SKELETON_BYTES

    @F.udf("int", useArrow=True)
    def shard_of(path: bytes, conv_id: int) -> int:
        return held.value.shard(bytes(path), conv_id)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        return build(table, key[0].as_py(), held.value)

    if skeleton.splitters:
        dealt = rows.withColumn("shard", shard_of("path", "conv_id"))
    else:
        dealt = rows.withColumn("shard", F.lit(0))
    parts = written(dealt.groupBy("shard").applyInArrow(one, PART), "trie-shards")
    sums = (
        parts.where("kind = 1")
        .groupBy("above")
        .agg(
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
            F.max("weight").alias("weight"),
        )
        .collect()  # as many as the skeleton has nodes
    )
    done = _finish(skeleton, sums) if sums else []
    nodes = spark.createDataFrame(
        done,
        "above bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint",
    )
    lists = parts.where("kind = 2").repartition("above").sortWithinPartitions("above", "shard", "portion")
    hashes = lists.select("above", "ids").mapInArrow(_streamed, "above bigint, sha string")
    columns = [c.split()[0] for c in NODE.split(", ")]
    top = nodes.join(hashes, "above", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NOTHING)))
    local = parts.where("kind = 0")
    inside = local.where(F.col("above").isNull())
    hung = local.where(F.col("above").isNotNull()).drop("parent_conv_id")
    hung = hung.join(nodes.select("above", F.col("conv_id").alias("parent_conv_id")), "above")
    return top.select(columns).unionByName(inside.select(columns)).unionByName(hung.select(columns))
