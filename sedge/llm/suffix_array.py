"""Suffix-array dedup (operator 10): repeated strings of at least `window` bytes, found in suffix arrays of shards.

Documents are cut into super-k-mers of bytes, so that equal strings of `window` bytes have the same minimiser. Minimisers
met once are dropped, equal super-k-mers collapse (all bytes of one that is there twice go), and what is left is dealt
into shards by minimiser. A shard is at most about `SHARD_BYTES` long; its suffix array is made by Larsson-Sadakane
refinement, in numpy, and Kasai's common prefixes tell which suffixes share `window` bytes with a neighbour.

The super-k-mers of a minimiser that has more than `crowded` of them are dealt into several shards, each with a suffix
array of its own. These are merged: each shard hands out its different strings of `window` bytes (as 128-bit digests) in
sorted portions, and a merge task looks up those of every shard in those of the others by binary search.

Defined results: a null text is empty; rows repeated, or with equal or null ids, are separate documents, and what they
share goes from each; a text shorter than `window` is kept whole; an empty table gives an empty result. Equal rows are cut
once, whatever their number, and their number counts. A very long text is cut like any other, in one task, into
super-k-mers of a bounded length. Columns with clashing names are not read.

Super-k-mers are told apart by two 64-bit hashes, which counts those that are there more than once before any suffix array
is made; the windows of different ones are compared by suffix arrays, and those of several shards by 128-bit digests. Two of n
different ones are taken for one with a chance below n * n / 2**129.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import ship, written
from sedge.llm.substring import by_kind, grouped, joined_with, keyed, once, texts_once
from sedge.llm.superkmers import runs, super_kmers

GRAM = 32
#: Windows in a super-k-mer at most.
LONGEST = 256
SHARD_BYTES = 1 << 19


@lru_cache(maxsize=1)
def _byte_hashes() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(1 << 63, size=256, dtype=np.int64).view(np.uint64)


#: Symbols of nine bits each that a signed 64-bit number holds.
AT_ONCE = 7


def suffix_array(text: np.ndarray, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: the suffix array of an array of numbers, and its inverse. Numbers below first_byte end a string,
    each of them once and in ascending order; the array ends in one. The others are bytes, raised by first_byte.

    Suffixes are ordered by their first h symbols, h doubling from AT_ONCE; a suffix's rank is the first place of its
    group. Only groups of several suffixes are sorted again, by the rank of what follows h symbols later.
    """
    n = len(text)
    symbol = np.concatenate([np.maximum(text - first_byte + 1, 0), np.zeros(AT_ONCE, dtype=np.int64)])
    key, on = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(AT_ONCE):
        key <<= 9
        key += symbol[j : j + n] * on
        on &= symbol[j : j + n] > 0
    order = np.argsort(key)
    key, on = key[order], on[order]
    ended = np.flatnonzero(~on)
    order[ended] = order[ended][np.lexsort((order[ended], key[ended]))]  # equal ones in the order of their ends
    new = np.append(True, (key[1:] != key[:-1]) | ~on[1:])  # a suffix that has come to its end is alone
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    h = AT_ONCE
    while True:
        alone = new & np.append(new[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            return order, rank
        suffixes = order[places]
        group = rank[suffixes]
        after = rank[suffixes + h]  # a suffix of a group of several is longer than h: its end is unique
        by = np.argsort(group * n + after)
        suffixes, group, after = suffixes[by], group[by], after[by]
        order[places] = suffixes
        cut = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        new[places] = cut
        rank[suffixes] = np.maximum.accumulate(np.where(cut, places, 0))
        h *= 2


def common_prefixes(
    text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int
) -> np.ndarray:
    """Kasai: for each place of the text, the length (up to `most`) of what its suffix shares with the one before it in
    the suffix array. The strings of the text, from starts to ends, go side by side: along each, a suffix shares at
    least one symbol less with its neighbour than the one before it did."""
    n = len(text)
    before = np.where(rank > 0, order[rank - 1], n)
    padded = np.concatenate([text, np.full(most + 1, -1)])
    shared = np.zeros(n, dtype=np.int64)
    place, length = starts.copy(), np.zeros(len(starts), dtype=np.int64)
    on = np.flatnonzero(place < ends)
    while len(on):
        p, k = place[on], length[on]
        q = before[p]
        k[q == n] = 0
        grow = np.flatnonzero((q < n) & (k < most))
        while len(grow):
            a, b = p[grow] + k[grow], q[grow] + k[grow]
            grow = grow[padded[a] == padded[b]]
            k[grow] += 1
            grow = grow[k[grow] < most]
        shared[p] = k
        length[on] = np.maximum(k - 1, 0)
        place[on] += 1
        on = on[place[on] < ends[on]]
    return shared


def repeated_windows(strings: list[bytes], window: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each string the places whose `window` bytes are at another place of these strings too; and the different
    windows among all places, one place each, as (string, place)."""
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    text = np.empty(ends[-1] + 1, dtype=np.int64)
    text[ends] = np.arange(len(strings))
    body = np.ones(len(text), dtype=bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int64) + len(strings)
    order, rank = suffix_array(text, len(strings))
    shared = common_prefixes(text, order, rank, starts, ends, window)[order]
    like_before = shared >= window
    like_other = like_before | np.append(like_before[1:], False)
    string = np.searchsorted(ends, order)
    whole = ends[string] - order >= window
    twice = np.zeros(len(text), dtype=bool)
    twice[order[like_other]] = True
    distinct = np.flatnonzero(whole & ~like_before)
    places = [np.flatnonzero(twice[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return places, string[distinct], order[distinct] - starts[string[distinct]]


def _cut(raw: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, hash, first window and number of windows of each super-k-mer."""
    import xxhash

    tokens = _byte_hashes()[np.frombuffer(raw, dtype=np.uint8)]
    minimiser, start, count = super_kmers(tokens, window, GRAM, LONGEST, by_place=True)
    pairs = zip(start.tolist(), (start + count + window - 1).tolist(), strict=True)
    hashes = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in pairs], dtype=np.uint64)
    return minimiser.view(np.int64), hashes.view(np.int64), start, count


def _units(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cut = [_cut((t.as_py() or "").encode(), window) for t in part.column(2)]
                sizes = [len(c[0]) for c in cut]
                if not any(sizes):
                    continue
                mini, sk, start, n = (np.concatenate(x) for x in zip(*cut, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mini),
                        pa.array(sk),
                        pa.array(np.repeat(part.column(0).to_numpy(), sizes)),
                        pa.array(np.repeat(part.column(1).to_numpy(), sizes)),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=["mini", "sk", "ord", "h", "start", "n"],
                )

    return rows.mapInArrow(run, "mini bigint, sk bigint, ord bigint, h bigint, start int, n int")


PACKED = "mini bigint, sk bigint, ord bigint, h bigint, start int, single boolean, shards int, bytes binary"
FOUND = "ord bigint, h bigint, first int, last int"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[f[1]]) for c, f in zip(columns, fields, strict=True)], names=[f[0] for f in fields]
    )


def _packed(rows_of: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    by_doc = wanted.groupBy("ord", "h").agg(
        F.collect_list(F.struct("mini", "sk", "start", "n", "single", "shards")).alias("list")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, rows = batch.slice(at, 128), []
                for o, h, text, wanted_here in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    raw = text.encode()
                    for x in wanted_here:
                        own = raw[x["start"] : x["start"] + x["n"] + window - 1]
                        rows.append((x["mini"], x["sk"], o, h, x["start"], x["single"], x["shards"], own))
                yield _table(rows, PACKED)

    # A repeated row would hand out its super-k-mers again; one of them is enough.
    texts = rows_of.hint("merge").join(written(by_doc, "suffix-wanted"), ["ord", "h"])
    return texts.select("ord", "h", "text", "list").mapInArrow(run, PACKED)


def _in_shards(packed: DataFrame, window: int) -> DataFrame:
    """Windows to remove of single super-k-mers whose minimisers have one shard each; many of them share one."""

    def found(shard: list[tuple]) -> list[tuple]:
        places, _, _ = repeated_windows([x[5] for x in shard], window)
        return [
            (o, h, start + a, start + b)
            for (_, o, h, start, single, _), where in zip(shard, places, strict=True)
            if single
            for a, b in runs(where)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        held = 0
        for _, group in grouped(batches):
            # a repeated document may have brought its super-k-mer more than once
            group = list({x[0]: x for x in group}.values())
            shard += group
            held += sum(len(x[5]) for x in group)
            if held >= SHARD_BYTES:
                if rows := found(shard):
                    yield _table(rows, FOUND)
                shard, held = [], 0
        if shard and (rows := found(shard)):
            yield _table(rows, FOUND)

    return (
        packed.select("mini", "sk", "ord", "h", "start", "single", "bytes")
        .repartition("mini")
        .sortWithinPartitions("mini")
        .mapInArrow(run, FOUND)
    )


def _digests(raw: bytes, places: Iterator[int], window: int) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_128_digest(raw[i : i + window]) for i in places]


def _split(digests: bytes) -> list[bytes]:
    return [digests[i : i + 16] for i in range(0, len(digests), 16)]


HANDED = "mini bigint, shard int, part int, distinct binary, twice binary"


def _handed_out(hot: DataFrame, window: int) -> DataFrame:
    """For each shard of a crowded minimiser and each merge task: its different windows, and those it has twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (mini, shard, parts), group in grouped(batches, 3):
            strings = list(dict(group).values())  # by sk
            places, string, place = repeated_windows(strings, window)
            distinct = sorted(_digests(strings[s], [p], window)[0] for s, p in zip(string.tolist(), place.tolist(), strict=True))
            twice = sorted({d for s, where in zip(strings, places, strict=True) for d in _digests(s, where.tolist(), window)})
            portions: dict[int, tuple[list, list]] = {}
            for digests, k in ((distinct, 0), (twice, 1)):
                for d in digests:
                    portions.setdefault(int.from_bytes(d[:8]) % parts, ([], []))[k].append(d)
            yield _table([(mini, shard, part, *map(b"".join, x)) for part, x in portions.items()], HANDED)

    return (
        hot.select("mini", "shard", "shards", "sk", "bytes")
        .repartition("mini", "shard")
        .sortWithinPartitions("mini", "shard")
        .mapInArrow(run, HANDED)
    )


def _merged(handed: DataFrame) -> DataFrame:
    """mini, shard, repeated: the windows of a shard that it has twice or that another shard has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (mini, _), group in grouped(batches, 2):
            rows = [(shard, _split(a), b) for shard, a, b in group]
            every = sorted(d for x in rows for d in x[1])
            for shard, own, twice in rows:
                met = [d for d in own if bisect_right(every, d) - bisect_left(every, d) > 1]
                both = b"".join(sorted({*met, *_split(twice)}))
                if both:
                    yield _table([(mini, shard, both)], "mini bigint, shard int, repeated binary")

    return (
        handed.select("mini", "part", "shard", "distinct", "twice")
        .repartition("mini", "part")
        .sortWithinPartitions("mini", "part")
        .mapInArrow(run, "mini bigint, shard int, repeated binary")
    )


def _across_shards(hot: DataFrame, window: int) -> DataFrame:
    """Windows to remove of single super-k-mers of crowded minimisers."""
    merged = _merged(written(_handed_out(hot, window), "suffix-handed"))
    none = lambda kind: F.lit(None).cast(kind)
    # What was found for a shard meets its super-k-mers again.
    both = merged.select(
        "mini", "shard", F.lit(0).alias("turn"), none("bigint").alias("ord"), none("bigint").alias("h"),
        none("int").alias("start"), F.col("repeated").alias("bytes"),
    ).unionByName(
        hot.where("single").select("mini", "shard", F.lit(1).alias("turn"), "ord", "h", "start", "bytes")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in grouped(batches, 2):
            repeated = sorted({d for turn, *_, raw in group if turn == 0 for d in _split(raw)})
            rows = []
            for turn, o, h, start, raw in group:
                if turn and repeated:
                    own = _digests(raw, range(len(raw) - window + 1), window)
                    where = [i for i, d in enumerate(own) if repeated[min(bisect_left(repeated, d), len(repeated) - 1)] == d]
                    rows += [(o, h, start + a, start + b) for a, b in runs(np.array(where))]
            if rows:
                yield _table(rows, FOUND)

    return (
        both.select("mini", "shard", "turn", "ord", "h", "start", "bytes")
        .repartition("mini", "shard")
        .sortWithinPartitions("mini", "shard", "turn")
        .mapInArrow(run, FOUND)
    )


def removals(rows: DataFrame, window: int, crowded: int) -> DataFrame:
    """ord, h, list: for each document with bytes to remove, the (first, last) windows to remove, in no order."""
    units, repeated = once(written(_units(rows, window), "suffix-units"), "suffix")
    shared = written(
        units.groupBy("mini").agg(F.sum("c").alias("c")).where(F.col("c") > 1).select("mini"), "suffix-shared"
    )
    met = written(units.hint("merge").join(shared, "mini"), "suffix-met")
    own = F.min(F.struct("ord", "h", "start", "n")).alias("o")
    kinds = written(
        met.groupBy("mini", "sk").agg(own, F.sum("c").alias("c")).select("mini", "sk", "o.*", "c"), "suffix-kinds"
    )
    mixed = written(
        kinds.groupBy("mini")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least"))
        .where((F.col("kinds") > 1) & (F.col("least") == 1))
        .select("mini", F.ceil(F.col("kinds") / crowded).cast("int").alias("shards")),
        "suffix-mixed",
    )
    wanted = kinds.hint("merge").join(mixed, "mini").withColumn("single", F.col("c") == 1)
    packed = written(_packed(texts_once(rows, repeated), wanted, window), "suffix-packed")
    found = _in_shards(packed.where(F.col("shards") == 1), window)
    if not mixed.where(F.col("shards") > 1).isEmpty():
        hot = packed.where(F.col("shards") > 1).withColumn("shard", F.pmod(F.xxhash64("sk"), F.col("shards")).cast("int"))
        found = found.unionByName(_across_shards(hot, window))
    # All of a super-k-mer that is there more than once goes.
    whole = (
        by_kind(met.drop("c"), kinds.where(F.col("c") > 1).select("mini", "sk", "c"), "suffix")
        .select("ord", "h", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))
    )
    return written(
        whole.unionByName(found).groupBy("ord", "h").agg(F.collect_list(F.struct("first", "last")).alias("list")),
        "suffix-removals",
    )


def deduplicated(docs: DataFrame, window: int = 200, crowded: int = 128) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(batch.column(c) for c in range(3)), strict=True):
                raw, found = (text.as_py() or "").encode(), found.as_py()
                n, spans = len(raw), 0
                if found:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, [x["first"] for x in found], 1)
                    np.add.at(edge, [x["last"] + window for x in found], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = len(runs(np.flatnonzero(gone)))
                    raw = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                rows.append((doc_id.as_py(), n, n - len(raw), spans, hashlib.sha256(raw).hexdigest()))
            a, b, c, d, e = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (a, b, c, d)), pa.array(e, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    ship(docs.sparkSession)
    found = removals(keyed(docs), window, crowded)
    return joined_with(docs, found, [F.col("doc_id").cast("bigint")]).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
