"""Substring dedup (operator 7): super-k-mer partitioning over windows of words.

1. Every document is cut into super-k-mers; each is noted as (minimiser, hash of its words, document, place).
2. Minimisers met in one document only are dropped: none of their windows is anywhere else.
3. Equal super-k-mers collapse to one, owned by the smallest document. In every larger document all of its windows are
   removed, which needs no look at single windows.
4. Where different super-k-mers share a minimiser, they may share windows. Each travels once, as one packed string, to
   the bucket of its minimiser, where sorting all windows finds equal ones and the smallest document of each.
   A minimiser with more than `crowded` different super-k-mers has several buckets of about that size, which compare
   their windows by digests in packed portions; no task ever gathers all of one minimiser.
5. The places to remove go to their documents.

Defined results: a null text has no words; a null doc_id is smaller than any other; documents of one doc_id are not
smaller than each other, so rows repeated with it never remove each other's words; a text shorter than a window is kept
whole; an empty table gives an empty result. Equal rows are cut once, whatever their number, and each gets the result. A
very long text is cut like any other, in one task, into super-k-mers of a bounded length. Columns with clashing names are
not read; without_repeats() returns them as they were.

Windows of one bucket are told apart by their words. Super-k-mers are by two 64-bit hashes, and windows of crowded
minimisers by digests of 128 bits; two of n different ones are taken for one with a chance below n * n / 2**129.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import NULL_ID, ship, written
from sedge.llm.superkmers import runs, super_kmers

GRAM = 6
#: Windows in a super-k-mer at most; words that repeat with a short period would otherwise make it as long as the text.
LONGEST = 64


def keyed(docs: DataFrame) -> DataFrame:
    """ord and h tell documents apart and put them in order, also where ids are null or repeated."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("ord"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"),
        F.col("text").cast("string").alias("text"),
    )


def once(units: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """units with c: how many equal rows (ord, h) they are of, those of equal rows given once; and these rows, if any."""
    on, one = ["ord", "h"], F.lit(1).cast("bigint").alias("c")
    starts = units.where("start = 0")  # each row with a window has one
    repeated = written(starts.groupBy(*on).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), f"{name}-repeated")
    if repeated.isEmpty():
        return units.select("*", one), None
    rest = units.join(repeated, on, "left_anti").select("*", one)
    return rest.unionByName(units.distinct().join(repeated, on)), repeated


def texts_once(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """rows, each of equal ones once if it is among the repeated."""
    if repeated is None:
        return rows
    on = ["ord", "h"]
    return rows.join(repeated, on, "left_anti").unionByName(rows.join(repeated, on, "left_semi").dropDuplicates(on))


#: Rows that one key of a join may have on its large side before it is joined apart.
HOT = 1000


def by_kind(met: DataFrame, kinds: DataFrame, name: str) -> DataFrame:
    """met with kinds by (mini, sk); kinds has c, the rows of met of each. Kinds with many rows, which are few, are joined
    first and without a hint, so that Spark sends them out if they are small, and splits their rows if not."""
    on = ["mini", "sk"]
    hot = written(kinds.where(F.col("c") > HOT), f"{name}-hot")
    cold = kinds.where(F.col("c") <= HOT)
    if hot.isEmpty():
        return met.hint("merge").join(cold, on)
    rest = met.join(hot.select(*on), on, "left_anti").hint("merge").join(cold, on)
    return rest.unionByName(met.join(hot, on))


def _ends(words: list[bytes]) -> np.ndarray:
    """Where each word ends in the words joined by single spaces."""
    return np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1


def _cut(text: str, window: int) -> list[tuple[int, int, int, int]]:
    """(minimiser, hash, first window, windows) of each super-k-mer of the text."""
    import xxhash

    words = text.encode().split()
    if len(words) < window:
        return []
    tokens = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    minimiser, start, count = super_kmers(tokens, window, GRAM, LONGEST)
    line, ends = b" ".join(words), _ends(words)
    begins = np.append(0, ends + 1)[start].tolist()
    finals = ends[start + count + window - 2].tolist()
    hashes = [xxhash.xxh3_64_intdigest(line[a:b]) for a, b in zip(begins, finals, strict=True)]
    signed = np.array(hashes, dtype=np.uint64).view(np.int64).tolist()
    return list(zip(minimiser.view(np.int64).tolist(), signed, start.tolist(), count.tolist(), strict=True))


def _units(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cut = [_cut(t.as_py() or "", window) for t in part.column(2)]
                sizes = [len(c) for c in cut]
                if not any(sizes):
                    continue
                rows = list(zip(*(r for c in cut for r in c), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[0], pa.int64()),
                        pa.array(rows[1], pa.int64()),
                        pa.array(np.repeat(part.column(0).to_numpy(), sizes)),
                        pa.array(np.repeat(part.column(1).to_numpy(), sizes)),
                        pa.array(rows[2], pa.int32()),
                        pa.array(rows[3], pa.int32()),
                    ],
                    names=["mini", "sk", "ord", "h", "start", "n"],
                )

    return rows.mapInArrow(run, "mini bigint, sk bigint, ord bigint, h bigint, start int, n int")


def _packed(rows_of: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted super-k-mers: mini, sk, lo, shards, words. wanted: mini, sk, lo, h, start, n, shards."""
    by_doc = wanted.groupBy(F.col("lo").alias("ord"), "h").agg(
        F.collect_list(F.struct("mini", "sk", "start", "n", "shards")).alias("list")
    )
    names = ["mini", "sk", "lo", "shards", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for lo, text, wanted_here in zip(*(part.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
                    words = text.encode().split()
                    for x in wanted_here:
                        a = x["start"]
                        own = b" ".join(words[a : a + x["n"] + window - 1])
                        rows.append((x["mini"], x["sk"], lo, x["shards"], own))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
                )

    held = rows_of.hint("merge").join(written(by_doc, "substring-wanted"), ["ord", "h"]).select("ord", "text", "list")
    return held.mapInArrow(run, "mini bigint, sk bigint, lo bigint, shards int, words binary")


def _windows(words: bytes, window: int) -> list[bytes]:
    parts = words.split(b" ")
    ends = _ends(parts)
    begins = np.append(0, ends[:-1] + 1)
    return [words[a:b] for a, b in zip(begins[: len(parts) - window + 1].tolist(), ends[window - 1 :].tolist(), strict=True)]


def _bucket(group: list[tuple[int, int, bytes]], window: int) -> list[tuple[int, int, int, int]]:
    """group: (sk, lo, words) of one minimiser. (sk, lo, first, last) of runs of windows that a smaller document has."""
    every = sorted(
        (w, lo, k, j) for k, (_, lo, words) in enumerate(group) for j, w in enumerate(_windows(words, window))
    )
    taken: dict[int, list[int]] = {}
    before, lowest = None, 0
    for w, lo, k, j in every:
        if w != before:
            before, lowest = w, lo
        elif lo > lowest:
            taken.setdefault(k, []).append(j)
    return [(*group[k][:2], a, b) for k, places in taken.items() for a, b in runs(np.array(sorted(places)))]


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of one key, the first n_keys columns, in sorted batches; a run may go on in the next
    batch. The rows are of the other columns."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != last:
                if rows:
                    yield last, rows
                last, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield last, rows


FOUND = "mini bigint, sk bigint, lo bigint, first int, last int"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
        names=["mini", "sk", "lo", "first", "last"],
    )


def _in_buckets(packed: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        for (mini,), group in grouped(batches):
            out += [(mini, *r) for r in _bucket(group, window)]
            if len(out) > 20_000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    return (
        packed.select("mini", "sk", "lo", "words")
        .repartition("mini")
        .sortWithinPartitions("mini")
        .mapInArrow(run, FOUND)
    )


def _records(lowest: dict[bytes, int]) -> bytes:
    """Digests and documents, 24 bytes each."""
    return b"".join(d + lo.to_bytes(8, "big", signed=True) for d, lo in sorted(lowest.items()))


def _read(records: bytes) -> Iterator[tuple[bytes, int]]:
    for i in range(0, len(records), 24):
        yield records[i : i + 16], int.from_bytes(records[i + 16 : i + 24], "big", signed=True)


def _digests(words: bytes, window: int) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_128_digest(w) for w in _windows(words, window)]


def _own_lowest(group: list[tuple], window: int) -> dict[bytes, int]:
    """group: (..., lo, words). The smallest document of each different window."""
    lowest: dict[bytes, int] = {}
    for *_, lo, words in group:
        for d in _digests(words, window):
            if lowest.setdefault(d, lo) > lo:
                lowest[d] = lo
    return lowest


def _across_shards(crowded: DataFrame, window: int) -> DataFrame:
    """The same for crowded minimisers. Their super-k-mers are dealt into shards of a bounded size. A shard hands out its
    different windows, each once and with the smallest document of the shard, in packed portions by digest; merge tasks,
    each for one portion of all shards, tell a shard where another has a smaller document; and the shard, given that,
    finds the windows to remove."""
    keyed_by = "mini bigint, part int, shard int, records binary"

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (mini, shard, shards), group in grouped(batches, 3):
            portions: dict[int, dict[bytes, int]] = {}
            for d, lo in _own_lowest(group, window).items():
                portions.setdefault(int.from_bytes(d[:8]) % shards, {})[d] = lo
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([mini] * len(portions), pa.int64()),
                    pa.array(portions.keys(), pa.int32()),
                    pa.array([shard] * len(portions), pa.int32()),
                    pa.array(map(_records, portions.values()), pa.binary()),
                ],
                names=["mini", "part", "shard", "records"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (mini, _), group in grouped(batches, 2):
            lowest: dict[bytes, int] = {}
            for _, records in group:
                for d, lo in _read(records):
                    if lowest.setdefault(d, lo) > lo:
                        lowest[d] = lo
            told = [(shard, {d: lowest[d] for d, lo in _read(records) if lowest[d] < lo}) for shard, records in group]
            told = [(shard, x) for shard, x in told if x]
            if told:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([mini] * len(told), pa.int64()),
                        pa.array([shard for shard, _ in told], pa.int32()),
                        pa.array([_records(x) for _, x in told], pa.binary()),
                    ],
                    names=["mini", "shard", "bytes"],
                )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (mini, _), group in grouped(batches, 2):
            own = [x for x in group if x[0] is not None]
            lowest = _own_lowest(own, window)
            for sk, _, records in group:
                if sk is None:
                    lowest.update(_read(records))
            rows = []
            for sk, lo, words in own:
                places = [j for j, d in enumerate(_digests(words, window)) if lowest[d] < lo]
                rows += [(mini, sk, lo, a, b) for a, b in runs(np.array(places))]
            if rows:
                yield _found(rows)

    handed = written(
        crowded.select("mini", "shard", "shards", "lo", "words")
        .repartition("mini", "shard")
        .sortWithinPartitions("mini", "shard")
        .mapInArrow(hand_out, keyed_by),
        "substring-handed",
    )
    told = (
        handed.repartition("mini", "part")
        .sortWithinPartitions("mini", "part")
        .mapInArrow(merge, "mini bigint, shard int, bytes binary")
    )
    none = F.lit(None).cast("bigint")
    both = told.select("mini", "shard", none.alias("sk"), none.alias("lo"), "bytes").unionByName(
        crowded.select("mini", "shard", "sk", "lo", F.col("words").alias("bytes"))
    )
    return both.repartition("mini", "shard").sortWithinPartitions("mini", "shard").mapInArrow(find, FOUND)


def removals(rows: DataFrame, window: int, crowded: int) -> DataFrame:
    """ord, h, list: for each document with words to remove, the (first, last) windows to remove, in no order."""
    units, repeated = once(written(_units(rows, window), "substring-units"), "substring")
    shared = written(
        units.groupBy("mini")
        .agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
        .where(F.col("lo") < F.col("hi"))
        .select("mini"),
        "substring-shared",
    )
    met = written(units.drop("c").hint("merge").join(shared, "mini"), "substring-met")
    own = F.min(F.struct(F.col("ord"), F.col("h"), F.col("start"), F.col("n"))).alias("o")
    kinds = written(
        met.groupBy("mini", "sk")
        .agg(own, F.count(F.lit(1)).alias("c"))
        .select("mini", "sk", F.col("o.ord").alias("lo"), "o.h", "o.start", "o.n", "c"),
        "substring-kinds",
    )
    mixed = written(
        kinds.groupBy("mini")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("lo").alias("a"), F.max("lo").alias("b"))
        .where(F.col("a") < F.col("b"))
        .select("mini", F.ceil(F.col("kinds") / crowded).cast("int").alias("shards")),
        "substring-mixed",
    )
    wanted = kinds.drop("c").hint("merge").join(mixed, "mini")
    packed = written(_packed(texts_once(rows, repeated), wanted, window), "substring-packed")
    many = F.col("shards") > 1
    parts = _in_buckets(packed.where(~many), window)
    if not mixed.where(many).isEmpty():
        shard = F.pmod(F.xxhash64("sk"), F.col("shards")).cast("int")
        parts = parts.unionByName(_across_shards(packed.where(many).withColumn("shard", shard), window))
    parts = written(parts, "substring-parts")
    # The owner of a super-k-mer loses the windows found above; documents after it lose all of them.
    whole = (
        by_kind(met, kinds.select("mini", "sk", "lo", "c"), "substring")
        .where(F.col("ord") > F.col("lo"))
        .select("ord", "h", F.col("start").alias("w_first"), (F.col("start") + F.col("n") - 1).alias("w_last"))
    )
    some = (
        met.hint("merge")
        .join(parts.withColumnRenamed("lo", "ord"), ["mini", "sk", "ord"])
        .select("ord", "h", (F.col("start") + F.col("first")).alias("w_first"), (F.col("start") + F.col("last")).alias("w_last"))
    )
    return written(
        whole.unionByName(some).groupBy("ord", "h").agg(F.collect_list(F.struct(F.col("w_first").alias("first"), F.col("w_last").alias("last"))).alias("list")),
        "substring-removals",
    )


def _flags(n: int, windows: list[dict], window: int) -> np.ndarray:
    """Which of n words the windows cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, [x["first"] for x in windows], 1)
    np.add.at(edge, [x["last"] + window for x in windows], -1)
    return np.cumsum(edge[:-1]) > 0


def joined_with(docs: DataFrame, found: DataFrame, columns: list[Column]) -> DataFrame:
    """`columns` of docs, its text as __text, and the list that found (ord, h, list) has for it, or null."""
    found = found.select(F.col("ord").alias("__ord"), F.col("h").alias("__h"), F.col("list").alias("__list"))
    held = docs.select(
        *columns,
        F.col("text").cast("string").alias("__text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("__own_ord"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__own_h"),
    )
    on = (F.col("__own_ord") == F.col("__ord")) & (F.col("__own_h") == F.col("__h"))
    return held.hint("merge").join(found, on, "left").drop("__own_ord", "__own_h", "__ord", "__h")


def deduplicated(docs: DataFrame, window: int = 50, crowded: int = 128) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by single spaces) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest = [], [], []
            for text, windows in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if windows.as_py():
                    gone = _flags(len(words), windows.as_py(), window).tolist()
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                removed.append(total[-1] - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    ship(docs.sparkSession)
    found = removals(keyed(docs), window, crowded)
    return joined_with(docs, found, [F.col("doc_id").cast("bigint")]).mapInArrow(
        run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, window: int = 50, crowded: int = 128) -> DataFrame:
    """docs, with their columns, without the words to remove: each goes with the white space after it, and what is kept
    stays as it was. n_chars, if there is such a column, is set anew for texts that changed."""
    ship(docs.sparkSession)
    names, fields = docs.columns, docs.schema

    def cut(text: str, windows: list[dict]) -> str:
        raw = text.encode()
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        gone = _flags(len(spans), windows, window)
        begins = [0, *(a for a, _ in spans[1:]), len(raw)]  # white space before the first word stays with it
        return b"".join(raw[begins[a] : begins[b + 1]] for a, b in runs(np.flatnonzero(~gone))).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, found = part.column("__text").to_pylist(), part.column("__list").to_pylist()
                new = [cut(t, w) if w else t for t, w in zip(texts, found, strict=True)]
                changed = pa.array([bool(w) for w in found])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(new, pa.string()), changed],
                    names=[*keep, "__new", "__changed"],
                )

    others = [c for c in names if c != "text"]
    keep = [f"__c{i}" for i in range(len(others))]
    back = dict(zip(others, keep, strict=True))
    held = [F.col(f"`{c}`").alias(back[c]) for c in others]
    shape = ", ".join(f"{back[c]} {fields[c].dataType.simpleString()}" for c in others)
    found = removals(keyed(docs), window, crowded)
    out = joined_with(docs, found, held).mapInArrow(run, f"{shape}, __new string, __changed boolean")
    columns = []
    for c in names:
        if c == "text":
            columns.append(F.col("__new").alias(c))
        elif c == "n_chars":
            size = F.length("__new").cast(fields[c].dataType)
            columns.append(F.when(F.col("__changed"), size).otherwise(F.col(back[c])).alias(c))
        else:
            columns.append(F.col(back[c]).alias(c))
    return out.select(*columns)
