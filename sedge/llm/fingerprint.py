"""SimHash fingerprints of texts, for operator 5, and what similar.py compares texts by.

Beside the 64-bit fingerprint, a text has a set of shingles. Keys of that set bring texts together that may be similar:
sets of any size but small ones by min-wise samples, small ones by a prefix of the set in one order, which misses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import ship

SEED = 42
#: Hashes whose bits are counted at once.
BLOCK = 1 << 13
#: Sets of more than so many shingles get keys by min-wise samples.
SMALL = 32
#: Orders of a set that are sampled, and hashes taken in each, for first keys and for the finer ones of crowded keys.
FIRST, FINER = (8, 2), (30, 6)
#: Bits of the fingerprint that tells which member of a crowded key is nearest to its majority.
WIDE_BITS = 512
#: An odd multiplier for each order, then for each 64 bits of the wide fingerprint.
ODD = np.random.default_rng(SEED).integers(0, 2**63, FIRST[0] + FINER[0] + WIDE_BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, A-Z in lower case; of all words together if there are fewer."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: both know ASCII only
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)],
        dtype=np.uint64,
    )


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero for a text without words."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0]) if len(hashes) else 0


def mixed(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """One more hash of each hash for each odd number, by columns."""
    x = hashes[:, None] * odd[None, :]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How often each bit is set in each column of 64-bit words. Rows are added in pairs, all bits of a word at once:
    plane p holds the bits of weight 2**p of sums so far."""
    planes = [words]
    while len(planes[0]) > 1:
        if len(planes[0]) % 2:
            planes = [np.concatenate((p, np.zeros_like(p[:1]))) for p in planes]
        carry, sums = np.zeros_like(planes[0][0::2]), []
        for p in planes:
            a, b = p[0::2], p[1::2]
            either = a ^ b
            sums.append(either ^ carry)
            carry = (a & b) | (either & carry)
        planes = [*sums, carry]
    bits = [np.unpackbits(np.ascontiguousarray(p[0]).view(np.uint8), bitorder="little").astype(np.int64) << i for i, p in enumerate(planes)]
    return sum(bits)


def wide_fingerprint(distinct: np.ndarray) -> np.ndarray:
    """WIDE_BITS as signed 64-bit numbers, by the same majority, over hashes of which each counts once."""
    counts = np.zeros(WIDE_BITS, dtype=np.int64)
    for i in range(0, len(distinct), BLOCK):
        counts += bit_counts(mixed(distinct[i : i + BLOCK], ODD[-(WIDE_BITS // 64) :]))
    return np.packbits((2 * counts > len(distinct)).astype(np.uint8), bitorder="little").view("<i8")


def _key(tag: int, hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(hashes.astype("<u8").tobytes(), tag)


def _sampled(distinct: np.ndarray, first: int, orders: int, taken: int) -> list[int]:
    """For each order of the hashes, a key of the first `taken` of them. Sets of similarity j have equal keys in an order
    with a probability of about j ** taken."""
    least = np.empty((0, orders), dtype=np.uint64)
    for i in range(0, len(distinct), BLOCK):
        x = np.concatenate((least, mixed(distinct[i : i + BLOCK], ODD[first : first + orders])))
        least = np.partition(x, min(taken, len(x)) - 1, axis=0)[:taken]
    least = np.ascontiguousarray(np.sort(least, axis=0).T)
    return [_key(first + c, least[c]) for c in range(orders)]


def _prefix(n: int, similarity: float, common: int) -> int:
    """Two sets of that similarity, one of them of n hashes, have at least `common` (if they share so many) of the first
    so many hashes of the one, in any order of all hashes, among the first of the other."""
    return min(n, n - int(np.ceil(similarity * n - 1e-9)) + common)


def first_keys(distinct: np.ndarray, similarity: float) -> list[int]:
    """Keys of an ascending set of hashes. Of two sets of that similarity, one of them small, each has a key of the other;
    of others they have one with a probability of 1 - (1 - j**2)**8 or so: 0.9997 at 0.8. An empty set has none."""
    n, keys = len(distinct), []
    if n <= SMALL / similarity:
        keys += [_key(1000, distinct[i : i + 1]) for i in range(_prefix(n, similarity, 1))]
    return keys + _sampled(distinct, 0, *FIRST) if n > SMALL else keys


def finer_keys(distinct: np.ndarray, similarity: float) -> list[int]:
    """The same by two hashes of the prefix, and by samples of more hashes in more orders (0.9999 at 0.8), which sets that
    only share a common passage seldom have alike."""
    n, keys = len(distinct), []
    if n <= SMALL / similarity:
        keys += [_key(1001, np.array(x)) for x in combinations(distinct[: _prefix(n, similarity, 2)], 2)]
    return keys + _sampled(distinct, FIRST[0], *FINER) if n > SMALL else keys


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def shingle_rows(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """What fingerprints() gives, and of each row's set of shingles node (a hash that stands for the set), size, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes, sizes, keys = [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py() or "", width)
                distinct = np.unique(hashes)
                fps.append(fingerprint(hashes))
                nodes.append(_key(0, distinct))
                sizes.append(len(distinct))
                keys.append(_signed(first_keys(distinct, similarity)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(_signed(fps)),
                    pa.array(_signed(nodes)),
                    pa.array(sizes, pa.int32()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "h", "fp", "node", "size", "keys"],
            )

    ship(docs.sparkSession)
    return _plain(docs).mapInArrow(run, "doc_id bigint, h bigint, fp bigint, node bigint, size int, keys array<bigint>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """node, wide and shingles (the hashes, each once, ascending as unsigned) of every row of texts: node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [np.unique(shingle_hashes(t.as_py() or "", width)) for t in part.column(1)]
                wide = pa.array([wide_fingerprint(x) for x in sets], longs)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), wide, pa.array([x.view(np.int64) for x in sets], longs)], names=["node", "wide", "shingles"]
                )

    ship(texts.sparkSession)
    return texts.select("node", F.col("text").cast("string")).mapInArrow(run, "node bigint, wide array<bigint>, shingles array<bigint>")


def finer_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """node, size and finer keys of sets: node and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.values.to_numpy().view(np.uint64) for x in batch.column(1)]
            keys = pa.array([_signed(finer_keys(x, similarity)) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int32()), keys], names=["node", "size", "keys"]
            )

    return sets.select("node", "shingles").mapInArrow(run, "node bigint, size int, keys array<bigint>")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("h"), F.col("text").cast("string"))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h (a hash of the text) and fp (the fingerprint as a signed 64-bit number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(shingle_hashes(t.as_py() or "", width)) for t in batch.column(2)]
            fps = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["doc_id", "h", "fp"])

    ship(docs.sparkSession)
    return _plain(docs).mapInArrow(run, "doc_id bigint, h bigint, fp bigint")
