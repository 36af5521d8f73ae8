"""Removal of redundant sequences: in order of length, each joins the first representative that it aligns with.

Two sequences are alike if at most (1 - identity) * n edits (a letter changed, put in or left out) turn the shorter, of n
letters, into some part of the longer. So many edits cannot touch all of one piece more than there are edits, and an
untouched piece is in the longer sequence as it is: sequences that share no k-mer of any piece cannot be alike, which
leaves few to align, and each alignment keeps to a band about the diagonals on which pieces are found.

No row is made for every two alike sequences. In rounds, a sequence before which nothing undecided shares one of its keys
is a representative; it is aligned with the sequences after it that share a key with it, and those that it covers are
decided. A family of n is n alignments with its longest member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.sources.code import ship
from sedge.sources.scratch import written

#: Cells of a band that are worked on together.
CELLS = 1 << 18
FAR = 1 << 20


def most_edits(n: int, identity: float) -> int:
    return int((1 - identity) * n + 1e-9)


def pieces(n: int, edits: int) -> np.ndarray:
    """Bounds of edits + 1 pieces of n letters, of nearly equal length."""
    return np.arange(edits + 2) * n // (edits + 1)


def word_size(n: int, edits: int, k: int) -> int:
    """The size of the k-mers that are keys of a sequence: k, but less where a piece is shorter."""
    return min(k, n // (edits + 1))


def words_of(s: bytes, k: int) -> np.ndarray:
    """The k-mers (k at most 8) of a sequence, each as a number."""
    padded = np.frombuffer(s + bytes(8), dtype=np.uint8)
    at = np.ndarray(len(s) - k + 1, dtype=">u8", buffer=padded, strides=(1,))
    return (at.astype(np.uint64) >> np.uint64(8 * (8 - k))).view(np.int64)


def band(short: bytes, long: bytes, edits: int) -> tuple[int, int] | None:
    """First and last diagonal (place in long less place in short) that an alignment with so few edits can touch; None if
    no piece of short is in long."""
    cuts, found = pieces(len(short), edits).tolist(), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = long.find(short[a:b])
        if at >= 0:
            found += [at - a, long.rfind(short[a:b]) - a]
    return (min(found) - edits, max(found) + edits) if found else None


def least_edits(pairs: list[tuple[bytes, bytes]], most: list[int]) -> np.ndarray:
    """The fewest edits that turn the first of each pair into a part of the second, where they are at most `most`; else some
    number above that. The pairs of a batch go through the rows of their bands side by side."""
    out = np.full(len(pairs), FAR)
    bands = [band(s, t, m) for (s, t), m in zip(pairs, most, strict=True)]
    order = sorted((i for i, b in enumerate(bands) if b), key=lambda i: (bands[i][1] - bands[i][0], len(pairs[i][0])))
    a = 0
    while a < len(order):
        b = a
        while b < len(order) and (b - a + 1) * (bands[order[b]][1] - bands[order[b]][0] + 1) <= CELLS:
            b += 1
        b = max(b, a + 1)
        own = sorted(order[a:b], key=lambda i: -len(pairs[i][0]))
        out[own] = _side_by_side([pairs[i] for i in own], np.array([bands[i][0] for i in own]), max(bands[i][1] - bands[i][0] + 1 for i in own))
        a = b
    return out


def _side_by_side(pairs: list[tuple[bytes, bytes]], first: np.ndarray, width: int) -> np.ndarray:
    """pairs in descending length of the shorter; first: each band's first diagonal."""
    lens, sizes = np.array([len(s) for s, _ in pairs]), np.array([len(t) for _, t in pairs])
    rows = int(lens[0])
    short, long = np.zeros((len(pairs), rows), dtype=np.int16), np.full((len(pairs), rows + width), -1, dtype=np.int16)
    for p, (s, t) in enumerate(pairs):
        short[p, : len(s)] = np.frombuffer(s, dtype=np.uint8)
        a, b = max(0, int(first[p])), min(len(t), int(first[p]) + rows + width)
        if a < b:
            long[p, a - first[p] : b - first[p]] = np.frombuffer(t, dtype=np.uint8)[a:b]
    column = np.arange(width, dtype=np.int32)
    place = first[:, None] + column  # in long, before row 0
    d = np.where((place >= 0) & (place <= sizes[:, None]), 0, FAR).astype(np.int32)
    out = np.zeros(len(pairs), dtype=np.int64)
    live = len(pairs)
    for i in range(rows + 1):
        done = int(np.searchsorted(-lens, -i, side="left"))  # the first pair of no more than i rows
        if done < live:
            out[done:live] = d[done:live].min(axis=1)
            live, d = done, d[:done]
        if not live:
            return out
        at = place[:live] + i + 1
        step = d + (short[:live, i : i + 1] != long[:live, i : i + width])
        step[:, :-1] = np.minimum(step[:, :-1], d[:, 1:] + 1)
        step = np.where((at >= 0) & (at <= sizes[:live, None]), step, FAR)
        d = np.minimum.accumulate(step - column, axis=1) + column
    return out


def representatives(rows: DataFrame, key: str, sequence: str, identity: float = 0.9, k: int = 8) -> DataFrame:
    """key and representative for every row. In order of length, the longest first and of equals the largest key, a sequence
    has the first alike representative as its own, and is one itself if there is none. Letters are bytes. Equal
    sequences count once, under their largest key; null and empty ones represent themselves."""
    if not 1 <= k <= 8:
        raise ValueError("k must be 1 to 8")
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[key].dataType.simpleString()
    given = rows.select(F.col(key).alias("id"), F.col(sequence).cast("string").cast("binary").alias("s"))
    alone = given.where(F.length("s") > 0).groupBy("s").agg(F.max("id").alias("x"))
    alone = written(alone.select("x", F.length("s").alias("n"), "s"), "rr-alone")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each sequence its k-mers with their pieces, piece -1 for those that it is only found by."""
        for batch in batches:
            for x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, e = len(s), most_edits(len(s), identity)
                own, cuts = word_size(n, e, k), pieces(n, e)
                for size in sorted({*sizes, own}):
                    if size > n:
                        continue
                    words = words_of(s, size)
                    at = np.arange(len(words))
                    piece = np.searchsorted(cuts, at, side="right") - 1
                    piece[(at + size > cuts[piece + 1]) | (size != own)] = -1
                    both = np.unique(np.stack([words, piece], axis=1), axis=0)
                    m = len(both)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x] * m, batch.schema.field(0).type),
                            pa.array(np.full(m, n, dtype=np.int32)),
                            pa.array(np.full(m, size, dtype=np.int32)),
                            pa.array(both[:, 0].copy()),
                            pa.array(both[:, 1].astype(np.int32)),
                        ],
                        names=["x", "n", "size", "word", "piece"],
                    )

    # sizes of keys that short sequences ask by: k values at most
    edits = F.floor(F.lit(1 - identity) * F.col("n") + 1e-9)
    asked_size = F.least(F.lit(k), F.floor(F.col("n") / (edits + 1))).cast("int")
    sizes = [r[0] for r in alone.select(asked_size).distinct().collect()]
    every = written(alone.select("x", "s").mapInArrow(keys, f"x {kind}, n int, size int, word bigint, piece int"), "rr-keys")
    word = ["size", "word"]
    often = every.select("x", *word).distinct().groupBy(*word).agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # Of each piece the rarest k-mer is the key; one that nobody else has leads nowhere.
    rarest = (
        every.where("piece >= 0").join(often, word, "left").groupBy("x", "n", "piece")
        .agg(F.min(F.struct(F.coalesce("often", F.lit(1)).alias("often"), *word)).alias("w"))
    )
    asked = written(rarest.where("w.often > 1").select("x", "n", "w.size", "w.word").distinct(), "rr-asked")
    posted = written(every.select("x", "n", *word).distinct().join(asked.select(*word).distinct(), word, "left_semi"), "rr-posted")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                pairs = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                most = [most_edits(len(s), identity) for s, _ in pairs]
                near = pa.array(least_edits(pairs, most) <= np.array(most))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(near), part.column(1).filter(near)], names=["x", "y"])

    order = lambda p: F.struct(F.col(f"{p}n").alias("n"), F.col(f"{p}x").alias("x"))
    left = alone.select("x", "n")
    chosen = left.limit(0)
    links = None
    while not left.isEmpty():
        first = posted.join(left.select("x"), "x", "left_semi").groupBy(*word).agg(F.max(F.struct("n", "x")).alias("first"))
        waits = asked.join(left.select("x"), "x", "left_semi").join(first, word).where(F.col("first") > order(""))
        new = written(left.join(waits.select("x").distinct(), "x", "left_anti"), "rr-new")
        other = asked.join(new.select("x"), "x", "left_anti").join(chosen.select("x"), "x", "left_anti")
        met = posted.join(new.select("x"), "x", "left_semi").select(F.col("x").alias("yx"), F.col("n").alias("yn"), *word)
        pairs = other.join(met, word).where(order("y") > order("")).select("x", F.col("yx").alias("y")).distinct()
        texts = pairs.join(alone.select("x", "s"), "x").join(alone.select(F.col("x").alias("y"), F.col("s").alias("t")), "y")
        found = written(texts.select("x", "y", "s", "t").mapInArrow(alike, f"x {kind}, y {kind}"), "rr-links")
        links = found if links is None else written(links.unionByName(found), "rr-all-links")
        chosen = written(chosen.unionByName(new), "rr-chosen")
        left = written(left.join(new.select("x"), "x", "left_anti").join(found.select("x"), "x", "left_anti"), "rr-left")
    out = given.select("id", "s")
    if links is None:
        return out.select(F.col("id").alias(key), F.col("id").alias("representative"))
    size = alone.select(F.col("x").alias("y"), "n")
    of = links.join(size, "y").groupBy("x").agg(F.max(F.struct("n", "y")).alias("w")).select("x", F.col("w.y").alias("up"))
    of = alone.join(of, "x", "left").select("s", F.coalesce("up", "x").alias("representative"))
    return out.join(of, "s", "left").select(F.col("id").alias(key), F.coalesce("representative", "id").alias("representative"))
