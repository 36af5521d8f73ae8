"""Byte-level BPE encoding and decoding (operator 6).

Each distinct piece of text is encoded once for each worker's memory, in bulk: pieces are grouped by byte length into
padded numpy matrices, a row for each. In every round each row merges its leftmost pair of lowest rank; pairs are found
in a hash table over (left id, right id), and rows without a pair left are taken out, as are columns no row fills.
Pieces longer than `LONG_PIECE` bytes, for which a round over a whole row would be wasteful, are folded into matrices of
their own, with rows of that width: a round finds the row with the leftmost lowest rank by the rows' minima, and changes
that row alone.

Defined results: a null text is empty: no ids, and the digests of nothing; every row stands alone, so repeated rows and
equal or null ids need no care; other columns are not read, so their names do not matter; an empty table gives an empty
result. A very long text is held whole by its task, as are its ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import opened, ship

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
LONG_PIECE = 256
NONE = np.iinfo(np.int32).max
#: A worker's memory of chunks: so many at most, none longer than so many characters.
MEMORY, LONGEST = 400_000, 64
#: White space beside a space: such texts are cut by the pattern as a whole, not at single spaces first.
IRREGULAR = re.compile(r"\s | \s")


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing in numpy arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(pairs) * 3).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, NONE, dtype=np.int32)
        waiting, values, slot = pairs, merged, self._slot(pairs)
        while len(waiting):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = waiting[free]  # of several for one slot, the last stays
            won = self.keys[slot] == waiting
            self.values[slot[won]] = values[won]
            waiting, values, slot = waiting[~won], values[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where there are none or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        flat, out = keys.ravel(), np.full(keys.size, NONE, dtype=np.int32)
        todo = np.flatnonzero(flat != -2)
        slot = self._slot(flat[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == flat[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(keys.shape)


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(pairs, dtype=np.int64), np.array(merged, dtype=np.int32))
        self.ids: dict[str, bytes] = {}  # of a chunk, in decimal, joined by commas
        self.back: dict[str, bytes] = {}  # what those ids decode to

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces of similar length, none of them empty."""
        n, width = len(pieces), max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        ids = np.full((n, width), -1, dtype=np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        out: list = [None] * n
        row = np.arange(n)
        found = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = found.argmin(axis=1) if found.shape[1] else np.zeros(len(row), dtype=np.int64)
            best = found[np.arange(len(row)), at] if found.shape[1] else np.full(len(row), NONE)
            over = best == NONE
            if over.any():
                for r, x, k in zip(row[over], ids[over], lengths[over], strict=True):
                    out[r] = x[:k].copy()
                keep = ~over
                row, ids, found, lengths, at, best = (x[keep] for x in (row, ids, found, lengths, at, best))
                if not len(row):
                    break
            each, columns = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids = np.where(columns <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[each, at] = best
            lengths = lengths - 1
            ids = ids[:, : lengths.max()]
            width = ids.shape[1]
            found = np.where(np.arange(width - 1) <= at[:, None], found[:, : width - 1], found[:, 1:width])
            # Only the pairs on both sides of the new token changed. One that would start before the row is left out.
            for start in (at - 1, at):
                ok = (start >= 0) & (start < width - 1)
                r, s = each[ok], start[ok]
                found[r, s] = self.pairs.find(ids[r, s], ids[r, s + 1])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of a long piece, folded into rows. Each round merges its leftmost pair of lowest rank; what is merged away
        stays as a gap until half of all is gaps, and is then compacted."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        ranks, tokens, width = self.ranks, self.tokens, LONG_PIECE
        while True:
            n = len(ids)
            found = np.full(-(-n // width) * width, NONE, dtype=np.int32)
            found[: n - 1] = self.pairs.find(ids[:-1], ids[1:])
            rows = found.reshape(-1, width)
            least = rows.min(axis=1)
            own = ids.tolist()
            after, before, gaps = list(range(1, n + 1)), list(range(-1, n - 1)), 0

            def renew(i: int) -> None:
                j = after[i]
                found[i] = NONE if j >= n else ranks.get(tokens[own[i]] + tokens[own[j]], NONE)  # noqa: B023

            while 2 * gaps <= n:
                r = int(least.argmin())
                if least[r] == NONE:
                    return [x for x in own if x >= 0]
                i = r * width + int(rows[r].argmin())
                j, h = after[i], before[i]
                own[i], own[j], after[i] = int(found[i]), -1, after[j]
                gaps += 1
                found[j] = NONE
                if after[i] < n:
                    before[after[i]] = i
                renew(i)
                if h >= 0:
                    renew(h)
                for k in {r, j // width, max(h, 0) // width}:
                    least[k] = rows[k].min()
            ids = np.array([x for x in own if x >= 0], dtype=np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece. A piece that is itself a token is that token."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[k] = [rank]
            elif len(p) > LONG_PIECE:
                out[k] = self.merge_long(p)
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(k)
        for _, members in sorted(buckets.items()):
            for i in range(0, len(members), 8192):
                part = members[i : i + 8192]
                for k, ids in zip(part, self.merge_rows([pieces[k] for k in part]), strict=True):
                    out[k] = ids.tolist()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        """Parts of the text that the pattern cuts each by itself as it does within the text: a single space between
        two other characters starts a match, and no match holds one further in."""
        if IRREGULAR.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def learn(self, order: list[str]) -> None:
        """Fill the memory with these chunks."""
        cut = [self.pattern.findall(c) for c in order]
        distinct = list(set().union(*cut))
        ids = dict(zip(distinct, self.encode_pieces([p.encode() for p in distinct]), strict=True))
        for c, pieces in zip(order, cut, strict=True):
            own = [i for p in pieces for i in ids[p]]
            self.ids[c] = ",".join(map(str, own)).encode()
            self.back[c] = self.decode(own)

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids, in decimal and joined by commas, and the bytes that they decode to."""
        cut = [self.chunks(t) if t else [] for t in texts]
        distinct = set().union(*cut)
        new = [c for c in distinct if c not in self.ids]
        full = len(self.ids) + len(new) > MEMORY
        if full and 2 * len(new) > len(distinct):  # what is remembered no longer helps
            self.ids, self.back, new, full = {}, {}, list(distinct), False
        self.learn(new)
        ids, back = self.ids, self.back
        out = [(b",".join([ids[c] for c in x]), b"".join([back[c] for c in x])) for x in cut]
        for c in new:
            if full or len(c) > LONGEST:
                del ids[c], back[c]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(read_ranks(path), pattern)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def round_trip(docs: DataFrame, ranks_path: str | Callable[[], str], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, and decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(opened(ranks_path), pattern)
        for doc_ids, texts in _texts(batches):
            done = own.encode_texts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([ids.count(b",") + 1 if ids else 0 for ids, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in done]),
                    pa.array([hashlib.sha256(back).hexdigest() for _, back in done]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, ranks_path: str | Callable[[], str], pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(opened(ranks_path), pattern)
        for doc_ids, texts in _texts(batches):
            ids = [np.fromstring(x, dtype=np.int32, sep=",") if x else [] for x, _ in own.encode_texts(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, ids array<int>"
    )


def decode(encoded: DataFrame, ranks_path: str | Callable[[], str], pattern: str) -> DataFrame:
    """doc_id and the bytes that ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(opened(ranks_path), pattern)
        for batch in batches:
            back = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=["doc_id", "decoded"])

    ship(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, decoded binary")
