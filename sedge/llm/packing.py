"""Packing (operator 3): cost-balanced packing of token sequences.

Each task tokenises its partition and packs it; no row is shuffled. A document's whole blocks of `capacity` tokens are
sequences of their own. What is left of each document waits in a pool; a pool of `pool_tokens` is packed at once: its
pieces are taken in descending length, and each goes to the sequence of lowest estimated cost (linear and quadratic in
the lengths of its pieces) among those with room for it, or, if none has, is cut at the room of the cheapest open
one. The pool opens exactly as many sequences as its tokens fill, so only the last sequence of a task has padding.

Defined results: a null text is empty and gives the closing id alone; rows are packed one by one, so repeated rows and
equal or null ids are packed each; an empty table gives no piece; other columns are not read, so their names do not
matter. Of a very long text whole sequences leave at once, and less than one waits in the pool. The string of a special
token in a text is that token, as the library has it. A retried task packs the same way as long as its partition holds
the same rows in the same order, as the partitions of a table scan do.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import opened, ship

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
#: A worker's memory of chunks and their ids: so many at most, none longer than so many characters.
MEMORY, LONGEST = 600_000, 48
#: Texts and bytes that are cut into chunks at once, but for a single longer text.
MOST_TEXTS, MOST_BYTES = 1024, 1 << 23
#: Punctuation beside which letters always begin or end a word of the tokenizer.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class ChunkTokenizer:
    """Ids of a text by a tokenizers file whose tokens, special ones included, never span a white space, and of which the
    last of each word ends in `end_of_word`: the text is cut at spaces and line feeds, and the ids of a chunk are
    remembered. New words are encoded many at a time, as one text."""

    def __init__(self, path: str, end_of_word: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normal = self.tokenizer.normalizer
        tokens = self.tokenizer.get_vocab()
        self.last = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.last[[i for t, i in tokens.items() if t.endswith(end_of_word)]] = True
        self.known: dict[str, bytes] = {"": b""}

    def parts(self, chunk: str) -> tuple[str, ...]:
        """The words of a chunk of letters with marks about them, the letters in lower case if plain. None are known of a
        chunk of another form, of one that may hold a special token, and of one whose letters the tokenizer brings into a
        form that does not begin and end with a letter: a combining mark there belongs to the marks."""
        core = chunk.strip(MARKS)
        if not core.isalpha() or "<|" in chunk:
            return ()
        if core.isascii():
            core = core.lower()
        elif core != chunk and self.normal:
            form = self.normal.normalize_str(core)
            if not form or not form[0].isalpha() or not form[-1].isalpha():
                return ()
        at = len(chunk) - len(chunk.lstrip(MARKS))
        found = (chunk[:at], core, chunk[len(chunk.rstrip(MARKS)) :])
        return tuple(x for x in found if x)

    def learn(self, chunks: list[str]) -> None:
        """Encode each chunk by itself."""
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            for chunk, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[chunk] = array("I", e.ids).tobytes()

    def learn_words(self, words: list[str]) -> None:
        """Encode words many at a time; those that do not come out as one word each, by themselves."""
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                self.learn(part)
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """For each text (none of them null) its ids, as little-endian unsigned 32-bit numbers."""
        texts = pa.array(texts, pa.string())
        # A-Z in lower case, and marks parted from the letter before them, give the same ids and fewer different chunks,
        # but for a letter that a combining mark follows and for special tokens.
        plain = pc.invert(pc.match_substring_regex(texts, r"[A-Z]\p{M}|<\|"))
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([!-&(-/:-@\[-`{-~])", r"\1 \2")
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(plain, parted, texts), "\n", " "), " ")
        counts, flat = np.diff(cut.offsets.to_numpy()), cut.flatten().dictionary_encode()
        chunks, at = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        new = [c for c in chunks if c not in self.known]
        full = len(self.known) + len(new) > MEMORY
        if full and 2 * len(new) > len(chunks):  # what is remembered no longer helps
            self.known, new, full = {"": b""}, list(chunks), False
        known = self.known
        of = [(c, self.parts(c)) for c in new]
        asked = list({p for _, x in of for p in x if p not in known})
        self.learn_words(asked)
        self.learn([c for c, x in of if not x])
        for c, x in of:
            if x and x != (c,):
                known[c] = b"".join([known[p] for p in x])
        held = [known[c] for c in chunks]
        sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
        ids, starts = np.frombuffer(b"".join(held), dtype="<u4"), np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.cumsum(each)
        out = ids[np.repeat(starts[at] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        if full:
            new += asked
        for c in new:
            if full or len(c) > LONGEST:
                known.pop(c, None)
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def portions(column: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last row (not included) of parts that hold a bounded number of texts and, but for long ones, of bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(column):
        before = sizes[a - 1] if a else 0
        b = min(a + MOST_TEXTS, max(a + 1, int(np.searchsorted(sizes, before + MOST_BYTES, side="right"))))
        yield a, b
        a = b


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def piece_cost(length: int, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def balance(
    lengths: list[int], capacity: int, last: bool, linear: float = 1.0, quadratic: float = 1 / 1024
) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Pack pieces of the given lengths. Return placed pieces (index, start within it, length, sequence) and, unless
    last, the (index, start) of what is left over: less than one sequence. With last, a last sequence that is not full
    takes that."""
    total = sum(lengths)
    full, rest = divmod(total, capacity)
    room = np.full(full + (last and rest > 0), capacity, dtype=np.int64)
    if last and rest:
        room[-1] = rest
    cost = np.zeros(len(room))
    waiting = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    placed, left = [], []
    open_room = int(room.sum())
    while waiting:
        n, i, start = heapq.heappop(waiting)
        n = -n
        if open_room == 0:
            left.append((i, start))
            continue
        fits = np.where(room >= n, cost, np.inf)
        k = int(fits.argmin())
        if not np.isfinite(fits[k]):
            k = int(np.where(room > 0, cost, np.inf).argmin())
            take = int(room[k])
            heapq.heappush(waiting, (take - n, i, start + take))
            n = take
        placed.append((i, start, n, k))
        room[k] -= n
        cost[k] += piece_cost(n, linear, quadratic)
        open_room -= n
    return placed, left


class _Packer:
    def __init__(self, capacity: int, pool_tokens: int, linear: float, quadratic: float):
        self.capacity, self.pool_tokens, self.weights = capacity, pool_tokens, (linear, quadratic)
        self.pool: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start, the document's tokens, ids
        self.pooled = 0
        self.sequence = TaskContext.get().partitionId() << 36 if TaskContext.get() else 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, whole = len(ids) // 4, len(ids) // 4 // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            crc = zlib.crc32(ids[4 * start : 4 * (start + self.capacity)])
            self.rows.append((doc_id, start, self.capacity, crc, tokens, self.sequence, 0))
            self.sequence += 1
        if tokens > whole:
            self.pool.append((doc_id, whole, tokens, ids[4 * whole :]))
            self.pooled += tokens - whole
            if self.pooled >= self.pool_tokens:
                self.flush(False)

    def flush(self, last: bool) -> None:
        placed, left = balance([len(p[3]) // 4 for p in self.pool], self.capacity, last, *self.weights)
        at: dict[int, int] = {}
        for i, start, n, k in placed:
            doc_id, before, tokens, ids = self.pool[i]
            crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
            self.rows.append((doc_id, before + start, n, crc, tokens, self.sequence + k, at.get(k, 0)))
            at[k] = at.get(k, 0) + n
        self.sequence += len(at)
        self.pool = [(p[0], p[1] + s, p[2], p[3][4 * s :]) for p, s in ((self.pool[i], s) for i, s in left)]
        self.pooled = sum(len(p[3]) // 4 for p in self.pool)


def pack(
    docs: DataFrame,
    tokenizer_path: str | Callable[[], str],
    capacity: int = 2048,
    close_id: int = 1,
    pool_tokens: int = 1 << 20,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
) -> DataFrame:
    """A row for each piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id,
    offset. The cost of a sequence is the sum over its pieces of linear * n + quadratic * n * n. tokenizer_path: a file, or
    what each worker finds it by."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    end = array("I", [close_id]).tobytes()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = _tokenizer(opened(tokenizer_path)), _Packer(capacity, pool_tokens, linear, quadratic)
        for batch in batches:
            for a, b in portions(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = pc.fill_null(part.column(1), "")
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode(texts), strict=True):
                    packer.add(doc_id, ids + end)
                if len(packer.rows) > 10_000:
                    yield table(packer.rows)
                    packer.rows = []
        packer.flush(True)
        if packer.rows:
            yield table(packer.rows)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
