"""Language ID (operator 4): script ranges narrow the candidates of a word, then Viterbi over the words' scores.

A word is a run of letters. Its score for a language is the log-likelihood of its letter trigrams, ends of the word
included, counted by a hash into `BUCKETS` buckets. Languages that do not use the script of a word's letters are put far
behind for that word. The best sequence of languages, where each switch costs `switch_cost`, labels the words; runs of
one label are the spans of a mixed text. A text's language is the one that holds most of its letters; the score is its
share of them.

Training counts trigrams over all training rows and sums them by language and bucket, so the model is at most BUCKETS
numbers for each language; it is the only thing that is sent to the executors, and comes to the driver as one row for each
language. Of languages there may be MOST_LANGUAGES, and more are an error, so the model is at most 131 MB. What a task
holds beside it does not grow with them but for one number for each word of a block.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text if there is nothing
to learn from; of languages with equal letters the alphabetically first counts; a null doc_id counts as an empty one for
the split; every row is labelled by itself, so repeated rows and equal ids need no care; other columns are not read, so
their names do not matter. A very long text is labelled whole, in a portion of its own and in blocks of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import ship, written

BUCKETS, MOST_LANGUAGES = 1 << 16, 500
#: Words of a text that are gone back through together, texts and characters that a task holds at once, and numbers of a
#: table of scores.
BLOCK, MOST_TEXTS, MOST_CHARS, MOST_CELLS = 64, 1024, 2_000_000, 4_000_000
#: First code points of ranges, and the script of each range; None: other.
SCRIPTS = [
    (0x0000, None), (0x0041, "Latin"), (0x02B0, None), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, None), (0x0750, "Arabic"), (0x0780, None), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, None),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, None),
    (0x0E00, "Thai"), (0x0E80, None), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, None), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, None), (0x3040, "Kana"), (0x3100, None), (0x3130, "Hangul"), (0x3190, None),
    (0x3400, "Han"), (0xA000, None), (0xAC00, "Hangul"), (0xD7B0, None), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB10, None), (0x20000, "Han"), (0x30000, None),
]
NAMES = [None, *dict.fromkeys(s for _, s in SCRIPTS if s)]
FAR_BEHIND = -1e3


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter, 0 if it is none; the number of its script in NAMES."""
    fold = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x41, 0x33480):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            fold[i] = ord(low) if len(low) == 1 else i
    starts = np.array([a for a, _ in SCRIPTS])
    script = np.array([NAMES.index(s) for _, s in SCRIPTS], dtype=np.uint8)
    return fold, script[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]


@dataclass
class Letters:
    """The letters of several texts: bucket and script of each; starts of words among them; the text of each word."""

    bucket: np.ndarray
    script: np.ndarray
    starts: np.ndarray
    text_of_word: np.ndarray


def letters(texts: list[str]) -> Letters:
    fold, script = _tables()
    joined = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    f = fold[points]
    at = np.flatnonzero(f)
    h = f[at - 1] * np.uint32(0x9E3779B1) ^ f[at] * np.uint32(0x85EBCA77) ^ f[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    bucket = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    starts = np.flatnonzero(f[at - 1] == 0)
    ends = np.cumsum([len(t) + 1 for t in texts])  # the place of the line feed that ends each text
    return Letters(bucket, script[points[at]], starts, np.searchsorted(ends, at[starts]))


def viterbi(scores: Callable[[np.ndarray], np.ndarray], text_of_word: np.ndarray, languages: int, switch_cost: float) -> np.ndarray:
    """The best label of each word; scores gives words x languages for numbers of words, text_of_word is ascending.

    Texts go through the recursion side by side, the longest first. As every switch costs the same, a word needs only the
    best language before it and which languages are better stayed in: no table of languages by languages. The values
    at the start of every `BLOCK` words of a text are kept; going back, each block is gone through once more.
    """
    labels = np.zeros(len(text_of_word), dtype=np.int64)
    if not len(labels):
        return labels
    _, first, words = np.unique(text_of_word, return_index=True, return_counts=True)
    order = np.argsort(-words, kind="stable")
    first, words = first[order], words[order]
    starts = range(0, int(words[0]), BLOCK)
    active = lambda t: int(np.searchsorted(-words, -t, side="left"))  # texts of more than t words

    def block(t0: int) -> np.ndarray:
        """Scores of a block: of each word of every text that reaches into it."""
        n, size = active(t0), min(BLOCK, int(words[0]) - t0)
        at = first[:n] + t0 + np.arange(size)[:, None]
        inside = t0 + np.arange(size)[:, None] < words[:n]
        out = np.zeros((size, n, languages), dtype=np.float32)
        out[inside] = scores(at[inside])
        return out

    v = np.zeros((len(words), languages))
    entered, last = [], np.zeros(len(words), dtype=np.int64)
    for t0 in starts:
        own = block(t0)
        v = v[: own.shape[1]]
        v -= v.max(axis=1, keepdims=True)
        entered.append(v.copy())
        for i in range(len(own)):
            n = active(t0 + i)
            x = v[:n]
            np.maximum(x, x.max(axis=1, keepdims=True) - switch_cost, out=x)
            x += own[i, :n]
        ends = np.flatnonzero(words[: len(v)] <= t0 + len(own))
        last[ends] = v[ends].argmax(axis=1)
    state = last
    for t0, v in zip(reversed(starts), reversed(entered), strict=True):
        own = block(t0)
        size, n, _ = own.shape
        stay, best_of = np.empty(own.shape, dtype=bool), np.empty((size, n), dtype=np.int16)
        for i in range(size):
            best_of[i] = v.argmax(axis=1)
            best = v.max(axis=1, keepdims=True) - switch_cost
            stay[i] = v >= best
            v = np.maximum(v, best) + own[i]
        for i in range(size - 1, -1, -1):
            k = active(t0 + i)
            labels[first[:k] + t0 + i] = state[:k]
            state[:k] = np.where(stay[i, np.arange(k), state[:k]], state[:k], best_of[i, :k])
    return labels


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, log-likelihoods
    uses: np.ndarray  # scripts x languages: 0 if used, FAR_BEHIND if not

    def word_scores(self, x: Letters, words: np.ndarray) -> np.ndarray:
        """words x languages, for some words, of which a bounded number of letters is looked up at once."""
        sizes = np.diff(np.append(x.starts, len(x.bucket)))[words]
        ends = np.cumsum(sizes)
        out = np.empty((len(words), len(self.languages)), dtype=np.float32)
        a = 0
        while a < len(words):
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + MOST_CELLS // len(self.languages), side="right")))
            n = sizes[a:b]
            begin = np.cumsum(n) - n
            at = np.repeat(x.starts[words[a:b]] - begin, n) + np.arange(n.sum())
            scores = np.add.reduceat(self.weights[x.bucket[at]], begin, axis=0)
            unused = np.add.reduceat(self.uses[x.script[at]], begin, axis=0)
            # A script that no language here uses says nothing about them.
            out[a:b] = scores + np.where(unused.max(axis=1, keepdims=True) < 0, 0, unused)
            a = b
        return out

    def label(self, texts: list[str], switch_cost: float) -> tuple[Letters, np.ndarray]:
        x, k = letters(texts), len(self.languages)
        if not len(x.starts) or not k:
            return x, np.zeros(0, dtype=np.int64)
        if len(x.starts) * k <= MOST_CELLS:  # then all scores are held, else those of a block are made where it is met
            held = self.word_scores(x, np.arange(len(x.starts)))
            return x, viterbi(held.__getitem__, x.text_of_word, k, switch_cost)
        return x, viterbi(lambda words: self.word_scores(x, words), x.text_of_word, k, switch_cost)

    def predict(self, texts: list[str], switch_cost: float) -> tuple[list[str], list[float]]:
        x, labels = self.label(texts, switch_cost)
        if not len(labels):
            return ["und"] * len(texts), [0.0] * len(texts)
        sizes = np.diff(np.append(x.starts, len(x.bucket)))
        k = len(self.languages)
        held = np.bincount(x.text_of_word * k + labels, sizes, len(texts) * k).reshape(-1, k)
        total, best = held.sum(axis=1), held.argmax(axis=1)
        share = held.max(axis=1) / np.maximum(total, 1)
        return [self.languages[b] if n else "und" for b, n in zip(best, total, strict=True)], share.tolist()


def _portions(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches that hold a bounded number of texts and, but for single long ones, of bytes."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            before = sizes[a - 1] if a else 0
            b = min(a + MOST_TEXTS, max(a + 1, int(np.searchsorted(sizes, before + MOST_CHARS, side="right"))))
            yield batch.slice(a, b - a)
            a = b


def train(labelled: DataFrame, smoothing: float = 0.5, least_share: float = 0.001) -> Model:
    """labelled: text and lang. least_share: of a language's letters, for a script to be one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in _portions(batches, 0):
            texts = [t or "" for t in part.column(0).to_pylist()]
            langs = np.array(part.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                x = letters([texts[i] for i in np.flatnonzero(langs == lang)])
                own = counts.setdefault(lang, np.zeros(BUCKETS + len(NAMES), dtype=np.int64))
                own[:BUCKETS] += np.bincount(x.bucket, minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(x.script, minlength=len(NAMES))
        for lang, own in counts.items():
            slots = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slots)), pa.array(slots.astype(np.int32)), pa.array(own[slots])],
                names=["lang", "slot", "n"],
            )

    ship(labelled.sparkSession)
    counts = (
        labelled.select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(run, "lang string, slot int, n bigint")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
    )
    counts = written(counts, "langid-counts")
    languages = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")

    def column(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.zeros(BUCKETS + len(NAMES), dtype=np.int64)
        own[rows["slot"].to_numpy()] = rows["n"].to_numpy()
        return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([own.tobytes()], pa.binary())})

    columns = {r.lang: r.counts for r in counts.groupBy("lang").applyInArrow(column, "lang string, counts binary").collect()}
    table = np.zeros((BUCKETS + len(NAMES), len(languages)))
    for i, lang in enumerate(languages):
        table[:, i] = np.frombuffer(columns[lang], dtype=np.int64)
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    weights = np.log((grams + smoothing) / (grams.sum(axis=0) + smoothing * BUCKETS)).astype(np.float32)
    own = scripts >= least_share * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, weights, np.where(own, 0, FAR_BEHIND).astype(np.float32))


def predict(docs: DataFrame, model: Model, switch_cost: float = 12.0) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for part in _portions(batches, 1):
            found, score = own.predict([t or "" for t in part.column(1).to_pylist()], switch_cost)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double"
    )


def spans(docs: DataFrame, model: Model, switch_cost: float = 12.0) -> DataFrame:
    """doc_id, lang, first_word and n_words (among the runs of letters of the text) of every span of one language."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for part in _portions(batches, 1):
            ids = part.column(0).to_pylist()
            x, labels = own.label([t or "" for t in part.column(1).to_pylist()], switch_cost)
            if not len(labels):
                continue
            cut = np.flatnonzero(np.append(True, (np.diff(labels) != 0) | (np.diff(x.text_of_word) != 0)))
            text = x.text_of_word[cut]
            first = np.searchsorted(x.text_of_word, text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in text], pa.int64()),
                    pa.array([own.languages[i] for i in labels[cut]], pa.string()),
                    pa.array(cut - first, pa.int64()),
                    pa.array(np.diff(np.append(cut, len(labels))), pa.int64()),
                ],
                names=["doc_id", "lang", "first_word", "n_words"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, lang string, first_word bigint, n_words bigint"
    )


def held_out(doc_id: Column) -> Column:
    """A third of all documents, by their ids alone."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
