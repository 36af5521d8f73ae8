"""A convolutional network over the bytes of a text, in numpy.

A text is cut into chunks of `CHUNK` bytes that overlap by `OVERLAP`, so each window of `WIDTH` bytes lies whole in one of
them; the last chunk ends with the text, and only a text shorter than a chunk is filled up, by a symbol of its own. A
byte is a vector of `DEPTH` numbers, a filter a weight for each of those in a window, and a chunk's answer to a filter its
largest over all windows, less a bound and not below zero. A text has the largest and the mean of its chunks' answers,
from which one hidden layer makes one probability. Everything is learned together, by Adam on the cross-entropy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK, OVERLAP, WIDTH, DEPTH, FILTERS, HIDDEN = 512, 64, 8, 8, 24, 16
#: The symbol that fills up a short text.
FILL = 256
#: Chunks that go through the filters at once, and of which the symbols are held at once.
AT_ONCE, MOST_CHUNKS = 16, 4096


def chunk_starts(size: int) -> np.ndarray:
    """Where the chunks of a text of so many bytes start: one at least."""
    if size <= CHUNK:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, size - CHUNK, CHUNK - OVERLAP), size - CHUNK)


def symbols_of(text: bytes) -> np.ndarray:
    symbols = np.full(max(len(text), CHUNK), FILL, dtype=np.int16)
    symbols[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return symbols


def chunks(text: bytes) -> np.ndarray:
    return symbols_of(text)[chunk_starts(len(text))[:, None] + np.arange(CHUNK)]


@dataclass
class Network:
    bytes_: np.ndarray  # (257, DEPTH)
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    bounds: np.ndarray
    inner: np.ndarray  # (2 * FILTERS, HIDDEN)
    inner_bias: np.ndarray
    outer: np.ndarray  # (HIDDEN,)
    bias: np.ndarray  # (1,)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        zero = lambda n: np.zeros(n, dtype=np.float32)
        table = rng.normal(0, 1, (FILL + 1, DEPTH)).astype(np.float32)
        return cls(table, draw(WIDTH * DEPTH, FILTERS), zero(FILTERS), draw(2 * FILTERS, HIDDEN), zero(HIDDEN), draw(HIDDEN), zero(1))

    def weights(self) -> list[np.ndarray]:
        return list(vars(self).values())

    def products(self, symbols: np.ndarray) -> Iterator[np.ndarray]:
        """For parts of the chunks the product of each window with each filter."""
        for a in range(0, len(symbols), AT_ONCE):
            own = self.bytes_[symbols[a : a + AT_ONCE]]
            shape = (len(own), CHUNK - WIDTH + 1, WIDTH * DEPTH)
            yield np.lib.stride_tricks.as_strided(own, shape, own.strides) @ self.filters

    def answers(self, symbols: np.ndarray) -> np.ndarray:
        """Of each chunk and filter the largest product with a window."""
        return np.concatenate([x.max(axis=1) for x in self.products(symbols)])

    def combine(self, answers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """first: the first chunk of each text. Logit, hidden layer, what goes into it, and answers over their bounds."""
        over = np.maximum(answers - self.bounds, 0)
        n = np.diff(np.append(first, len(over)))[:, None]
        pooled = np.concatenate([np.maximum.reduceat(over, first), np.add.reduceat(over, first) / n], axis=1)
        hidden = np.tanh(pooled @ self.inner + self.inner_bias)
        return hidden @ self.outer + self.bias[0], hidden, pooled, over

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The probability of each text, of which a bounded number of chunks go through the filters at once."""
        answers, counts = [], []
        for text in texts:
            symbols, starts = symbols_of(text), chunk_starts(len(text))
            counts.append(len(starts))
            for a in range(0, len(starts), MOST_CHUNKS):
                answers.append(self.answers(symbols[starts[a : a + MOST_CHUNKS, None] + np.arange(CHUNK)]))
        first = np.cumsum([0, *counts])[:-1]
        return 1 / (1 + np.exp(-self.combine(np.concatenate(answers), first)[0].astype(np.float64)))

    def gradients(self, symbols: np.ndarray, first: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        tops = [(x.max(axis=1), x.argmax(axis=1)) for x in self.products(symbols)]
        answers, at = (np.concatenate(x) for x in zip(*tops, strict=True))
        logit, hidden, pooled, over = self.combine(answers, first)
        n = np.diff(np.append(first, len(over)))
        text = np.repeat(np.arange(len(first)), n)
        d = ((1 / (1 + np.exp(-logit)) - label) / len(label)).astype(np.float32)
        d_hidden = d[:, None] * self.outer * (1 - hidden**2)
        d_pooled = d_hidden @ self.inner.T
        largest = (over == pooled[text, :FILTERS]).astype(np.float32)
        largest /= np.add.reduceat(largest, first)[text]  # a window where two chunks overlap may be the largest of both
        d_over = d_pooled[text, :FILTERS] * largest + d_pooled[text, FILTERS:] / n[text, None]
        d_over *= over > 0
        seen = symbols[np.arange(len(symbols))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # chunk, filter, place
        vectors = self.bytes_[seen].reshape(len(symbols), FILTERS, WIDTH * DEPTH)
        d_filters = np.einsum("cf,cfw->wf", d_over, vectors, optimize=True)
        d_bytes = np.zeros_like(self.bytes_)
        back = (d_over[:, :, None] * self.filters.T).reshape(-1, DEPTH)
        flat = seen.reshape(-1)
        for k in range(DEPTH):
            d_bytes[:, k] = np.bincount(flat, back[:, k], FILL + 1)
        return [d_bytes, d_filters, -d_over.sum(axis=0), pooled.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d, d.sum(keepdims=True)]


def fit(texts: list[np.ndarray], labels: np.ndarray, steps: int, rate: float = 0.01, batch: int = 32, seed: int = 1) -> Network:
    """texts: of each the chunks that are learned from. The same texts in the same order give the same network, after so
    many steps of so many texts, however few there are."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    weights = net.weights()
    mean, square = ([np.zeros_like(w) for w in weights] for _ in range(2))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    net.bias[0] = np.log(share / (1 - share))
    for step, own in zip(range(1, steps + 1), _batches(rng, len(texts), batch), strict=False):
        symbols = np.concatenate([texts[i] for i in own])
        first = np.cumsum([0, *(len(texts[i]) for i in own)])[:-1]
        now = rate * (1 - 0.9 * step / steps)
        for w, g, m, v in zip(weights, net.gradients(symbols, first, labels[own]), mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def _batches(rng: np.random.Generator, n: int, size: int) -> Iterator[np.ndarray]:
    while n:
        order = rng.permutation(n)
        for a in range(0, n, size):
            yield order[a : a + size]
