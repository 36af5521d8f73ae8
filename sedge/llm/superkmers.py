"""Minimisers over sequences of hashed tokens, for the substring operators 7 and 10.

The minimiser of a window is the smallest hash among the grams (runs of a few tokens) within it; equal windows have equal
minimisers. Consecutive windows with one minimiser make a super-k-mer, which travels as one piece.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: An odd factor, its inverse modulo 2 ** 64, and the constants that mix a sum into a hash.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits for a place in a text; a text in Arrow has less than 2 ** 31 bytes.
PLACE_BITS = 32


@lru_cache(maxsize=64)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of `gram` tokens, each token being a 64-bit hash, from differences of one running sum."""
    n = len(tokens)
    bits = max(10, int(n).bit_length())
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(tokens * _powers(FACTOR, bits)[:n], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * _powers(INVERSE, bits)[: n - gram + 1]
    x ^= x >> np.uint64(32)
    x *= MIX
    x ^= x >> np.uint64(29)
    return x


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values: of what a block holds before and after each place."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def super_kmers(
    tokens: np.ndarray, window: int, gram: int, longest: int, by_place: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer; at most `longest` windows in one.

    By default windows go together if their minimisers are equal. With by_place they must also be at one place, the
    first of the window; then no two windows of a super-k-mer are equal, as this place is further in for one.
    """
    if len(tokens) < window:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    grams = gram_hashes(tokens, gram)
    if by_place:  # the place takes the low bits, as many in every text, and so decides between grams equal in the others
        bits = np.uint64(PLACE_BITS)
        marked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_minimum(marked, window - gram + 1)
    else:
        least = sliding_minimum(grams, window - gram + 1)
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    counts = np.diff(np.append(starts, len(least)))
    if counts.max() > longest:
        parts = -(-counts // longest)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + (np.arange(parts.sum()) - first) * longest
        counts = np.diff(np.append(starts, len(least)))
    minimisers = grams[(least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] if by_place else least[starts]
    return minimisers, starts, counts


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers among ascending places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(
        zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist(), strict=True)
    )
