"""Counts of the terms of many texts: packed into words of 64 bits, radix-sorted and run-counted in numpy.

A term is a run of the letters A-Z and a-z and of bytes over 0x7F, A-Z in lower case. Terms of up to 8 bytes are one
uint64, those of up to 16 two, first byte highest, so that their order is that of their bytes; no term holds a zero
byte, so the zeros that fill the last word tell its length. Longer terms are sorted as bytes in buckets of widths that
double, so a bucket holds at most twice the bytes of its terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: For each byte: the byte of a term that it stands for, or 0.
FOLD = np.zeros(256, dtype=np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[ord("a") : ord("z") + 1] = FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
#: The bytes of a word that the first n bytes of a term fill.
FILLED = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], dtype=np.uint64)


@dataclass
class Runs:
    """Terms with their group, how often they are there and in how many texts, in order of term and group. high and low
    are the words of a term of up to 16 bytes, else 0; rest is a longer term, else empty."""

    high: np.ndarray
    low: np.ndarray
    rest: pa.Array
    group: np.ndarray
    n: np.ndarray
    texts: np.ndarray


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by uint64 keys, of which the first counts most: sixteen bits a pass, from the last ones on."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 64, 16):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(keys: list[np.ndarray], order: np.ndarray, group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """First place in order of each run of equal keys and group, its length, and its number of different texts."""
    opens = np.zeros(len(order), dtype=bool)
    opens[:1] = True
    for key in (*keys, group):
        k = key[order]
        opens[1:] |= k[1:] != k[:-1]
    t = text[order]
    fresh = opens.copy()
    fresh[1:] |= t[1:] != t[:-1]
    at = np.flatnonzero(opens)
    return at, np.diff(np.append(at, len(order))), np.add.reduceat(fresh.astype(np.int64), at)


def count_terms(texts: pa.Array, group: np.ndarray) -> Iterator[Runs]:
    """texts: strings without nulls; group: the number of each text's group, ascending. One result for each form of
    term, so each pair of term and group is in one of them at most."""
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    size = int(bounds[-1] - bounds[0])
    low = np.zeros(size + 16, dtype=np.uint8)
    if size:
        low[:size] = FOLD[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]]
    bounds -= bounds[0]
    inside = low[: size + 1] != 0
    first, after = inside.copy(), np.zeros(size + 1, dtype=bool)
    first[1:] &= ~inside[:-1]
    after[1:] = inside[:-1] & ~inside[1:]
    first[bounds] |= inside[bounds]  # two texts meet without a byte between them
    cut = bounds[bounds > 0]
    after[cut] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(after)
    length = end - start
    text = np.searchsorted(bounds, start, side="right") - 1
    words = np.ndarray(size + 9, dtype=">u8", buffer=low, strides=(1,))

    def word(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return words[at].astype(np.uint64) & FILLED[np.minimum(left, 8)]

    for wide in (False, True):
        of = np.flatnonzero((length > 8) & (length <= 16) if wide else length <= 8)
        if not len(of):
            continue
        keys = [word(start[of], length[of])]
        if wide:
            keys.append(word(start[of] + 8, length[of] - 8))
        g, order = group[text[of]], radix_order(keys)
        at, count, held = _runs(keys, order, g, text[of])
        shown = order[at]
        second = keys[1][shown] if wide else np.zeros(len(shown), dtype=np.uint64)
        yield Runs(keys[0][shown], second, pa.array([b""] * len(shown), pa.binary()), g[shown], count, held)

    width = 32
    while len(length) and length.max() > width // 2:
        of = np.flatnonzero((length > max(16, width // 2)) & (length <= width))
        if len(of):
            held = np.array([low[a:b].tobytes() for a, b in zip(start[of], end[of], strict=True)], dtype=f"S{width}")
            g, order = group[text[of]], np.argsort(held, kind="stable")
            at, count, in_texts = _runs([held], order, g, text[of])
            shown = order[at]
            none = np.zeros(len(shown), dtype=np.uint64)
            yield Runs(none, none, pa.array(held[shown].tolist(), pa.binary()), g[shown], count, in_texts)
        width *= 2


def merged(parts: list[Runs]) -> list[Runs]:
    """The same counts with equal terms of a group put together; groups are numbered alike in all parts."""
    short = [p for p in parts if p.high[0]]
    if len(short) < 2:
        return parts
    high, low, group = (np.concatenate([getattr(p, f) for p in short]) for f in ("high", "low", "group"))
    n, texts = (np.concatenate([getattr(p, f) for p in short]) for f in ("n", "texts"))
    order = radix_order([high, low, group.astype(np.uint64)])
    at, _, _ = _runs([high, low], order, group, np.zeros(len(order), dtype=np.int8))
    shown = order[at]
    one = Runs(
        high[shown],
        low[shown],
        pa.array([b""] * len(shown), pa.binary()),
        group[shown],
        np.add.reduceat(n[order], at),
        np.add.reduceat(texts[order], at),
    )
    return [one, *(p for p in parts if not p.high[0])]
