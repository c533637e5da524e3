"""Words and word shingles of many texts as 64-bit hashes, in whole-array steps.

Words are the runs between ASCII white space (space, U+0009 to U+000D) after lower-casing
A to Z. On UTF-8 bytes, ``bytes.lower`` touches those letters only and a polynomial prefix
sum gives every word's hash without a step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once: keeps the work arrays in tens of MB however long a text is.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so that its powers have inverses modulo 2^64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in a piece that no word crosses."""
    word = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(max(len(data), 1 << 16))
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=run[1:])
    return mixed((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        if to < len(data):  # back to a blank, or on to one within a giant word
            back = np.flatnonzero(_BLANK[data[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                on = np.flatnonzero(_BLANK[data[to:]])
                to = to + int(on[0]) + 1 if len(on) else len(data)
        h, s = _piece_words(data[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    where = np.searchsorted(np.concatenate(starts), ends)
    return np.concatenate(hashes), np.diff(np.r_[0, where])


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (not yet distinct) of each text, and their number. A text with fewer words has one shingle of all its words, one without words none."""
    total = np.zeros(len(words), np.uint64)
    owner_left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words from here to the end of the text
    factor = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for j in range(width):
        part = np.zeros(len(words), np.uint64)
        part[: max(len(words) - j, 0)] = words[j:] * factor[j]
        total += np.where(owner_left > j, part, np.uint64(0)) if j else part
    first = np.repeat(np.cumsum(counts) - counts, counts) == np.arange(len(words))
    keep = (owner_left >= width) | first
    short = np.minimum(owner_left, width).astype(np.uint64)
    return mixed(total + short)[keep], np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)


def groups(texts: list[str | None], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of consecutive texts with about ``most`` characters each, so that work arrays stay small."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
