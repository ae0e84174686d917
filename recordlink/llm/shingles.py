"""Hashes of word shingles, computed over the bytes of many texts at a time.

Words are runs of anything but ASCII white space, with A-Z lower-cased. A word's hash is a
sum over its bytes, each times a multiplier of its place, mixed with its length; a
shingle's mixes those of its words in order. No word becomes an object of its own and
nothing is remembered, so memory is that of ``TOGETHER`` bytes of text, or of one text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# Bytes of text that are hashed at a time; a longer text is hashed by itself.
TOGETHER = 250_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B1], dtype=np.uint64)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# of the first places in a word; a place beyond continues the powers
_PLACES = 64


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(max(n, _PLACES), np.uint64(0xD6E8FEB86659FD93), dtype=np.uint64))


_POWERS = _powers(_PLACES)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    octets = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    at = np.flatnonzero(~_SPACE[octets])
    if not len(at):
        return np.empty(0, dtype=np.uint64), at
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    longest = int(sizes.max())
    powers = _POWERS if longest <= _PLACES else _powers(longest)
    parts = (octets[at].astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.add.reduceat(parts, first)
    return mixed(sums + sizes.astype(np.uint64) * _MIX[2]), at[first]


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(hashes) - width + 1
    # the number of words is part of the hash, so a short text equals no shingle of a long one
    total = np.full(n, np.uint64(width) * _MIX[2], dtype=np.uint64)
    for i in range(width):
        total *= _MIX[0]
        total += hashes[i : i + n]
    return mixed(total)


def shingles_of_texts(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """The shingles of each text in order, with repeats; a short text is one shingle."""
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        waiting.append(text.encode("utf-8", "surrogatepass") if text else b"")
        size += len(waiting[-1])
        if size >= TOGETHER:
            yield from _of_some(waiting, words)
            waiting, size = [], 0
    yield from _of_some(waiting, words)


def _of_some(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    hashes, starts = word_hashes(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    found = runs(hashes, words) if len(hashes) >= words else hashes[:0]
    begin = 0
    for end in np.searchsorted(starts, ends):
        if 0 < end - begin < words:
            yield runs(hashes[begin:end], int(end - begin))
        else:
            yield found[begin : max(begin, end - words + 1)]
        begin = end


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(next(shingles_of_texts([text], words)))
