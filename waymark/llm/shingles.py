"""Sets of word shingles as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: Bytes of text that are hashed at once; a longer text goes alone. Each takes some fifty bytes while it is hashed.
BATCH = 1 << 18
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def mixed(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _some(texts: Sequence[bytes], n: int) -> Iterator[np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    a = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    a = np.where((a >= 65) & (a <= 90), a | 32, a)
    inside = ~((a == 32) | ((a >= 9) & (a <= 13)))
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    if len(starts):
        place = np.arange(len(a))
        place -= starts[np.maximum(np.cumsum(np.bincount(starts, minlength=len(a))) - 1, 0)]
        np.maximum(place, 0, out=place)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(place.max()) + 1, _BASE))
            h = mixed(np.add.reduceat(np.where(inside, _BYTE[a] * powers[place], np.uint64(0)), starts))
            s = h[: max(0, len(h) - n + 1)].copy()
            for j in range(1, n):
                s = s * _STEP + h[j : len(h) - n + 1 + j]
            s = mixed(s + np.uint64(n))
    ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
    begin = 0
    for end in ends.tolist():
        if end - begin >= n:
            yield np.unique(s[begin : end - n + 1])
        elif end > begin:
            with np.errstate(over="ignore"):
                one = np.uint64(0)
                for x in h[begin:end]:
                    one = one * _STEP + x
                yield mixed(np.array([one + np.uint64(end - begin)]))
        else:
            yield np.empty(0, np.uint64)
        begin = end


def shingle_sets(texts: Iterable[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, A-Z lower-cased, words between ASCII white space; texts with
    fewer words have their whole sequence as one; null and empty texts have none. Memory is a few dozen bytes a byte of
    BATCH or of the longest text."""
    some: list[bytes] = []
    held = 0
    for text in texts:
        b = (text or "").encode("utf-8", "surrogatepass")
        if some and held + len(b) > BATCH:
            yield from _some(some, n)
            some, held = [], 0
        some.append(b)
        held += len(b)
    if some:
        yield from _some(some, n)
