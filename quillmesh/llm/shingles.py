"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at once with numpy.

A word's hash is a polynomial over its UTF-8 bytes modulo 2^64, taken from prefix sums; a shingle's
hash mixes those of its words in order. A text of fewer words than a shingle has is one shingle.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept between calls."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data``: bytes of texts after each other, each followed by one space; ``starts``: where each begins, and the end.
    The hash of each word and the number of words before each text (and in all)."""
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    up, down = _power(len(data) + 1)
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    hashes = mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, starts)


def shingle_sets(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text after each other, and where each text's begin (and the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b" " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    w, first = word_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), starts)
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    h = np.zeros(len(owner), dtype=np.uint64)
    last = first[owner + 1] - 1
    padded = np.concatenate([w, np.zeros(size, dtype=np.uint64)])
    for i in range(size):
        word = np.where(at + i <= last, padded[at + i], np.uint64(0))
        h = mix(h * BASE + word + np.uint64(i + 1))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))
