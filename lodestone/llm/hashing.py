"""Word and shingle hashes of whole texts, in numpy.

Words are runs of bytes other than the six ASCII blanks, A-Z lowered. A word's
64-bit hash is a multilinear sum over its bytes (a fixed random multiplier per
position), finalised by splitmix64; texts are hashed together, so the cost per
byte does not depend on how long they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLANKS = bytes([32, 9, 10, 11, 12, 13])
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([c not in BLANKS for c in range(256)])


@lru_cache(maxsize=1)
def _multipliers(power: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 1 << power, np.uint64) | np.uint64(1)


def mix(z: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64 with a salt."""
    z = z + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the hashes of all words in order, the number of words of each text)."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(LOWERED), np.uint8)
    counts = np.zeros(len(texts), np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), counts
    inside = np.concatenate([[False], _IS_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = ends - starts
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # position in the word
    letters = data[inside[1:-1]].astype(np.uint64) + np.uint64(1)
    table = _multipliers(max(12, int(sizes.max() - 1).bit_length()))
    sums = np.add.reduceat(letters * table[at], np.cumsum(sizes) - sizes)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    np.add.at(counts, np.searchsorted(text_ends, starts, side="right"), 1)
    return mix(sums + sizes.astype(np.uint64)), counts


def in_blocks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, bytes of the texts): runs of texts of about limit bytes, a longer text alone."""
    first, size, block = 0, 0, []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if block and size + len(b) > limit:
            yield first, i, block
            first, size, block = i, 0, []
        block.append(b)
        size += len(b) + 1
    if block:
        yield first, len(texts), block


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of a text's k-word shingles, sorted; fewer words give their whole sequence, none nothing."""
    n = min(k, len(words))
    if not n:
        return words[:0]
    rows = len(words) - n + 1
    h = np.full(rows, np.uint64(n))
    for j in range(n):
        h = mix(h ^ words[j : j + rows], j)
    return np.unique(h)
