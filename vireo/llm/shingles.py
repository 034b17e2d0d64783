"""Word-shingle sets as sorted arrays of 64-bit hashes, made for a batch of texts at once with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64


class Words(dict):
    """Numbers for words, given as they come, with a 64-bit hash of each; emptied when it holds ``most``: some 20 MB, of which each worker of an executor has its own."""

    def __init__(self, most: int = 100_000) -> None:
        super().__init__()
        self.most, self.hashes, self.table = most, [], np.empty(0, U)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n

    def empty(self) -> None:
        self.clear()
        self.hashes, self.table = [], np.empty(0, U)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The hashes of the words in order."""
        if len(self) > self.most:
            self.empty()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.table) < len(self.hashes):
            self.table = np.concatenate([self.table, np.array(self.hashes[len(self.table) :], U)])
        return self.table[at]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased: bytes know no other blanks and no other case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray, key: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of a well-known generator)."""
    x = x + U((0x9E3779B97F4A7C15 * (key + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str | None], width: int, words: Words) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, sorted. Fewer words than ``width``: one shingle of them all; none: empty."""
    split = [words_of(t) for t in texts]
    flat = words.of([w for s in split for w in s])
    out, at = [], 0
    for s in split:
        h = flat[at : at + len(s)]
        at += len(s)
        n = min(width, len(s))
        if not n:
            out.append(np.empty(0, U))
            continue
        x = np.full(len(h) - n + 1, n, U)
        for k in range(n):
            x = mixed(x ^ h[k : len(h) - n + 1 + k], k)
        out.append(np.unique(x))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
