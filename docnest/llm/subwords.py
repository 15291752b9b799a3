"""Words as rows of a growing table, and their hashed byte n-grams in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_PRIME = np.uint32(0x01000193)


def grams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): the index of its word and the bucket of every n-gram of ``^word$``."""
    marked = [b"^" + w + b"$" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked), dtype=np.int32), lengths)
    owners, found = [], []
    with np.errstate(over="ignore"):
        rolling = np.full(len(data), np.uint32(0x811C9DC5))
        for n in range(1, max(sizes) + 1):
            last = len(data) - n + 1
            if last <= 0:
                break
            rolling = (rolling[:last] ^ data[n - 1 :]) * _PRIME
            if n in sizes:
                inside = owner[:last] == owner[n - 1 :]
                mixed = rolling ^ (rolling >> np.uint32(15)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                owners.append(owner[:last][inside])
                found.append((mixed[inside] % np.uint32(buckets)).astype(np.int32))
    if not owners:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(owners), np.concatenate(found)


def affixes(words: list[bytes], most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the first and the last 1 to ``most`` bytes of every word."""
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    owners, found = [], []
    with np.errstate(over="ignore"):
        for salt, first, step in ((0x51, starts, 1), (0xA7, starts + lengths - 1, -1)):
            rolling = np.full(len(words), np.uint32(0x811C9DC5 ^ salt))
            which = np.arange(len(words), dtype=np.int32)
            for n in range(most):
                long = lengths[which] > n
                which, rolling = which[long], rolling[long]
                rolling = (rolling ^ data[first[which] + step * n]) * _PRIME
                mixed = rolling ^ (rolling >> np.uint32(15)) ^ np.uint32(salt * 0x9E3779B1 + n & 0xFFFFFFFF)
                owners.append(which)
                found.append((mixed % np.uint32(buckets)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(found)


class WordTable(dict):
    """Number of each word, and a row of values per number, made in one go for the words that are new.

    ``rows_of(words)`` gives the rows of a list of words. The table starts anew when ``most`` words are in it.
    """

    def __init__(self, rows_of: Callable[[list[bytes]], np.ndarray], width: int, most: int = 100_000):
        super().__init__()
        self.rows_of, self.most = rows_of, most
        self.values = np.zeros((1024, width), np.float32)
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settle(self) -> np.ndarray:
        """The values of all words, the new ones included."""
        if self.fresh:
            first = len(self) - len(self.fresh)
            while len(self.values) < len(self):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            for at in range(0, len(self.fresh), 20_000):
                part = self.fresh[at : at + 20_000]
                self.values[first + at : first + at + len(part)] = self.rows_of(part)
            self.fresh = []
        return self.values

    def forget(self) -> None:
        """Start anew if the table is full; numbers given before are void."""
        if len(self) > self.most:
            self.clear()
            self.fresh = []
