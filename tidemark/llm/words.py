"""Words of many texts at once: lower case, letters, marks and digits; hashes by arithmetic on arrays."""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np

#: An odd multiplier, its inverse modulo 2**64, and the steps of a 64-bit finaliser. Fixed values.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Code points below this are classified; what lies above (no letters of living scripts) separates words.
KNOWN = 0x32000


@functools.cache
def word_table() -> np.ndarray:
    """The lower-case code point of each code point that belongs to a word, else 0."""
    low = np.zeros(KNOWN, np.uint32)
    for i in range(KNOWN):
        c = chr(i)
        if unicodedata.category(c)[0] in "LMN":
            low[i] = ord(c.lower()[0])
    return low


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX2)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(length, BASE, np.uint64), np.full(length, BACK, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 20
    if n > size:  # a single very long text: not kept
        size = n
        return _powers.__wrapped__(size)
    return _powers(size)


@dataclass
class Words:
    """Words of several texts: hash, first and last+1 code point within the joined texts, and text number of each."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    texts: int
    offsets: np.ndarray  # where each text begins in the joined texts
    codes: np.ndarray  # the joined texts
    _run: np.ndarray
    _down: np.ndarray

    def cuts(self) -> np.ndarray:
        """Where each text's words begin, with the total at the end."""
        return np.searchsorted(self.owner, np.arange(self.texts + 1))

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The words that have so many code points, and the hashes of their first so many: those of words of that length."""
        long = np.flatnonzero(self.ends - self.starts >= length)
        begin = self.starts[long]
        return long, mix((self._run[begin + length] - self._run[begin]) * self._down[begin] + np.uint64(length))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words that lie in one text, and the first word of each."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = np.zeros(count, np.uint64)
        for i in range(n):
            total = total * np.uint64(BASE) + self.hashes[i : i + count]
        first = np.flatnonzero(self.owner[:count] == self.owner[n - 1 :])
        return mix(total[first]), first


def words_of(texts: list[str]) -> Words:
    """The words of each text; a text without letters, marks and digits has none."""
    joined = " ".join(texts) + " "
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.append(0, np.cumsum(lengths + 1))[: len(texts)]
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = word_table()[np.minimum(cp, KNOWN - 1)]
    inside = low > 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers_for(len(cp) + 1)
    run = np.append(np.uint64(0), np.cumsum(low.astype(np.uint64) * up[: len(cp)]))
    hashes = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return Words(hashes, starts, ends, owner, len(texts), offsets, cp, run, down)
