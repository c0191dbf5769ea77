"""Vectorised hashes of words and of runs of words.

A word is a run of bytes other than ASCII white space. Its hash is a polynomial in random byte values, taken from running
sums over all bytes of a batch at once; a run of words hashes the same way from its words. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), np.uint64(base))
        grown[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[name] = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser: every bit of x reaches every bit of the result."""
    x = x ^ np.uint64(seed)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Byte values, bases and steps of two independent polynomials.
_FAMILIES = ((_BYTE, _BASE, _STEP), (_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), 0xD1342543DE82EF95, 0xA0761D6478BD642F))


class Words:
    """The words of many texts: hashes, byte places, and where each text's words begin.

    family chooses one of two independent polynomials.
    """

    def __init__(self, texts: list[bytes], family: int = 0):
        values, base, self.step = _FAMILIES[family]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        space = _SPACE[data]
        edge = np.diff(space.view(np.int8), prepend=np.int8(1))
        self.begin, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        with np.errstate(over="ignore"):
            sums = np.cumsum(values[data] * _powers(f"byte{family}", base, len(data)), dtype=np.uint64)
            whole = sums[self.end - 1] - np.where(self.begin > 0, sums[self.begin - 1], np.uint64(0))
            whole *= _powers(f"back{family}", pow(base, -1, 2**64), len(data))[self.begin]
        self.hash = mix(whole)
        self.text_begin = begin
        self.first = np.searchsorted(self.begin, begin)  # index of each text's first word; the last entry is the total

    def runs(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words at each place, and whether all k are in one text."""
        h, n = self.hash, len(self.hash)
        m = max(0, n - k + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            factor = 1
            for j in range(k):
                out[:m] += h[j : j + m] * np.uint64(factor)
                factor = factor * self.step % 2**64
        count = np.diff(self.first)
        last = np.repeat(self.first[1:] - k, count)
        return mix(out, seed), np.arange(n) <= last

    def sequence(self, i: int, seed: int = 0) -> int:
        """Hash of all words of text i."""
        h = self.hash[self.first[i] : self.first[i + 1]]
        with np.errstate(over="ignore"):
            total = (h * _powers("word", _STEP, len(h))).sum(dtype=np.uint64)
        return int(mix(np.array([total ^ np.uint64(len(h) * 0x2545F4914F6CDD1D % 2**64)]), seed)[0])


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z taken as a-z. A text of fewer than k words is one shingle, an empty one none."""
    words = Words([t.lower() for t in texts])
    run, whole = words.runs(k)
    out = []
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            out.append(np.array([words.sequence(i)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
