"""Words of whole texts and 64-bit hashes of runs of words, by array operations over the bytes of many texts.

A word is a run of bytes other than the six ASCII white-space bytes (0x20 and 0x09 to 0x0D), in UTF-8 as well as in
code points. Its hash is the sum of a random value for each byte times a random odd factor for each place, modulo 2^64,
then mixed with its length. A run of words is hashed by doubling: the hash of a run of n words and that of the n words
after it give that of 2n words, mixed again each time (the second run may overlap the first, for lengths that are no
power of two). Two seeds share no value, so they give independent hashes, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Seed:
    """Random values of bytes, factors of places and of the two halves of a run."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.of_byte = random.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
        self.start, self.first, self.second, self.length = random.integers(1 << 40, 1 << 62, 4, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        self._of_place = np.empty(0, _U)

    def of_place(self, n: int) -> np.ndarray:
        if len(self._of_place) < n:
            places = np.arange(max(n, 2 * len(self._of_place), 1024), dtype=_U)
            self._of_place = mix(places * _U(0x9E3779B97F4A7C15) + self.start) | _U(1)
        return self._of_place


_SEEDS = [_Seed(11), _Seed(23)]


class Words:
    """Words of a block of texts: ``start`` and ``end`` (byte positions) and ``doc`` (number of the text) of each word,
    ``first`` (number of the first word of each text and, at the end, of all words)."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, lower: bool):
        """``raw``: the bytes of all texts, one white-space byte after each; ``ends``: positions after those."""
        space = _SPACE[raw]
        edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        self.raw, self.space = (_LOWER[raw] if lower else raw), space
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends, "left"))).astype(np.int64)
        self.n_docs = len(ends)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word."""
        own = _SEEDS[seed]
        lengths = self.end - self.start
        ends = np.cumsum(lengths)
        begins = ends - lengths
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(begins, lengths)
        factors = own.of_place(int(lengths.max(initial=0)))
        total = np.concatenate((np.zeros(1, _U), np.cumsum(own.of_byte[self.raw[~self.space]] * factors[place], dtype=_U)))
        return mix(total[ends] - total[begins] + lengths.astype(_U) * own.length)

    @staticmethod
    def runs(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
        """A hash of the ``size`` words from each word on; meaningless where the text ends before (see ``whole``)."""
        if len(hashes) < size:
            return np.empty(0, _U)
        run, length, own = hashes, 1, _SEEDS[seed]
        while length < size:
            step = min(length, size - length)
            run = mix(run[:-step] * own.first + run[step:] * own.second)
            length += step
        return run

    def whole(self, size: int) -> np.ndarray:
        """For each run that ``runs`` gives: does it lie in one text?"""
        n = len(self.start)
        return self.doc[: n - size + 1] == self.doc[size - 1 :] if n >= size else np.empty(0, bool)


def blocks(texts: pa.Array, lower: bool, limit: int = 1 << 18, rows: int = 1024) -> Iterator[tuple[int, Words]]:
    """(number of the first text, words) for blocks of texts of up to ``limit`` bytes, or of one longer text.

    Texts are taken from the Arrow batch ``rows`` at a time, so a worker holds little more than the batch itself.
    """
    for lo in range(0, len(texts), rows):
        values = [v or b"" for v in texts.slice(lo, rows).cast(pa.binary()).to_pylist()]
        sizes = np.array([len(v) + 1 for v in values], np.int64)
        at = 0
        while at < len(values):
            ends = np.cumsum(sizes[at:])
            stop = at + max(1, int(np.searchsorted(ends, limit, "right")))
            yield lo + at, Words(np.frombuffer(b" ".join(values[at:stop]) + b" ", np.uint8), ends[: stop - at], lower)
            at = stop
