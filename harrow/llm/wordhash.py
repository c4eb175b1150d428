"""Vectorised word and word-window hashes of many texts at once, for use inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers of the rolling sums and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93 | 1)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int, inverse=False) -> np.ndarray:
    got = _powers.get((base, inverse))
    if got is None or len(got) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        steps = np.full(1 << max(16, int(n - 1).bit_length()), step, U)
        steps[0] = 1
        got = _powers[base, inverse] = np.multiply.accumulate(steps)
    return got[:n]


def rolling(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """For each i, a hash of values[first[i]:last[i]]."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix((sums[last] - sums[first]) * powers(base, len(values) + 1, True)[first] + (last - first).astype(U) * U(BASES[2]))


_letters = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))


class Words:
    """The words (runs of bytes other than ASCII white space) of some texts: hash, and of each text the first word and the number of words."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edges = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        self.hash = rolling(_letters[buf], starts, ends, BASES[0])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        stops = np.cumsum(sizes)
        self.last = np.searchsorted(starts, stops)
        self.first = np.r_[0, self.last[:-1]].astype(np.int64)
        self.n = self.last - self.first
        self.text = np.repeat(np.arange(len(texts)), self.n)

    def place(self) -> np.ndarray:
        """Of each word, its place in its text, from 0."""
        return np.arange(len(self.hash)) - self.first[self.text]

    def left(self) -> np.ndarray:
        """Of each word, how many words its text has from it on."""
        return self.last[self.text] - np.arange(len(self.hash))

    def windows(self, at: np.ndarray, width: int, base: int = 1) -> np.ndarray:
        """A hash of the width words from each place in at."""
        return rolling(self.hash, at, at + width, BASES[base])


def batches(texts: list[bytes], most=2_000_000):
    """Ranges of texts with about `most` bytes each, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)
