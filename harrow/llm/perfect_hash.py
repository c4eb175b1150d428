"""A minimal perfect hash function over 64-bit keys, built in shards inside tasks; of each shard, levels of bits that a key alone has set."""

from __future__ import annotations

import numpy as np

from harrow.llm.wordhash import mix

U = np.uint64
SHARD_SEED, LEVEL_STEP = U(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(keys.astype(U) ^ SHARD_SEED) >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def _spots(keys: np.ndarray, level: int, size) -> np.ndarray:
    return (mix(keys ^ U((level + 1) * LEVEL_STEP % (1 << 64))) % size).astype(np.int64)


def build(keys: np.ndarray, load=2.0) -> tuple[list[int], np.ndarray]:
    """(sizes of the levels, their bits in words of 64): a level has load bits for each key that is left; keys whose bit no other key has are placed, the others go on."""
    keys, sizes, words = keys.astype(U), [], []
    while len(keys):
        size = -(-int(load * len(keys)) // 64) * 64
        spots = _spots(keys, len(sizes), U(size))
        alone = np.bincount(spots, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(U))
        sizes.append(size)
        keys = keys[~alone[spots]]
    return sizes, np.concatenate(words) if words else np.zeros(0, U)


class PerfectHash:
    """Shards put together: each key of theirs has a slot of its own in 0..n-1, the slots of a shard follow those of the shard before. Other keys have any slot or -1, so a slot's key is to be compared."""

    def __init__(self, shards: list[tuple[list[int], np.ndarray]]):
        self.shards = len(shards)
        levels = max([len(s) for s, _ in shards], default=0)
        self.sizes = np.zeros((self.shards, levels), U)
        self.starts = np.zeros((self.shards, levels), np.int64)
        at = 0
        for i, (sizes, _) in enumerate(shards):
            for j, size in enumerate(sizes):
                self.sizes[i, j], self.starts[i, j] = size, at
                at += size
        self.words = np.concatenate([w for _, w in shards] or [np.zeros(0, U)])
        self.rank = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys, out = keys.astype(U), np.full(len(keys), -1, np.int64)
        if not self.shards:
            return out
        left, shard = np.arange(len(keys)), shard_of(keys, self.shards)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            bit = self.starts[shard[left], level] + _spots(keys[left], level, size)
            word, below = self.words[bit >> 6], (bit & 63).astype(U)
            hit = (word >> below) & U(1) == 1
            under = word[hit] & ((U(1) << below[hit]) - U(1))
            out[left[hit]] = self.rank[bit[hit] >> 6] + np.bitwise_count(under)
            left = left[~hit]
        return out
