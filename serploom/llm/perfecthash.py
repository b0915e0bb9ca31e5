"""A minimal perfect hash over integers, with the keys stored by slot."""

from __future__ import annotations

from itertools import count

import numpy as np


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key (unsigned)."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def below(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes brought into 0 .. n - 1, n up to 2 ** 32."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Slots 0 .. n - 1 of n distinct keys; ``slots`` gives -1 for every other key, since the slot's stored key is compared.

    A cascade of bit arrays: a key that is alone at its position of a level sets the bit there, the others go on to the next level. A slot is the number of bits set before.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        left, base = np.unique(keys).astype(np.int64).view(np.uint64), 0
        self.keys, self.levels = np.empty(len(left), np.int64), []
        for level in count():
            if not len(left):
                break
            size = -(-int(gamma * len(left)) // 64) * 64
            at = below(mixed(left, level), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            placed = alone[at]
            self.levels.append((size, bits, ranks[:-1]))
            order = np.argsort(at[placed], kind="stable")
            self.keys[base : ranks[-1]] = left[placed][order].view(np.int64)
            base, left = int(ranks[-1]), left[~placed]

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, where, left = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys.astype(np.int64).view(np.uint64)
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = below(mixed(left, level), size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = bits[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            slot = ranks[word[hit]] + np.bitwise_count(held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            same = self.keys[slot].view(np.uint64) == left[hit]
            out[where[hit][same]] = slot[same]
            where, left = where[~hit], left[~hit]
        return out
