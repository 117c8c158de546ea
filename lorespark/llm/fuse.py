"""Static 3-wise binary-fuse filters (8-bit fingerprints) over 64-bit keys, in numpy.

Graf and Lemire, "Binary Fuse Filters: Fast and Smaller Than Xor Filters", 2022. Construction peels the
hypergraph in rounds: all slots that hold one key are freed at once, so that each round is a few array
operations. About 9 bits a key, false positives 1/256, no false negatives. Repeated keys count once; a filter of no
keys holds none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64 bits for each seed."""
    with np.errstate(over="ignore"):
        h = keys ^ U(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> U(shift))) * U(factor)
        return h ^ (h >> U(33))


@dataclass(frozen=True)
class FuseFilter:
    seed: int
    segment: int
    starts: int
    table: bytes

    def _slots(self, h: np.ndarray) -> np.ndarray:
        mask = U(self.segment - 1)
        first = ((h >> U(32)) * U(self.starts)) >> U(32)
        second = (first + U(self.segment)) ^ ((h >> U(18)) & mask)
        third = (first + U(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> U(32))) & U(0xFF)).astype(np.uint8)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not self.table or not len(keys):
            return np.zeros(len(keys), bool)
        h = _mix(keys.astype(U), self.seed)
        a, b, c = np.frombuffer(self.table, np.uint8)[self._slots(h)]
        return (a ^ b ^ c) == self._print(h)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(U))
        n = len(keys)
        if not n:
            return cls(0, 4, 0, b"")
        segment = 4 if n == 1 else min(1 << int(math.log(n) / math.log(3.33) + 2.25), 1 << 18)
        slots = round(n * (1.125 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))))
        starts = max(1, -(-slots // segment) - 2) * segment
        for seed in range(1, 200):
            out = cls(seed, segment, starts, b"")
            h = _mix(keys, seed)
            if (order := _peel(out._slots(h), starts + 2 * segment)) is not None:
                table = np.zeros(starts + 2 * segment, np.uint8)
                at, prints = out._slots(h), cls._print(h)
                for key, slot in reversed(order):
                    table[slot] = 0
                    table[slot] = prints[key] ^ table[at[0, key]] ^ table[at[1, key]] ^ table[at[2, key]]
                return cls(seed, segment, starts, table.tobytes())
        raise RuntimeError("no seed peels this key set")


def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot each of them owns), or None if a core of keys is left."""
    n = at.shape[1]
    count = np.bincount(at.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    np.bitwise_xor.at(held, at.ravel(), np.tile(np.arange(n), 3))
    rounds, left = [], n
    ready = np.flatnonzero(count == 1)
    while len(ready):
        keys, first = np.unique(held[ready], return_index=True)
        rounds.append((keys, ready[first]))
        left -= len(keys)
        touched = at[:, keys].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(held, touched, np.tile(keys, 3))
        ready = np.unique(touched)
        ready = ready[count[ready] == 1]
    return None if left else rounds
