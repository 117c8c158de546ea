"""Codes of a text's words in array operations."""

from __future__ import annotations

import numpy as np

U = np.uint64
ODD = 0x9E3779B97F4A7C15
#: Texts are read in parts of this size; a word that is longer counts as several.
PART = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, base, U), out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_factors = powers(ODD, 1 << 16)


def word_codes(text: bytes) -> np.ndarray:
    """A 64-bit code of each run of other characters than ASCII white space."""
    out, start = [], 0
    while start < len(text):
        data = np.frombuffer(text[start : start + PART], np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        if start + PART < len(text) and space.any():  # the last word may go on in the next part
            end = np.flatnonzero(space)[-1] + 1
            data, space = data[:end], space[:end]
        start += len(data)
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        first, size = edge[::2], edge[1::2] - edge[::2]
        if len(first):
            at = np.cumsum(size) - size
            with np.errstate(over="ignore"):
                place = np.arange(int(size.sum())) - np.repeat(at, size)
                sums = np.add.reduceat((data[~space].astype(U) + U(1)) * _factors[place & 0xFFFF], at)
                out.append(mix(sums + size.astype(U)))
    return np.concatenate(out) if out else np.zeros(0, U)
