"""Hashed character n-grams of whole texts, as numpy arrays inside tasks."""

from __future__ import annotations

import functools

import numpy as np

SPACE = 32
CHUNK = 1 << 20


@functools.cache
def letter_table() -> np.ndarray:
    """True at every code point that is a letter; built once per Python worker."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def folded(text: str) -> np.ndarray:
    """Lower-case code points; each run of other characters than letters is one space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letter_table()[codes], codes, np.uint32(SPACE))
    keep = codes != SPACE
    keep[1:] |= codes[:-1] != SPACE
    keep[0] = True
    return codes[keep]


def buckets(codes: np.ndarray, sizes: tuple[int, ...], bits: int):
    """Arrays of hashed n-grams in ``0 .. 2**bits - 1``, one per size and chunk of text."""
    mask, longest = np.uint32((1 << bits) - 1), max(sizes)
    for start in range(0, max(len(codes), 1), CHUNK):
        piece = codes[start : start + CHUNK + longest - 1]
        # n-grams that begin in this chunk; the overlap completes its last ones
        rolling = np.zeros(len(piece), np.uint32)
        for n in range(1, longest + 1):
            if n > len(piece):
                break
            rolling = rolling[: len(piece) - n + 1] * np.uint32(0x01000193) + piece[n - 1 :]
            if n in sizes:
                h = rolling[:CHUNK] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
                yield (h ^ (h >> np.uint32(16))) & mask
