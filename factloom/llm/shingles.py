"""Sets of hashed word shingles of whole texts, computed for many texts at once on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is taken by itself.
BLOCK = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_random = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte; capital letters have that of their small letter.
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 1
_MUL = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and _BASE^-i for i < n, modulo 2^64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(n, dtype=np.uint64)
            p[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits."""
    x = (x ^ (x >> np.uint64(30))) * _MUL[0]
    x = (x ^ (x >> np.uint64(27))) * _MUL[1]
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a column of strings without nulls."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def stretches(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, after last) of neighbouring texts that have at most `most` bytes together; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the number of words before each text. Words are runs of bytes other than white space, in small letters."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    b = data[lo:hi]
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    edges = offsets - lo
    space = _SPACE[b]
    word = ~space
    first, last = word.copy(), word.copy()
    inner = edges[(edges > 0) & (edges < len(b))]
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _power(len(b) + 1)
    total = np.cumsum(_BYTE[b] * up[: len(b)])
    h = total[ends]
    h[1:] -= np.where(starts[1:] > 0, total[starts[1:] - 1], np.uint64(0))
    if len(starts) and starts[0] > 0:
        h[0] -= total[starts[0] - 1]
    return mix(h * down[starts] + (ends - starts + 1).astype(np.uint64) * _MUL[2]), np.searchsorted(starts, edges)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of `width` words; with fewer words, of all of them as one; without words, none."""
    data, offsets = text_bytes(column)
    for i, j in stretches(offsets, BLOCK):
        words, before = word_hashes(data, offsets[i : j + 1])
        n = max(0, len(words) - width + 1)
        runs = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            runs += words[k : k + n] * _MUL[(k % 5) + 3] * np.uint64(2 * (k // 5) + 1)
        runs = mix(runs)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                one = np.array([b - a], dtype=np.uint64)
                for k in range(a, b):
                    one = mix(one * _MUL[2] + words[k : k + 1])
                yield one
            else:
                yield np.zeros(0, dtype=np.uint64)
