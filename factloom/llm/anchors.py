"""Content-defined anchors: places that two copies of any long enough string share.

The anchor of a string of `length` bytes is the place of the smallest hash among its runs of GRAM bytes, the
leftmost of equal ones. It depends on the string alone, so equal strings have it at the same offset.
"""

from __future__ import annotations

import numpy as np

from factloom.llm.decontaminate import gram_hashes
from factloom.llm.shingles import mix

GRAM = 32
#: Bits of a 64-bit value that hold a place; the others hold the hash.
_PLACE = 24
#: A longer text is read in parts that overlap.
LONGEST = 4 << 20


def smallest(values: np.ndarray, window: int) -> np.ndarray:
    """The smallest of each run of `window` values, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - window + 1], ahead[window - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first, last, hash): the strings of `length` bytes of text that start from first to last have this anchor. Places are in data."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    h = mix(gram_hashes(data, GRAM))
    packed = (h >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(h), dtype=np.uint64)
    place = (smallest(packed, length - GRAM + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(place)]
    good = np.arange(len(place)) + length <= ends[text]
    at, text = np.flatnonzero(good), text[good]
    place = place[good]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return text[first], place[first], at[first], at[last], h[place[first]]
