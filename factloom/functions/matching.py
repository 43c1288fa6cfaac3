"""The blocks on which two sequences agree, as difflib's SequenceMatcher finds them, in time that hardly grows faster than the sequences.

SequenceMatcher looks at every pair of equal elements again for each block. Here the pairs of equal runs of elements are found once, as diagonal segments, and each
part of the sequences picks its longest segment. The result is the same, block by block: elements that make up over 1 % of a second sequence of 200 and more start no block
(`autojunk`), and of blocks of one length the first in the first sequence counts, then the first in the second.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import numpy as np

#: Products of lengths up to which SequenceMatcher itself is faster, and pairs of equal runs that are held at once.
SMALL, MOST_PAIRS = 2_500, 4_000_000
Block = tuple[int, int, int]


def matching_blocks(a: Sequence, b: Sequence) -> list[Block]:
    """(start in a, start in b, length) of each block in order, neighbours joined, without the empty one at the end."""
    if not len(a) or not len(b):
        return []
    if a == b:  # the first of the longest runs lies on the main diagonal, and so does what is equal around it
        return [(0, 0, len(a))]
    if len(a) * len(b) <= SMALL:
        return [tuple(x) for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks()[:-1]]
    found: list[Block] = []
    for i, j, n in sorted(_Matcher(*_codes(a, b)).blocks()):
        if found and sum(found[-1][::2]) == i and found[-1][1] + found[-1][2] == j:
            found[-1] = (*found[-1][:2], found[-1][2] + n)
        else:
            found.append((i, j, n))
    return found


def ratio(a: Sequence, b: Sequence) -> float:
    """SequenceMatcher.ratio()."""
    n = len(a) + len(b)
    return 2.0 * sum(x[2] for x in matching_blocks(a, b)) / n if n else 1.0


def changes(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """(start and end in a, start and end in b) of each run that differs: the opcodes but for the equal ones."""
    blocks = [(0, 0, 0), *matching_blocks(a, b), (len(a), len(b), 0)]
    gaps = [(x[0] + x[2], y[0], x[1] + x[2], y[1]) for x, y in zip(blocks[:-1], blocks[1:], strict=True)]
    return [g for g in gaps if g[0] < g[1] or g[2] < g[3]]


def _codes(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """The elements as numbers from 0, equal ones alike."""
    if isinstance(a, str):
        both = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen = np.zeros(int(both.max()) + 1, dtype=np.int64)
        seen[both] = 1
        both = (np.cumsum(seen) - 1)[both]
        return both[: len(a)], both[len(a) :]
    known = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    of = lambda x: np.fromiter(map(known.__getitem__, x), dtype=np.int64, count=len(x))
    return of(a), of(b)


class _Grams:
    """Runs of `width` rare elements of both sequences as numbers, with their places; b's in order of number and place."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], step: int):
        (self.key_a, self.at_a), (self.key_b, self.at_b), self.step = a, b, step
        self.sorted_b = np.sort(self.key_b * step + self.at_b)


class _Matcher:
    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        kinds = int(max(a.max(), b.max())) + 1
        counts = np.bincount(b, minlength=kinds)
        rare = (counts > 0) & ((counts <= len(b) // 100 + 1) if len(b) >= 200 else True)
        at_a, at_b = np.flatnonzero(rare[a]), np.flatnonzero(rare[b])
        self.step = max(len(a), len(b)) + 1
        self.grams = {1: _Grams((a[at_a], at_a), (b[at_b], at_b), self.step)}

    def gram(self, width: int) -> _Grams:
        if width not in self.grams:
            shorter, one = self.gram(width - 1), self.grams[1]

            def longer(key, at, whole, rare_at):
                rare = np.zeros(len(whole) + width, dtype=bool)
                rare[rare_at] = True
                kept = rare[at + width - 1]
                return key[kept], at[kept], whole[at[kept] + width - 1]

            ka, pa, na = longer(shorter.key_a, shorter.at_a, self.a, one.at_a)
            kb, pb, nb = longer(shorter.key_b, shorter.at_b, self.b, one.at_b)
            kinds = int(max(na.max(initial=0), nb.max(initial=0))) + 1
            both = np.concatenate([ka * kinds + na, kb * kinds + nb])
            if len(both) and int(both.max()) >= 2**62 // self.step:
                both = np.unique(both, return_inverse=True)[1]
            self.grams[width] = _Grams((both[: len(pa)], pa), (both[len(pa) :], pb), self.step)
        return self.grams[width]

    def segments(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """A width, and the start in a, diagonal and length of each maximal run of rare elements, of that width at least, that is common to both parts."""
        width = 2
        while True:
            g = self.gram(width)
            inside = slice(*np.searchsorted(g.at_a, [alo, max(alo, ahi - width + 1)]))
            key, at = g.key_a[inside], g.at_a[inside]
            first = np.searchsorted(g.sorted_b, key * self.step + blo)
            n = np.maximum(np.searchsorted(g.sorted_b, key * self.step + max(blo, bhi - width + 1)) - first, 0)
            total = int(n.sum())
            if total <= MOST_PAIRS:
                break
            width += 1
        if not total:
            none = np.empty(0, dtype=np.int64)
            return width, none, none, none
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(at, n)
        j = g.sorted_b[np.repeat(first, n) + within] % self.step
        on = np.sort((i - j + self.step) * (2 * self.step) + i)  # by diagonal, then place
        starts = np.flatnonzero(np.diff(on, prepend=on[0] - 2) != 1)
        length = np.diff(starts, append=total) + width - 1
        return width, on[starts] % (2 * self.step), on[starts] // (2 * self.step) - self.step, length

    def first_gram(self, width: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int] | None:
        """The first run of a's part that b's part has too, and its first place there."""
        g = self.gram(width)
        low, high = np.searchsorted(g.at_a, [alo, max(alo, ahi - width + 1)])
        size = 16
        while low < high:
            key = g.key_a[low : min(low + size, high)] * self.step
            k = np.searchsorted(g.sorted_b, key + blo)
            hit = np.flatnonzero(k < np.searchsorted(g.sorted_b, key + max(blo, bhi - width + 1)))
            if len(hit):
                return int(g.at_a[low + hit[0]]), int(g.sorted_b[k[hit[0]]] - key[hit[0]])
            low, size = low + size, size * 4
        return None

    def reach(self, i: int, j: int, most: int, way: int) -> int:
        """How many elements from (i, j) on, or before it for a way of -1, are equal."""
        done, size = 0, 32
        while done < most:
            n = min(size, most - done)
            x, y = (self.a[i + done : i + done + n], self.b[j + done : j + done + n]) if way > 0 else (self.a[i - done - n : i - done][::-1], self.b[j - done - n : j - done][::-1])
            other = (x != y).argmax()
            if x[other] != y[other]:
                return done + int(other)
            done, size = done + n, size * 4
        return done

    def blocks(self) -> list[Block]:
        found, todo = [], [(0, len(self.a), 0, len(self.b), None)]
        while todo:
            alo, ahi, blo, bhi, known = todo.pop()
            if min(ahi - alo, bhi - blo) < 2:
                known = (2, *[np.empty(0, dtype=np.int64)] * 3)
            elif known is None:
                known = self.segments(alo, ahi, blo, bhi)
            width, start, diagonal, length = known
            i, j, n = alo, blo, 0
            if len(start):
                begin = np.maximum(start, np.maximum(alo, diagonal + blo))
                end = np.minimum(start + length, np.minimum(ahi, diagonal + bhi))
                size = end - begin
                if (n := int(size.max())) >= width:
                    ends = np.where(size == n, end, ahi + 1)
                    i = int(ends.min()) - n
                    j = i - int(diagonal[ends == i + n].max())
                else:
                    n = 0
                left = size >= width  # only these can count in a part of this part
                if not left.all():
                    known = (width, start[left], diagonal[left], length[left])
            if not n and width > 2 and min(ahi - alo, bhi - blo) >= 2:
                # Runs of the widths that the segments leave out: over again, in this part alone.
                for w in range(width - 1, 0, -1):
                    if at := self.first_gram(w, alo, ahi, blo, bhi):
                        (i, j), n = at, w
                        break
            elif not n and (at := self.first_gram(1, alo, ahi, blo, bhi)):
                (i, j), n = at, 1
            back = self.reach(i, j, min(i - alo, j - blo), -1)
            i, j, n = i - back, j - back, n + back
            n += self.reach(i + n, j + n, min(ahi - i - n, bhi - j - n), 1)
            if n:
                found.append((i, j, n))
                if alo < i and blo < j:
                    todo.append((alo, i, blo, j, known))
                if i + n < ahi and j + n < bhi:
                    todo.append((i + n, ahi, j + n, bhi, known))
        return found
