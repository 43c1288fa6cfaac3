"""Benchmark decontamination by the q-gram lemma.

A passage within k edits of an item of m characters shares at least m + 1 - q * (k + 1) q-grams with it, all on k + 1
neighbouring diagonals (place in the text less place in the item). Hits are counted in diagonal bands that overlap by half, so that one of
them holds all the passage's hits; bands that reach the bound are retained and verified by banded alignment.

Both sides are compared in small letters, with each run of other characters than letters and digits as one space, character by character (not
byte by byte: an accented letter is one edit).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import freed, id_and_text, stored, text_key
from factloom.llm.shingles import stretches, text_bytes

SCHEMA = "doc_id long, item_id long, edits long, budget long, start long, length long, text_key long"
#: Bytes of texts that are searched together (a longer text by itself), and pairs of equal q-grams that are counted at once.
BLOCK, HITS = 1 << 18, 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def gram_hashes(b: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of q bytes or characters, by doubling."""
    n = len(b) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    known, power = {1: b.astype(np.uint64) + np.uint64(1)}, {1: _STEP}
    k = 1
    with np.errstate(over="ignore"):
        while 2 * k <= q:
            h = known[k]
            known[2 * k] = h[:-k] * power[k] + h[k:]
            power[2 * k] = power[k] * power[k]
            k *= 2
        out, have = known[k], k
        for step in sorted(known, reverse=True)[1:]:
            if have + step <= q:
                out = out[: len(b) - have - step + 1] * power[step] + known[step][have : have + len(b) - have - step + 1]
                have += step
    return out


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in them) of texts in UTF-8."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = data[lo:hi]
    before = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), before[offsets - lo]


def banded_distance(item: np.ndarray, text: np.ndarray, first: int, last: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start diagonal, end) of the best alignment of the whole item with a part of text that stays on diagonals first..last; None over budget."""
    diagonals = np.arange(first, last + 1)
    width = len(diagonals)
    t = np.full(last + len(item) + 1 - min(first, 0), -1, np.int64)
    shift = -min(first, 0)
    src = text[: max(0, len(t) - shift)]
    t[shift : shift + len(src)] = src
    inside = lambda i: (diagonals + i >= 0) & (diagonals + i <= len(text))  # noqa: E731  columns after i characters of the item
    far = 1 << 20
    d = np.where(inside(0), 0, far)
    start = diagonals.copy()
    ramp = np.arange(width)
    for i, c in enumerate(item.tolist()):
        here = t[diagonals + i + shift]
        swap = d + (here != c)
        swap[here < 0] = far
        drop = np.append(d[1:] + 1, far)  # an item character without partner
        take = drop < swap
        cur = np.where(take, drop, swap)
        begun = np.where(take, np.append(start[1:], 0), start)
        low = cur - ramp
        best = np.minimum.accumulate(low)
        at = np.maximum.accumulate(np.where(low == best, ramp, 0))
        d, start = np.where(inside(i + 1), best + ramp, far), begun[at]
        if d.min() > budget:
            return None
    k = int(d.argmin())
    return int(d[k]), int(start[k]), int(diagonals[k] + len(item))


def place_of(part: np.ndarray, text: np.ndarray) -> int:
    """The first place of part in text; -1 if it isn't there."""
    raw, sought, at = text.tobytes(), part.tobytes(), -1
    while True:
        at = raw.find(sought, at + 1)
        if at < 0 or at % 4 == 0:
            return at // 4 if at >= 0 else -1


class Items:
    """Index of the q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int, edit_percent: int) -> None:
        self.q, self.texts = q, [np.frombuffer(t.encode("utf-32-le"), np.uint32) for _, t in items]
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        m = np.array([len(t) for t in self.texts], dtype=np.int64)
        # The budget, or as much of it as the lemma bears with these q-grams.
        self.budget = np.maximum(0, np.minimum(m * edit_percent // 100, m // q - 1))
        self.bound = m + 1 - q * (self.budget + 1)
        self.width = self.budget + 1
        h = [gram_hashes(t, q) for t in self.texts]
        all_, owner, place = np.concatenate([*h, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate([np.arange(len(x)) for x in h] or [np.zeros(0, np.int64)])
        order = np.argsort(all_, kind="stable")
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.grams, self.first = np.unique(all_[order], return_index=True)
        self.after = np.append(self.first[1:], len(all_))
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self.slot(self.grams)] = True
        self.longest = int(m.max(initial=0))

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _BITS)

    def search(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, length) of each pair of a text and an item that it holds."""
        h = gram_hashes(data, self.q)
        at = np.flatnonzero(self.seen[self.slot(h)])
        k = np.searchsorted(self.grams, h[at])
        k[k == len(self.grams)] = 0
        good = self.grams[k] == h[at]
        at, k = at[good], k[good]
        text = np.searchsorted(starts, at, side="right") - 1
        good = at + self.q <= ends[text]  # not across two texts
        at, k, text = at[good], k[good], text[good]
        if not len(at):
            return []
        # Pairs of equal q-grams are counted a slice at a time, so that a text and an item of one repeated letter need no room for all of theirs.
        n = self.after[k] - self.first[k]
        upto = np.cumsum(n)
        edges = np.unique(np.r_[0, np.searchsorted(upto, np.arange(HITS, int(upto[-1]) + HITS, HITS), side="left") + 1])
        span = int((len(data) + 2 * self.longest) // int(self.width.min())) + 3
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo, hi in zip(edges[:-1].tolist(), np.minimum(edges[1:], len(n)).tolist(), strict=True):
            if lo == hi:
                continue
            m, total = n[lo:hi], int(n[lo:hi].sum())
            post = np.arange(total) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[k[lo:hi]], m)
            item, of = self.owner[post], np.repeat(text[lo:hi], m)
            band = (np.repeat(at[lo:hi], m) - starts[of] - self.place[post] + self.longest) // self.width[item]
            pair = of * len(self.texts) + item
            some, times = np.unique(np.concatenate([pair * span + band + 1, pair * span + band]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, times]), minlength=len(keys)).astype(np.int64)
        pairs, bands = keys // span, keys % span - 1
        item = pairs % len(self.texts)
        keep = counts >= self.bound[item]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for p, band, i in zip(pairs[keep].tolist(), bands[keep].tolist(), item[keep].tolist(), strict=True):
            t, w, budget = p // len(self.texts), int(self.width[i]), int(self.budget[i])
            if best.get((t, i), (1,))[0] == 0:
                continue
            lo = band * w - self.longest  # diagonals lo .. lo + 2w - 1
            a, b = max(0, int(starts[t]) + lo - budget), min(int(ends[t]), int(starts[t]) + lo + 2 * w + len(self.texts[i]) + budget)
            a = max(a, int(starts[t]))
            region = data[a:b]
            exact = place_of(self.texts[i], region)
            if exact >= 0:
                found = (0, exact, exact + len(self.texts[i]))
            else:
                found = banded_distance(self.texts[i], region, lo + int(starts[t]) - a - budget, lo + int(starts[t]) - a + 2 * w - 1 + budget, budget)
            if found and found[0] <= budget:
                made = (found[0], a - int(starts[t]) + found[1], found[2] - found[1])
                best[t, i] = min(best.get((t, i), made), made)
        return [(t, i, *x) for (t, i), x in best.items()]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, least_chars: int, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most block_bytes characters (or one item): what is sent to the executors at once is bounded."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).where(f"i IS NOT NULL AND length(t) >= {least_chars}")
    for i, t in rows.toLocalIterator():
        if block and size + len(t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, *, q: int = 10, edit_percent: int = 8, least_chars: int = 25, block_bytes: int = 4 << 20, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and benchmark item that it holds within edit_percent edits in 100 characters, as SCHEMA.

    edits: of the best alignment that was verified; budget: those allowed; start, length: of the passage, in characters of the
    normalised text. An item so short that the lemma bears fewer edits is matched within those; items under least_chars normalised
    characters, items without item_id, and null or blank ones, match nothing. A null or empty text holds nothing; a very long one is read whole. Rows that repeat a
    doc_id are judged each; rows that repeat an item_id are items each. Empty tables give no rows. Only doc_id and text of docs are read, so no column can clash.

    The benchmark is the stated query set: it goes to the executors in blocks of at most block_bytes, each block against all documents. With several
    blocks, texts are normalised once and kept in the shared folder, and each block's result is written before the next block is sent.
    """
    texts = id_and_text(docs).select("doc_id", text_key(F.col("text")).alias("text_key"), normalised(F.col("text")).alias("text"))
    spark, out = docs.sparkSession, None
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    blocks = item_blocks(benchmark, item_id, item_text, max(q, least_chars), block_bytes)
    block, following = next(blocks, None), next(blocks, None)
    if following:
        texts = stored(texts, "decontamination-texts")
    several = following is not None
    while block:
        shared = spark.sparkContext.broadcast((block, q, edit_percent))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for batch in batches:
                data, offsets = text_bytes(batch.column("text"))
                rows = []
                for i, j in stretches(offsets, BLOCK):
                    held, o = characters(data, offsets[i : j + 1])
                    for t, item, *x in items.search(held, o[:-1], o[1:]):
                        rows.append((batch.column("doc_id")[i + t].as_py(), int(items.ids[item]), x[0], int(items.budget[item]), *x[1:], batch.column("text_key")[i + t].as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        found = texts.mapInArrow(freed(run), SCHEMA)
        if several:
            found = stored(found, "decontamination-found")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
        block, following = following, next(blocks, None)
    return out if out is not None else spark.createDataFrame([], SCHEMA)
