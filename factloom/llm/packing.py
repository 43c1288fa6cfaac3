"""Packing of documents into sequences of at most `capacity` tokens.

Documents are dealt over tasks by a hash, and in the order of that hash each task's are cut into groups of bounded text, so groups are random and of
about one size at any input size; each group is packed by itself. In a group, a document longer than a sequence gives full sequences and a remainder; remainders are
placed by first-fit decreasing, with a tournament tree over the bins' free room that finds the first bin with enough of it in
logarithmic time. Then documents of the emptiest bins are cut to fill the rest, so that a group has at most one sequence that isn't full;
that one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import freed, id_and_text, shuffle_partitions
from factloom.llm.shingles import text_bytes
from factloom.llm.tokens import encoder


class BinTree:
    """Tournament tree over bins: each inner node holds the larger free room of its two children."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size; its room shrinks by size."""
        room, at = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            at += room[at] < size
        bin_ = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return bin_


def first_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """Bins of the (size, key) items, none larger than capacity; ties in order of key."""
    items = sorted(sizes, key=lambda x: (-x[0], x[1]))
    tree, bins = BinTree(len(items), capacity), []
    for item in items:
        k = tree.place(item[0])
        if k == len(bins):
            bins.append([])
        bins[k].append(item)
    return bins


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces. Every token of every document is in one piece.

    All sequences but those of one group's rest are full; the rest are of lengths that are powers of two.
    """
    sequences, remainders = [], []
    for i, n in enumerate(lengths):
        full = n - n % capacity
        sequences += [[(i, s, capacity)] for s in range(0, full, capacity)]
        if n > full:
            remainders.append((n - full, i))
    start = {i: lengths[i] - n for n, i in remainders}
    bins = [[(i, start[i], n) for n, i in b] for b in first_fit_decreasing(remainders, capacity)]
    used = lambda b: sum(x[2] for x in b)
    sequences += [b for b in bins if used(b) == capacity]
    open_ = sorted((b for b in bins if used(b) < capacity), key=used)
    giving = []  # pieces of the emptiest bins, cut as the fuller ones need
    lo, hi = 0, len(open_) - 1
    while lo <= hi:
        target = open_[hi]
        room = capacity - used(target)
        while room:
            if not giving:
                if lo == hi:
                    break
                giving = open_[lo]
                lo += 1
            i, s, n = giving.pop()
            take = min(n, room)
            target.append((i, s, take))
            room -= take
            if take < n:
                giving.append((i, s + take, n - take))
        hi -= 1
        if room == 0:
            sequences.append(target)
        else:
            giving = target
            break
    rest = used(giving)
    while giving:
        size = 1 << (rest.bit_length() - 1)
        piece, room = [], size
        while room:
            i, s, n = giving.pop(0)
            take = min(n, room)
            piece.append((i, s, take))
            room -= take
            if take < n:
                giving.insert(0, (i, s + take, n - take))
        sequences.append(piece)
        rest -= size
    return sequences


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def packed(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, capacity: int = 2048, group_docs: int = 512, group_bytes: int = 4 << 20, seed: int = 7) -> DataFrame:
    """One row a piece, as SCHEMA; offset counts from 0 in the sequence, without gaps.

    A null text counts as empty: one token, the end id. Rows with the same or no doc_id, and equal rows, are separate
    documents; the deal goes by row, so that none of these is a hot key. A group ends at group_docs documents or group_bytes of text; a longer
    text is a group of its own, and takes its task memory in proportion to it. An empty table gives no rows.
    sequence_id is the task's number times 2^32 plus the sequence's in the task.
    """

    def group(doc_ids: list[int | None], texts: pa.Array, base: int) -> tuple[pa.RecordBatch, int]:
        ids, n = encoder(tokenizer_path, end_id).encode(texts)
        first = np.cumsum(n) - n
        raw, out = memoryview(ids.astype("<u4", copy=False)).cast("B"), []
        sequences = pack(n.tolist(), capacity)
        for q, sequence in enumerate(sequences):
            at, total = 0, sum(x[2] for x in sequence)
            for i, s, m in sequence:
                a = 4 * (int(first[i]) + s)
                out.append((doc_ids[i], s, m, zlib.crc32(raw[a : a + 4 * m]), int(n[i]), base + q, at, total))
                at += m
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names), len(sequences)

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, held_ids, held_texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            lengths = np.diff(text_bytes(texts)[1]).tolist()
            i = 0
            for j, k in enumerate(lengths):
                if len(held_ids) + j - i and (size + k > group_bytes or len(held_ids) + j - i >= group_docs):
                    out, n = group([*held_ids, *doc_ids[i:j]], pa.concat_arrays([*held_texts, texts.slice(i, j - i)]), base)
                    yield out
                    base, held_ids, held_texts, size, i = base + n, [], [], 0, j
                size += k
            held_ids += doc_ids[i:]
            held_texts.append(texts.slice(i))
        if held_ids:
            yield group(held_ids, pa.concat_arrays(held_texts), base)[0]

    # Equal rows from different tasks are dealt apart too; in a task, sorting makes a second attempt's groups those of the first.
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = id_and_text(docs).withColumn("deal", key).withColumn("from", F.spark_partition_id())
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "deal", "from").sortWithinPartitions("deal", "doc_id", "text")
    return rows.select("doc_id", "text").mapInArrow(freed(run), SCHEMA)
