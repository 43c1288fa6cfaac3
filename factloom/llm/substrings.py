"""Removal of long repeated strings, by suffix arrays of the places that can hold repeats.

A string of `length` bytes has an anchor (see anchors.py), so equal strings meet under the hash at their anchor. An anchor and the strings that
have it are a segment of a text. Segments under a hash of their own hold no repeat. Segments with the same 128-bit keyed digest are one class; it goes on
as one segment, or as two where it has copies. The segments under a shared hash are cut into blocks on a grid that starts at the anchor, and a
suffix array of the blocks (suffixes.py) gives which strings agree in their whole blocks; with the bytes before and after those,
compared as they are, that says which strings occur again. What a class's segment has of these holds for all its members. Only of groups too large for
one suffix array are the strings, one by one at last, counted by digest. Of n strings, some pair of different ones has the same 128-bit digest with a probability of n^2 / 2^129.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.anchors import GRAM, LONGEST, anchors
from factloom.llm.common import freed, id_and_text, shuffle_partitions, stored
from factloom.llm.shingles import mix, text_bytes
from factloom.llm.suffixes import common_prefixes, suffix_array

BLOCK = 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_WEIGHTS = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF) for k in range(2 * BLOCK // 8 + 1)]
#: Bytes of texts in which anchors are sought together.
TOGETHER = 2 << 20
#: Distinct segments under a hash that are put in one suffix array; where there are more, they are split by what their strings have in common.
MOST = 1500
#: Segments that share a suffix array, whole groups of them unless a group is larger.
BATCH = 3000


def repeated_windows(segments: list[bytes], anchor: list[int], length: int) -> list[np.ndarray]:
    """For each segment, whether the string of `length` bytes that starts at each of its places occurs again in one of the segments.

    anchor: the place in each segment where its grid starts.
    """
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    skip = np.array(anchor, dtype=np.int64) % BLOCK  # bytes before a segment's first block
    blocks = (sizes - skip) // BLOCK
    data = np.frombuffer(b"".join(segments) + bytes(BLOCK), np.uint8)
    begin = np.cumsum(sizes) - sizes
    of_block = np.repeat(np.arange(len(segments)), blocks)
    nth = np.arange(len(of_block)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    at = (begin + skip)[of_block] + nth * BLOCK
    rank = _ranks([words[at + 8 * j] for j in range(BLOCK // 8)]) + len(segments)
    # Each segment ends in a symbol of its own, smaller than blocks.
    starts = np.cumsum(blocks + 1) - (blocks + 1)
    symbols = np.empty(len(rank) + len(segments), dtype=np.int64)
    symbols[starts + blocks] = np.arange(len(segments))
    symbols[starts[of_block] + nth] = rank
    text = symbols.tolist()
    array = suffix_array(text)
    shared = np.array(common_prefixes(text, array))
    place = np.array(array)
    # Strings that have r bytes before their first whole block have depths[r] whole blocks.
    depths = (length - np.arange(BLOCK)) // BLOCK
    class_at = {}
    for depth in np.unique(depths).tolist():
        of = np.empty(len(text), dtype=np.int64)
        of[place] = np.cumsum(shared < depth)
        class_at[depth] = of
    n = sizes - length + 1
    segment = np.repeat(np.arange(len(segments)), n)
    x = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    r = (skip[segment] - x) % BLOCK
    depth = depths[r]
    first = starts[segment] + (x + r - skip[segment]) // BLOCK
    agreed = np.zeros(len(x), dtype=np.int64)
    for d, of in class_at.items():
        mine = depth == d
        agreed[mine] = of[first[mine]]
    # The bytes before the first whole block, and those after the last, as they are.
    keys = [(agreed * 64 + r).astype(np.uint64)]
    for start, count in ((begin[segment] + x, r), (begin[segment] + x + r + depth * BLOCK, length - r - depth * BLOCK)):
        for j in range(BLOCK // 8):
            keys.append(words[np.minimum(start + 8 * j, len(words) - 1)] & _MASK[np.clip(count - 8 * j, 0, 8)])
    _, same, order = _sorted(keys)
    again = np.zeros(len(x), dtype=bool)
    again[order] = np.r_[False, same] | np.r_[same, False]
    return np.split(again, np.cumsum(n)[:-1])


def _sorted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a hash of each row, whether each row in order equals the one before, the order that puts equal rows side by side)."""
    h = np.zeros(len(keys[0]), dtype=np.uint64)
    for k, weight in zip(keys, _WEIGHTS, strict=False):
        h = mix(h ^ (k * weight))
    order = np.argsort(h, kind="stable")
    same, close = np.ones(max(0, len(h) - 1), dtype=bool), h[order][1:] == h[order][:-1]
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    if (close & ~same).any():  # different rows with one hash
        order = np.lexsort(keys)
        same = np.ones(len(h) - 1, dtype=bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
    return h, same, order


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """A number for each row, from 0, the same for equal rows."""
    _, same, order = _sorted(keys)
    out = np.zeros(len(order), dtype=np.int64)
    if len(order):
        out[order] = np.append(0, np.cumsum(~same))
    return out


def alike(rows: list[tuple], length: int) -> list[tuple]:
    """Of the segments (class, anchor, key, shift, text, copies) under some keys, those that can have a string in common with another of the same key or their own copies.

    Two equal strings have their anchor and, as they are longer than it, at least half of the rest on one of its sides in common.
    """
    side = (length - GRAM) // 2
    counts: Counter = Counter()
    sides = []
    for r in rows:
        a, text = r[1], r[4]
        mine = [(r[2], 0, text[a - side : a])] * (a >= side) + [(r[2], 1, text[a + GRAM : a + GRAM + side])] * (a + GRAM + side <= len(text))
        sides.append(mine)
        for x in mine:
            counts[x] += r[5]
    return [r for r, mine in zip(rows, sides, strict=True) if any(counts[x] > 1 for x in mine)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _anchor_rows(length: int):
    """Rows (doc, sum, text): their segments; class: a digest of the segment, its anchor's place in it and the hash there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "sum", "hash", "first", "last", "grid", "class"]
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc, sums = batch.column("doc"), batch.column("sum")
            i, n = 0, batch.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, side="right")) - 1)
                start, stop = int(offsets[i]), int(offsets[j])
                alone = j == i + 1  # and perhaps so long that it is read in parts, each with the strings that start in it
                for lo in range(start, stop, LONGEST) if alone else (start,):
                    hi = min(stop, lo + LONGEST + length - 1) if alone else stop
                    o = np.array([0, hi - lo]) if alone else offsets[i : j + 1] - start
                    part = data[lo:hi]
                    text, place, first, last, h = anchors(part, o[:-1], o[1:], length)
                    raw, before = part.tobytes(), o[:-1][text] - (lo - start)
                    classes = [hashlib.blake2b(raw[a : b + length], digest_size=16, salt=b"%d" % (p - a), key=x).digest() for a, b, p, x in zip(first.tolist(), last.tolist(), place.tolist(), (v.tobytes() for v in h), strict=True)]
                    where = pa.array(text + i)
                    yield pa.RecordBatch.from_arrays([doc.take(where), sums.take(where), pa.array(h.view(np.int64)), pa.array((first - before).astype(np.int64)), pa.array((last - before).astype(np.int64)), pa.array((place - first).astype(np.int32)), pa.array(classes, pa.binary())], names)
                i = j

    return run


def _segments(length: int):
    """Rows (wanted, text): the segments of the text that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                cut = [data[offsets[i] + w["first"] : offsets[i] + w["last"] + length].tobytes() for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([w["class"] for w in wanted], pa.binary()), pa.array([w["grid"] for w in wanted], pa.int32()), pa.array([w["hash"].to_bytes(8, "little", signed=True) for w in wanted], pa.binary()), pa.array([0] * len(wanted), pa.int32()), pa.array(cut, pa.binary()), pa.array([w["copies"] for w in wanted], pa.int32())], SEGMENT_NAMES)

    return run


def _split(length: int, width: int):
    """Cuts segments into the strings that start at `width` neighbouring distances before the anchor, under a key of what all of these have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for class_, grid, key, shift, s, copies in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                x, end = 0, len(s) - length + 1
                while x < end:
                    near = (grid - x) // width * width  # the least of these distances
                    stop = min(end, grid - near + 1)
                    core = s[grid - near : grid - (near + width - 1) + length]
                    name = hashlib.blake2b(core, digest_size=16, salt=b"%d" % near, key=key).digest()
                    out.append((class_, grid - x, name, shift + x, s[x : stop - 1 + length], copies))
                    x = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32()), strict=True)], SEGMENT_NAMES)

    return run


def _solved(length: int):
    """Segments, sorted by key: the spans (class, from, to) of strings that occur again under the same key."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found, rows = [], alike(rows, length)
        if not rows:
            return pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["class", "from", "to"])
        twice = rows + [r for r in rows if r[5] > 1]
        for r, flags in zip(rows, repeated_windows([r[4] for r in twice], [r[1] for r in twice], length), strict=False):
            found += [(r[0], r[3] + a, r[3] + b + length) for a, b in runs(flags)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], ["class", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if len(held) >= BATCH and row[2] != held[-1][2]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


SEGMENT_NAMES = ["class", "grid", "key", "shift", "segment", "copies"]
SEGMENT_SCHEMA = "class binary, grid int, key binary, shift int, segment binary, copies int"


def _spans(segments: DataFrame, length: int, most: int) -> DataFrame:
    """class, from, to: what occurs again, in each class's segment.

    Groups with over `most` segments are split by what their strings have in common, at last to single strings: then strings of
    a group are equal, and being two says that they occur again. So no task has a group without bound, and none is left out.
    """
    out, parts = None, shuffle_partitions(segments.sparkSession)
    for width in (32, 1, None):
        large = stored(segments.groupBy("key").agg(F.sum("copies").alias("n")).where(F.col("n") > most).select("key"), "substring-large")
        small = segments.join(large, "key", "left_anti")
        done = small.select(SEGMENT_NAMES).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(freed(_solved(length)), "class binary, from long, to long")
        out = done if out is None else out.unionByName(done)
        if width is None or large.isEmpty():
            break
        segments = stored(segments.join(large.hint("merge"), "key").select(SEGMENT_NAMES).mapInArrow(freed(_split(length, width)), SEGMENT_SCHEMA), "substring-split")
        if width == 1:
            again = stored(segments.groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1").select("key"), "substring-again")
            out = out.unionByName(segments.join(again.hint("merge"), "key").select("class", F.col("shift").cast("long").alias("from"), (F.col("shift") + F.lit(length)).cast("long").alias("to")))
            break
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans): what is left of each text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        rows = []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            kept, at, removed, n = [], 0, 0, 0
            until = -1
            for a, b in sorted((x["from"], x["to"]) for x in spans or ()):
                if a > until:  # a run of its own
                    kept.append(text[at:a])
                    n, until, removed = n + 1, b, removed + b - a
                elif b > until:
                    removed, until = removed + b - until, b
                at = until
            kept.append(text[at:])
            rows.append((len(text), removed, n, b"".join(kept)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, *, length: int = 400, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row: its text without each byte that a repeated string of `length` bytes covers.

    Strings are of UTF-8 bytes, within a text, and repeated if they start at another place of the same or any other text;
    they are judged on the input. A null text counts as empty; texts under `length` bytes are kept whole. Rows that repeat a doc_id are texts of
    their own, so all that is long enough in two equal rows goes. A very long text is read in parts that overlap. Only doc_id and text are read, so
    no column can clash. An empty table gives no rows.
    """
    if length < 64:
        raise ValueError("length is under 64 bytes")
    texts = id_and_text(docs).select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("sum"), "text")
    rows = stored(texts.where(F.octet_length("text") >= length).select("doc", "sum", "text").mapInArrow(freed(_anchor_rows(length)), "doc long, sum long, hash long, first long, last long, grid int, class binary"), "substring-anchors")
    # Under a hash: how many segments, and how many of them differ; counted from classes, so a hot hash is a row for each class and task.
    classes = rows.groupBy("hash", "class").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "sum", "first", "last", "grid")).alias("one"))
    classes = stored(classes, "substring-classes")
    shared = classes.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    shared = stored(classes.join(stored(shared, "substring-shared").hint("merge"), "hash"), "substring-several")
    one = F.struct("class", "hash", "one.first", "one.last", "one.grid", F.least("n", F.lit(2)).cast("int").alias("copies"))
    wanted = stored(shared.select("one.doc", "one.sum", one.alias("w")).groupBy("doc", "sum").agg(F.collect_list("w").alias("wanted")), "substring-wanted")
    segments = stored(texts.select("doc", "sum", "text").join(wanted.hint("merge"), ["doc", "sum"]).dropDuplicates(["doc", "sum"]).select("text", "wanted").mapInArrow(freed(_segments(length)), SEGMENT_SCHEMA), "substring-segments")
    found = _spans(segments, length, most).groupBy("class").agg(F.collect_list(F.struct("from", "to")).alias("found"))
    found = stored(found, "substring-spans")
    # What is found in a class's segment holds for all members of the class.
    each = rows.join(found.hint("merge"), "class").select("doc", "sum", "first", F.explode("found").alias("f"))
    spans = each.groupBy("doc", "sum").agg(F.collect_set(F.struct((F.col("first") + F.col("f.from")).alias("from"), (F.col("first") + F.col("f.to")).alias("to"))).alias("spans"))
    spans = stored(spans, "substring-removed")
    return texts.join(spans.hint("merge"), ["doc", "sum"], "left").select("doc_id", "text", "spans").mapInArrow(freed(_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM d WHERE n >= 400)),
s AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
j AS (SELECT k.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, removed IS NOT NULL AS repeated FROM d LEFT JOIN j USING (doc_id)
"""
