"""Token ids of whole texts, and their files.

Encoding is the `tokenizers` library's. Where the vocabulary's file says that it is byte-level BPE of the usual splitting pattern, text is cut at
places that no token of that pattern crosses: before a single space, and on both sides of a single line end, between other characters than white space; and between
letters, digits and other signs (but for what follows an apostrophe). So each piece is encoded by the library once and looked up after
that, and the ids are those of encoding the whole text at once. With any other kind of file texts are encoded whole.

File format of `write_token_files`: Parquet, ascending doc_id, one row a document, `ids` a list column with
dictionary (or delta) encoding, small row groups and pages, with the column and offset indexes that Parquet writers leave in the
footer. A filter on doc_id reads only the pages that can hold it; lengths and offsets are read without ids.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Batches, freed, id_and_text, shared_dir, shuffle_partitions
from factloom.llm.shingles import mix, stretches, text_bytes

#: Bytes of texts that are encoded at once (a longer text by itself), and pieces that are looked up at once.
TOGETHER, PIECES = 1 << 19, 1 << 15
#: Bytes of texts (or one text) that are encoded and handed over at once: bounds what a Python worker holds.
SLICE = 4 << 20
#: Longer pieces aren't kept in the table.
SHORT = 24
_FRONT, _BACK = 8, 32
#: White space beyond ASCII, in UTF-8.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE2, _WIDE3 = (np.array([int.from_bytes(c, "big") for c in _WIDE if len(c) == n], dtype=np.int64) for n in (2, 3))
#: Kinds of bytes. WIDE: of characters beyond ASCII, but for the letters from U+00C0 to U+00FF, which are LETTER.
_SPACE, _LINE, _BLANK, _LETTER, _DIGIT, _SIGN, _QUOTE, _FAR = range(8)
_KIND = np.full(256, _SIGN, dtype=np.uint8)
_KIND[[*range(0x09, 0x0E), *range(0x1C, 0x20)]] = _BLANK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A], _KIND[0x80:], _KIND[0x20], _KIND[0x0A], _KIND[0x27] = _DIGIT, _FAR, _SPACE, _LINE, _QUOTE
_APART = np.zeros(64, dtype=bool)
_APART[[8 * a + b for a, b in ((_LETTER, _DIGIT), (_LETTER, _SIGN), (_LETTER, _QUOTE), (_DIGIT, _LETTER), (_DIGIT, _SIGN), (_DIGIT, _QUOTE), (_SIGN, _LETTER), (_SIGN, _DIGIT))]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_WEIGHT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def cuttable(rules: dict) -> bool:
    """Whether the rules of a vocabulary file are those that cuts() relies on."""
    split, model = rules.get("pre_tokenizer") or {}, rules.get("model") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    own = not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in rules.get("added_tokens") or ())
    return bool(plain and own and not rules.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout"))


def cuts(buf: np.ndarray, edge: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """Where pieces start in the texts between neighbouring edges of buf, which has _FRONT bytes before them and _BACK after. Nothing in `whole` is cut."""
    n = len(buf)
    kind = _KIND[buf]
    high = np.flatnonzero(buf == 0xC3)
    high = high[(buf[high + 1] != 0x97) & (buf[high + 1] != 0xB7)]
    kind[high] = kind[high + 1] = _LETTER
    start = np.zeros(n + 1, dtype=bool)
    start[1:n] = _APART[kind[:-1] * np.uint8(8) + kind[1:]]
    at = np.flatnonzero(kind <= _LINE)
    before, after = kind[at - 1], kind[at + 1]
    is_edge = np.zeros(n + 1, dtype=bool)
    is_edge[edge] = True
    good = (before > _BLANK) & (after > _BLANK) & ~is_edge[at] & ~is_edge[at + 1]
    if (wide := np.flatnonzero(good & ((before == _FAR) | (after == _FAR)))).size:
        p = at[wide]
        b = [buf[p + k].astype(np.int64) for k in (-3, -2, -1, 1, 2, 3)]
        bad = np.isin(b[1] << 8 | b[2], _WIDE2) | np.isin(b[3] << 8 | b[4], _WIDE2) | np.isin(b[0] << 16 | b[1] << 8 | b[2], _WIDE3) | np.isin(b[3] << 16 | b[4] << 8 | b[5], _WIDE3)
        good[wide[bad]] = False
    at = at[good]
    start[at] = True
    start[at[kind[at] == _LINE] + 1] = True
    raw = buf.tobytes() if whole else b""
    for x in whole:
        k = raw.find(x)
        while k >= 0:
            start[k + 1 : k + len(x)] = False
            k = raw.find(x, k + 1)
    start[edge[:-1][edge[:-1] < edge[1:]]] = True
    start[edge[-1] :] = False
    return np.flatnonzero(start)


class CachedEncoder:
    """Ids of texts, `end_id` (if any) behind each text's.

    A table of fixed size keeps the ids of short pieces, under their bytes themselves; each piece has two places in it, of which
    the second is overwritten. What is kept changes no result.
    """

    def __init__(self, path: str, end_id: int | None = None, *, slots: int = 1 << 20, most_ids: int = 1 << 23) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.end, self.cut = end_id, cuttable(rules)
        self.whole_texts = [x["content"] for x in rules.get("added_tokens") or ()]
        self.whole = [x.encode() for x in self.whole_texts]
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.slots, self.most_ids = np.uint64(slots - 1), most_ids
        #: Rows: up to 24 bytes of a piece, as three integers; its length, how many ids it has, and where they are in `pool`.
        self.table = np.zeros((slots, 4), dtype=np.uint64)
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _add(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(start in pool, number of ids) of each piece, by the library; many at a time, in lines of their own, if they have no white space but at the start."""
        texts, n, ids = [x.decode() for x in pieces], np.zeros(len(pieces), dtype=np.int64), []
        able = self.cut and len(self.line) == 1
        lines = np.array([able and len(x) <= SHORT and len(x.split()) == 1 and not x[-1].isspace() and (x[0] == " " or not x[0].isspace()) and "\u180e" not in x and not any(w in x for w in self.whole_texts) for x in texts], dtype=bool)
        order = np.r_[np.flatnonzero(lines), np.flatnonzero(~lines)]
        k, alone = 0, int(lines.sum())
        while k < alone:
            part = order[k : k + 4096][: alone - k]
            found = np.array(self.library.encode_batch_fast(["\n".join([texts[i] for i in part.tolist()])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            at = np.flatnonzero(found == self.line[0])
            if len(at) != len(part) - 1:
                alone = k  # a vocabulary that joins line ends with others: one by one
                break
            n[part] = np.diff(np.r_[-1, at, len(found)]) - 1
            ids.append(np.delete(found, at))
            k += len(part)
        made = [x.ids for x in self.library.encode_batch_fast([texts[i] for i in order[alone:].tolist()], add_special_tokens=False)]
        n[order[alone:]] = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        ids = np.concatenate([*ids, np.fromiter((i for x in made for i in x), dtype=np.uint32)])
        start = np.empty_like(n)
        start[order] = self.used + np.cumsum(n[order]) - n[order]
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return start, n

    def _short(self, buf: np.ndarray, s: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where, count = np.zeros(len(s), dtype=np.int64), np.zeros(len(s), dtype=np.int64)
        eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        size = k.astype(np.uint64)
        key = [eight[s] & _MASK[np.minimum(k, 8)], eight[s + 8] & _MASK[np.clip(k - 8, 0, 8)], eight[s + 16] & _MASK[np.maximum(k - 16, 0)]]
        h = mix(key[0] * _WEIGHT[0] + key[1] * _WEIGHT[1] + key[2] * _WEIGHT[2] + size * _WEIGHT[3])
        first = (h & self.slots).astype(np.int64)
        row = self.table[first]
        hit = (row[:, 0] == key[0]) & (row[:, 1] == key[1]) & (row[:, 2] == key[2]) & (row[:, 3] & np.uint64(63) == size)
        meta = np.where(hit, row[:, 3], np.uint64(0)).astype(np.int64)
        open_ = np.flatnonzero(~hit)
        if len(open_):
            second = (h >> np.uint64(32)) & self.slots
            row = self.table[second[open_]]
            hit = (row[:, 0] == key[0][open_]) & (row[:, 1] == key[1][open_]) & (row[:, 2] == key[2][open_]) & (row[:, 3] & np.uint64(63) == size[open_])
            meta[open_[hit]] = row[hit, 3].astype(np.int64)
            open_ = open_[~hit]
        where, count = meta >> 12, meta >> 6 & 63
        while len(open_):  # once, but for different pieces of one hash
            _, one, of = np.unique(h[open_], return_index=True, return_inverse=True)
            one = open_[one]
            start, m = self._add([buf[a : a + b].tobytes() for a, b in zip(s[one].tolist(), k[one].tolist(), strict=True)])
            row = np.stack([key[0][one], key[1][one], key[2][one], size[one] | (start << 12 | m << 6).astype(np.uint64)], axis=1)
            free = self.table[first[one], 3] == 0
            self.table[first[one[free]]] = row[free]
            self.table[second[one[~free]]] = row[~free]
            same = size[one[of]] == size[open_]
            for x in key:
                same &= x[one[of]] == x[open_]
            where[open_[same]], count[open_[same]] = start[of[same]], m[of[same]]
            open_ = open_[~same]
        return where, count

    def _look(self, buf: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in pool, number of ids) of the pieces of n bytes at starts of buf."""
        long = np.flatnonzero(n > SHORT)
        if not len(long):
            return self._short(buf, starts, n)
        where, count = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        short = np.flatnonzero(n <= SHORT)
        where[short], count[short] = self._short(buf, starts[short], n[short])
        raw = [buf[a : a + m].tobytes() for a, m in zip(starts[long].tolist(), n[long].tolist(), strict=True)]
        place = {x: k for k, x in enumerate(dict.fromkeys(raw))}
        start, m = self._add(list(place))
        of = np.array([place[x] for x in raw])
        where[long], count[long] = start[of], m[of]
        return where, count

    def _together(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts that are short together, or one."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        buf = np.zeros(_FRONT + hi - lo + _BACK, dtype=np.uint8)
        buf[_FRONT : _FRONT + hi - lo] = data[lo:hi]
        edge = offsets - lo + _FRONT
        starts = cuts(buf, edge, self.whole) if self.cut else edge[:-1][edge[:-1] < edge[1:]]
        n = np.diff(np.append(starts, edge[-1]))
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(starts), PIECES):
            where, count = self._look(buf, starts[i : i + PIECES], n[i : i + PIECES])
            total = np.cumsum(count)
            ids.append(self.pool[np.arange(total[-1]) + np.repeat(where - (total - count), count)])
            counts.append(count)
            if self.used > self.most_ids:
                self.forget()
        ids = np.concatenate(ids)
        at = np.append(0, np.cumsum(np.concatenate(counts)))[np.searchsorted(starts, edge)]
        if self.end is None:
            return ids, np.diff(at)
        return np.insert(ids, at[1:], self.end), np.diff(at) + 1

    def forget(self) -> None:
        self.table[:] = 0
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a column of texts without nulls."""
        data, offsets = text_bytes(column)
        out = [self._together(data, offsets[i : j + 1]) for i, j in stretches(offsets, TOGETHER)]
        return np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in out)]), np.concatenate([np.zeros(0, np.int64), *(x for _, x in out)])


_ENCODERS: dict[tuple[str, int | None], CachedEncoder] = {}


def encoder(path: str, end_id: int | None) -> CachedEncoder:
    """This worker's encoder; what it has learned serves its later tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = CachedEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def id_lists(ids: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Lists of n ids each."""
    offsets = np.zeros(len(n) + 1, dtype=np.int32)
    np.cumsum(n, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))


def crc_of_lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(length, unsigned crc32 of the ids as little-endian unsigned 32-bit integers) of each list."""
    offsets = lists.offsets.to_numpy()
    values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4")).cast("B")
    crc = np.fromiter((zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), dtype=np.int64, count=len(lists))
    return np.diff(offsets).astype(np.int64), crc


def local_path(path: str) -> str | None:
    """Where a path under file: is; None for other ones, and for those without scheme, which may be any file system's."""
    found = re.fullmatch("file:(?://)?(/.*)", path)
    return found[1] if found else None


FILE_SCHEMA = "shard int, doc_id long, shard_start long, n_ids long, ids array<int>"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, *, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_rows: int = 500) -> None:
    """Encodes every whole text and writes the files; a null text counts as empty, null doc_ids come first.

    Rows with the same doc_id stay separate rows, next to each other, and are dealt apart by their texts if there are many. A very long text is encoded by
    itself; texts go to a worker in batches, of which it holds one. Only doc_id and text are read, so no column can clash. An empty table gives a folder without
    rows, and a path that exists an error. encoding: "dictionary" or "delta" (delta binary packed), of the ids.

    Under file: the tasks write the files themselves. Hadoop's local file system would start a process for each file there, which counts as another one of the
    JVM's size until it runs its own program, and the JVM would hold the ids too. Elsewhere Spark's writer does the same job.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is {encoding!r}, neither 'dictionary' nor 'delta'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path, end_id)
        for batch in batches:
            for i, j in stretches(text_bytes(batch.column("text"))[1], SLICE):
                part = batch.slice(i, j - i)
                ids, n = enc.encode(part.column("text"))
                before = at + np.cumsum(n) - n
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), part.column("doc_id"), pa.array(before), pa.array(n), id_lists(ids, n)], ["shard", "doc_id", "shard_start", "n_ids", "ids"])

    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("sum", F.xxhash64("text")).repartitionByRange(shuffle_partitions(spark), "doc_id", "sum").sortWithinPartitions("doc_id", "sum").drop("sum")
    if root := local_path(path):
        _write_locally(rows, run, root, encoding, row_group_bytes, page_rows)
        return
    (
        rows.mapInArrow(freed(run), FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(path)
    )


def _write_locally(rows: DataFrame, run: Batches, root: str, encoding: str, row_group_bytes: int, page_rows: int) -> None:
    """run's batches, each task's in a file of its own; files are moved in place when all tasks have ended, only those of the attempts that counted."""
    open_folder = f"{root}/_temporary"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, out, group, size = TaskContext.get(), None, [], 0
        name = f"part-{c.partitionId():05d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}.parquet"
        plain = ["shard", "doc_id", "shard_start", "n_ids"]
        kinds = {"use_dictionary": [*plain, "ids.list.element"]} if encoding == "dictionary" else {"use_dictionary": plain, "column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED"}}
        for batch in run(batches):
            if out is None:
                os.makedirs(open_folder, exist_ok=True)
                out = pq.ParquetWriter(f"{open_folder}/{name}", batch.schema, compression="zstd", data_page_version="2.0", write_page_index=True, max_rows_per_page=page_rows, **kinds)
            ends = 4 * np.append(0, np.cumsum(batch.column("n_ids").to_numpy()))
            for i, j in stretches(ends, row_group_bytes):
                if group and size + ends[j] - ends[i] > row_group_bytes:
                    out.write_table(pa.Table.from_batches(group))
                    group, size = [], 0
                group.append(batch.slice(i, j - i))
                size += int(ends[j] - ends[i])
        if out is not None:
            out.write_table(pa.Table.from_batches(group))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    os.makedirs(root)
    try:
        # One row for each task that wrote.
        for r in rows.mapInArrow(freed(write), "file string").collect():
            os.replace(f"{open_folder}/{r.file}", f"{root}/{r.file}")
    except BaseException:
        shutil.rmtree(root, ignore_errors=True)
        raise
    shutil.rmtree(open_folder, ignore_errors=True)


def _before(files: DataFrame) -> list[tuple[int, int]]:
    """(shard, ids in the shards before it). One row for each task that wrote: small, whatever the number of documents."""
    before, at = [], 0
    for shard, n in sorted(files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        before.append((shard, at))
        at += n
    return before


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_ids, ids. Unused columns aren't read."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    starts = spark.createDataFrame(_before(files), "shard int, shard_before long")
    return files.join(F.broadcast(starts), "shard").select("doc_id", (F.col("shard_start") + F.col("shard_before")).alias("start"), "n_ids", "ids")


DIGEST_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _digests(doc_id: pa.Array, start: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
    n, crc = crc_of_lists(ids)
    return pa.RecordBatch.from_arrays([doc_id, start, pa.array(n), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_token_files gives, counted from the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digests(batch.column("doc_id"), batch.column("start"), batch.column("ids"))

    return files.select("doc_id", "start", "ids").mapInArrow(freed(run), DIGEST_SCHEMA)


def file_digests(spark, path: str, *, together: int = 1000) -> DataFrame:
    """token_digests of the files at path. Under file: the tasks read them themselves, a file each and `together` documents at a time, so the JVM doesn't hold ids; elsewhere Spark's reader does."""
    if not (root := local_path(path)):
        return token_digests(read_token_files(spark, path))
    names = sorted(x for x in os.listdir(root) if x.endswith(".parquet") and x[0] not in "._")
    before = dict(_before(spark.read.schema(FILE_SCHEMA).parquet(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                with pq.ParquetFile(f"{root}/{names[k]}") as file:
                    for rows in file.iter_batches(together, columns=["shard", "doc_id", "shard_start", "ids"]):
                        shards = np.fromiter((before[x] for x in rows.column("shard").to_pylist()), dtype=np.int64, count=rows.num_rows)
                        yield _digests(rows.column("doc_id"), pa.array(rows.column("shard_start").to_numpy() + shards), rows.column("ids"))

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(freed(run), DIGEST_SCHEMA)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the token files in the shared folder, and gives the digests of what is read back."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_path, end_id, path)
    return file_digests(docs.sparkSession, path)
