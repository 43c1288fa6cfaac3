"""WARC files: written by Spark's tasks, and read back through a PySpark data source.

A file is a sequence of gzip members, one for each record, and each member's gzip header tells its length (an extra field, which other
readers pass over). Identical payloads are stored once: the other records revisit the first. The source plans one partition for some files each, takes
predicates on record type and header fields, parses headers first, and goes to the next member without reading or inflating a
payload that no column or predicate asks for.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from factloom.llm.common import freed, shared_dir, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = struct.Struct("<4sIBBH2sHQQ")
#: Bytes that are read at once.
CHUNK = 1 << 18
SCHEMA = "page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Columns that a predicate can be pushed down on, and the header that has each.
HEADERS = {"record_type": "WARC-Type", "uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "page_id": "WARC-Page-ID", "payload_bytes": "WARC-Payload-Length", "refers_to": "WARC-Refers-To-Page-ID"}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str | None) -> str:
    """A header's value has one line."""
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has the payload's digest and length, and no payload."""
    kept = refers_to is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kept else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if kept else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{clean(url)}')}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if not kept:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return member("\r\n".join(head).encode() + body + b"\r\n\r\n")


def member(raw: bytes) -> bytes:
    """A gzip member whose header has an extra field SL: the member's length, and that of what it holds."""
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = _HEAD.size + len(body) + 8
    head = _HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 20, b"SL", 16, size, len(raw))
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def member_length(start: bytes) -> int | None:
    """Of the member that starts so, if its header tells it."""
    if len(start) < _HEAD.size or start[:4] != b"\x1f\x8b\x08\x04":
        return None
    *_, name, n, size, _ = _HEAD.unpack_from(start)
    return size if name == b"SL" and n == 16 else None


def with_references(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), refers_to: the smallest page_id of the equal payloads, if another's.

    Payloads are equal if their SHA-256 and length are. Payloads under least_bytes, and pages without id, are never revisits.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digest = F.unhex(F.sha2("html", 256))
    rows = rows.withColumn("sum", F.when((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull(), digest))
    shared = rows.where("sum IS NOT NULL").groupBy("sum").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sum", "first_id")
    shared = stored(shared, "warc-shared")  # a plain table, so that Spark can split a hot payload's rows in the join
    return rows.join(shared, "sum", "left").select("page_id", "url", "html", F.when(F.col("first_id") != F.col("page_id"), F.col("first_id")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, *, roll_bytes: int = 64 << 20) -> DataFrame:
    """Writes with_references' rows as archives under path; returns (file, records, bytes), also stored as a manifest at path-manifest.

    Each task writes files of its own name and moves them in place when they are whole; only those that the
    manifest names count, so a task that is lost or runs twice leaves nothing that is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = TaskContext.get()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        done, out, n, size, part = [], None, 0, 0, 0
        stem = f"part-{c.partitionId():05d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}"

        def close() -> None:
            out.close()
            store.move(posixpath.join(root, f".{stem}-{part}.tmp"), posixpath.join(root, f"{stem}-{part}.warc.gz"))
            done.append((f"{stem}-{part}.warc.gz", n, size))

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, refers_to = (batch.column(j)[k] for j in range(4))
                if out is None:
                    out, n, size = store.open_output_stream(posixpath.join(root, f".{stem}-{part}.tmp")), 0, 0
                payload = html.as_buffer().to_pybytes()
                size += out.write(x := record(page_id.as_py(), url.as_py(), payload, refers_to.as_py())) or len(x)
                n += 1
                if size >= roll_bytes:
                    close()
                    out, part = None, part + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([x[0] for x in done], pa.string()), "records": pa.array([x[1] for x in done], pa.int64()), "bytes": pa.array([x[2] for x in done], pa.int64())})

    manifest = f"{path}-manifest"
    pages.select("page_id", "url", "html", "refers_to").mapInArrow(freed(run), "file string, records long, bytes long").write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


class Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(tuple(files))
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.columns = [f.name for f in schema.fields]
        self.path = options["path"]
        self.manifest = options.get("manifest", "")
        self.per_partition = int(options.get("filesperpartition", "4"))
        self.types: set[str] | None = None
        self.equal: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality with a value, or one of some values, of the columns in HEADERS; gives the others back."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.value is not None:
                values = {str(f.value)}
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {str(x) for x in f.value if x is not None}
            else:
                yield f
                continue
            name = f.attribute[0]
            self.equal[name] = self.equal[name] & values if name in self.equal else values

    def partitions(self) -> list[InputPartition]:
        if self.manifest:
            store, root = fs.FileSystem.from_uri(self.manifest)
            parts = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".parquet")]
            names = sorted(ds.dataset(parts, filesystem=store, format="parquet").to_table(["file"])["file"].to_pylist()) if parts else []
        else:
            store, root = fs.FileSystem.from_uri(self.path)
            names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".warc.gz"))
        return [Files(names[i : i + self.per_partition]) for i in range(0, len(names), self.per_partition)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for name in partition.files:
            with store.open_input_file(posixpath.join(root, name)) as stream:
                for head, payload in records(stream):
                    if any(self.value(head, k) not in v for k, v in self.equal.items()):
                        continue
                    rows.append((head, payload() if "payload" in self.columns else None))
                    size += len(rows[-1][1] or b"") + 500
                    if size > 8 << 20:
                        yield self.batch(rows)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def value(head: dict[str, str], column: str) -> str | None:
        v = head.get(HEADERS[column].lower())
        return v.removeprefix("sha1:") if v is not None and column == "payload_digest" else v

    def batch(self, rows: list) -> pa.RecordBatch:
        made = {}
        for c in self.columns:
            if c == "payload":
                made[c] = pa.array([x[1] for x in rows], pa.binary())
            elif c in ("page_id", "payload_bytes", "refers_to"):
                made[c] = pa.array([None if (v := self.value(x[0], c)) is None else int(v) for x in rows], pa.int64())
            else:
                made[c] = pa.array([self.value(x[0], c) for x in rows], pa.string())
        return pa.RecordBatch.from_pydict(made)


def records(stream):
    """(headers, function that gives the payload) of each record; the function is to be called before the next record.

    Inflates each member to the end of its headers. If the payload isn't asked for, the stream goes to the next member by the length in the
    gzip header; only in archives without that field is what follows inflated, as a member's end can't be found otherwise.
    """
    left = b""
    while True:
        if len(left) < _HEAD.size:
            left += stream.read(CHUNK)
        size, used = member_length(left), 0
        z, got, end = zlib.decompressobj(31), bytearray(), -1
        while end < 0 and not z.eof:
            left = left or stream.read(CHUNK)
            if not left:
                if got or used:
                    raise ValueError("the archive ends within a record")
                return
            before = len(left)
            got += z.decompress(left, 4096)
            left = z.unconsumed_tail if not z.eof else z.unused_data
            used += before - len(left)
            end = got.find(b"\r\n\r\n")
        if end < 0:
            raise ValueError("a record has no end of headers")
        head = {}
        for line in bytes(got[:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.strip()
        body, over = got[end + 4 :], False

        def rest(keep: bool):
            nonlocal left, over
            over = True
            if not keep and size is not None:
                on = size - used
                if on > len(left):
                    stream.seek(on - len(left), 1)
                left = left[on:]
                return
            while not z.eof:
                left = left or stream.read(CHUNK)
                if not left:
                    raise ValueError("the archive ends within a record")
                x = z.decompress(left, 1 << 20)
                left = z.unconsumed_tail if not z.eof else z.unused_data
                if keep:
                    body.extend(x)

        def payload() -> bytes | None:
            rest(True)
            if head.get("warc-type") == "revisit":
                return None
            whole = bytes(body[: int(head["content-length"])])
            content = whole[whole.index(b"\r\n\r\n") + 4 :]
            if "sha1:" + sha1_base32(content) != head.get("warc-payload-digest"):
                raise ValueError(f"the payload of {head.get('warc-record-id')} isn't what its digest says")
            return content

        yield head, payload
        if not over:
            rest(False)


class WarcSource(DataSource):
    """spark.read.format("warc"): path; manifest (a table with the names of the files that count, else all), filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, manifest: str | None = None, columns: str = SCHEMA) -> DataFrame:
    """The records; columns: those of SCHEMA that are wanted. Without payload among them no payload is read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").schema(columns)
    return (reader.option("manifest", manifest) if manifest else reader).load(path)


def archive_round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each page and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html counts as empty. Pages that repeat a page_id are records each; of equal payloads all records with the smallest page_id are responses. Pages
    without page_id are responses. Responses are decoded and held against their digests; a very long payload is held whole by its task. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_warc(with_references(pages, least_bytes=least_bytes), path)
    back = read_warc(spark, path, f"{path}-manifest")
    sizes_agree = F.when(F.col("record_type") == "response", F.length("payload") == F.col("payload_bytes")).otherwise(True)
    return back.where(F.assert_true(sizes_agree, "a payload has another length than its header says").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS t FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first, sha1(t) AS h FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
