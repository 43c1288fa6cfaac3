"""What the operators of this subpackage share: reading tables, writing intermediate tables, Python workers' memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.stored import shared_dir, stored

__all__ = ["freed", "id_and_text", "shared_dir", "shuffle_partitions", "stored", "table", "text_key", "without_rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freed(run: Batches) -> Batches:
    """run, for mapInArrow; at a task's end its worker, which waits for other tasks, gives the memory back that it no longer holds."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id long and text string, null texts as empty ones; other columns can't clash with an operator's."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_key(text: Column) -> Column:
    """With doc_id, what a row is told by: a hash of its text as it is (null: empty). It matters only among rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, dropped: DataFrame, *, once: bool = False) -> DataFrame:
    """docs but for the rows (doc_id, text_key) that dropped lists; rows without doc_id are told by their text alone. once: of equal rows that stay, one does."""
    key = lambda doc_id, of_text: F.concat_ws("/", F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), of_text.cast("string"))
    name = "row_key"
    while name in docs.columns:
        name += "_"
    listed = dropped.select(key(F.col("doc_id"), F.col("text_key")).alias(name)).distinct()
    left = docs.withColumn(name, key(F.col("doc_id"), text_key(F.col("text")))).join(listed, name, "left_anti")
    return (left.dropDuplicates([name]) if once else left).select(docs.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


