"""Extraction as a stream of arriving documents: each micro-batch is enqueued and run, and its rows are appended as new versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.extraction import SCHEMA, TextModel, enqueue, run_pipeline
from factloom.sources.readers import newest


def extract_stream(spark: SparkSession, source: str, target: str, checkpoint: str, rewrites: list[Callable[[], TextModel]], extract: Callable[[], TextModel], *, files_per_batch: int = 16) -> StreamingQuery:
    """Starts a query over JSON files (id, original_text) that appear under source; a batch that is run again writes its own folder again.

    target/batch=N holds each batch's rows; the newest version of an id is its state. An id that arrives again goes on from its state of
    earlier batches: done stages aren't asked again, and attempts add up.
    """

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        try:
            earlier = session.read.schema(f"{SCHEMA}, batch long").parquet(target).where(F.col("batch") < number)
        except AnalysisException:  # nothing was written yet
            earlier = session.createDataFrame([], f"{SCHEMA}, batch long")
        known = newest(earlier.join(batch.select("id").distinct(), "id", "left_semi"), "id", "batch").drop("batch")
        rows = run_pipeline(enqueue(known, batch), rewrites, extract, F.unix_timestamp().cast("double"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema("id string, original_text string").option("maxFilesPerTrigger", files_per_batch).json(source)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
