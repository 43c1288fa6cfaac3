"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_facts(facts: DataFrame, vectors: DataFrame, path: str) -> None:
    """A graph: facts, and the dictionary of vectors."""
    facts.write.mode("overwrite").parquet(f"{path}/facts")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def append_vectors(vectors: DataFrame, path: str) -> None:
    """(ns, fingerprint, text, vec) to the cache, by namespace."""
    vectors.write.mode("append").partitionBy("ns").parquet(path)


def write_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").partitionBy("system").json(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """JSON lines for each stage and split."""
    samples.select("stage", "is_eval", "conversations").write.mode("overwrite").partitionBy("stage", "is_eval").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_prompts(spark, prompts, path: str) -> None:
    """A caller's prompts, a JSON object with a field each."""
    kept = {k: v for k, v in vars(prompts).items() if isinstance(v, str)}
    spark.createDataFrame([tuple(kept.values())], ", ".join(f"{k} string" for k in kept)).coalesce(1).write.mode("overwrite").json(path)


def dataset_meta(rows: DataFrame) -> DataFrame:
    """One row about a training set: rows(reason, is_eval) counted as valid, invalid, train and eval."""
    ok = F.col("reason") == "ok"
    return rows.agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"), F.count_if(ok & ~F.col("is_eval")).alias("n_train"), F.count_if(ok & F.col("is_eval")).alias("n_eval"))
