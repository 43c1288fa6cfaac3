"""The queries op1 to op10 and pipeline, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, exact, licences, near, packing, secrets, substrings, tokens, toxicity, warc
from factloom.llm.common import table

#: The path of the vocabulary file is a parameter of the operators; these queries use this public one.
TOKENIZER = "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1, capacity=2048)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.without_repeats(table(spark, sf_dir, "documents"), length=400)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_key")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_token_output, op4_packing, op5_substrings, op6_minhash, op7_licences, op8_exact_dedup, op9_secrets, op10_warc)}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express: not classifiers, tokenizers and alignment, which are tested against plain versions."""
    return {
        "op5_substrings": substrings.ORACLE, "op6_minhash": near.ORACLE, "op7_licences": licences.oracle(), "op8_exact_dedup": exact.ORACLE, "op9_secrets": secrets.oracle(), "op10_warc": warc.ORACLE,
    }
