"""Typed facts: from extracted records to rows with subspace texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import fold_chunk_id, spaced, strip
from factloom.functions.vocab import normalize_type

SUBSPACES = ["head", "tail", "verb", "pair", "full"]
RECORD = "struct<e1:string,e1_type:string,verb:string,e2:string,e2_type:string,head:string,head_type:string,tail:string,tail_type:string>"


def _field(x: Column, *names: str) -> Column:
    return strip(F.coalesce(*[F.nullif(x[n], F.lit("")) for n in names], F.lit("")))


def _type(x: Column, *names: str) -> Column:
    """The first name's value that isn't empty."""
    return F.coalesce(*[F.nullif(x[n], F.lit("")) for n in names])


def facts_of_records(rows: DataFrame, record: str = "record") -> DataFrame:
    """(doc_id, record) to facts: both names of each field are read, types normalised; records without head or tail go."""
    r = F.col(record)
    out = rows.select(
        "doc_id", _field(r, "e1", "head").alias("head"), normalize_type(_type(r, "e1_type", "head_type")).alias("head_type"), _field(r, "verb").alias("verb"),
        _field(r, "e2", "tail").alias("tail"), normalize_type(_type(r, "e2_type", "tail_type")).alias("tail_type"),
    )
    return out.where("head <> '' AND tail <> ''")


def payload_records(payload: Column) -> Column:
    """Records of a JSON payload: an object with a list `triplets`, or a list; null for anything else."""
    as_object = F.from_json(payload, f"struct<triplets:array<{RECORD}>>")["triplets"]
    return F.when(payload.rlike(r"^\s*\["), F.from_json(payload, f"array<{RECORD}>")).otherwise(as_object)


def facts_of_checkpoint(pipeline: DataFrame, *, fold: bool = True) -> DataFrame:
    """Facts of finished rows of the extraction table."""
    done = pipeline.where("status = 'done' AND step4_triplets_json IS NOT NULL")
    unit = F.col("id").cast("string")
    rows = done.select((fold_chunk_id(unit) if fold else unit).alias("doc_id"), F.explode(payload_records(F.col("step4_triplets_json"))).alias("record"))
    return facts_of_records(rows)


def with_subspaces(facts: DataFrame) -> DataFrame:
    """With pair (head and tail) and full (the sentence)."""
    return facts.withColumn("pair", F.concat_ws(" ", "head", "tail")).withColumn("full", spaced(F.col("head"), F.col("verb"), F.col("tail")))


def rendered() -> Column:
    return F.format_string("(%s : %s) -[%s]-> (%s : %s)", "head", "head_type", "verb", "tail", "tail_type")


def long_subspaces(facts: DataFrame) -> DataFrame:
    """(fact_id, subspace, text) of texts that aren't empty."""
    pairs = ", ".join(f"'{s}', `{s}`" for s in SUBSPACES)
    return with_subspaces(facts).selectExpr("fact_id", f"stack({len(SUBSPACES)}, {pairs}) AS (subspace, text)").where("text <> ''")


def describe(facts: DataFrame) -> DataFrame:
    """One row of counts."""
    counts = facts.agg(F.count(F.lit(1)).alias("n_facts"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(F.nullif(F.lower("verb"), F.lit(""))).alias("n_verbs"))
    entities = facts.select(F.explode(F.array(F.lower("head"), F.lower("tail"))).alias("e")).agg(F.countDistinct("e").alias("n_entities"))
    return counts.join(F.broadcast(entities)).select("n_facts", "n_docs", (F.col("n_facts") / F.greatest("n_docs", F.lit(1))).alias("facts_per_doc"), "n_entities", "n_verbs")


def type_histogram(facts: DataFrame) -> DataFrame:
    """Types of both ends, with their share in percent."""
    n = facts.select(F.explode(F.array("head_type", "tail_type")).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("type", "n", (100 * F.col("n") / F.col("total")).alias("percent"))
