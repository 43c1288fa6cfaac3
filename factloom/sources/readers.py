"""Files that retrieval corpora, judgements, extraction tables and pattern replies come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import chunks, document_text
from factloom.operators.extraction import SCHEMA
from factloom.operators.facts import facts_of_records, long_subspaces, payload_records


def corpus(rows: DataFrame, *, id_col: str = "_id", title_col: str = "title", text_col: str = "text", most_words: int = 0) -> DataFrame:
    """(id, text) of each document that has any text, or of its chunks: those are named id__0, id__1, ... if there are several."""
    docs = rows.select(F.col(id_col).cast("string").alias("doc"), document_text(F.col(title_col).cast("string"), F.col(text_col).cast("string")).alias("body")).where("body IS NOT NULL")
    if not most_words:
        return docs.select(F.col("doc").alias("id"), F.col("body").alias("text"))
    cut = docs.withColumn("parts", chunks(F.col("body"), most_words)).select("doc", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "text"))
    return cut.select(F.when(F.col("n") > 1, F.concat("doc", F.lit("__"), F.col("i").cast("string"))).otherwise(F.col("doc")).alias("id"), "text")


def read_corpus(spark: SparkSession, path: str, *, id_col: str = "_id", title_col: str = "title", text_col: str = "text", most_words: int = 0) -> DataFrame:
    """corpus() of a file with a JSON object a line."""
    rows = spark.read.schema(f"`{id_col}` string, `{title_col}` string, `{text_col}` string").json(path)
    return corpus(rows, id_col=id_col, title_col=title_col, text_col=text_col, most_words=most_words)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))


def qrels(lines: DataFrame) -> DataFrame:
    """(line_no, value) to (qid, doc_id, grade): the first line is a header if it has the word query; of repeated pairs the last counts. line_no: anything that orders lines."""
    first = lines.agg(F.min("line_no").alias("first_line"))
    rows = lines.join(F.broadcast(first)).where(~((F.col("line_no") == F.col("first_line")) & F.lower("value").contains("query"))).withColumn("f", F.split("value", "\t")).where("size(f) >= 3")
    pairs = rows.select("line_no", F.get("f", 0).alias("qid"), F.get("f", 1).alias("doc_id"), F.get("f", 2).cast("int").alias("grade"))
    return pairs.groupBy("qid", "doc_id").agg(F.max_by("grade", "line_no").alias("grade"))


def read_qrels(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Of a tab-separated file, or, with a split, of path/qrel_<split>.tsv or else path/qrels/<split>.tsv.

    Lines go by their place in the file: where their part of the file starts, then as they come in it.
    """
    if split is not None:
        jvm = spark.sparkContext._jvm
        own = jvm.org.apache.hadoop.fs.Path(f"{path}/qrel_{split}.tsv")
        path = own.toString() if own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own) else f"{path}/qrels/{split}.tsv"
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_no"))
    return qrels(lines)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Training samples as write_samples leaves them: (stage, is_eval, conversations)."""
    return spark.read.schema("conversations array<struct<role:string,content:string>>, stage string, is_eval boolean").json(path)


def read_extraction(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def facts_of_export(documents: DataFrame) -> DataFrame:
    """(value: one JSON object, document to records or to an object with `triplets`) to facts."""
    each = documents.select(F.explode(F.from_json("value", "map<string,string>")).alias("doc_id", "payload"))
    return facts_of_records(each.select("doc_id", F.explode(payload_records(F.col("payload"))).alias("record")))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return facts_of_export(spark.read.text(path, wholetext=True))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """A saved graph: every text of every subspace must have a vector."""
    facts, vectors = spark.read.parquet(f"{path}/facts"), spark.read.parquet(f"{path}/vectors")
    lost = long_subspaces(facts).select("text").distinct().join(vectors.select("text"), "text", "left_anti").limit(1).count()
    if lost:
        raise ValueError(f"{path}: vectors don't cover the facts' texts")
    return facts


def cached_vectors(spark: SparkSession, path: str, namespace: str, fingerprint: str) -> DataFrame:
    """A namespace of the vector cache; one that another model wrote is an error."""
    rows = spark.read.parquet(path).where(F.col("ns") == namespace)
    if rows.where(F.col("fingerprint") != fingerprint).limit(1).count():
        raise ValueError(f"{path}: namespace {namespace} has another fingerprint than {fingerprint}")
    return rows


def replies_todo(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries without a reply that isn't blank."""
    have = cache.where(F.trim(F.coalesce("reply", F.lit(""))) != "").select("qid")
    return queries.join(have, "qid", "left_anti")


def titles(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their documents' titles."""
    return hits.join(documents.select("doc_id", "title").join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "left")


def newest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Of a log of versions of rows, each key's latest."""
    order = W.partitionBy(key).orderBy(F.col(version).desc())
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


