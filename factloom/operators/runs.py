"""Run producers: BM25, dense, oracle and reciprocal-rank fusion. A run is rows (qid, doc_id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import alnum_tokens
from factloom.operators.vectors import nearest
from factloom.sources.stored import stored


def ranked(run: DataFrame, depth: int | None = None) -> DataFrame:
    """With rank: by score to nine digits descending, then doc_id."""
    order = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")
    out = run.withColumn("rank", F.row_number().over(order).cast("long"))
    return out if depth is None else out.where(F.col("rank") <= depth)


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_id, w): each document's tokens, computed once and kept in the shared folder."""
    return stored(docs.select("doc_id", alnum_tokens(F.col("text"), 2).alias("w")), "tokens")


def bm25_idf(tokens: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf) of tokenised(): negative idf values are replaced by epsilon times the mean of all."""
    n = tokens.agg(F.count(F.lit(1)).cast("double").alias("n"))
    df = tokens.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(F.broadcast(n)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, *, depth: int = 100, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi BM25 over whole texts; a query's repeated terms count each time. The depth is cut first, then scores of 0 and less go.

    Document tokens join the queries' terms before they are counted, so only terms that some query has are shuffled.
    """
    tokens = tokenised(docs)
    asked = stored(queries.select("qid", F.explode(alnum_tokens(F.col("text"), 2)).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    mean = tokens.agg(F.avg(F.size("w")).alias("mean_length"))
    terms = tokens.select("doc_id", F.size("w").alias("length"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = terms.groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    saturated = tf.join(F.broadcast(mean)).withColumn("w", F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length"))))
    scored = saturated.join(bm25_idf(tokens), "term").join(asked, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("times") * F.col("idf") * F.col("w")).alias("score"))
    return ranked(scored, depth).where("score > 0")


def dense(doc_vectors: DataFrame, query_vectors: DataFrame, *, depth: int = 100) -> DataFrame:
    """Best documents by similarity: (doc_id, vec_id, vec) against (qid, vec)."""
    none = [F.lit("text").alias("subspace"), F.lit("none").alias("need"), F.lit("").alias("head_type"), F.lit("").alias("tail_type")]
    slices = doc_vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")).select(*none, "vec_id", "n", "vec")
    requests = query_vectors.select(F.col("qid").cast("long").alias("request_id"), *none, F.lit(depth).alias("k"), "vec")
    hits = nearest(slices, requests).join(doc_vectors.select("doc_id", "vec_id"), "vec_id").select(F.col("request_id").alias("qid"), "doc_id", "score")
    order = W.partitionBy("qid").orderBy(F.round("score", 6).desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= depth)


def oracle(qrels: DataFrame, reachable: DataFrame) -> DataFrame:
    """Reachable documents of positive grade, best grade first."""
    hits = qrels.where("grade > 0").join(reachable.select("doc_id").distinct(), "doc_id", "left_semi")
    order = W.partitionBy("qid").orderBy(F.col("grade").desc(), "doc_id")
    every = F.count(F.lit(1)).over(W.partitionBy("qid"))
    return hits.select("qid", "doc_id", (every - F.row_number().over(order) + 1).cast("double").alias("score"))


def rrf(runs: DataFrame, damping: int = 60) -> DataFrame:
    """Fusion of runs (system, qid, doc_id, score)."""
    order = W.partitionBy("system", "qid").orderBy(F.round("score", 9).desc(), "doc_id")
    return runs.withColumn("rank", F.row_number().over(order)).groupBy("qid", "doc_id").agg(F.sum(1.0 / (damping + F.col("rank"))).alias("score"))
