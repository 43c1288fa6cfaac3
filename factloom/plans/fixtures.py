"""Facts, patterns, judgements and extraction rows derived from the driver's tables, whole; and the same rules as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import alnum_tokens
from factloom.functions.vocab import EXTRACTION_TYPES, QUERY_TYPES
from factloom.operators.extraction import STAGES
from factloom.operators.facts import with_subspaces
from factloom.operators.patterns import parse_replies

RAW_TYPES = ["food", "DISEASE", " drug", "Gene", "unheard of", "", "bio marker", "SYMPTOM", "NONE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h(text: Column) -> Column:
    """A number that both engines derive from a text."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def chosen(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values)).cast("int") + 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each run of five tokens of each document: two for the head, one for the verb, two for the tail."""
    w = documents(spark, sf_dir).select("doc_id", alnum_tokens(F.col("text")).alias("w")).where("size(w) >= 5")
    at = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / 5).cast("int") - 1)).alias("i"))
    word = lambda k: F.get("w", F.col("i") * 5 + k)
    out = at.select(
        "doc_id", (F.col("doc_id") * 1_000_000 + F.col("i")).alias("fact_id"), F.concat_ws(" ", word(0), word(1)).alias("head"), word(2).alias("verb"), F.concat_ws(" ", word(3), word(4)).alias("tail"),
    )
    return with_subspaces(out.withColumns({"head_type": chosen(EXTRACTION_TYPES, h(F.col("head"))), "tail_type": chosen(EXTRACTION_TYPES, h(F.col("tail")))}))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def vec_id_of(spark: SparkSession, sf_dir: str):
    """The fixture's encoder: a text's vector is that of the embedding its hash picks."""
    n = table(spark, sf_dir, "embeddings").count()
    return lambda text: h(text) % n


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, reply): five pattern lines an item, over all 27 shapes."""
    w = queries(spark, sf_dir).select("qid", alnum_tokens(F.col("text")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    word = lambda k: F.get("w", ((F.col("j") * 5 + k) % F.size("w")).cast("int"))
    shape = (F.col("qid") * 5 + F.col("j")) % 27

    def slot(text: Column, kind: Column) -> Column:
        return F.when(kind == 0, text).when(kind == 1, chosen(QUERY_TYPES, h(text))).otherwise("?")

    line = F.format_string(
        "MEM( %s ^ %s ^ %s )", slot(F.concat_ws(" ", word(0), word(1)), F.floor(shape / 9)), slot(word(2), F.floor(shape / 3) % 3), slot(F.concat_ws(" ", word(3), word(4)), shape % 3),
    )
    lines = w.select("qid", "j", line.alias("line")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("j", "line"))).alias("lines"))
    return lines.select("qid", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("reply"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_replies(replies(spark, sf_dir))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, doc_id, grade): a document is relevant to the items whose first five tokens it has in a row; grade 2 if its quality label is 1."""
    items = queries(spark, sf_dir).select("qid", F.array_join(F.slice(alnum_tokens(F.col("text")), 1, 5), " ").alias("key"))
    runs = documents(spark, sf_dir).select("doc_id", alnum_tokens(F.col("text")).alias("w")).where("size(w) >= 5")
    runs = runs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice("w", i, 5), " "))).alias("key"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(2).alias("g"))
    return items.join(runs, "key").select("qid", "doc_id").distinct().join(good, "doc_id", "left").select("qid", "doc_id", F.coalesce("g", F.lit(1)).alias("grade"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction row for each document, at stages that its hash picks; payloads hold a record for each run of five tokens, with a second name for the head's type."""
    d = documents(spark, sf_dir).select("doc_id", "text", h(F.col("doc_id").cast("string")).alias("x"), alnum_tokens(F.col("text")).alias("w"))
    k = F.col("x") % 10

    def record(w: Column, i: Column) -> Column:
        word = lambda i, j: F.get(w, i * 5 + j)
        head, tail = F.concat_ws(" ", word(i, 0), word(i, 1)), F.concat_ws(" ", word(i, 3), word(i, 4))
        return F.format_string(
            '{"e1":" %s","e1_type":"%s","verb":"%s","e2":"%s","e2_type":"%s","head_type":"drug"}', head, chosen(RAW_TYPES, h(head)), word(i, 2), F.when(h(tail) % 17 == 0, " ").otherwise(tail), chosen(RAW_TYPES, h(tail)),
        )

    def of(w: Column) -> Column:
        n = F.floor(F.size(w) / 5).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: record(w, i)), ",")).otherwise("")

    # The tokens are a lambda's variable here, so they are made once for each row.
    records = F.get(F.transform(F.array("w"), of), 0)
    payload = F.when(k == 9, "no JSON").when(k % 2 == 0, F.concat(F.lit('{"triplets":['), records, F.lit("]}"))).otherwise(F.concat(F.lit("["), records, F.lit("]")))
    text = F.col("text")
    return d.select(
        F.when(F.col("x") % 3 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("__"), (F.col("x") % 4).cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("id"), text.alias("original_text"),
        F.when(k >= 1, F.replace(text, F.lit(" it "), F.lit(" them "))).alias(STAGES[0]), F.when(k >= 2, text).alias(STAGES[1]), F.when(k >= 3, F.when(k == 8, " ").otherwise(text)).alias(STAGES[2]), F.when(k >= 4, payload).alias(STAGES[3]),
        F.when(k >= 4, "done").when(k == 3, "failed").when(k >= 1, "in_progress").otherwise("pending").alias("status"), F.when(k == 3, "timed out").alias("error"),
        (F.col("x") % 4).cast("int").alias("attempts"), F.when(k > 0, (F.col("x") % 1000).cast("double")).alias("updated_at"),
    )


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_h(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 7)) AS BIGINT)"


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def sql_type(values: list[str], text: str) -> str:
    return f"({sql_list(values)})[{sql_h(text)} % {len(values)} + 1]"


SQL_FACTS = f"""
fx_w AS (SELECT doc_id, {sql_tokens("text")} AS w FROM documents),
fx_i AS (SELECT doc_id, w, unnest(range(0, len(w) // 5)) AS i FROM fx_w),
fx_f AS (SELECT doc_id, doc_id * 1000000 + i AS fact_id, w[5*i+1] || ' ' || w[5*i+2] AS head, w[5*i+3] AS verb, w[5*i+4] || ' ' || w[5*i+5] AS tail FROM fx_i),
facts AS (SELECT *, {sql_type(EXTRACTION_TYPES, "head")} AS head_type, {sql_type(EXTRACTION_TYPES, "tail")} AS tail_type, head || ' ' || tail AS pair, head || ' ' || verb || ' ' || tail AS full_text FROM fx_f)"""

_kind = lambda text, kind: f"CASE {kind} WHEN 0 THEN {text} WHEN 1 THEN {sql_type(QUERY_TYPES, text)} ELSE '?' END"
SQL_PATTERNS = f"""
px_w AS (SELECT item_id AS qid, {sql_tokens("text")} AS w, unnest(range(0, 5)) AS j FROM benchmark),
px_s AS (SELECT qid, j, (qid * 5 + j) % 27 AS s, w[(j*5)%len(w)+1] || ' ' || w[(j*5+1)%len(w)+1] AS ht, w[(j*5+2)%len(w)+1] AS rt, w[(j*5+3)%len(w)+1] || ' ' || w[(j*5+4)%len(w)+1] AS tt FROM px_w),
px_k AS (SELECT qid, j, {_kind("ht", "(s // 9)")} AS head, {_kind("rt", "((s // 3) % 3)")} AS relation, {_kind("tt", "(s % 3)")} AS tail,
         (['c', 'T', '?'])[s // 9 + 1] AS hk, (['c', 'T', '?'])[(s // 3) % 3 + 1] AS rk, (['c', 'T', '?'])[s % 3 + 1] AS tk FROM px_s),
px_d AS (SELECT *, row_number() OVER (PARTITION BY qid, lower(head), lower(relation), lower(tail) ORDER BY j) AS nth FROM px_k WHERE hk || rk || tk <> '???'),
patterns AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY j) - 1 AS BIGINT) AS pattern_no, head, relation, tail, hk, rk, tk, hk || rk || tk AS shape FROM px_d WHERE nth = 1)"""

SQL_QRELS = f"""
qx_i AS (SELECT item_id AS qid, array_to_string(({sql_tokens("text")})[1:5], ' ') AS key FROM benchmark),
qx_w AS (SELECT doc_id, {sql_tokens("text")} AS w FROM documents),
qx_r AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM qx_w WHERE len(w) >= 5),
qx_k AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS key FROM qx_r),
qrels AS (SELECT DISTINCT qid, k.doc_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS grade FROM qx_i JOIN qx_k k USING (key) LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = k.doc_id)"""

_rec = f"w[5*i+1] || ' ' || w[5*i+2] AS head, w[5*i+3] AS verb, w[5*i+4] || ' ' || w[5*i+5] AS tail0"
SQL_PIPELINE = f"""
dx AS (SELECT doc_id, text, {sql_h("CAST(doc_id AS VARCHAR)")} AS x, {sql_tokens("text")} AS w FROM documents),
dk AS (SELECT *, x % 10 AS k, CASE WHEN x % 3 = 0 THEN doc_id || '__' || (x % 4) ELSE CAST(doc_id AS VARCHAR) END AS id FROM dx),
pipeline AS (SELECT id, doc_id, k, x, text AS original_text, CASE WHEN k >= 1 THEN replace(text, ' it ', ' them ') END AS s1, CASE WHEN k >= 2 THEN text END AS s2,
  CASE WHEN k >= 3 THEN CASE WHEN k = 8 THEN ' ' ELSE text END END AS s3, k >= 4 AS has4,
  CASE WHEN k >= 4 THEN 'done' WHEN k = 3 THEN 'failed' WHEN k >= 1 THEN 'in_progress' ELSE 'pending' END AS status,
  CASE WHEN k = 3 THEN 'timed out' END AS error, CAST(x % 4 AS INTEGER) AS attempts, CASE WHEN k > 0 THEN CAST(x % 1000 AS DOUBLE) END AS updated_at, w FROM dk),
recs AS (SELECT id, doc_id, k, i, {_rec} FROM (SELECT id, doc_id, k, w, unnest(range(0, len(w) // 5)) AS i FROM pipeline WHERE k BETWEEN 4 AND 8)),
records AS (SELECT *, CASE WHEN {sql_h("tail0")} % 17 = 0 THEN '' ELSE tail0 END AS tail, coalesce(nullif({sql_type(RAW_TYPES, "head")}, ''), 'drug') AS raw_head, {sql_type(RAW_TYPES, "tail0")} AS raw_tail FROM recs)"""
