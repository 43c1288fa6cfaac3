"""Named queries over the driver's tables, and DuckDB SQL for the same results."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.vocab import EXTRACTION_TYPES, QUERY_TYPES, TYPE_ALIASES, WILDCARDS, normalize_type, slot_kind
from factloom.operators import chat, distill, extraction, metrics, patterns, retrieve, runs, vectors
from factloom.operators import facts as fact_ops
from factloom.plans import fixtures as fx
from factloom.sources import readers, sinks
from factloom.sources.stored import shared_dir, stored

FLAGSHIP = "search"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _ORACLES[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def long(c: str):
    return F.col(c).cast("long").alias(c)


def six(c: str):
    return F.round(F.col(c), 6).alias(c)


_Q = lambda values: ", ".join(f"'{v}'" for v in values)
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ''), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '')"
_ALIAS = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_ALIASES.items()) + " ELSE t END"
_NORM = lambda x: f"(SELECT CASE WHEN u IN ({_Q(EXTRACTION_TYPES)}) THEN u ELSE 'NONE' END FROM (SELECT {_ALIAS} AS u FROM (SELECT replace(upper({_STRIP(x)}), ' ', '_') AS t)))"
_F = f"WITH {fx.SQL_FACTS}"
_P = f"WITH {fx.SQL_PATTERNS}"
_PIPE = f"WITH {fx.SQL_PIPELINE}"


# Facts.


@query(f"{_F} SELECT fact_id, doc_id, head, head_type, verb, tail, tail_type, '(' || head || ' : ' || head_type || ') -[' || verb || ']-> (' || tail || ' : ' || tail_type || ')' AS rendered FROM facts")
def render_fact(spark, sf):
    return fx.facts(spark, sf).select("fact_id", "doc_id", "head", "head_type", "verb", "tail", "tail_type", fact_ops.rendered().alias("rendered"))


@query(f"{_F} SELECT subspace, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT s) AS BIGINT) AS n_distinct, CAST(sum(length(s)) AS BIGINT) AS chars FROM (UNPIVOT (SELECT fact_id, head, tail, verb, pair, full_text AS \"full\" FROM facts) ON head, tail, verb, pair, \"full\" INTO NAME subspace VALUE s) GROUP BY subspace")
def subspace_texts(spark, sf):
    return fact_ops.long_subspaces(fx.facts(spark, sf).drop("pair", "full")).groupBy("subspace").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_distinct"), F.sum(F.char_length("text")).cast("long").alias("chars"))


@query(f"{_F} SELECT CAST(count(*) AS BIGINT) AS n_facts, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, round(count(*) / count(DISTINCT doc_id), 6) AS facts_per_doc, (SELECT CAST(count(DISTINCT e) AS BIGINT) FROM (SELECT lower(head) e FROM facts UNION ALL SELECT lower(tail) FROM facts)) AS n_entities, CAST(count(DISTINCT lower(verb)) AS BIGINT) AS n_verbs FROM facts")
def graph_describe(spark, sf):
    return fact_ops.describe(fx.facts(spark, sf)).select("n_facts", "n_docs", six("facts_per_doc"), "n_entities", "n_verbs")


@query(f"{_F} SELECT type, CAST(n AS BIGINT) AS n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT type, count(*) n FROM (SELECT head_type AS type FROM facts UNION ALL SELECT tail_type FROM facts) GROUP BY type)")
def type_histogram(spark, sf):
    return fact_ops.type_histogram(fx.facts(spark, sf)).select("type", "n", six("percent"))


@query(f"{_F} SELECT lower(head) AS entity FROM facts UNION SELECT lower(tail) FROM facts")
def entity_union(spark, sf):
    f = fx.facts(spark, sf)
    return f.select(F.lower("head").alias("entity")).union(f.select(F.lower("tail"))).distinct()


@query(f"{_F} SELECT fact_id, doc_id, head FROM facts WHERE head_type = 'FOOD'")
def type_filter(spark, sf):
    return fx.facts(spark, sf).where("head_type = 'FOOD'").select("fact_id", "doc_id", "head")


@query(f"{_F} SELECT fact_id, doc_id, verb FROM facts WHERE head_type = 'FOOD' AND tail_type = 'DRUGS'")
def type_pair_filter(spark, sf):
    return fx.facts(spark, sf).where("head_type = 'FOOD' AND tail_type = 'DRUGS'").select("fact_id", "doc_id", "verb")


@query(f"{_F} SELECT CAST(count(DISTINCT f.doc_id) AS BIGINT) AS n_docs, CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_corpus, round(100.0 * count(DISTINCT f.doc_id) / (SELECT count(*) FROM documents), 6) AS percent FROM facts f")
def coverage(spark, sf):
    n = fx.documents(spark, sf).agg(F.count("*").alias("n_corpus"))
    return fx.facts(spark, sf).agg(F.countDistinct("doc_id").alias("n_docs")).join(F.broadcast(n)).select("n_docs", "n_corpus", F.round(100 * F.col("n_docs") / F.col("n_corpus"), 6).alias("percent"))


# Scalars and text.

_RAW = _Q(fx.RAW_TYPES)


@query(f"SELECT event_id, {_NORM('raw')} AS type FROM (SELECT event_id, CASE event_id % 11 WHEN 9 THEN NULL WHEN 10 THEN ' disease-disorder ' ELSE ([{_RAW}])[event_id % 11 + 1] END AS raw FROM events)".replace("ELSE 'NONE' END FROM (SELECT CASE t", "ELSE 'NONE' END FROM (SELECT CASE t"), "normalize_type")
def normalize_type_q(spark, sf):
    k = F.col("event_id") % 11
    raw = F.when(k == 9, F.lit(None)).when(k == 10, " disease-disorder ").otherwise(F.get(F.array(*map(F.lit, fx.RAW_TYPES)), k.cast("int")))
    return fx.table(spark, sf, "events").select("event_id", normalize_type(raw).alias("type"))


@query(f"SELECT DISTINCT w AS slot, CASE WHEN w IN ({_Q(WILDCARDS)}) THEN '?' WHEN w IN ({_Q(QUERY_TYPES)}) THEN 'T' ELSE 'c' END AS kind FROM (SELECT unnest(w) AS w FROM (SELECT {fx.sql_tokens('text')} AS w FROM benchmark) UNION ALL SELECT unnest([{_Q([*QUERY_TYPES, *WILDCARDS, 'NONE', 'food'])}]))", "slot_kind")
def slot_kind_q(spark, sf):
    w = fx.queries(spark, sf).select(F.explode(tx.alnum_tokens(F.col("text"))).alias("slot"))
    more = spark.createDataFrame([(x,) for x in [*QUERY_TYPES, *WILDCARDS, "NONE", "food"]], "slot string")
    return w.union(more).distinct().select("slot", slot_kind(F.col("slot")).alias("kind"))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, list_aggregate(w, 'min') AS least FROM (SELECT doc_id, list_filter({fx.sql_tokens('text')}, lambda x: length(x) > 1) AS w FROM documents)")
def tokenize(spark, sf):
    t = fx.documents(spark, sf).select("doc_id", tx.alnum_tokens(F.col("text"), 2).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n"), F.array_min("w").alias("least"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def corpus_load(spark, sf):
    return readers.corpus(fx.documents(spark, sf).withColumn("title", F.lit(None).cast("string")), id_col="doc_id")


@query(r"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
n AS (SELECT doc_id, ps, list_transform(ps, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda t: t <> ''))) AS ns FROM p WHERE len(ps) > 0),
s AS (SELECT doc_id, ps, ns, 1 AS i, ns[1] AS n, 0 AS c FROM n
      UNION ALL SELECT doc_id, ps, ns, i + 1, CASE WHEN n + ns[i+1] > 60 THEN ns[i+1] ELSE n + ns[i+1] END, CASE WHEN n + ns[i+1] > 60 THEN c + 1 ELSE c END FROM s WHERE i < len(ps)),
g AS (SELECT doc_id, c, string_agg(ps[i], chr(10) ORDER BY i) AS text, max(c) OVER (PARTITION BY doc_id) AS most FROM s GROUP BY doc_id, c)
SELECT CASE WHEN most > 0 THEN doc_id || '__' || c ELSE CAST(doc_id AS VARCHAR) END AS id, text FROM g""")
def chunk_text(spark, sf):
    return readers.corpus(fx.documents(spark, sf).withColumn("title", F.lit("")), id_col="doc_id", most_words=60)


@query(f"{_PIPE} SELECT id, CAST(doc_id AS VARCHAR) AS doc_id FROM pipeline")
def fold_chunk_ids(spark, sf):
    return fx.pipeline(spark, sf).select("id", tx.fold_chunk_id(F.col("id")).alias("doc_id"))


@query("SELECT conv_id, turn, role || text AS reply FROM conversations")
def strip_think(spark, sf):
    c = fx.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.without_thinking(F.concat("role", F.lit("<think>x\ny</think>"), "text")).alias("reply"))


@query("SELECT event_type, substr(sha1('model|' || event_type || '|' || '32'), 1, 12) AS fingerprint FROM events GROUP BY event_type")
def fingerprint(spark, sf):
    return fx.table(spark, sf, "events").select("event_type").distinct().select("event_type", tx.fingerprint(F.lit("model"), F.col("event_type"), F.lit(32)).alias("fingerprint"))


@query("SELECT vec_id, round(list_dot_product(v, v), 6) AS length FROM (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: 3.0 * CAST(x AS DOUBLE)) AS e FROM embeddings))")
def l2_normalize(spark, sf):
    v = tx.unit(F.transform("vec", lambda x: 3.0 * x.cast("double")))
    return fx.vectors(spark, sf).select("vec_id", F.round(tx.dot(v, v), 6).alias("length"))


@query("SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)")
def cosine(spark, sf):
    v, n = fx.vectors(spark, sf), fx.vectors(spark, sf).count()
    other = v.select(((F.col("vec_id") - 1 + n) % n).alias("vec_id"), F.col("vec").alias("next"))
    return v.join(other, "vec_id").select("vec_id", F.round(tx.dot(F.col("vec"), F.col("next")), 6).alias("score"))


@query("SELECT doc_id, length(text) < 0.5 * (length(text) + length(source) * 100) AS collapsed FROM documents")
def rewrite_guard(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", tx.is_collapsed(F.concat("text", F.repeat(F.col("source"), F.lit(100))), F.col("text")).alias("collapsed"))


# Patterns.


@query(f"{_P} SELECT * FROM patterns")
def parse_patterns(spark, sf):
    return fx.patterns(spark, sf)


@query(f"{_P} SELECT qid, pattern_no, shape, (CAST(hk <> '?' AS INT) + CAST(rk <> '?' AS INT) + CAST(tk <> '?' AS INT)) <= 1 AS is_degenerate, hk = 'T' OR tk = 'T' AS has_type, 'MEM( ' || head || ' ^ ' || relation || ' ^ ' || tail || ' )' AS line FROM patterns")
def pattern_shape(spark, sf):
    return patterns.described(fx.patterns(spark, sf)).select("qid", "pattern_no", "shape", "is_degenerate", "has_type", "line")


@query(f"""{_P} SELECT DISTINCT qid, text FROM (SELECT qid, unnest([CASE WHEN hk='c' THEN head END, CASE WHEN tk='c' THEN tail END, CASE WHEN rk='c' THEN relation END, CASE WHEN hk='c' AND tk='c' THEN head||' '||tail END,
 CASE WHEN hk='c' AND rk='c' THEN head||' '||relation END, CASE WHEN rk='c' AND tk='c' THEN relation||' '||tail END, CASE WHEN hk||rk||tk='ccc' THEN head||' '||relation||' '||tail END]) AS text FROM patterns) WHERE text IS NOT NULL""")
def pattern_texts(spark, sf):
    return patterns.needed_texts(fx.patterns(spark, sf))


@query(f"""{_P}, b AS (SELECT qid, count(*) n, bool_and((CAST(hk <> '?' AS INT) + CAST(rk <> '?' AS INT) + CAST(tk <> '?' AS INT)) <= 1) AS d, sum(CAST(hk = 'T' AS INT) + CAST(rk = 'T' AS INT) + CAST(tk = 'T' AS INT)) AS t FROM patterns GROUP BY qid),
j AS (SELECT item_id, n, d, t FROM benchmark LEFT JOIN b ON b.qid = item_id)
SELECT CAST(count(*) AS BIGINT) AS n_queries, CAST(sum(n) AS BIGINT) AS n_patterns, round(sum(n) / count(*), 6) AS per_query, CAST(count(*) FILTER (n IS NULL) AS BIGINT) AS n_empty, CAST(count(*) FILTER (d) AS BIGINT) AS n_degenerate, round(count(*) FILTER (d) / count(*), 6) AS degenerate_rate, round(sum(t) / (3 * sum(n)), 6) AS typed_slot_rate FROM j""")
def shape_summary(spark, sf):
    s = patterns.shape_summary(fx.replies(spark, sf), fx.patterns(spark, sf))
    return s.select("n_queries", "n_patterns", six("per_query"), "n_empty", "n_degenerate", six("degenerate_rate"), six("typed_slot_rate"))


@query(f"{_P} SELECT shape, CAST(count(*) AS BIGINT) AS n FROM patterns GROUP BY shape")
def shape_hist(spark, sf):
    return fx.patterns(spark, sf).groupBy("shape").agg(F.count("*").alias("n"))


@query(f"{_P}, w AS (SELECT DISTINCT head AS text FROM patterns WHERE hk = 'c') SELECT text FROM w WHERE text NOT IN (SELECT tail FROM patterns WHERE tk = 'c')")
def missing_texts(spark, sf):
    p = fx.patterns(spark, sf)
    return vectors.missing_texts(p.where("hk = 'c'").select(F.col("head").alias("text")), p.where("tk = 'c'").select(F.col("tail").alias("text")).distinct())


@query(f"{_P} SELECT item_id AS qid FROM benchmark WHERE item_id NOT IN (SELECT qid FROM patterns WHERE shape = 'ccc')")
def patterns_todo(spark, sf):
    cache = fx.patterns(spark, sf).where("shape = 'ccc'").select("qid", F.col("head").alias("reply"))
    return readers.replies_todo(fx.queries(spark, sf).select("qid"), cache)


# Retrieval.


def _requests() -> str:
    slots = {"h": "head", "t": "tail", "r": "relation", "q": "q.text", "rt": "relation || ' ' || tail", "hr": "head || ' ' || relation", "ht": "head || ' ' || tail", "hrt": "head || ' ' || relation || ' ' || tail"}
    parts = []
    for shapes, need, scans in retrieve.SHAPES:
        for i, (role, subspace, s) in enumerate(scans):
            k = 2000 if len(scans) > 1 and role in ("base", "side") else 100
            ht, tt = ("head" if need in ("head", "both") else "''"), ("tail" if need in ("tail", "both") else "''")
            parts.append(f"SELECT p.qid, pattern_no, shape, {i} AS c, '{role}' AS role, '{subspace}' AS subspace, {slots[s]} AS text, {ht} AS ht, {tt} AS tt, {k} AS k FROM patterns p JOIN (SELECT item_id AS qid, text FROM benchmark) q USING (qid) WHERE shape IN ({_Q(shapes)})")
    parts.append(f"SELECT item_id, {retrieve.QUERY_CHANNEL}, 'query', 0, 'base', 'full', text, '', '', 100 FROM benchmark")
    return " UNION ALL ".join(parts)


_N = "(SELECT count(*) FROM embeddings)"
_SCORED = f"""WITH {fx.SQL_FACTS}, {fx.SQL_PATTERNS},
post AS MATERIALIZED (SELECT fact_id, doc_id, head_type, tail_type, subspace, {fx.sql_h("s")} % {_N} AS v FROM (SELECT fact_id, doc_id, head_type, tail_type, unnest(['head','tail','verb','pair','full']) AS subspace, unnest([head, tail, verb, pair, full_text]) AS s FROM facts)),
req AS MATERIALIZED (SELECT *, {fx.sql_h("text")} % {_N} AS qv FROM ({_requests()})),
sim AS MATERIALIZED (SELECT a.qv, e.vec_id AS v, list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM (SELECT DISTINCT qv FROM req) a JOIN embeddings b ON b.vec_id = a.qv CROSS JOIN embeddings e),
scan AS MATERIALIZED (SELECT r.qid, r.pattern_no, r.c, r.role, p.fact_id, p.doc_id, s.score FROM req r JOIN post p ON p.subspace = r.subspace AND (r.ht = '' OR r.ht = p.head_type) AND (r.tt = '' OR r.tt = p.tail_type) JOIN sim s ON s.qv = r.qv AND s.v = p.v WHERE r.role <> 'rescan'
  QUALIFY row_number() OVER (PARTITION BY r.qid, r.pattern_no, r.c ORDER BY round(s.score, 6) DESC, p.fact_id) <= r.k),
base AS (SELECT qid, pattern_no, fact_id, doc_id, score FROM scan WHERE role IN ('base', 'pair')),
comp AS (SELECT * FROM base UNION ALL SELECT qid, pattern_no, fact_id, doc_id, avg(score) FROM scan WHERE role = 'side' GROUP BY ALL HAVING count(*) = 2
  UNION ALL SELECT b.qid, b.pattern_no, b.fact_id, b.doc_id, s.score FROM base b JOIN req r ON r.qid = b.qid AND r.pattern_no = b.pattern_no AND r.role = 'rescan' JOIN post p ON p.fact_id = b.fact_id AND p.subspace = 'full' JOIN sim s ON s.qv = r.qv AND s.v = p.v),
comb AS (SELECT qid, pattern_no, fact_id, doc_id, avg(score) AS score FROM comp GROUP BY ALL),
scored AS MATERIALIZED (SELECT c.*, n.shape FROM comb c JOIN (SELECT DISTINCT qid, pattern_no, shape FROM req) n USING (qid, pattern_no) QUALIFY row_number() OVER (PARTITION BY qid, pattern_no ORDER BY round(score, 6) DESC, fact_id) <= 100),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid, fact_id ORDER BY round(score, 6) DESC, pattern_no) = 1),
nth AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 6) DESC, fact_id) AS nth FROM best)
"""


def _scored(spark, sf, config=None):
    return retrieve.scored_facts(fx.facts(spark, sf), fx.vectors(spark, sf), fx.vec_id_of(spark, sf), fx.patterns(spark, sf), fx.queries(spark, sf), config or retrieve.RetrievalConfig())


def _documents(spark, sf, aggregation="max"):
    return retrieve.to_documents(retrieve.best_per_fact(_scored(spark, sf)), aggregation)


@query(_SCORED + "SELECT qid, doc_id, round(max(score), 5) AS score, CAST(count(*) AS BIGINT) AS n_facts FROM best GROUP BY qid, doc_id")
def search(spark, sf):
    return _documents(spark, sf).select("qid", "doc_id", F.round("score", 5).alias("score"), "n_facts")


@query(_SCORED + "SELECT qid, doc_id, round(max(score), 5) AS score FROM scored WHERE qid = (SELECT min(item_id) FROM benchmark) AND pattern_no = 0 GROUP BY qid, doc_id")
def search_one(spark, sf):
    """One pattern of one question, without the question itself."""
    first = fx.queries(spark, sf).agg(F.min("qid").alias("qid"))
    chosen = fx.patterns(spark, sf).where("pattern_no = 0").join(F.broadcast(first), "qid", "left_semi")
    found = retrieve.search(fx.facts(spark, sf), fx.vectors(spark, sf), fx.vec_id_of(spark, sf), chosen, fx.queries(spark, sf), retrieve.RetrievalConfig(query_channel=False))
    return found.select("qid", "doc_id", F.round("score", 5).alias("score"))


@query(_SCORED + "SELECT qid, doc_id, round(sum(score) FILTER (nth <= 3), 5) AS score FROM nth GROUP BY qid, doc_id")
def agg_sum3(spark, sf):
    return _documents(spark, sf, "sum3").select("qid", "doc_id", F.round("score", 5).alias("score"))


@query(_SCORED + "SELECT qid, doc_id, round(sum(score), 5) AS score FROM nth GROUP BY qid, doc_id")
def agg_sum_all(spark, sf):
    return _documents(spark, sf, "sum").select("qid", "doc_id", F.round("score", 5).alias("score"))


@query(_SCORED + "SELECT qid, pattern_no, shape, fact_id, doc_id, round(score, 5) AS score FROM scored")
def per_pattern_cap(spark, sf):
    return _scored(spark, sf).select("qid", "pattern_no", "shape", "fact_id", "doc_id", F.round("score", 5).alias("score"))


@query(_SCORED + "SELECT qid, fact_id, doc_id, pattern_no, shape, round(score, 5) AS score FROM best")
def best_per_fact(spark, sf):
    return retrieve.best_per_fact(_scored(spark, sf)).select("qid", "fact_id", "doc_id", "pattern_no", "shape", F.round("score", 5).alias("score"))


@query(_SCORED + "SELECT qid, doc_id, string_agg(fact_id, ',' ORDER BY nth) AS facts FROM nth GROUP BY qid, doc_id")
def supporting(spark, sf):
    return _documents(spark, sf).select("qid", "doc_id", F.array_join(F.transform("facts", lambda x: x["fact_id"].cast("string")), ",").alias("facts"))


@query(_SCORED + "SELECT qid, fact_id, doc_id, round(score, 5) AS score FROM scored WHERE shape = 'query'")
def query_channel(spark, sf):
    none = fx.patterns(spark, sf).where("1 = 0")
    config = retrieve.RetrievalConfig()
    found = retrieve.scored_facts(fx.facts(spark, sf), fx.vectors(spark, sf), fx.vec_id_of(spark, sf), none, fx.queries(spark, sf), config)
    return found.select("qid", "fact_id", "doc_id", F.round("score", 5).alias("score"))


def _shape(name: str, shapes: list[str]) -> None:
    listed = _Q(shapes)

    @query(_SCORED + f"SELECT qid, pattern_no, fact_id, doc_id, round(score, 5) AS score FROM scored WHERE shape IN ({listed})", f"shape_{name}")
    def one(spark, sf):
        chosen = fx.patterns(spark, sf).where(F.col("shape").isin(shapes))
        found = retrieve.scored_facts(fx.facts(spark, sf), fx.vectors(spark, sf), fx.vec_id_of(spark, sf), chosen, fx.queries(spark, sf), retrieve.RetrievalConfig(query_channel=False))
        return found.select("qid", "pattern_no", "fact_id", "doc_id", F.round("score", 5).alias("score"))


for _shapes, _need, _scans in retrieve.SHAPES:
    _shape(_shapes[0].replace("?", "any").replace("T", "type").replace("c", "text"), _shapes)


@query(_SCORED + """, docs AS (SELECT qid, doc_id, max(score) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(max(score), 6) DESC, doc_id) AS rank FROM best GROUP BY qid, doc_id)
SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 5) AS score FROM docs WHERE rank <= 10""")
def top_documents(spark, sf):
    docs = retrieve.to_documents(retrieve.best_per_fact(_scored(spark, sf)), "max", 10)
    return docs.select("qid", long("rank"), "doc_id", F.round("score", 5).alias("score"))


_TEN = """, docs AS (SELECT qid, doc_id, max(score) AS score, count(*) AS n_facts, row_number() OVER (PARTITION BY qid ORDER BY round(max(score), 6) DESC, doc_id) AS rank FROM best GROUP BY qid, doc_id QUALIFY rank <= 10),
told AS (SELECT d.qid, d.doc_id, d.rank, d.score, d.n_facts, n.nth, n.score AS fact_score, n.shape, n.pattern_no, '(' || f.head || ' : ' || f.head_type || ') -[' || f.verb || ']-> (' || f.tail || ' : ' || f.tail_type || ')' AS fact
  FROM docs d JOIN nth n ON n.qid = d.qid AND n.doc_id = d.doc_id AND n.nth <= 3 JOIN facts f ON f.fact_id = n.fact_id)"""


@query(_SCORED + _TEN + """SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, CAST(n_facts - count(*) AS BIGINT) AS more, string_agg(fact, ' | ' ORDER BY nth) AS facts FROM told GROUP BY qid, rank, doc_id, n_facts""")
def search_json(spark, sf):
    """Read back from the JSON lines."""
    docs = retrieve.to_documents(retrieve.best_per_fact(_scored(spark, sf)), "max", 10)
    lines = retrieve.rendered_hits(docs, fx.facts(spark, sf))
    read = lines.select("qid", "rank", F.from_json("json", "struct<doc_id:long,facts:array<string>,more:long>").alias("j"))
    return read.select("qid", "rank", "j.doc_id", "j.more", F.array_join("j.facts", " | ").alias("facts"))


@query(_SCORED + _TEN + """SELECT qid, doc_id, CAST(count(*) + 1 + CAST(max(n_facts) > 3 AS INT) AS BIGINT) AS lines, string_agg(fact, chr(10) ORDER BY nth) AS facts FROM told GROUP BY qid, doc_id""")
def explain_hits(spark, sf):
    docs = retrieve.to_documents(retrieve.best_per_fact(_scored(spark, sf)), "max", 10)
    facts = F.transform(F.filter("l", lambda x: x.startswith("    [")), lambda x: F.regexp_extract(x, r"^    \[-?[\d.]+\] (.*)   <- .*$", 1))
    told = retrieve.explained(docs, fx.facts(spark, sf)).withColumn("l", F.split("explanation", "\n"))
    return told.select("qid", "doc_id", (1 + F.size(F.filter("l", lambda x: x.startswith("    ")))).cast("long").alias("lines"), F.array_join(facts, "\n").alias("facts"))


# Runs and metrics.


@query(f"WITH {fx.SQL_QRELS} SELECT qid, doc_id, CAST(grade AS INTEGER) AS grade FROM qrels")
def qrels(spark, sf):
    return fx.qrels(spark, sf)


@query(f"WITH {fx.SQL_QRELS} SELECT CAST(qid AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS doc_id, CAST(grade AS INTEGER) AS grade FROM qrels")
def qrels_load(spark, sf):
    lines = fx.qrels(spark, sf).select(F.concat_ws("\t", "qid", "doc_id", "grade").alias("value"), (F.col("doc_id") + 1).alias("line_no"))
    more = spark.createDataFrame([("query-id\tcorpus-id\tscore", 0), ("short line", 1)], "value string, line_no long")
    return readers.qrels(lines.unionByName(more))


_BM25 = f"""bt AS MATERIALIZED (SELECT doc_id, list_filter({fx.sql_tokens("text")}, lambda x: length(x) > 1) AS w FROM documents),
bl AS (SELECT doc_id, len(w) AS dl FROM bt), ba AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM bl),
btf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM bt) GROUP BY ALL),
bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY term), braw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM bdf, ba),
bidf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM braw) ELSE raw END AS idf FROM braw),
bq AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter({fx.sql_tokens("text")}, lambda x: length(x) > 1)) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT qid, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM bq JOIN btf USING (term) JOIN bidf USING (term) JOIN bl USING (doc_id), ba GROUP BY ALL),
bm25 AS MATERIALIZED (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 100)"""
_DENSE = f"""dv AS MATERIALIZED (SELECT doc_id, {fx.sql_h("text")} % {_N} AS v FROM documents), dq AS (SELECT item_id AS qid, {fx.sql_h("text")} % {_N} AS qv FROM benchmark),
dense AS MATERIALIZED (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM (SELECT qid, doc_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM dq JOIN embeddings a ON a.vec_id = qv CROSS JOIN dv JOIN embeddings b ON b.vec_id = v) QUALIFY rank <= 100)"""


def _bm25(spark, sf):
    return runs.bm25(fx.documents(spark, sf), fx.queries(spark, sf))


def _dense(spark, sf):
    v, of = fx.vectors(spark, sf), fx.vec_id_of(spark, sf)
    docs = fx.documents(spark, sf).select("doc_id", of(F.col("text")).alias("vec_id")).join(v, "vec_id")
    asked = fx.queries(spark, sf).select("qid", of(F.col("text")).alias("vec_id")).join(v, "vec_id").select("qid", "vec")
    return runs.dense(docs, asked)


@query(f"WITH {_BM25} SELECT qid, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM bm25 WHERE score > 0")
def bm25(spark, sf):
    return _bm25(spark, sf).select("qid", "doc_id", "rank", six("score"))


@query(f"WITH {_BM25} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM bidf")
def bm25_idf(spark, sf):
    return runs.bm25_idf(runs.tokenised(fx.documents(spark, sf))).select("term", "df", six("idf"))


@query(f"WITH {_DENSE} SELECT qid, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 5) AS score FROM dense")
def dense_run(spark, sf):
    return _dense(spark, sf).select("qid", "doc_id", "rank", F.round("score", 5).alias("score"))


_ORACLE_RUN = "orc AS (SELECT qid, doc_id, CAST(count(*) OVER (PARTITION BY qid) - row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) + 1 AS DOUBLE) AS score FROM qrels WHERE grade > 0 AND doc_id IN (SELECT doc_id FROM facts))"


@query(f"WITH {fx.SQL_FACTS}, {fx.SQL_QRELS}, {_ORACLE_RUN} SELECT * FROM orc")
def oracle_run(spark, sf):
    return runs.oracle(fx.qrels(spark, sf), fx.facts(spark, sf))


@query(f"WITH {fx.SQL_FACTS}, {fx.SQL_QRELS}, r AS (SELECT * FROM qrels WHERE doc_id IN (SELECT doc_id FROM facts)) SELECT qid, doc_id, CAST(grade AS INTEGER) AS grade FROM r WHERE qid IN (SELECT qid FROM r WHERE grade > 0)")
def restricted_qrels(spark, sf):
    return metrics.restricted(fx.qrels(spark, sf), fx.facts(spark, sf))


_RUNS = f"{_BM25}, {_DENSE}, runs AS MATERIALIZED (SELECT 'bm25' AS system, qid, doc_id, score FROM bm25 WHERE score > 0 UNION ALL SELECT 'dense', qid, doc_id, round(score, 6) FROM dense)"


def _runs(spark, sf):
    rows = lambda df, name: df.select(F.lit(name).alias("system"), "qid", "doc_id", six("score") if name == "dense" else "score")
    return rows(_bm25(spark, sf), "bm25").unionByName(rows(_dense(spark, sf), "dense"))


@query(f"WITH {_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY system, qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM runs) SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM k GROUP BY ALL")
def rrf(spark, sf):
    return runs.rrf(_runs(spark, sf)).select("qid", "doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_RUNS} SELECT system, qid, doc_id, CAST(row_number() OVER (PARTITION BY system, qid ORDER BY round(score, 9) DESC, doc_id) AS BIGINT) AS rank FROM runs")
def rank_docs(spark, sf):
    order = W.partitionBy("system", "qid").orderBy(F.round("score", 9).desc(), "doc_id")
    return _runs(spark, sf).select("system", "qid", "doc_id", F.row_number().over(order).cast("long").alias("rank"))


_CUT = lambda name, value: ", ".join(f"coalesce(sum({value}) FILTER (rank <= {k}), 0) AS {name}_{k}" for k in metrics.CUTS)
_PER_QUERY = f"""{_RUNS}, {fx.SQL_QRELS}, jd AS (SELECT * FROM qrels WHERE qid IN (SELECT qid FROM qrels WHERE grade > 0)),
ideal AS (SELECT qid, count(*) FILTER (grade > 0) AS relevant, {_CUT("idcg", "grade / log2(rank + 1)")} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS rank FROM jd) GROUP BY qid),
hits AS (SELECT *, sum(CAST(grade > 0 AS INT)) OVER (PARTITION BY system, qid ORDER BY rank) AS found FROM (SELECT r.system, r.qid, r.doc_id, coalesce(j.grade, 0) AS grade, row_number() OVER (PARTITION BY r.system, r.qid ORDER BY round(r.score, 9) DESC, r.doc_id) AS rank FROM runs r LEFT JOIN jd j USING (qid, doc_id))),
got AS (SELECT system, qid, count(*) AS n, {_CUT("dcg", "grade / log2(rank + 1)")}, {_CUT("hits", "CAST(grade > 0 AS INT)")}, coalesce(sum(found / rank) FILTER (grade > 0), 0) AS precisions, min(rank) FILTER (grade > 0) AS first FROM hits GROUP BY system, qid),
pq AS (SELECT s.system, i.qid, {", ".join(f"coalesce(dcg_{k}, 0) / idcg_{k} AS ndcg_{k}" for k in metrics.CUTS)}, {", ".join(f"coalesce(hits_{k}, 0) / {k} AS p_{k}" for k in metrics.CUTS)}, {", ".join(f"coalesce(hits_{k}, 0) / relevant AS recall_{k}" for k in metrics.CUTS)},
 coalesce(precisions, 0) / relevant AS ap, coalesce(1.0 / first, 0) AS rr, CAST(coalesce(n, 0) AS BIGINT) AS n_retrieved FROM ideal i CROSS JOIN (SELECT DISTINCT system FROM runs) s LEFT JOIN got g ON g.qid = i.qid AND g.system = s.system)"""
_METRICS = [f"{m}_{k}" for m in ("ndcg", "p", "recall") for k in metrics.CUTS]


def _per_query(spark, sf):
    return metrics.per_query(stored(_runs(spark, sf), "runs"), fx.qrels(spark, sf), systems=["bm25", "dense"])


def _measure(name: str, columns: list[str]) -> None:
    @query(f"WITH {_PER_QUERY} SELECT system, qid, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM pq", name)
    def one(spark, sf):
        return _per_query(spark, sf).select("system", "qid", *map(six, columns))


_measure("ndcg", [c for c in _METRICS if c.startswith("ndcg")])
_measure("precision_recall", [c for c in _METRICS if not c.startswith("ndcg")])
_measure("average_precision", ["ap"])
_measure("mrr", ["rr"])


@query(f"WITH {_PER_QUERY} SELECT system, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _METRICS)}, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, CAST(count(*) AS BIGINT) AS n_queries, round(avg(n_retrieved), 6) AS n_retrieved FROM pq GROUP BY system")
def evaluate_run(spark, sf):
    return metrics.means(_per_query(spark, sf)).select("system", *map(six, _METRICS), six("map"), six("mrr"), "n_queries", six("n_retrieved"))


@query(f"WITH {_PER_QUERY}, d AS (SELECT x.ndcg_10 AS a, y.ndcg_10 AS b FROM pq x JOIN pq y USING (qid) WHERE x.system = 'bm25' AND y.system = 'dense') SELECT CAST(count(*) AS BIGINT) AS n_queries, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS diff, CAST(count(*) FILTER (a - b > 1e-12) AS BIGINT) AS wins, CAST(count(*) FILTER (a - b < -1e-12) AS BIGINT) AS losses, CAST(count(*) FILTER (abs(a - b) <= 1e-12) AS BIGINT) AS ties FROM d")
def win_loss_tie(spark, sf):
    r = metrics.win_loss_tie(metrics.paired(_per_query(spark, sf), "bm25", "dense", "ndcg_10"))
    return r.select("n_queries", six("mean_a"), six("mean_b"), six("diff"), "wins", "losses", "ties")


_PAIRS = [("bm25 - dense", "bm25", "dense", "ndcg_10"), ("dense - bm25, ap", "dense", "bm25", "ap"), ("search - bm25", "search", "bm25", "ndcg_10")]


def _comparisons(spark, sf):
    """Fixed comparisons; that with a system which has no run falls away."""
    return metrics.compared(_per_query(spark, sf), spark.createDataFrame(_PAIRS, "comparison string, system_a string, system_b string, metric string"))


_COMPARED = f"""WITH {_PER_QUERY}, cmp AS (SELECT 'bm25 - dense' AS comparison, x.qid, x.ndcg_10 AS a, y.ndcg_10 AS b FROM pq x JOIN pq y USING (qid) WHERE x.system = 'bm25' AND y.system = 'dense'
 UNION ALL SELECT 'dense - bm25, ap', x.qid, x.ap, y.ap FROM pq x JOIN pq y USING (qid) WHERE x.system = 'dense' AND y.system = 'bm25')"""


@query(f"{_COMPARED} SELECT comparison, qid, round(a, 6) AS a, round(b, 6) AS b FROM cmp")
def comparisons(spark, sf):
    return _comparisons(spark, sf).select("comparison", "qid", six("a"), six("b"))


_DRAWS = 2000


@query(f"""{_COMPARED}, dl AS MATERIALIZED (SELECT comparison, list(a - b ORDER BY qid) AS l, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS diff, count(*) FILTER (a - b > 1e-12) AS wins, count(*) FILTER (a - b < -1e-12) AS losses, count(*) FILTER (abs(a - b) <= 1e-12) AS ties FROM cmp GROUP BY comparison),
ds AS (SELECT comparison, diff, r, avg(l[CAST(('0x' || substr(md5(r || '-' || j || '-12345'), 1, 8)) AS BIGINT) % n + 1]) AS m FROM (SELECT comparison, l, n, diff, r, unnest(range(n)) AS j FROM (SELECT *, unnest(range({_DRAWS})) AS r FROM dl)) GROUP BY comparison, diff, r),
dm AS (SELECT comparison, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, avg(CAST(abs(m - diff) >= abs(diff) - 1e-12 AS DOUBLE)) AS p FROM ds GROUP BY comparison)
SELECT comparison, CAST(n AS BIGINT) AS n_queries, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(diff, 6) AS diff, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(ties AS BIGINT) AS ties, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM dl JOIN dm USING (comparison)""")
def bootstrap(spark, sf):
    """With 2,000 resamples here, for the SQL's sake; 10,000 are the operator's own."""
    r = metrics.bootstrap(_comparisons(spark, sf), resamples=_DRAWS)
    return r.select("comparison", "n_queries", *map(six, ("mean_a", "mean_b", "diff")), "wins", "losses", "ties", *map(six, ("ci_low", "ci_high", "p")), "stars")


@query(f"WITH {fx.SQL_FACTS} SELECT 'full' AS frame, doc_id FROM documents UNION ALL SELECT DISTINCT 'restricted', doc_id FROM facts")
def frames(spark, sf):
    return metrics.framed(fx.documents(spark, sf).select("doc_id"), fx.facts(spark, sf))


# Extraction.


@query(f"{_PIPE} SELECT CAST(r.doc_id AS VARCHAR) AS doc_id, r.head AS head, {_NORM('r.raw_head')} AS head_type, r.verb, r.tail, {_NORM('r.raw_tail')} AS tail_type FROM records r WHERE r.tail <> ''")
def facts_from_records(spark, sf):
    return fact_ops.facts_of_checkpoint(fx.pipeline(spark, sf))


@query(f"{_PIPE} SELECT id, CAST(count(*) AS BIGINT) AS n FROM records GROUP BY id")
def iter_triplets(spark, sf):
    p = fx.pipeline(spark, sf).where("status = 'done' AND step4_triplets_json IS NOT NULL")
    return p.select("id", F.explode(fact_ops.payload_records(F.col("step4_triplets_json")))).groupBy("id").agg(F.count("*").alias("n"))


@query(f"{_PIPE} SELECT id AS doc_id, CAST(count(*) AS BIGINT) AS n FROM records WHERE tail <> '' GROUP BY id")
def triplets_from_json(spark, sf):
    p = fx.pipeline(spark, sf).where("step4_triplets_json LIKE '{%' OR step4_triplets_json LIKE '[%'")
    exported = p.select(F.concat(F.lit('{"'), "id", F.lit('":'), "step4_triplets_json", F.lit("}")).alias("value"))
    return readers.facts_of_export(exported).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"{_PIPE} SELECT p.id, CAST(count(r.i) FILTER (r.tail <> '') AS BIGINT) AS kept, CAST(count(r.i) FILTER (r.tail = '') AS BIGINT) AS dropped FROM pipeline p LEFT JOIN records r ON r.id = p.id WHERE p.k IN (4, 6, 8) GROUP BY p.id")
def clean_triplets(spark, sf):
    p = fx.pipeline(spark, sf).where("step4_triplets_json LIKE '{%'").select("id", extraction.cleaned_triplets(F.col("step4_triplets_json")).alias("c"))
    return p.select("id", F.col("c.kept").cast("long").alias("kept"), F.col("c.dropped").cast("long").alias("dropped"))


@query(f"{_PIPE} SELECT id, CASE WHEN s1 IS NULL THEN 'step1_pronoun_resolved' WHEN s2 IS NULL THEN 'step2_references_resolved' WHEN s3 IS NULL THEN 'step3_flattened' WHEN NOT has4 THEN 'step4_triplets_json' END AS next FROM pipeline")
def next_step(spark, sf):
    return fx.pipeline(spark, sf).select("id", extraction.next_step().alias("next"))


@query(f"{_PIPE} SELECT id, status, updated_at FROM pipeline WHERE NOT has4 AND status <> 'failed'")
def pending_ids(spark, sf):
    return extraction.pending(fx.pipeline(spark, sf)).select("id", "status", "updated_at")


@query(f"{_PIPE} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'done') AS BIGINT) AS done, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (status NOT IN ('done', 'failed')) AS BIGINT) AS pending, CAST(count(s1) AS BIGINT) AS step1_pronoun_resolved, CAST(count(s2) AS BIGINT) AS step2_references_resolved, CAST(count(s3) AS BIGINT) AS step3_flattened, CAST(count(*) FILTER (has4) AS BIGINT) AS step4_triplets_json FROM pipeline")
def pipeline_stats(spark, sf):
    return extraction.stats(fx.pipeline(spark, sf))


@query(f"{_PIPE} SELECT id, CASE WHEN k IN (0, 1, 3) THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, CAST(attempts + CAST(k IN (0, 1, 3) AS INT) AS INTEGER) AS attempts, CASE WHEN k IN (0, 1, 3) THEN 'no answer' ELSE error END AS error FROM pipeline")
def fail_transition(spark, sf):
    p = fx.pipeline(spark, sf)
    failures = p.where("step2_references_resolved IS NULL OR status = 'failed'").select("id", F.lit("no answer").alias("error"))
    return extraction.fail(p, failures, F.lit(0.0)).select("id", "status", "attempts", "error")


@query(f"{_PIPE} SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts, CAST(NULL AS VARCHAR) AS error FROM pipeline")
def reset_failed(spark, sf):
    return extraction.reset_failed(fx.pipeline(spark, sf)).select("id", "status", "attempts", "error")


@query(f"{_PIPE} SELECT id, CASE WHEN k = 3 THEN 'done' ELSE status END AS status, CASE WHEN k <> 3 THEN error END AS error, CASE WHEN k = 3 THEN 5000.0 ELSE updated_at END AS updated_at FROM pipeline")
def record(spark, sf):
    p = fx.pipeline(spark, sf)
    results = p.where("status = 'failed'").select("id", F.lit("step4_triplets_json").alias("step"), F.lit('{"triplets":[]}').alias("value"))
    return extraction.record(p, results, F.lit(5000.0)).select("id", "status", "error", "updated_at")


@query(f"{_PIPE} SELECT id, status, attempts FROM pipeline UNION ALL SELECT 'new' || doc_id, 'pending', 0 FROM documents")
def enqueue(spark, sf):
    p = fx.pipeline(spark, sf)
    units = p.select("id", "original_text").unionByName(fx.documents(spark, sf).select(F.concat(F.lit("new"), "doc_id").alias("id"), F.col("text").alias("original_text")))
    return extraction.enqueue(p, units).select("id", "status", "attempts")


def _stand_ins():
    rewrite = lambda: lambda texts: [f" {t}\n" for t in texts]

    def reply(text: str) -> str:
        """A record of the first and last word, whatever characters they have; of a text without words, of a dash."""
        w = text.split() or ["-"]
        return json.dumps({"triplets": [{"e1": w[0], "e1_type": "food", "verb": "precedes", "e2": w[-1], "e2_type": "DRUG"}]})

    return rewrite, lambda: lambda texts: [reply(t) for t in texts]


@query(rf"""{_PIPE} SELECT id, CASE WHEN has4 OR status = 'failed' THEN status ELSE 'done' END AS status, attempts, CASE WHEN has4 OR status = 'failed' THEN error END AS error,
 CASE WHEN s1 IS NULL THEN md5(regexp_replace(original_text, '^\s+|\s+$', '', 'g')) ELSE md5(s1) END AS step1, CASE WHEN status = 'failed' OR s2 IS NOT NULL THEN md5(s2) WHEN s1 IS NULL THEN md5(regexp_replace(original_text, '^\s+|\s+$', '', 'g')) ELSE md5(regexp_replace(s1, '^\s+|\s+$', '', 'g')) END AS step2 FROM pipeline""")
def pipeline_run(spark, sf):
    """With stand-ins for the models: rewrites pass text on with white space around it, and the extractor makes a record of the first and last word."""
    rewrite, extract = _stand_ins()
    out = extraction.run_pipeline(fx.pipeline(spark, sf), [rewrite, rewrite], extract, F.lit(9000.0))
    return out.select("id", "status", "attempts", "error", F.md5("step1_pronoun_resolved").alias("step1"), F.md5("step2_references_resolved").alias("step2"))


@query(f"""{_PIPE} SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS completed, CAST(0 AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS triplets, CAST(0 AS BIGINT) AS rejected_rewrites,
 CAST(count(*) FILTER (s1 IS NULL) AS BIGINT) AS calls_step1, CAST(count(*) FILTER (s2 IS NULL) AS BIGINT) AS calls_step2, CAST(count(*) FILTER (s3 IS NULL) AS BIGINT) AS calls_step3, CAST(count(*) AS BIGINT) AS calls_step4 FROM pipeline WHERE NOT has4 AND status <> 'failed'""")
def run_counters(spark, sf):
    rewrite, extract = _stand_ins()
    before = fx.pipeline(spark, sf)
    return extraction.run_counters(before, extraction.run_pipeline(before, [rewrite, rewrite], extract, F.lit(9000.0)))


@query("SELECT doc_id, greatest(1.0, least(120.0, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 200 AS DOUBLE) ELSE 2.0 * pow(2.0, doc_id % 8) END) * (1 + 0.5 * (2 * ((doc_id % 101) / 100.0) - 1))) AS seconds FROM documents")
def backoff(spark, sf):
    d = F.col("doc_id")
    return fx.documents(spark, sf).select("doc_id", chat.wait_seconds(d % 8, F.when(d % 3 == 0, d % 200), (d % 101) / 100.0).alias("seconds"))


@query(f"WITH {fx.SQL_PATTERNS} SELECT item_id AS qid, CAST((SELECT count(*) FROM patterns p WHERE p.qid = item_id) AS BIGINT) AS n FROM benchmark WHERE item_id % 2 = 1")
def rewrite_questions(spark, sf):
    """Questions to patterns through a stand-in for the model, for those without a reply in the cache."""
    replies = fx.replies(spark, sf).join(fx.queries(spark, sf), "qid")
    cache = replies.where("qid % 2 = 0").select("qid", "reply")
    new = chat.pattern_replies(replies.select("qid", F.col("reply").alias("text")), cache, lambda: lambda texts: [f"<think>{t}</think> {t}" for t in texts])
    return new.join(patterns.parse_replies(new).groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# Distillation.


@query(f"{_PIPE} SELECT id FROM pipeline WHERE status = 'done' AND has4")
def completed_rows(spark, sf):
    return distill.completed(fx.pipeline(spark, sf)).select("id")


@query(f"""{_PIPE}, v AS (SELECT id, CASE WHEN trim(original_text) = '' THEN 'empty original_text' WHEN s1 IS NULL OR trim(s1) = '' THEN 'empty step1_pronoun_resolved' WHEN s2 IS NULL OR trim(s2) = '' THEN 'empty step2_references_resolved' WHEN s3 IS NULL OR trim(s3) = '' THEN 'empty step3_flattened' WHEN NOT has4 THEN 'empty step4_triplets_json'
 WHEN k = 9 THEN 'step4 invalid JSON' WHEN k IN (5, 7) THEN 'step4 missing triplets array' WHEN len(w) < 5 THEN 'step4 has 0 triplets' ELSE 'ok' END AS reason FROM pipeline) SELECT id, reason FROM v""")
def validate_rows(spark, sf):
    return fx.pipeline(spark, sf).select("id", distill.reason().alias("reason"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id HAVING count(*) = 3")
def sharegpt(spark, sf):
    c = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).where("size(t) = 3")
    return c.select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("rendered"))


@query(f"""{_PIPE}, s AS (SELECT unnest(['step1', 'step2', 'step4']) AS stage, unnest([3 + length(original_text) + length(s1), 3 + length(s1) + length(s2), 3 + {len(distill.REQUEST)} + length(s3) + 10]) AS chars FROM pipeline WHERE k >= 4),
o AS (SELECT stage, list_sort(list(chars)) AS l FROM s GROUP BY stage) SELECT stage, CAST(len(l) AS BIGINT) AS n, CAST(l[1] AS BIGINT) AS least, CAST(l[len(l) // 2 + 1] AS BIGINT) AS median, CAST(l[CAST(floor(len(l) * 0.9) AS BIGINT) + 1] AS BIGINT) AS p90, CAST(l[CAST(floor(len(l) * 0.99) AS BIGINT) + 1] AS BIGINT) AS p99, CAST(l[-1] AS BIGINT) AS most FROM o""")
def char_stats(spark, sf):
    rows = distill.completed(fx.pipeline(spark, sf)).withColumn("step4_triplets_json", F.lit("0123456789"))
    return distill.length_stats(distill.samples(rows, {"step1": "one", "step2": "two", "step4": "six"})).select("stage", *map(long, ("n", "least", "median", "p90", "p99", "most")))


@query(f"{_PIPE} SELECT id, row_number() OVER (ORDER BY md5(id || '-42'), id) <= 50 AS is_eval FROM pipeline WHERE status = 'done' AND has4")
def split(spark, sf):
    return distill.split(distill.completed(fx.pipeline(spark, sf)).select("id"), 50)


# Texts whose words are made distinct by their places, with words changed at places that the document's class decides.
_CHANGED = {"want": "CASE WHEN k = 0 THEN false ELSE i % 50 = 2 END", "got": "CASE k WHEN 0 THEN doc_id % 2 = 1 AND i % 50 = 3 WHEN 1 THEN i % 50 = 2 WHEN 2 THEN false WHEN 3 THEN i % 100 = 2 WHEN 4 THEN i % 100 = 2 OR i % 50 = 4 WHEN 5 THEN i % 50 = 4 ELSE i % 50 = 2 END"}
_EDITS = f"""WITH ew AS (SELECT doc_id, doc_id % 7 AS k, {fx.sql_tokens("text")} AS w FROM documents),
ec AS (SELECT doc_id, k, w, {", ".join(f"list_filter(range(0, len(w)), lambda i: {c}) AS {n}" for n, c in _CHANGED.items())} FROM ew),
em AS (SELECT *, len(list_intersect(want, got)) AS tp, len(got) - len(list_intersect(want, got)) AS fp, len(want) - len(list_intersect(want, got)) AS fn, want = got AND (k <> 6 OR len(want) = 0) AS exact, len(want) = 0 AS unchanged FROM ec),
ep AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE CAST(fn = 0 AS DOUBLE) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall FROM em),
ed AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
 CASE WHEN unchanged AND exact THEN 'EXACT (no-change)' WHEN unchanged THEN 'HALLUCINATION' WHEN exact THEN 'EXACT' WHEN tp = 0 AND fp = 0 THEN 'MISSED ALL' WHEN tp > 0 AND fp = 0 THEN 'PARTIAL (conservative)' WHEN tp > 0 THEN 'PARTIAL (mixed)' ELSE 'OVER-EDITED' END AS category FROM ep)"""


def _edits(spark, sf, alike=True):
    d = fx.documents(spark, sf).select("doc_id", (F.col("doc_id") % 7).alias("k"), F.transform(tx.alnum_tokens(F.col("text")), lambda x, i: F.concat(x, F.lit("_"), i.cast("string"))).alias("w"))

    def made(where: str, mark) -> Column:
        return F.array_join(F.transform("w", lambda x, i: F.when(_at(where, i), F.concat(x, mark)).otherwise(x)), " ")

    d = d.select("doc_id", "k", F.array_join("w", " ").alias("text"), made("want", F.lit("r")).alias("reference"), made("got", F.when(F.col("k") == 6, "q").otherwise("r")).alias("prediction"))
    return d.withColumn("m", distill.edit_metrics("text", "reference", "prediction", alike))


def _at(which: str, i: Column) -> Column:
    """_CHANGED as a Column."""
    k, five, ten = F.col("k"), i % 50, i % 100
    if which == "want":
        return (k != 0) & (five == 2)
    return F.when(k == 0, (F.col("doc_id") % 2 == 1) & (five == 3)).when(k.isin(1, 6), five == 2).when(k == 2, F.lit(False)).when(k == 3, ten == 2).when(k == 4, (ten == 2) | (five == 4)).otherwise(five == 4)


def _edits_twice(spark, sf, alike=True):
    """With the prediction put right in every second document, as post-processing would."""
    d = _edits(spark, sf, alike).withColumn("after", F.when(F.col("doc_id") % 2 == 0, F.col("reference")).otherwise(F.col("prediction")))
    return d.withColumnRenamed("m", "raw").withColumn("processed", distill.edit_metrics("text", "reference", "after", alike))


_MEAN = lambda c: f"round(avg({c}) FILTER (NOT unchanged), 6) AS {c}"


@query(f"{_EDITS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (exact) AS BIGINT) AS exact, {_MEAN('precision')}, {_MEAN('recall')}, {_MEAN('f1')}, CAST(count(*) FILTER (unchanged) AS BIGINT) AS unchanged, CAST(count(*) FILTER (unchanged AND NOT exact) AS BIGINT) AS hallucinated FROM ed")
def edit_agg(spark, sf):
    """All of the summary but the characters' similarity, which SQL can't compute."""
    return distill.edit_summary(_edits(spark, sf, alike=False)).select("n", "exact", *map(six, ("precision", "recall", "f1")), "unchanged", "hallucinated")


@query(f"""{_EDITS}, two AS (SELECT category, 0 AS after FROM ed UNION ALL SELECT CASE WHEN doc_id % 2 = 1 THEN category WHEN unchanged THEN 'EXACT (no-change)' ELSE 'EXACT' END, 1 FROM ed)
SELECT category, CAST(count(*) FILTER (after = 0) AS BIGINT) AS n_raw, CAST(count(*) FILTER (after = 1) AS BIGINT) AS n_processed, CAST(count(*) FILTER (after = 1) - count(*) FILTER (after = 0) AS BIGINT) AS delta FROM two GROUP BY category""")
def edit_hist(spark, sf):
    return distill.category_histogram(_edits_twice(spark, sf, alike=False))


@query(f"""{_EDITS} SELECT doc_id, array_to_string(list_transform(want[1:8], lambda i: w[i + 1] || '_' || i || 'r -> ' || w[i + 1] || '_' || i || 'q'), ', ') AS differences FROM ed WHERE k = 6 AND len(want) > 0""")
def edit_other_form(spark, sf):
    """The diagnostics' first kind; the second goes by similarity."""
    found = distill.edit_diagnostics(_edits(spark, sf, alike=False), "reference", "prediction").where("kind = 'right words, other form'")
    return found.select("doc_id", F.array_join("differences", ", ").alias("differences"))


@query()
def edit_delta(spark, sf):
    return distill.edit_delta(_edits_twice(spark, sf))


@query()
def edit_diag(spark, sf):
    return distill.edit_diagnostics(_edits(spark, sf), "reference", "prediction").select("doc_id", "kind", "differences")


@query(f"""{_EDITS}, v AS (SELECT avg(f1) FILTER (NOT unchanged) AS f1, count(*) FILTER (exact) / count(*) AS e, count(*) FILTER (unchanged AND NOT exact) / nullif(count(*) FILTER (unchanged), 0) AS h, avg(recall) FILTER (NOT unchanged) AS r FROM ed),
t AS (SELECT unnest(['f1', 'exact_share', 'hallucinated_share', 'recall']) AS target, unnest([f1, e, h, r]) AS value, unnest([0.80, 0.50, 0.10, 0.75]) AS bound FROM v)
SELECT target, round(value, 6) AS value, CASE WHEN target = 'hallucinated_share' THEN value <= bound ELSE value >= bound END AS met FROM t WHERE value IS NOT NULL""")
def edit_verdict(spark, sf):
    """Without the target of similarity, which SQL can't compute."""
    return distill.verdict(distill.edit_summary(_edits(spark, sf, alike=False))).where("target <> 'similarity'").select("target", six("value"), "met")


@query(f"""{_PIPE}, r AS (SELECT unnest([94 + length(original_text) + length(s1), 94 + length(s1) + length(s2), 94 + 43 + length(s3) + 10]) AS chars, unnest(['step1', 'step2', 'step4']) AS stage FROM pipeline WHERE k >= 4)
SELECT stage, CAST(count(*) AS BIGINT) AS n, quantile_cont(chars, 0.5) AS p50, quantile_cont(chars, 0.9) AS p90, quantile_cont(chars, 0.95) AS p95, quantile_cont(chars, 0.99) AS p99, CAST(max(chars) AS BIGINT) AS most, CAST(count(*) FILTER (chars > 2000) AS BIGINT) AS over FROM r GROUP BY stage""")
def token_stats(spark, sf):
    """With characters for tokens: the tokenizer is the caller's."""
    rows = distill.completed(fx.pipeline(spark, sf)).withColumn("step4_triplets_json", F.lit("0123456789"))
    return distill.token_stats(distill.samples(rows, {"step1": "one", "step2": "two", "step4": "six"}, "x" * 43), F.char_length, 2000)


@query(f"""{_PIPE}, c AS (SELECT id, s3 IS NOT NULL AND trim(s3) <> '' AND k IN (4, 6, 8) AND len(w) >= 5 AND trim(original_text) <> '' AND trim(s1) <> '' AND trim(s2) <> '' AS ok FROM pipeline)
SELECT CAST(count(*) FILTER (ok) AS BIGINT) AS n_valid, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS n_invalid, CAST(count(*) FILTER (ok AND id NOT LIKE '%7') AS BIGINT) AS n_train, CAST(count(*) FILTER (ok AND id LIKE '%7') AS BIGINT) AS n_eval FROM c""")
def dataset_meta(spark, sf):
    return sinks.dataset_meta(fx.pipeline(spark, sf).select(distill.reason().alias("reason"), F.col("id").endswith("7").alias("is_eval")))


@query("SELECT vec_id, 'retrieval_passage_' || (CASE WHEN vec_id % 2 = 0 THEN 32 ELSE 512 END) AS ns, substr(sha1('m|retrieval.passage|' || (CASE WHEN vec_id % 2 = 0 THEN 32 ELSE 512 END)), 1, 12) AS fingerprint FROM embeddings")
def encoder_roles(spark, sf):
    """Texts encoded as nodes and as documents, by a stand-in for the encoder."""
    texts = fx.vectors(spark, sf).select("vec_id", F.col("vec_id").cast("string").alias("text"))
    encoder_of = lambda role: lambda: lambda batch: np.ones((len(batch), 2))
    parts = [vectors.encoded_as(role, texts.where(F.col("vec_id") % 2 == k), encoder_of, "m") for k, role in enumerate((vectors.NODES, vectors.DOCUMENTS))]
    return parts[0].unionByName(parts[1]).select(F.col("text").cast("long").alias("vec_id"), "ns", "fingerprint")


@query(f"WITH {fx.SQL_FACTS} SELECT fact_id, doc_id, head, verb, tail FROM facts WHERE fact_id % 50 = 0")
def graph_roundtrip(spark, sf):
    """Facts and vectors of their texts, written as a graph and opened again."""
    facts = fx.facts(spark, sf).where("fact_id % 50 = 0")
    texts = fact_ops.long_subspaces(facts.drop("pair", "full")).select("text").distinct()
    path = shared_dir(spark, "graph")
    sinks.write_facts(facts, texts.select("text", F.array(F.lit(1.0)).alias("vec")), path)
    return readers.read_facts(spark, path).select("fact_id", "doc_id", "head", "verb", "tail")


@query("SELECT DISTINCT l.doc_id, d.source AS title FROM labels l LEFT JOIN documents d USING (doc_id)")
def title_lookup(spark, sf):
    hits = fx.table(spark, sf, "labels").select("doc_id").distinct()
    return readers.titles(hits, fx.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title")))


@query(f"{_EDITS} SELECT doc_id, array_to_string(list_transform(list_filter(range(0, len(w)), lambda i: i % 4 <> 1), lambda i: w[i + 1] || '_' || i || CASE WHEN k <> 0 AND i % 50 = 2 THEN 'r' ELSE '' END), ' ') AS anchored FROM ec")
def anchor(spark, sf):
    """Replies that leave out every fourth word of a text and change others, anchored to it."""
    d = _edits(spark, sf).select("doc_id", "text", F.array_join(F.filter(F.split("reference", " "), lambda x, i: i % 4 != 1), " ").alias("reply"))
    return d.select("doc_id", distill.anchored("text", "reply").alias("anchored"))


@query(f"""{_EDITS}, o AS (SELECT doc_id AS id, len(list_filter(got, lambda i: NOT list_contains(got, i - 1))) AS n FROM ec)
SELECT id, CAST(n AS BIGINT) AS operations, c AS copy, md5(id || '-' || c || '-42') AS place FROM (SELECT id, n, unnest(range(1, CASE WHEN n BETWEEN 1 AND 3 THEN 3 ELSE 4 END)) AS c FROM o)""")
def rebalance(spark, sf):
    d = _edits(spark, sf).select(F.col("doc_id").alias("id"), distill.edit_operations("text", "prediction").alias("operations"))
    return distill.rebalanced(d, "operations").select("id", "operations", long("copy"), "place")
