"""Soft-pattern retrieval for a whole batch of queries in one plan.

What a pattern's shape asks for is data: SHAPES lists, for each, the scans and rescans that score facts. A base scan
ranks the facts that the shape's types admit by similarity in one subspace; a rescan scores the base scan's facts in another; the mean over
the scores present is the pattern's score of a fact. Ties are broken by fact_id, then doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import dot, spaced
from factloom.operators.facts import SUBSPACES, rendered
from factloom.operators.vectors import nearest
from factloom.sources.stored import stored


@dataclass(frozen=True)
class RetrievalConfig:
    slot_top_k: int = 2000
    per_pattern: int = 100
    query_channel: bool = True
    query_channel_k: int = 100
    aggregation: str = "max"


#: (shapes, types that facts must have, [(role, subspace, slots of the text; q: the question)]). Shapes that aren't listed match nothing.
SHAPES = [
    (["Tcc"], "head", [("base", "tail", "t"), ("rescan", "full", "rt")]),
    (["T?c", "TTc"], "head", [("base", "tail", "t")]),
    (["ccT"], "tail", [("base", "head", "h"), ("rescan", "full", "hr")]),
    (["c?T", "cTT"], "tail", [("base", "head", "h")]),
    (["TcT"], "both", [("base", "verb", "r")]),
    (["T?T", "TTT"], "both", [("base", "full", "q")]),
    (["Tc?"], "head", [("base", "verb", "r")]),
    (["?cT"], "tail", [("base", "verb", "r")]),
    (["ccc"], "none", [("base", "full", "hrt")]),
    (["c?c", "cTc"], "none", [("side", "head", "h"), ("side", "tail", "t"), ("pair", "pair", "ht")]),
    (["cc?"], "none", [("base", "head", "h"), ("rescan", "full", "hr")]),
    (["c??", "cT?"], "none", [("base", "head", "h")]),
    (["?cc"], "none", [("base", "tail", "t"), ("rescan", "full", "rt")]),
    (["??c", "?Tc"], "none", [("base", "tail", "t")]),
    (["?c?"], "none", [("base", "verb", "r")]),
]
QUERY_CHANNEL = 1 << 40


def requests_of(patterns: DataFrame, queries: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(qid, pattern_no, shape, label, component, role, subspace, text, need, head_type, tail_type, k) for each scan that a pattern asks for."""
    plan = []
    for shapes, need, scans in SHAPES:
        wide = len(scans) > 1
        for shape in shapes:
            plan += [(shape, need, i, role, subspace, slots, config.slot_top_k if wide and role in ("base", "side") else config.per_pattern) for i, (role, subspace, slots) in enumerate(scans)]
    spark = patterns.sparkSession
    table = spark.createDataFrame(plan, "shape string, need string, component int, role string, subspace string, slots string, k int")
    h, r, t = F.col("head"), F.col("relation"), F.col("tail")
    text = F.when(F.col("slots") == "q", F.col("question"))
    for slots, value in {"h": h, "t": t, "r": r, "rt": spaced(r, t), "hr": spaced(h, r), "ht": spaced(h, t), "hrt": spaced(h, r, t)}.items():
        text = text.when(F.col("slots") == slots, value)
    label = F.format_string("MEM( %s ^ %s ^ %s )", "head", "relation", "tail")
    asked = patterns.join(F.broadcast(table), "shape").join(queries.select("qid", F.col("text").alias("question")), "qid").select(
        "qid", F.col("pattern_no").cast("long").alias("pattern_no"), "shape", label.alias("label"), "component", "role", "subspace", text.alias("text"), "need",
        F.when(F.col("need").isin("head", "both"), h).otherwise("").alias("head_type"), F.when(F.col("need").isin("tail", "both"), t).otherwise("").alias("tail_type"), "k",
    )
    if config.query_channel:
        raw = queries.select(
            "qid", F.lit(QUERY_CHANNEL).alias("pattern_no"), F.lit("query").alias("shape"), F.concat(F.lit("raw query: "), "text").alias("label"), F.lit(0).alias("component"), F.lit("base").alias("role"),
            F.lit("full").alias("subspace"), "text", F.lit("none").alias("need"), F.lit("").alias("head_type"), F.lit("").alias("tail_type"), F.lit(config.query_channel_k).alias("k"),
        )
        asked = asked.unionByName(raw)
    return asked.where("text <> ''").withColumn("request_id", F.xxhash64("qid", "pattern_no", "component"))


#: What a request may need, and the types that its facts are then joined by.
NEEDS = {"none": [], "head": ["head_type"], "tail": ["tail_type"], "both": ["head_type", "tail_type"]}


def slices_of(postings: DataFrame, vectors: DataFrame, requests: DataFrame) -> DataFrame:
    """For each kind of need that some request has, how many facts have each vector: what nearest() scans instead of the facts.

    The kinds are combinations of subspace and types, so there are few, whatever the number of requests.
    """
    keys = ["subspace", "need", "head_type", "tail_type"]
    kinds = stored(requests.select(keys).distinct(), "kinds")
    finest = stored(postings.groupBy("subspace", "head_type", "tail_type", "vec_id").agg(F.count(F.lit(1)).alias("n")), "counts")
    out = None
    for need, keep in NEEDS.items():
        types = [(F.col(c) if c in keep else F.lit("")).alias(c) for c in NEEDS["both"]]
        part = finest.select("subspace", F.lit(need).alias("need"), *types, "vec_id", "n").join(F.broadcast(kinds), keys, "left_semi").groupBy(*keys, "vec_id").agg(F.sum("n").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.join(vectors, "vec_id").select(*keys, "vec_id", "n", "vec")


def postings_of(facts: DataFrame, vec_id) -> DataFrame:
    """(fact_id, doc_id, subspace, head_type, tail_type, vec_id) of every fact and subspace; vec_id: a function from a text Column to the id of its vector."""
    pairs = ", ".join(f"'{s}', `{s}`" for s in SUBSPACES)
    long = facts.selectExpr("fact_id", "doc_id", "head_type", "tail_type", f"stack({len(SUBSPACES)}, {pairs}) AS (subspace, text)").where("text <> ''")
    return long.withColumn("vec_id", vec_id(F.col("text"))).drop("text")


def top_rows(postings: DataFrame, slices: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, fact_id, doc_id, score): each request's k best facts, by score to six digits, then fact_id."""
    entries = stored(nearest(slices, requests), "entries")
    hits = None
    for need, types in NEEDS.items():  # each by exact keys, so that a frequent vector is dealt out by its types
        part = entries.where(F.col("need") == need).select("request_id", "k", "score", "subspace", "vec_id", *types).join(postings.select("fact_id", "doc_id", "subspace", "vec_id", *types), ["subspace", "vec_id", *types])
        part = part.select("request_id", "k", "fact_id", "doc_id", "score")
        hits = part if hits is None else hits.unionByName(part)
    order = W.partitionBy("request_id").orderBy(F.round("score", 6).desc(), "fact_id")
    return hits.withColumn("nth", F.row_number().over(order)).where("nth <= k").select("request_id", "fact_id", "doc_id", "score")


def scored_facts(facts: DataFrame, vectors: DataFrame, vec_id, patterns: DataFrame, queries: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(qid, pattern_no, shape, label, fact_id, doc_id, score): each pattern's best per_pattern facts.

    Postings, slices and requests are computed once and kept in the shared folder.
    """
    postings = stored(postings_of(facts, vec_id), "postings")
    requests = requests_of(patterns, queries, config)
    vector = vectors.select(F.col("vec_id").alias("text_vec"), "vec")
    requests = stored(requests.withColumn("text_vec", vec_id(F.col("text"))).join(vector, "text_vec"), "requests")
    scanned = requests.where("role <> 'rescan'")
    slices = stored(slices_of(postings, vectors, scanned), "slices")
    scans = top_rows(postings, slices, scanned)
    scans = scans.join(requests.select("request_id", "qid", "pattern_no", "role", "component"), "request_id").drop("request_id")
    base = scans.where("role IN ('base', 'pair')").select("qid", "pattern_no", "fact_id", "doc_id", "score")
    sides = scans.where("role = 'side'").groupBy("qid", "pattern_no", "fact_id", "doc_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
    again = requests.where("role = 'rescan'").select("qid", "pattern_no", F.col("vec").alias("asked"))
    full = postings.where("subspace = 'full'").select("fact_id", "vec_id")
    rescans = base.join(again, ["qid", "pattern_no"]).join(full, "fact_id").join(vectors, "vec_id").select("qid", "pattern_no", "fact_id", "doc_id", dot(F.col("vec"), F.col("asked")).alias("score"))
    combined = base.unionByName(sides).unionByName(rescans).groupBy("qid", "pattern_no", "fact_id", "doc_id").agg(F.avg("score").alias("score"))
    named = requests.select("qid", "pattern_no", "shape", "label").distinct()
    order = W.partitionBy("qid", "pattern_no").orderBy(F.round("score", 6).desc(), "fact_id")
    most = F.when(F.col("pattern_no") == QUERY_CHANNEL, config.query_channel_k).otherwise(config.per_pattern)
    return combined.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth").join(named, ["qid", "pattern_no"])


def best_per_fact(scored: DataFrame) -> DataFrame:
    """Each fact's highest score of a query; of patterns with the same score the first counts."""
    order = W.partitionBy("qid", "fact_id").orderBy(F.round("score", 6).desc(), "pattern_no")
    return scored.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def to_documents(best: DataFrame, aggregation: str = "max", top_k: int | None = None) -> DataFrame:
    """(qid, doc_id, score, n_facts, facts): facts by score; aggregation: max, sum (of all) or sum<N> (of the N best)."""
    order = W.partitionBy("qid", "doc_id").orderBy(F.round("score", 6).desc(), "fact_id")
    ranked = best.withColumn("nth", F.row_number().over(order))
    facts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "fact_id", "score", "shape", "label"))), lambda x: x.dropFields("nth"))
    docs = ranked.groupBy("qid", "doc_id").agg(document_score(aggregation).alias("score"), F.count(F.lit(1)).alias("n_facts"), facts.alias("facts"))
    if top_k is None:
        return docs
    best_docs = W.partitionBy("qid").orderBy(F.round("score", 6).desc(), "doc_id")
    return docs.withColumn("rank", F.row_number().over(best_docs)).where(F.col("rank") <= top_k)


def document_score(aggregation: str) -> Column:
    if aggregation == "max":
        return F.max("score")
    digits = aggregation.removeprefix("sum")
    if not aggregation.startswith("sum") or not (digits == "" or digits.isdigit()):
        raise ValueError(f"aggregation is {aggregation!r}: max, sum or sum<N>")
    n = int(digits or 0)
    return F.sum(F.when(F.col("nth") <= n, F.col("score"))) if n else F.sum("score")


def search(facts: DataFrame, vectors: DataFrame, vec_id, patterns: DataFrame, queries: DataFrame, config: RetrievalConfig | None = None, top_k: int | None = None) -> DataFrame:
    """Ranked documents of every query, with the facts that support them."""
    config = config or RetrievalConfig()
    return to_documents(best_per_fact(scored_facts(facts, vectors, vec_id, patterns, queries, config)), config.aggregation, top_k)


def rendered_hits(documents: DataFrame, facts: DataFrame, n_facts: int = 3) -> DataFrame:
    """One JSON line a document: rank, doc_id, score, its best facts and how many more there are."""
    shown = documents.select("qid", "rank", "doc_id", "score", "n_facts", F.explode(F.slice("facts", 1, n_facts)).alias("f"))
    text = facts.select("fact_id", F.format_string("(%s : %s) -[%s]-> (%s : %s)", "head", "head_type", "verb", "tail", "tail_type").alias("fact"))
    joined = shown.select("qid", "rank", "doc_id", "score", "n_facts", F.col("f.fact_id").alias("fact_id"), F.col("f.score").alias("fact_score"))
    listed = joined.join(text, "fact_id").groupBy("qid", "rank", "doc_id", "score", "n_facts").agg(F.array_sort(F.collect_list(F.struct((-F.round("fact_score", 6)).alias("by"), "fact_id", "fact"))).alias("listed"))
    return listed.select("qid", F.col("rank").cast("long").alias("rank"), F.to_json(F.struct("rank", "doc_id", F.round("score", 6).alias("score"), F.col("listed.fact").alias("facts"), (F.col("n_facts") - F.size("listed")).alias("more"))).alias("json"))


def explained(documents: DataFrame, facts: DataFrame, n_facts: int = 3) -> DataFrame:
    """(qid, doc_id, explanation): a line for the document, one for each of its best facts with the pattern that found it, and how many more there are."""
    shown = documents.select("qid", "doc_id", "score", "n_facts", F.posexplode(F.slice("facts", 1, n_facts)).alias("place", "f"))
    text = facts.select("fact_id", rendered().alias("fact"))
    line = F.concat(F.format_string("    [%.3f] ", F.round("f.score", 6)), F.col("fact"), F.lit("   <- "), F.col("f.label"))
    lines = shown.withColumn("fact_id", F.col("f.fact_id")).join(text, "fact_id").groupBy("qid", "doc_id", "score", "n_facts").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.concat(F.col("doc_id").cast("string"), F.format_string("  score=%.4f", F.round("score", 6)))
    more = F.when(F.col("n_facts") > n_facts, F.concat(F.lit("    ... and "), (F.col("n_facts") - n_facts).cast("string"), F.lit(" more facts")))
    return lines.select("qid", "doc_id", F.concat_ws("\n", head, F.array_join("lines", "\n"), more).alias("explanation"))
