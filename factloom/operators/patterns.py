"""Soft patterns: MEM( head ^ relation ^ tail ) lines, parsed and described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import spaced, strip
from factloom.functions.vocab import slot_kind


# What replies may have before a pattern, how a pattern is wrapped, and what parts its slots.
BEFORE = r"^[\s\-*•\d.)`\"']+"
WRAPPER, WRAPPED = r"(?i)MEM\s*\(", r"(?is)MEM\s*\((.*?)(?:\)|$)"
BETWEEN = r"\s*[\^|]\s*"


def parsed_line(line: Column) -> Column:
    """struct(head, relation, tail, hk, rk, tk, shape) of a line; null if it is no pattern.

    Lists' numbers and bullets before it are passed over; a body ends at the first closing parenthesis; ^ and | separate slots.
    """
    plain = F.regexp_replace(strip(line), BEFORE, "")
    body = F.when(plain.rlike(WRAPPER), F.regexp_extract(plain, WRAPPED, 1)).otherwise(plain)
    part = F.split(body, BETWEEN)
    slot = lambda k: F.regexp_replace(F.regexp_replace(strip(F.get(part, k)), '^"+|"+$', ""), "^'+|'+$", "")
    head, relation, tail = slot(0), slot(1), strip(F.regexp_replace(slot(2), r"\)+$", ""))
    kinds = [slot_kind(x) for x in (head, relation, tail)]
    shape = F.concat(*kinds)
    out = F.struct(head.alias("head"), relation.alias("relation"), tail.alias("tail"), *[k.alias(n) for k, n in zip(kinds, ("hk", "rk", "tk"), strict=True)], shape.alias("shape"))
    return F.when((F.size(part) >= 3) & (shape != "???"), out)


def parse_replies(replies: DataFrame) -> DataFrame:
    """(qid, reply) to (qid, pattern_no from 0, head, relation, tail, hk, rk, tk, shape): repeated patterns count once, whatever their case."""
    lines = replies.select("qid", F.posexplode(F.split(F.coalesce("reply", F.lit("")), r"\R")).alias("line_no", "line"))
    found = lines.select("qid", "line_no", parsed_line(F.col("line")).alias("p")).where("p IS NOT NULL").select("qid", "line_no", "p.*")
    same = W.partitionBy("qid", F.lower("head"), F.lower("relation"), F.lower("tail")).orderBy("line_no")
    first = found.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    return first.withColumn("pattern_no", (F.row_number().over(W.partitionBy("qid").orderBy("line_no")) - 1).cast("long")).drop("line_no")


def concrete_slots() -> Column:
    return sum((F.col(k) != "?").cast("int") for k in ("hk", "rk", "tk"))


def described(patterns: DataFrame) -> DataFrame:
    """With is_degenerate (at most one slot that isn't a wildcard), has_type (of head or tail) and the canonical line."""
    return patterns.select(
        "*", (concrete_slots() <= 1).alias("is_degenerate"), ((F.col("hk") == "T") | (F.col("tk") == "T")).alias("has_type"),
        F.format_string("MEM( %s ^ %s ^ %s )", "head", "relation", "tail").alias("line"),
    )


def needed_texts(patterns: DataFrame) -> DataFrame:
    """Distinct texts whose vectors a search needs."""
    c = lambda k: F.col(k) == "c"
    h, r, t = F.col("head"), F.col("relation"), F.col("tail")
    texts = F.array(
        F.when(c("hk"), h), F.when(c("tk"), t), F.when(c("rk"), r), F.when(c("hk") & c("tk"), spaced(h, t)),
        F.when(c("hk") & c("rk"), spaced(h, r)), F.when(c("rk") & c("tk"), spaced(r, t)), F.when(c("hk") & c("rk") & c("tk"), spaced(h, r, t)),
    )
    return patterns.select("qid", F.explode(F.array_compact(texts)).alias("text")).where("text <> ''").distinct()


def shape_summary(replies: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row: counts of queries and patterns, and the rates that tell whether patterns constrain anything. All queries count, those without patterns too."""
    by_query = described(patterns).groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("is_degenerate").alias("all_degenerate"),
        F.sum(sum((F.col(k) == "T").cast("int") for k in ("hk", "rk", "tk"))).alias("typed"),
    )
    joined = replies.select("qid").distinct().join(by_query, "qid", "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    q = F.count(F.lit(1))
    return joined.agg(
        q.cast("long").alias("n_queries"), total.cast("long").alias("n_patterns"), (total / F.greatest(q, F.lit(1))).alias("per_query"),
        F.count_if(F.col("n").isNull()).cast("long").alias("n_empty"), F.count_if(F.col("all_degenerate")).cast("long").alias("n_degenerate"),
        (F.count_if(F.col("all_degenerate")) / F.greatest(q, F.lit(1))).alias("degenerate_rate"),
        (F.coalesce(F.sum("typed"), F.lit(0)) / F.greatest(3 * total, F.lit(1))).alias("typed_slot_rate"),
    )
