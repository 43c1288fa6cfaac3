"""Training sets for smaller models, from finished extraction rows, and measures of edit fidelity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import matching
from factloom.functions.text import strip, words
from factloom.operators.extraction import STAGES

FIELDS = ["original_text", *STAGES]
KEYS = ["e1", "e1_type", "verb", "e2", "e2_type"]
#: What stands before a text that relations are to be taken from, unless a caller says otherwise.
REQUEST = "List every relation that this text states.\n\n"


def completed(pipeline: DataFrame) -> DataFrame:
    return pipeline.where(f"status = 'done' AND {STAGES[0]} IS NOT NULL AND {STAGES[1]} IS NOT NULL AND {STAGES[3]} IS NOT NULL")


def reason() -> Column:
    """ok, or the first of a row's faults."""
    payload = F.try_parse_json(F.col(STAGES[3]))
    items = F.expr("try_variant_get(try_parse_json(step4_triplets_json), '$.triplets', 'array<map<string, variant>>')")
    out = None
    for f in FIELDS:
        blank = strip(F.coalesce(F.col(f), F.lit(""))) == ""
        out = F.when(blank, f"empty {f}") if out is None else out.when(blank, f"empty {f}")
    out = out.when(payload.isNull(), "step4 invalid JSON").when(items.isNull(), "step4 missing triplets array").when(F.size(items) == 0, "step4 has 0 triplets")
    # The first triplet that misses a key decides, by its first missing key.
    lacks = lambda t: F.coalesce(*[F.when(~F.map_contains_key(t, k), f"triplet missing {k}") for k in KEYS])
    first = F.get(F.filter(F.transform(items, lacks), lambda r: r.isNotNull()), 0)
    return F.coalesce(out.otherwise(first), F.lit("ok"))


def reason_log(rows: DataFrame, most: int = 5) -> str:
    """A text for people: the first faulty rows by id, and how many more there are. rows: (id, reason)."""
    faulty = rows.where("reason <> 'ok'")
    first = [f"{r.id}: {r.reason}" for r in faulty.orderBy("id").limit(most).collect()]
    more = faulty.count() - len(first)
    return "\n".join(first + ([f"and {more} more"] if more > 0 else []))


def conversation(system: Column, user: Column, assistant: Column) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))


def samples(rows: DataFrame, prompts: dict[str, str], request: str = REQUEST) -> DataFrame:
    """(id, stage, conversations): three samples a row; request stands before the text of the last stage."""
    pairs = {"step1": ("original_text", STAGES[0]), "step2": (STAGES[0], STAGES[1]), "step4": (STAGES[2], STAGES[3])}
    made = []
    for stage, (source, target) in pairs.items():
        user = F.concat(F.lit(request), F.col(source)) if stage == "step4" else F.col(source)
        made.append(F.struct(F.lit(stage).alias("stage"), conversation(F.lit(prompts[stage]), user, F.col(target)).alias("conversations")))
    return rows.select("id", F.explode(F.array(*made)).alias("s")).select("id", "s.*")


def split(rows: DataFrame, n_eval: int, seed: int = 42, spare: int = 10) -> DataFrame:
    """With is_eval: n_eval rows by a seeded hash of id that any engine with MD5 draws alike. There must be n_eval + spare rows at least."""
    chosen = rows.select("id").orderBy(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(n_eval)
    n = rows.count()
    if n < n_eval + spare:
        raise ValueError(f"{n} rows are too few for {n_eval} to be held out")
    return rows.join(chosen.withColumn("is_eval", F.lit(True)), "id", "left").withColumn("is_eval", F.coalesce("is_eval", F.lit(False)))


def length_stats(sampled: DataFrame) -> DataFrame:
    """Characters of conversations: count, min, max, and elements at n/2, 0.9 n and 0.99 n of the sorted lengths, without interpolation."""
    total = F.aggregate("conversations", F.lit(0).cast("long"), lambda s, t: s + F.char_length(t["content"]))
    # Counts by length instead of a sorted list: as many rows as there are lengths.
    by = sampled.select("stage", total.alias("chars")).groupBy("stage", "chars").agg(F.count(F.lit(1)).alias("n"))
    ordered = by.withColumn("upto", F.sum("n").over(W.partitionBy("stage").orderBy("chars"))).withColumn("of", F.sum("n").over(W.partitionBy("stage")))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("of") * F.lit(share)), F.col("chars")))
    return ordered.groupBy("stage").agg(F.sum("n").alias("n"), F.min("chars").alias("least"), at(0.5).alias("median"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("chars").alias("most"))


@F.pandas_udf(T.LongType())
def edit_operations(source: pd.Series, target: pd.Series) -> pd.Series:
    """Word runs that differ."""
    return pd.Series([len(matching.changes(a.split(), b.split())) for a, b in zip(source, target, strict=True)])


def anchored(source: str, reply: str) -> Column:
    """The reply, with the source's own words where they agree, and nothing where the reply only deletes.

    Words agree only if they are equal, so whatever the alignment is, equal runs are the reply's words too, replaced and inserted ones are the reply's, and deleted ones are none:
    the result is the reply's words, one space apart, and needs no alignment. Null if either text is.
    """
    return F.when(F.col(source).isNotNull(), F.array_join(words(F.col(reply)), " "))


_AGREED = T.StructType([T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn")])


@F.pandas_udf(_AGREED)
def _agreement(source: pd.Series, reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """On which of the source's words two rewrites agree."""

    def touched(before: list[str], after: list[str]) -> np.ndarray:
        out = np.ones(len(before), dtype=bool)
        for i, _, n in matching.matching_blocks(before, after):
            out[i : i + n] = False
        return out

    counts = np.zeros((3, len(source)), dtype=np.int64)
    for k, (text, want, got) in enumerate(zip(source, reference, prediction, strict=True)):
        before = text.split()
        in_want = touched(before, want.split())
        in_got = in_want if want == got else touched(before, got.split())
        counts[:, k] = (in_want & in_got).sum(), (in_got & ~in_want).sum(), (in_want & ~in_got).sum()
    return pd.DataFrame({"tp": counts[0], "fp": counts[1], "fn": counts[2]})


@F.pandas_udf(T.DoubleType())
def _similarity(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    """How alike two texts are by characters."""
    return pd.Series([matching.ratio(a, b) for a, b in zip(reference, prediction, strict=True)])


def edit_metrics(source: str, reference: str, prediction: str, alike: bool = True) -> Column:
    """struct(exact, similarity, tp, fp, fn, precision, recall, f1, unchanged, hallucinated): how a prediction's changed words of the source agree with the reference's.

    Without alike, similarity isn't computed but null, for callers that don't read it. Pure insertions change no word. Without changed words precision is 1 if none was to be changed, else 0; recall is 1 where none was to be changed.
    """
    same = lambda a, b: strip(F.col(a)) == strip(F.col(b))

    def of(x: Column) -> Column:
        found, wanted = x["tp"] + x["fp"], x["tp"] + x["fn"]
        precision = F.when(found > 0, x["tp"] / found).otherwise((x["fn"] == 0).cast("double"))
        recall = F.when(wanted > 0, x["tp"] / wanted).otherwise(1.0)
        f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
        return F.struct(*[x[c].alias(c) for c in ("tp", "fp", "fn")], precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))

    x = F.get(F.transform(F.array(_agreement(source, reference, prediction)), of), F.lit(0))
    exact, unchanged = same(reference, prediction), same(source, reference)
    return F.struct(
        exact.alias("exact"), (_similarity(reference, prediction) if alike else F.lit(None).cast("double")).alias("similarity"), *[x[c].alias(c) for c in ("tp", "fp", "fn", "precision", "recall", "f1")],
        unchanged.alias("unchanged"), (unchanged & ~exact).alias("hallucinated"),
    )


def edit_delta(rows: DataFrame, before: str = "raw", after: str = "processed") -> DataFrame:
    """One row: what post-processing changed between two columns of edit_metrics: how many rows moved, gained or lost, how many became or ceased to be exact, and the mean change of similarity."""
    old, new = F.col(before), F.col(after)
    by = new["similarity"] - old["similarity"]
    moved = (F.abs(by) > 1e-6) | (new["exact"] != old["exact"])
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(moved).alias("moved"), F.count_if(by > 1e-6).alias("gained"), F.count_if(by < -1e-6).alias("lost"),
        F.count_if(new["exact"] & ~old["exact"]).alias("became_exact"), F.count_if(~new["exact"] & old["exact"]).alias("ceased_exact"), F.avg(by).alias("mean_change"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def word_changes(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    """Runs of words in which two texts differ, as `from -> to`."""
    out = []
    for a, b in zip(reference.str.split(), prediction.str.split(), strict=True):
        out.append([f"{' '.join(a[i:j])} -> {' '.join(b[k:m])}" for i, j, k, m in matching.changes(a, b)])
    return pd.Series(out)


def edit_diagnostics(rows: DataFrame, reference: str, prediction: str, metrics: str = "m", most: int = 8) -> DataFrame:
    """Rows to look at, with a kind and the first differences: right words in another form (f1 of .999 and more, but not exact), and outliers (similarity under .80)."""
    m = F.col(metrics)
    kind = F.when((m["f1"] >= 0.999) & ~m["exact"], "right words, other form").when(m["similarity"] < 0.80, "outlier")
    # A filter would be moved below the metrics and have them computed twice; rows without a kind explode into nothing.
    found = rows.select("*", F.explode(F.array_compact(F.array(kind))).alias("kind"))
    return found.withColumn("differences", F.slice(word_changes(reference, prediction), 1, most))


#: What an edit model is to reach: metric of edit_summary or its share, at least or at most, value.
TARGETS = [("f1", ">=", 0.80), ("exact_share", ">=", 0.50), ("similarity", ">=", 0.95), ("hallucinated_share", "<=", 0.10), ("recall", ">=", 0.75)]


def verdict(summary: DataFrame) -> DataFrame:
    """(target, value, bound, met) of edit_summary's row, for the targets that its rows say anything about."""
    values = {t: F.col(t) for t in ("f1", "similarity", "recall")}
    values |= {"exact_share": F.col("exact") / F.nullif(F.col("n"), F.lit(0)), "hallucinated_share": F.col("hallucinated") / F.nullif(F.col("unchanged"), F.lit(0))}
    rows = [F.struct(F.lit(t).alias("target"), values[t].alias("value"), F.lit(bound).alias("bound"), (values[t] >= bound if sign == ">=" else values[t] <= bound).alias("met")) for t, sign, bound in TARGETS]
    return summary.select(F.explode(F.array(*rows)).alias("t")).select("t.*").where("value IS NOT NULL")


def category_histogram(rows: DataFrame, before: str = "raw", after: str = "processed") -> DataFrame:
    """(category, n_raw, n_processed, delta)."""
    each = rows.select(F.explode(F.array(F.struct(category(F.col(before)).alias("category"), F.lit(0).alias("after")), F.struct(category(F.col(after)).alias("category"), F.lit(1).alias("after")))).alias("x")).select("x.*")
    out = each.groupBy("category").agg(F.count_if(F.col("after") == 0).alias("n_raw"), F.count_if(F.col("after") == 1).alias("n_processed"))
    return out.withColumn("delta", F.col("n_processed") - F.col("n_raw"))


def category(m: Column) -> Column:
    """One of seven classes of an edit."""
    some, wrong = m["tp"] > 0, m["fp"] > 0
    changed = F.when(m["exact"], "EXACT").when(~some & ~wrong, "MISSED ALL").when(some & ~wrong, "PARTIAL (conservative)").when(some & wrong, "PARTIAL (mixed)").otherwise("OVER-EDITED")
    return F.when(m["unchanged"] & m["exact"], "EXACT (no-change)").when(m["unchanged"], "HALLUCINATION").otherwise(changed)


def edit_summary(rows: DataFrame, metrics: str = "m") -> DataFrame:
    m = F.col(metrics)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(m["exact"]).alias("exact"), F.avg(m["similarity"]).alias("similarity"), F.avg(F.when(~m["unchanged"], m["precision"])).alias("precision"),
        F.avg(F.when(~m["unchanged"], m["recall"])).alias("recall"), F.avg(F.when(~m["unchanged"], m["f1"])).alias("f1"), F.count_if(m["unchanged"]).alias("unchanged"), F.count_if(m["hallucinated"]).alias("hallucinated"),
    )


def rendered_sample(conversations: Column) -> Column:
    """A chat template: each turn between marks, with its role."""
    turn = lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(conversations, turn), "")


def token_stats(sampled: DataFrame, tokens: Callable[[Column], Column], limit: int) -> DataFrame:
    """One row a stage: count, p50, p90, p95, p99 (interpolated) and longest of the rendered samples' lengths in tokens, and how many exceed limit.

    tokens: from a text Column to its number of tokens; the tokenizer is the caller's.
    """
    n = tokens(rendered_sample(F.col("conversations"))).cast("long")
    at = lambda share: F.expr(f"percentile(tokens, {share})")
    return sampled.select("stage", n.alias("tokens")).groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("tokens").alias("most"), F.count_if(F.col("tokens") > limit).alias("over"),
    )


def multiplier(operations: Column) -> Column:
    """Copies of a training row: many for those without edits and for those with many."""
    return F.when((operations >= 1) & (operations <= 3), 2).otherwise(3)


def rebalanced(rows: DataFrame, operations: str, seed: int = 42) -> DataFrame:
    """Rows as often as their multiplier says, in a seeded order (a hash of id and copy)."""
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), multiplier(F.col(operations)))))
    return copies.withColumn("place", F.md5(F.concat_ws("-", F.col("id").cast("string"), F.col("copy").cast("string"), F.lit(str(seed)))))

