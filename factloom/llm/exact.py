"""Exact duplicates by most-significant-digit radix partitioning.

A digit is the next run of bytes of the normalised text. Each round splits every open group by its documents' next
digit; a group is settled when it holds one document, or when its texts have ended. The group's name is its smallest doc_id, and texts are
compared byte by byte: no digest takes part. Digits lengthen from round to round, so a text of n bytes takes in the order of log(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import id_and_text, stored, text_key

SPACE = r"[\x20\x09-\x0D]+"
FIRST_DIGIT, GROWTH = 48, 24


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def exact_groups(docs: DataFrame, *, first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_key of every row.

    Texts are equal when identical after each run of white space became one space; a null text counts as
    empty. Of equal texts the smallest doc_id stays. Rows that repeat a doc_id with an equal text are all members of its group and all kept (dropped_rows() leaves one);
    rows without doc_id are left out of the choice where any has one. An empty table gives no rows.

    Very long texts are compared whole, in a number of rounds that grows with the logarithm of their length. Only doc_id and text are read, so no column can clash.

    Each round counts by (group, digit), which combines before the shuffle however large a group of copies is; the counts are written
    to the shared folder and joined back, a join whose hot keys Spark splits. Only documents of open groups go on, with what is left of their text.
    """
    text = normalised(F.col("text"))
    rest = id_and_text(docs).select("doc_id", F.sha2(text, 256).alias("text_sha256"), text_key(F.col("text")).alias("text_key"), F.lit(None).cast("long").alias("group"), text.cast("binary").alias("rest"))
    settled, width, round_ = [], first_digit, 0
    while True:
        digit = [F.col("group"), F.substring("rest", 1, width).alias("digit"), (F.length("rest") <= width).alias("ended")]
        counts = rest.select("doc_id", *digit).groupBy("group", "digit", "ended").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        if round_ == 0:  # most documents are alone from here on and need no row
            counts = counts.where("group_size > 1")
        counts = stored(counts, f"radix-counts-{round_}")
        keys = [rest[k].eqNullSafe(counts[k]) if k == "group" else rest_k == counts[k] for k, rest_k in (("group", rest["group"]), ("digit", F.substring(rest["rest"], 1, width)), ("ended", F.length(rest["rest"]) <= width))]
        done = (F.coalesce(counts["group_size"], F.lit(1)) == 1) | F.coalesce(counts["ended"], F.lit(True))
        # Counts grow with the input: a merge join at every size, whose hot keys Spark splits.
        joined = rest.join(counts.hint("merge"), keys[0] & keys[1] & keys[2], "left").select(
            rest["doc_id"],
            rest["text_sha256"],
            rest["text_key"],
            F.when(counts["group_size"].isNull(), rest["doc_id"]).otherwise(counts["keep_id"]).alias("group"),
            F.coalesce(counts["group_size"], F.lit(1)).cast("long").alias("group_size"),
            F.when(~done, F.substring(rest["rest"], width + 1, 0x7FFFFFFF)).alias("rest"),
        )
        state = stored(joined, f"radix-{round_}")
        settled.append(state.where(F.col("rest").isNull()).select("doc_id", F.col("group").alias("keep_id"), "group_size", "text_sha256", "text_key"))
        rest = state.where(F.col("rest").isNotNull()).select("doc_id", "text_sha256", "text_key", "group", "rest")
        if rest.isEmpty():
            break
        width, round_ = width * growth, round_ + 1
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "text_key")


def dropped_rows(groups: DataFrame) -> DataFrame:
    """(doc_id, text_key) of the rows that go so that one text of each group stays: all that aren't kept, and of rows that repeat the kept doc_id with another raw text all but one."""
    several = groups.where("kept AND group_size > 1").select("doc_id", "text_sha256", "text_key")
    first = several.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.min("text_key").alias("first_key"))
    spare = several.join(first, F.expr("doc_id <=> id AND text_sha256 = sha")).where("text_key <> first_key").select("doc_id", "text_key")
    return groups.where("NOT kept").select("doc_id", "text_key").unionByName(spare)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(min(doc_id) OVER w AS BIGINT) AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
