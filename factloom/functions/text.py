"""Text functions on Columns, with the white-space and Unicode rules of the data's own tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends of strings, the separators U+001C to U+001F among it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


#: The same, character by character: trimming looks at the ends only, where a pattern goes through the whole text.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def words(x: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(x, f"{SPACE}+"), lambda t: t != "")


def alnum_tokens(x: Column, least: int = 1) -> Column:
    """Lower-case runs of letters and digits with at least `least` characters."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda t: F.char_length(t) >= least)


def document_text(title: Column, body: Column) -> Column:
    """Title and body, a line each, without white space at the ends; null if nothing is left."""
    t, b = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(body, F.lit("")))
    joined = strip(F.when(t != "", F.concat(t, F.lit("\n"), b)).otherwise(b))
    return F.nullif(joined, F.lit(""))


def chunks(text: Column, most_words: int) -> Column:
    """Paragraphs packed greedily, in order, into chunks of at most most_words words; a longer paragraph is a chunk of its own."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")
    lines = F.when(F.size(lines) == 0, F.array(text)).otherwise(lines)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(acc: Column, p: Column) -> Column:
        n = F.size(words(p))
        full = (acc["n"] > 0) & (acc["n"] + n > most_words)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), p).otherwise(F.concat(acc["open"], F.lit("\n"), p)).alias("open"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(lines, zero, add, lambda acc: F.array_append(acc["done"], acc["open"]))


def fold_chunk_id(unit_id: Column) -> Column:
    """The document of a chunk: what stands before the last double underscore, if there is one."""
    return F.when(unit_id.contains("__"), F.regexp_extract(unit_id, r"(?s)^(.*)__", 1)).otherwise(unit_id)


def without_thinking(reply: Column) -> Column:
    return F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")


def spaced(*parts: Column) -> Column:
    """The parts that aren't empty, with a space between each two."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def fingerprint(model: Column, task: Column, most: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", model, task, most.cast("string"))), 1, 12)


def namespace(task: Column, most: Column) -> Column:
    """The name of a part of the vector cache: task, with underscores for its dots, and length."""
    return F.concat_ws("_", F.replace(task, F.lit("."), F.lit("_")), most.cast("string"))


def is_collapsed(original: Column, rewritten: Column, share: float = 0.5) -> Column:
    """Whether a rewrite lost so much that it is rejected."""
    out = F.coalesce(rewritten, F.lit(""))
    return (out == "") | (F.char_length(out) < share * F.char_length(original))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length, of which 1e-12 is the least."""
    length = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / length)
