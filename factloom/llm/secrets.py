"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by pattern in each whole text. The hash of each candidate's value is counted over the corpus by distinct
owners and repositories: a value that many owners have is a copied example; one that few owners have looks live.
Candidates of the base kinds are always reported. Those of the added kind, `token`, are reported only if they look live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored

#: Kind, pattern of a match, group with the value, least length of that value: in the order in which ties of spans are listed.
KINDS = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("token", r"gh[pousr]_[A-Za-z0-9]{30,}|xox[abeprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|[A-Za-z0-9+/_-]{32,}", 0, 14),
]
BASE = 3
#: Matches whose lengths are added up together.
CHUNK = 256
SPAN = "struct<kind: int, start: long, stop: long, value: string>"


def spans(text: Column, kind: int) -> Column:
    """Array of SPAN of the leftmost matches that don't overlap, in code points, stop exclusive.

    The text is cut at the matches, and the lengths of pieces and matches are added up: in chunks of CHUNK matches, whose own lengths
    are then added up, so that the work for n matches is about n * (CHUNK + n / CHUNK^2) small steps. (A greedy run of at least
    n characters of one class is the same span as a run of any length of which the shorter ones are dropped.)
    """
    name, pattern, group, least = KINDS[kind]
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    value = (lambda x: F.regexp_extract(x["m"], pattern, group)) if group else (lambda x: x["m"])
    good = lambda x: x["m"].isNotNull() & (F.char_length(value(x)) >= least)
    if name == "token":  # known prefixes, or a mixture of classes; and not all of it hexadecimal
        mixed = lambda v: (v.rlike("^(?:gh[pousr]_|xox|AIza|eyJ)") | (v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]"))) & ~v.rlike("^[0-9a-f]+$")
        good = lambda x: x["m"].isNotNull() & mixed(x["m"])
    start = lambda a, x: a["at"] + F.char_length(x["p"])
    span = lambda a, x: F.struct(F.lit(kind).alias("kind"), start(a, x).alias("start"), (start(a, x) + F.char_length(x["m"])).alias("stop"), value(x).alias("value"))
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.lit(0).cast("long")
    # Of a chunk: its length, and its spans as if it began at 0.
    local = lambda chunk: F.aggregate(
        chunk,
        F.struct(zero.alias("at"), none.alias("found")),
        lambda a, x: F.struct(
            (start(a, x) + F.coalesce(F.char_length(x["m"]), F.lit(0))).cast("long").alias("at"),
            F.when(good(x), F.concat(a["found"], F.array(span(a, x).cast(SPAN)))).otherwise(a["found"]).alias("found"),
        ),
    )
    chunks = lambda every: F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int")), lambda c: local(F.slice(every, c * CHUNK + 1, F.lit(CHUNK))))
    begins = lambda each: F.aggregate(each, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["at"])))
    moved = lambda x, by: F.struct(x["kind"].alias("kind"), (x["start"] + by).alias("start"), (x["stop"] + by).alias("stop"), x["value"].alias("value"))
    joined = lambda each, at: F.flatten(F.transform(each, lambda x, k: F.transform(x["found"], lambda y: moved(y, F.get(at, k)))))
    found = _let(parts, lambda every: _let(chunks(every), lambda each: _let(begins(each), lambda at: joined(each, at))))
    return F.when(text.rlike(pattern), found.cast(f"array<{SPAN}>")).otherwise(none)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, however often use() names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def listing(found: Column) -> Column:
    """kind:start:stop by start, then kind as listed, joined by commas."""
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame, *, owner: Column | None = None, repository: Column | None = None, most_owners: int = 2, most_repositories: int = 3) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_widespread, n_tokens.

    owner and repository default to `source`, and `source` with `lang`. A value with at most most_owners owners and most_repositories
    repositories looks live. A null text counts as empty (no spans), null owners as one owner. Rows that repeat a doc_id are
    separate documents. A very long text is read whole, in time proportional to its matches and length; spans that start at one place go by kind. Other columns of docs
    are not read, so none can clash. An empty table gives no rows.

    Texts are read once; the small table of candidates is written to the shared folder. Counting first reduces to distinct (value, owner,
    repository), so a value that a third of all rows hold is a few rows before it is counted.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"),
        F.concat(*[spans(text, k) for k in range(BASE)]).alias("base"), spans(text, BASE).alias("more"),
    )
    rows = stored(rows, "secret-candidates")
    each = rows.where("size(base) + size(more) > 0").select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("x")).select("row", "owner", "repository", "x", F.xxhash64("x.value").alias("key"), F.sha2("x.value", 256).alias("digest"))
    distinct = each.groupBy("key", "digest", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    counted = distinct.groupBy("key", "digest").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    wide = stored(counted.where((F.col("owners") > most_owners) | (F.col("repositories") > most_repositories)).select("key", "digest", F.lit(True).alias("wide")), "secret-widespread")
    judged = each.join(wide, ["key", "digest"], "left").groupBy("row").agg(
        F.collect_list(F.when((F.col("x.kind") == BASE) & F.col("wide").isNull(), F.col("x"))).alias("added"),
        F.count_if(F.col("wide").isNull()).alias("n_live"),
        F.count_if(F.col("wide").isNotNull()).alias("n_widespread"),
    )
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    none = F.array().cast(f"array<{SPAN}>")
    return rows.join(judged, "row", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listing(F.col("base")), 256).alias("base_sha256"),
        listing(F.concat("base", F.coalesce("added", none))).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_widespread", F.lit(0)).cast("long").alias("n_widespread"), F.size(F.coalesce("added", none)).cast("long").alias("n_tokens"),
    )


def oracle(most_owners: int = 2, most_repositories: int = 3) -> str:
    """DuckDB SQL for scan() of documents."""
    quoted = lambda x: x.replace("'", "''")
    patterns = [quoted(p.replace("((?i)", "((?i:").replace(")(?-i)", "))")) for _, p, _, _ in KINDS]
    kinds = "\nUNION ALL ".join(
        f"SELECT doc_id, {k} AS k, regexp_split_to_array(s, '{p}') AS parts, regexp_extract_all(s, '{p}', 0) AS ms FROM t" for k, p in enumerate(patterns)
    )
    mixed = "(regexp_matches(m, '^(?:gh[pousr]_|xox|AIza|eyJ)') OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]'))) AND NOT regexp_matches(m, '^[0-9a-f]+$')"
    names = ", ".join(f"'{name}'" for name, *_ in KINDS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS s FROM documents),
c AS ({kinds}),
i AS (SELECT doc_id, k, parts, ms, unnest(range(1, len(ms) + 1)) AS i FROM c WHERE len(ms) > 0),
x AS (SELECT doc_id, k, ms[i] AS m, list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS start, CASE WHEN k = 0 THEN regexp_extract(ms[i], '{patterns[0]}', 2) ELSE ms[i] END AS value FROM i),
f AS (SELECT doc_id, k, value, CAST(start AS BIGINT) AS start, CAST(start + length(m) AS BIGINT) AS stop, ([{names}])[k + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT) AS span FROM x
  WHERE CASE WHEN k = {BASE} THEN {mixed} ELSE length(value) >= ([{", ".join(str(k[3]) for k in KINDS)}])[k + 1] END),
o AS (SELECT value FROM f JOIN t USING (doc_id) GROUP BY value HAVING count(DISTINCT owner) > {most_owners} OR count(DISTINCT repository) > {most_repositories}),
j AS (SELECT f.*, o.value IS NOT NULL AS wide FROM f LEFT JOIN o USING (value)),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(span, ',' ORDER BY start, k) FILTER (k < {BASE}) AS base, string_agg(span, ',' ORDER BY start, k) FILTER (k < {BASE} OR NOT wide) AS spans,
  count(*) FILTER (NOT wide) AS live, count(*) FILTER (wide) AS widespread, count(*) FILTER (k = {BASE} AND NOT wide) AS tokens FROM j GROUP BY doc_id)
SELECT CAST(t.doc_id AS BIGINT) AS doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(live, 0) AS BIGINT) AS n_live, CAST(coalesce(widespread, 0) AS BIGINT) AS n_widespread, CAST(coalesce(tokens, 0) AS BIGINT) AS n_tokens FROM t LEFT JOIN a USING (doc_id)"""
