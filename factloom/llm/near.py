"""Near duplicates by one-permutation MinHash.

Each text's set of word shingles is hashed once; the hash range is cut into bins, a bin's value is the smallest hash in it, and an
empty bin takes the value of a bin that a hash of the bin's number and the attempt chooses among the others (optimal densification). Bins are
banded; texts that agree in a band share a bucket. In a bucket, members are compared with few hubs (a star), not with each
other; links are confirmed on the full sets.

A star can miss a link between two members that aren't both linked with the hub. So buckets that still hold several components
are gone through again: in small ones all pairs between components are compared; in larger ones another member is the hub,
and a member of each other component is compared with it: as many comparisons as components. That leaves fewer
components. Members of larger buckets that still hold several go through an exact join with
prefix, length and position filters (candidates()), so that no pair in a bucket that can reach the threshold is left unchecked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import freed, id_and_text, stored, text_key
from factloom.llm.components import components
from factloom.llm.shingles import mix, shingle_sets, stretches, text_bytes

#: Bands, and the probability with which a pair that just reaches the threshold may share none of their buckets.
BANDS, MISS = 48, 1e-4
_ATTEMPTS = 128
#: Bytes of texts (or one text) whose sets are held together: bounds what a Python worker holds.
SLICE = 4 << 20
#: Buckets of so many members at most have all pairs between components compared.
SMALL = 24


def rows_for(percent: int, bands: int = BANDS, miss: float = MISS) -> int:
    """The most bins of a band for which a pair of `percent` shares no bucket with a probability of at most `miss` (and 1 if none does)."""
    able = [r for r in range(1, 33) if (1 - (percent / 100) ** r) ** bands <= miss]
    return max(able, default=1)


class OnePermutation:
    """Band keys of a sorted set of 64-bit hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 11) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.edges = np.array([(i << 64) // self.bins for i in range(self.bins)], dtype=np.uint64)
        r = np.random.Generator(np.random.PCG64(seed))
        self.choice = r.integers(0, self.bins, (self.bins, _ATTEMPTS))
        self.weight = r.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = np.append(np.searchsorted(hashes, self.edges), len(hashes))
        full = at[:-1] < at[1:]
        value = hashes[np.minimum(at[:-1], len(hashes) - 1)]
        empty = np.flatnonzero(~full)
        if len(empty):
            hit = full[self.choice[empty]]
            first = hit.argmax(axis=1)
            source = self.choice[empty, first]
            lost = ~hit[np.arange(len(empty)), first]
            if lost.any():  # sets of very few shingles: the next full bin
                there = np.flatnonzero(full)
                source[lost] = there[np.searchsorted(there, empty[lost]) % len(there)]
            value[empty] = value[source]
        return value

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return mix((mix(self.signature(hashes)).reshape(self.bands, self.rows) * self.weight).sum(axis=1, dtype=np.uint64))


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct a < b of different components of sets(rep, component, hashes): all that reach `percent`, and few others.

    Hashes are put in one order, rare ones first. Where i and j are the places of the first hash that two sets share, they share at most
    the smaller of what follows these places; so each set goes by its first hashes only, and pairs that meet at a hash too late for their
    sizes are left out. In the component that has most sets at a hash, no set is met with another of the same.
    """
    sized = sets.select("rep", "component", F.size("hashes").alias("size"), "hashes")
    hashes = sized.select("rep", F.explode("hashes").alias("hash"))
    # A hash of one set takes a place, before all others, but can't be met.
    often = stored(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-often")
    placed = hashes.join(often, "hash").withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("n", "hash")))
    shared = placed.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("rep"))).select("rep", "hash", "place", "shared")
    first = shared.join(sized.drop("hashes"), "rep").select("rep", "component", "size", "hash", (F.col("shared") - F.col("place") + 1).alias("rest"))
    first = stored(first.where(F.lit(100) * F.col("rest") >= F.lit(percent) * F.col("size")), "near-first")
    at = first.groupBy("hash", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("components"))
    mixed = stored(first.join(at.where("components > 1").select("hash", "most"), "hash"), "near-mixed")
    one = mixed.where("component <> most").select("hash", *(F.col(c).alias(f"{c}_1") for c in ("rep", "component", "size", "rest")))
    met = one.join(mixed.drop("most"), "hash").where("component <> component_1")
    met = met.where(F.lit(100) * F.least("size", "size_1") >= F.lit(percent) * F.greatest("size", "size_1"))
    met = met.where(F.lit(100 + percent) * F.least("rest", "rest_1") >= F.lit(percent) * (F.col("size") + F.col("size_1")))
    return met.select(F.least("rep", "rep_1").alias("a"), F.greatest("rep", "rep_1").alias("b")).distinct()


def open_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """candidates() of sets(rep, digest, component, hashes), as pairs of rep."""
    found = candidates(sets.select(F.struct("rep", "digest").alias("rep"), "component", "hashes"), percent)
    return found.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).where("a <> b").distinct()


def near_groups(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key of every row.

    Documents with 100 * |intersection| >= percent * |union| of their shingle sets are linked; component_id is the smallest
    doc_id that links reach. Words are runs of characters other than white space, with A-Z as a-z. With fewer than `width` words the whole
    sequence is the one shingle; a null or empty text has none, and is linked with nothing. Equal rows are one node, and so are all
    rows of equal sets; a row that repeats a doc_id with another text goes by its own text, and classes of equal sets that have the same smallest doc_id are one
    node. A row without doc_id takes no part and is kept. An empty table gives no rows. Very long texts are read whole, each by itself.
    A pair that reaches `percent` shares none of the `bands` buckets with a probability of at most `miss`; rows_for() chooses their bins.
    """
    rows = rows_for(percent, bands, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = OnePermutation(bands, rows)
        for batch in batches:
            n, digests, keys = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(minhash.keys(s).astype(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "digest", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in stretches(text_bytes(batch.column("text"))[1], SLICE):
                part = batch.slice(i, j - i)
                found = list(shingle_sets(part.column("text"), width))
                lengths = np.cumsum([0, *map(len, found)]).astype(np.int32)
                digests = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], pa.binary())
                values = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), digests, pa.ListArray.from_arrays(pa.array(lengths), pa.array(values))], ["rep", "digest", "hashes"])

    texts = id_and_text(docs)
    signed = stored(texts.withColumn("text_key", text_key(F.col("text"))).mapInArrow(freed(sign), "doc_id long, text_key long, n_shingles long, digest binary, keys array<long>"), "near-signed")
    able = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # Equal sets are one class; its representative is its smallest doc_id.
    classes = stored(able.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "near-classes")
    banded = classes.select("rep", "digest", F.posexplode("keys").alias("band", "key"))
    sizes = stored(banded.groupBy("band", "key").agg(F.countDistinct("rep").alias("members"), F.min("rep").alias("hub")).where("members > 1"), "near-buckets")
    met = stored(banded.join(sizes, ["band", "key"]).select("band", "key", "members", "hub", "rep", "digest"), "near-members")
    members = met.select("band", "key", "members", "hub", "rep").distinct()
    reps = stored(met.select("rep", "digest").distinct(), "near-reps")
    # A doc_id may have several texts, and a text several equal rows: one set for each (doc_id, digest) that stands for a class.
    of_reps = texts.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(freed(sets), "rep long, digest binary, hashes array<long>")
    hashes = stored(of_reps.join(reps, ["rep", "digest"], "left_semi").dropDuplicates(["rep", "digest"]), "near-sets")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """linked, for each of pairs(a, b)."""
        left, right = hashes.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), hashes.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        linked = F.lit(100) * both >= F.lit(percent) * (F.size("x") + F.size("y") - both)
        each = pairs.join(right, "b").join(left, "a").select("a", "b", linked.alias("linked"))
        return stored(each.groupBy("a", "b").agg(F.max("linked").alias("linked")), f"near-compared-{name}")

    star = members.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    compared = confirm(star, "star")
    component = components(compared.where("linked").select("a", "b"))
    placed = members.join(component, members["rep"] == component["node"], "left").select("band", "key", "members", "rep", F.coalesce("component", "rep").alias("component"))
    # One member of each bucket and component stands for it; another member than the star's is the hub.
    stand = stored(placed.groupBy("band", "key", "members", "component").agg(F.min_by("rep", F.xxhash64("rep", F.lit(1))).alias("rep")), "near-stand")
    hubs = stand.groupBy("band", "key").agg(F.min_by(F.struct("rep", "component"), F.xxhash64("band", "key", "rep")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = stored(hubs.select("band", "key", F.col("hub.rep").alias("hub"), F.col("hub.component").alias("hub_component")), "near-hubs")
    pair = [F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")]
    of_hubs = stand.join(hubs, ["band", "key"]).where("component <> hub_component").select(*pair)
    few = placed.where(F.col("members") <= SMALL)
    other = few.select("band", "key", F.col("rep").alias("hub"), F.col("component").alias("hub_component"))
    of_few = few.join(hubs.select("band", "key"), ["band", "key"], "left_semi").join(other, ["band", "key"]).where("component < hub_component").select(*pair)
    new = confirm(of_hubs.unionByName(of_few).distinct().join(compared.select("a", "b"), ["a", "b"], "left_anti"), "again")
    compared = compared.unionByName(new)
    if not new.where("linked").isEmpty():
        component = components(compared.where("linked").select("a", "b"))
    placed = members.where(F.col("members") > SMALL).join(component, members["rep"] == component["node"], "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("band", "key")
    open_reps = stored(placed.join(mixed, ["band", "key"], "left_semi").select("rep", "component").distinct(), "near-open")
    if not open_reps.isEmpty():
        pairs = stored(open_pairs(hashes.join(open_reps, "rep"), percent).join(compared.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs-last")
        new = confirm(pairs, "last")
        if not new.where("linked").isEmpty():
            component = components(compared.unionByName(new).where("linked").select("a", "b"))
    named = classes.join(component, classes["rep"] == component["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    named = stored(named, "near-named")
    out = signed.join(named, "digest", "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM d),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, list_sort(x) AS x FROM s WHERE len(x) > 0 GROUP BY list_sort(x)),
e AS MATERIALIZED (SELECT rep, len(x) AS n, unnest(x) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
t AS (SELECT rep AS node, rep AS of FROM c UNION SELECT l.b, t.of FROM t JOIN l ON l.a = t.node WHERE t.of < l.b),
m AS (SELECT node, min(of) AS component FROM t GROUP BY node)
SELECT s.doc_id, CAST(len(s.x) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, s.doc_id = coalesce(m.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.x = list_sort(s.x) LEFT JOIN m ON m.node = c.rep
"""
