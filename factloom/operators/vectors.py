"""Dictionary of text vectors, and exact top-k by similarity.

The encoder is pluggable: anything that maps a batch of texts to unit vectors. Vectors are kept once for each distinct text (or vector
id), never once for each fact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import fingerprint

Encoder = Callable[[list[str]], np.ndarray]
#: Request vectors that are scored at once, and sent to the executors together.
REQUEST_BLOCK = 2048
#: Entries that are scored at once against a block.
ENTRIES = 1024


@dataclass(frozen=True)
class Role:
    """What a text is encoded as: the encoder's task, and how many tokens of it are read."""

    task: str
    most_tokens: int

    @property
    def namespace(self) -> str:
        return f"{self.task.replace('.', '_')}_{self.most_tokens}"


#: Texts of facts, whole documents and questions are encoded apart, and cached under names of their own.
NODES, DOCUMENTS, QUERIES = Role("retrieval.passage", 32), Role("retrieval.passage", 512), Role("retrieval.query", 64)


def encoded_as(role: Role, texts: DataFrame, encoder_of: Callable[[Role], Callable[[], Encoder]], model: str) -> DataFrame:
    """(ns, fingerprint, text, vec) of texts, as the vector cache keeps them."""
    mark = fingerprint(F.lit(model), F.lit(role.task), F.lit(role.most_tokens))
    return encoded(texts, encoder_of(role)).select(F.lit(role.namespace).alias("ns"), mark.alias("fingerprint"), "text", "vec")


def encoded(texts: DataFrame, encoder_factory: Callable[[], Encoder]) -> DataFrame:
    """(text) to (text, vec): the encoder is made once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder_factory()
        for b in batches:
            v = np.asarray(encode(b["text"].tolist()), dtype=np.float32) if len(b) else np.zeros((0, 1), np.float32)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"text": b["text"], "vec": list(v)})

    return texts.select("text").mapInPandas(run, "text string, vec array<float>")


def missing_texts(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts without vector in the cache."""
    return wanted.select("text").where("text <> ''").distinct().join(cache, "text", "left_anti")


def upsert(cache: DataFrame, wanted: DataFrame, encoder_factory: Callable[[], Encoder]) -> DataFrame:
    return cache.unionByName(encoded(missing_texts(wanted, cache), encoder_factory))


class _Best:
    """A request's best entries so far: up to k rows, with all that tie in the sixth digit."""

    def __init__(self, k: int) -> None:
        self.k, self.least, self.held, self.size = k, -np.inf, [], 0

    def add(self, score: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        keep = np.flatnonzero(np.round(score, 6) >= self.least)
        if len(keep):
            self.held.append((score[keep], n[keep], ids[keep]))
            self.size += len(keep)
            if self.size > 4 * min(self.k, 1000) + 2 * ENTRIES:
                self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score, n, ids = (np.concatenate([x[c] for x in self.held]) for c in range(3))
        order = np.lexsort((ids, -score))
        reach = np.cumsum(n[order])
        last = int(np.searchsorted(reach, self.k))
        if last < len(order):  # without k rows yet, every entry may still be needed
            self.least = np.round(score[order[last]], 6)
            order = order[np.round(score[order], 6) >= self.least]
        self.held, self.size = [(score[order], n[order], ids[order])], len(order)
        return self.held[0]


def nearest(slices: DataFrame, requests: DataFrame) -> DataFrame:
    """Entries that can hold a request's k best rows: (request_id, k, subspace, need, head_type, tail_type, vec_id, n, score).

    slices: (subspace, need, head_type, tail_type, vec_id, n, vec): the rows n under each vector, by what a request may ask for; requests:
    (request_id, subspace, need, head_type, tail_type, k, vec). Requests are the stated query set: they go to the executors in blocks, each block
    against all entries, as matrix products of bounded size; so slices should be a stored table. A task holds, for each request, only its
    best entries up to k rows, with all that tie in the sixth digit, and passes these on.
    """
    spark, out = slices.sparkSession, None
    block: list = []

    def scored(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked: dict = {}
            for r in shared.value:
                asked.setdefault((r["subspace"], r["need"], r["head_type"], r["tail_type"]), []).append(r)
            sought = {key: np.stack([np.asarray(r["vec"], dtype=np.float64) for r in rows]).T for key, rows in asked.items()}
            best = {key: [_Best(r["k"]) for r in rows] for key, rows in asked.items()}
            for b in batches:
                for key, part in b.groupby(["subspace", "need", "head_type", "tail_type"]):
                    if key not in asked:
                        continue
                    for i in range(0, len(part), ENTRIES):
                        some = part.iloc[i : i + ENTRIES]
                        scores = np.round(np.stack(some["vec"].to_numpy()).astype(np.float64) @ sought[key], 9)
                        n, ids = some["n"].to_numpy(), some["vec_id"].to_numpy()
                        for j, mine in enumerate(best[key]):
                            mine.add(scores[:, j], n, ids)
            for key, rows in asked.items():
                for r, mine in zip(rows, best[key], strict=True):
                    if mine.held:
                        score, n, ids = mine.prune()
                        yield pd.DataFrame({"request_id": r["request_id"], "k": r["k"], "subspace": key[0], "need": key[1], "head_type": key[2], "tail_type": key[3], "vec_id": ids, "n": n, "score": score})

        return slices.mapInPandas(run, "request_id long, k int, subspace string, need string, head_type string, tail_type string, vec_id long, n long, score double")

    for row in requests.select("request_id", "subspace", "need", "head_type", "tail_type", "k", "vec").toLocalIterator():
        block.append(row.asDict())
        if len(block) == REQUEST_BLOCK:
            out = scored(block) if out is None else out.unionByName(scored(block))
            block = []
    if block or out is None:
        out = scored(block) if out is None else out.unionByName(scored(block))
    rank = W.partitionBy("request_id").orderBy(F.round("score", 6).desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    reach = F.sum("n").over(rank)
    peers = F.sum("n").over(W.partitionBy("request_id", F.round("score", 6)))
    return out.withColumn("before", reach - peers).where("before < k").drop("before")
