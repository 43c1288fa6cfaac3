"""Blocks of agreement against difflib's, and their time on a long text."""

import difflib
import random
import time

import pytest

from factloom.functions import matching
from factloom.functions import text as tx
from factloom.operators import distill
from pyspark.sql import functions as F


def changed(r, a, kinds):
    b = list(a)
    for _ in range(r.choice([0, 1, 3, 20])):
        p, op = r.randrange(len(b) + 1), r.random()
        b[p : p + r.choice([0, 1, 5])] = r.choices(range(kinds + 1), k=r.choice([0, 1, 1, 3])) if op < 0.8 else b[: r.randrange(60)]
    return b


@pytest.mark.parametrize("most_pairs", [4_000_000, 50, 5])
def test_the_same_blocks_as_difflib(monkeypatch, most_pairs):
    monkeypatch.setattr(matching, "SMALL", 0)
    monkeypatch.setattr(matching, "MOST_PAIRS", most_pairs)
    r = random.Random(most_pairs)
    for _ in range(400):
        kinds = r.choice([1, 2, 5, 60, 300])
        a = r.choices(range(kinds), [1 / (k + 1) ** r.choice([0, 1, 2]) for k in range(kinds)], k=r.choice([0, 1, 10, 199, 230, 500]))
        b = changed(r, a, kinds) if r.random() < 0.7 else r.choices(range(kinds), k=r.choice([1, 50, 201]))
        if r.random() < 0.5:
            a, b = ("".join(chr(97 + x) for x in s) for s in (a, b))
        m = difflib.SequenceMatcher(None, a, b)
        assert matching.matching_blocks(a, b) == [tuple(x) for x in m.get_matching_blocks()[:-1]]
        assert matching.ratio(a, b) == m.ratio()
        assert matching.changes(a, b) == [x[1:] for x in m.get_opcodes() if x[0] != "equal"]


def test_long_texts_take_seconds_not_minutes():
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlucmfwypvbgkjqxz", range(26, 0, -1), k=r.randrange(2, 9))) + f"_{i}" for i in range(20_000)]
    other = [w + "r" if i % 50 == 2 else w for i, w in enumerate(words)]
    began = time.process_time()
    assert len(matching.changes(words, other)) == 400
    assert 0.99 < matching.ratio(" ".join(words), " ".join(other)) < 1
    assert time.process_time() - began < 10


def test_anchoring_is_the_aligned_reply(spark):
    texts = [("a  b c d", " a x\tc \n"), ("a b a b", "b a b a b"), ("", "new"), ("gone", ""), ("\x1ca\x85b", "b a")]

    def aligned(a, b):
        a, b = a.split(), b.split()
        return " ".join(w for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes() for w in (a[i:j] if tag == "equal" else b[k:m]))

    got = [x[0] for x in spark.createDataFrame(texts, "s string, r string").coalesce(1).select(distill.anchored("s", "r")).collect()]
    assert got == [aligned(*t) for t in texts]
    ends = spark.createDataFrame([(c + "x" + c + "y" + c,) for c in tx.SPACES], "s string").select("s", tx.strip(F.col("s")).alias("t")).collect()
    assert all(x.t == x.s.strip() for x in ends)
