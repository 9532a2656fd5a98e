from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from segue.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(good):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(good) if n != at and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def test_brute_force_with_ties_and_odd_vectors(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(100, rows[3][1]), (None, rows[1][1]), (901, None), (902, []), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] + [0.0] * 7), (905, [float("inf")] + [0.0] * 7), (950, [0.1, 0.2]), (951, [0.3, 0.1])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expect = brute(rows, 5)
    for block in (3, 8192):
        monkeypatch.setattr(topk, "HELD", 2000)
        monkeypatch.setattr(topk, "HELD_CANDIDATES", 50)
        found = [tuple(r) for r in topk.top_k(docs, F.col("vec_id") % 50 == 0, 5, query_block=block).collect()]
        assert sorted(found) == expect
    assert topk.top_k(docs.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_fewer_than_k(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, 0.5]), (50, [0.1, 0.1])], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in topk.top_k(docs, F.col("vec_id") % 50 == 0, 5).collect())
    assert found == brute([tuple(r) for r in docs.collect()], 5)


def test_few_exact_vectors_are_read(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.125) for _ in range(64)]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    stored, known = topk.approximated(docs, F.col("vec_id") % 50 == 0, "vec_id", "embedding")
    asked = spark.sparkContext.broadcast(topk._block(stored.where("asked").select("row", "size", "vector").toArrow()))
    read = topk.searched(stored, asked, known, 5).count()
    assert 80 * 5 <= read < 80 * 25  # of 80 queries and 4000 vectors
    found = sorted(tuple(r) for r in topk.top_k(docs, F.col("vec_id") % 50 == 0, 5).collect())
    assert found == brute(rows, 5)


@pytest.mark.parametrize("size", [1e3, 1e6, 1e9])
def test_large_components_are_exact_or_refused(spark, size):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-size, size) for _ in range(4)]) for i in range(120)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    if size < 1e7:
        assert sorted(tuple(r) for r in topk.top_k(docs, F.col("vec_id") % 50 == 0, 5).collect()) == brute(rows, 5)
    else:
        with pytest.raises(OverflowError):
            topk.top_k(docs, F.col("vec_id") % 50 == 0, 5)
