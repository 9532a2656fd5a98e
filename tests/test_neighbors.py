from __future__ import annotations

import numpy as np
import pytest

from segue.operators import neighbors as nb


@pytest.fixture(scope="module")
def tracks(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(int(i * 7), vectors[i % 250].tolist()) for i in range(900)]  # copies, so that products tie
    return spark.createDataFrame(rows, "idx long, embedding array<double>").repartition(3).cache()


def brute(tracks, n):
    rows = sorted((r["idx"], r["embedding"]) for r in tracks.collect())
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    products = np.round(matrix @ matrix.T, nb.DIGITS)
    np.fill_diagonal(products, -np.inf)
    best = np.argsort(-products, axis=1, kind="stable")[:, :n]
    return {(int(ids[i]), k + 1): int(ids[j]) for i in range(len(ids)) for k, j in enumerate(best[i])}


def test_table_and_update(spark, tracks, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_LEAST", 100)
    want = brute(tracks, 4)
    table = nb.neighbor_table(tracks, 4)
    got = {(r["idx"], r["rank"]): r["neighbor"] for r in table.collect()}
    assert got == want
    old, added = tracks.where("idx % 5 < 3"), tracks.where("idx % 5 >= 3")
    assert {(r["idx"], r["rank"]): r["neighbor"] for r in nb.with_added(nb.neighbor_table(old, 4), old, added, 4).collect()} == want


def test_only_results_are_shuffled(spark, tracks, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_LEAST", 100)
    plan = nb.neighbor_table(tracks, 4)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.replace("embedding AS source", "") and "Range" in plan


def test_small_and_empty_tables(spark, tracks):
    assert nb.number_of_blocks(0, 8) == 1 and nb.number_of_blocks(5, 8) == 1 and nb.number_of_blocks(2000, 8) == 8 and nb.number_of_blocks(1_188_873, 8) == 37
    few = nb.neighbor_table(tracks.where("idx < 14"), 4, source="tags").collect()
    assert sorted((r["idx"], r["neighbor"], r["source"]) for r in few) == [(0, 7, "tags"), (7, 0, "tags")]
    assert nb.neighbor_table(tracks.where("false"), 4).count() == 0
    assert nb.neighbor_table(tracks.where("idx = 0"), 4).count() == 0


def _block(nb, vectors, ids, least=None):
    block = nb._Block.__new__(nb._Block)
    block.ids, block.vectors = ids, vectors
    block.least = np.full(ids.size, -np.inf) if least is None else least
    block.lengths = np.sqrt((vectors**2).sum(axis=1))
    block.longest, block.plain, block.single = float(block.lengths.max()), True, vectors.astype(np.float32)
    return block


@pytest.mark.parametrize("scale", [1.0, 1e-4, 3e6])
def test_products_in_single_precision_miss_nothing(scale):
    """The same rows as by all exact products, with equal and nearly equal vectors, and few of them made exactly."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(500, 16)) * scale
    vectors[100:120] = vectors[0]
    vectors[120:140] = vectors[0] * (1 + 1e-9 * np.arange(20))[:, None]
    ids = rng.permutation(5000)[:500].astype(np.int64)
    ids.sort()
    mix = rng.permutation(500)
    one, two = (_block(nb, vectors[mix][at], ids[at]) for at in (slice(0, 300), slice(300, 500)))
    for block in (one, two):
        a, b = nb._Best(6), nb._Best(6)
        nb._all_products(block, block, a, None)
        nb._near_products(block, block, b, None)
        assert all(np.array_equal(x, y) for x, y in zip(a.all()[:2], b.all()[:2]))
        block.least = a.all()[2].reshape(-1, 6)[:, -1]
    a, b, c, d = (nb._Best(6) for _ in range(4))
    nb._all_products(one, two, a, b)
    nb._near_products(one, two, c, d)
    for every, near, block in ((a, c, one), (b, d, two)):
        found = {(r, o) for r, o, _ in zip(*near.all())}
        assert {(r, o) for r, o, v in zip(*every.all()) if v >= block.least[np.searchsorted(block.ids, r)]} <= found and len(found) < len(every.all()[0])
    rows, _ = nb._reaching((one.single @ two.single.T), one.least - one.loses(two), two.least - two.loses(one))
    assert len(rows) < 300 * 200 / 4


def test_vectors_that_single_precision_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_LEAST", 100)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * (1e30 if i % 50 == 0 else 1)).tolist()) for i in range(400)]
    tracks = spark.createDataFrame(rows, "idx long, embedding array<double>")
    got = {(r["idx"], r["rank"]): r["neighbor"] for r in nb.neighbor_table(tracks, 3).collect()}
    assert got == brute(tracks, 3)


@pytest.mark.parametrize("known", [2, 4, 7])
def test_an_update_meets_only_what_may_be_nearer(tracks, monkeypatch, known):
    """From tables of fewer, as many or more neighbours than are asked for; where enough are known, few products are made exactly."""
    monkeypatch.setattr(nb, "BLOCK_LEAST", 100)
    old, added = tracks.where("idx % 5 < 3"), tracks.where("idx % 5 >= 3")
    table = nb.neighbor_table(old, known)
    got = {(r["idx"], r["rank"]): r["neighbor"] for r in nb.with_added(table, old, added, 4).collect()}
    want = brute(tracks, 4)
    if known >= 4:
        assert got == want
        path, best = nb.write_blocks(old), nb._stored(table.select("idx", "neighbor", "similarity", nb._block_of(4).alias("b")))[1]
        assert path[1] == 4 and all(np.isfinite(nb._Block(path[0], b, best, 4).least).all() for b in range(4))
    else:  # what a table has never had cannot be told; rows of added tracks are whole
        new = {r["idx"] for r in added.collect()}
        assert {k: v for k, v in got.items() if k[0] in new} == {k: v for k, v in want.items() if k[0] in new}
