from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segue.operators import pairs as pr
from segue.operators import train


@pytest.fixture(scope="module")
def lists(spark):
    rng = np.random.default_rng(7)
    rows = [(p, rng.integers(0, 40, int(rng.integers(2, 16))).tolist()) for p in range(300)]
    return spark.createDataFrame(rows, "pid long, ids array<long>").cache()


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(i, 60) for i in range(40)], "idx long, count long")


def dealt(tables, blocks):
    """The pairs of all cells; ValueError if one is not in its own."""
    found = Counter()
    for r in (r for t in tables for r in t.mapInArrow(lambda x: train._dealt(x, blocks), "turn int, task int, pairs binary").collect()):
        for center, context in np.frombuffer(r["pairs"], np.int64).reshape(-1, 2).tolist():
            task, other = train.block_of(np.array([center, context]), blocks).tolist()
            if (task, (other - task) % blocks) != (r["task"], r["turn"]):
                raise ValueError((center, context))
            found[center, context] += 1
    return found


def test_all_pairs_are_dealt_to_their_cells(lists, monkeypatch):
    monkeypatch.setattr(train, "HELD", 500)
    want = Counter((r["center"], r["context"]) for r in pr.skipgram_pairs(lists, 3).collect())
    own = lists.select("ids", F.array_repeat(F.lit(3), F.size("ids")).alias("reach"))
    assert dealt([own], 5) == want == dealt([pr.skipgram_pairs(lists, 3).select("center", "context")], 1)
    drawn = lists.withColumn("keep", F.transform("ids", lambda x: F.lit(0.8)))
    want = Counter((r["center"], r["context"]) for r in pr.shrinking_pairs(drawn, 5, 42, 3).collect())
    assert dealt([pr.drawn_windows(drawn, 5, 42, 3).select("ids", "reach")], 4) == want
    assert train.pairs_in_windows(pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32()))).shape == (0, 2)


@pytest.mark.parametrize("most", [0, 20])
def test_capped_lists_are_trained_with_others(lists, vocab, most, monkeypatch):
    """The pairs of a training are those of sampled_pairs."""
    seen = []

    def grid(pairs_of, anew, vocab, config, blocks, rates):
        seen.append(dealt(pairs_of(0), blocks))

    monkeypatch.setattr(train, "_on_grid", grid)
    train.sgns(lists, vocab, train.Config(window=4, max_pairs=most), partitions=3)
    assert seen == [Counter((r["center"], r["context"]) for r in pr.sampled_pairs(lists, 4, most).collect())]


def test_a_turn_is_one_job(spark, lists, vocab):
    """Vectors are not joined, sorted and shuffled in each turn: 24 turns took more than four jobs each."""
    sc = spark.sparkContext
    sc.setJobGroup("turns", "turns")
    try:
        vectors, losses = train.sgns(lists, vocab, train.Config(vector_size=4, epochs=4), partitions=6)
        jobs = len(sc.statusTracker().getJobIdsForGroup("turns"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert vectors.count() == 40 and losses[-1] < losses[0] and jobs < 2 * 24


def test_epochs_drawn_anew_are_dealt_and_trained_in_few_jobs(spark, lists, vocab):
    """Each of 24 turns took more than four jobs, and every epoch a join; reruns have the same losses."""
    sc, drawn = spark.sparkContext, lists.withColumn("keep", F.transform("ids", lambda x: F.lit(0.9)))
    sc.setJobGroup("epochs", "epochs")
    try:
        vectors, losses = train.skipgram(drawn, vocab, train.Config(vector_size=4, epochs=4), partitions=6)
        jobs = len(sc.statusTracker().getJobIdsForGroup("epochs"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert vectors.count() == 40 and losses[-1] < losses[0] and jobs < 3 * 24
    assert train.skipgram(drawn, vocab, train.Config(vector_size=4, epochs=1), partitions=3)[1] == train.skipgram(drawn.repartition(7), vocab, train.Config(vector_size=4, epochs=1), partitions=3)[1]


def test_word2vec_vectors_need_no_model_on_the_driver(spark, monkeypatch):
    """All uris that are frequent enough get vectors, of lists with ids or without, and no MLlib model is fitted."""
    from pyspark.ml.feature import Word2Vec

    monkeypatch.setattr(Word2Vec, "fit", lambda *a: pytest.fail("a model on the driver"))
    lists = spark.createDataFrame([([f"u{p % 5}", f"u{p % 3 + 5}", f"once{p}"],) for p in range(30)], "uris array<string>")
    config = train.Config(vector_size=4, epochs=1, partitions=2)
    for own in (lists, lists.withColumn("pid", F.monotonically_increasing_id())):
        rows = train.word2vec_vectors(own, config).collect()
        assert sorted(r["track_uri"] for r in rows) == [f"u{i}" for i in range(8)]
        assert all(len(r["embedding"]) == 4 and abs(sum(x * x for x in r["embedding_norm"]) - 1) < 1e-9 for r in rows)


def test_items_without_pairs_and_empty_blocks_keep_their_vectors(spark):
    lists = spark.createDataFrame([(0, [1, 2])], "pid long, ids array<long>")
    vocab = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "idx long, count long")
    vectors, losses = train.sgns(lists, vocab, train.Config(vector_size=4, epochs=2), partitions=7)
    rows = {r["idx"]: r for r in vectors.collect()}
    assert sorted(rows) == [1, 2, 3] and all(x > 0 for x in losses)
    assert np.array_equal(rows[3]["embedding"], train.first_vectors(np.array([3]), 4, 42)[0].astype(float))
    whole = train.first_vectors(np.arange(10_000), 64, 42)
    assert abs(whole).max() <= 0.5 / 64 and abs(whole.mean()) < 1e-4 and abs(np.corrcoef(whole[:, 0], whole[:, 1])[0, 1]) < 0.05


def test_a_step_adds_up_repeats():
    rng = np.random.default_rng(2)
    rows, change = np.concatenate([np.arange(30), np.repeat([3, 5, 7], [4, 9, 40])]), rng.normal(size=(83, 5))
    want = np.zeros((30, 5))
    for r in range(30):
        own = change[rows == r]
        want[r] = own.sum(axis=0) * min(1, train.STEPS / len(own))
    got = np.zeros((30, 5))
    train._summed(got, rows, change)
    assert np.allclose(got, want)
