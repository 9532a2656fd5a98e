from __future__ import annotations

import pytest
from compare import differences
from pyspark.sql import functions as F

from segue.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir):
    assert differences(QUERIES[name], ORACLES[name], spark, sf_dir) == ""


def test_capped_pairs_are_a_sample(spark, sf_dir):
    """No playlist has more pairs than the cap, those below it keep all, and reruns agree."""
    from segue.operators import pairs
    from segue.plans.registry import _lists

    every = pairs.skipgram_pairs(_lists(spark, sf_dir))
    names = ["pid", "center_pos", "context_pos", "center", "context"]
    found = {tuple(r) for r in QUERIES["pair_cap"](spark, sf_dir).select(*names).collect()}
    whole = [tuple(r) for r in every.select(*names).collect()]
    assert found <= set(whole) and found == {tuple(r) for r in QUERIES["pair_cap"](spark, sf_dir).select(*names).collect()}
    from collections import Counter

    kept, sizes = Counter(r[0] for r in found), Counter(r[0] for r in whole)
    assert all(kept[p] == min(20, n) for p, n in sizes.items())


def test_trained_vectors_place_neighbours_together(spark, sf_dir):
    rows = QUERIES["train_word2vec"](spark, sf_dir)
    assert rows.where("dim <> 64 or abs(length - 1) > 1e-4").count() == 0
    vocab = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    lists = vocab.groupBy("l_orderkey", "l_partkey").count().groupBy("l_orderkey").count().where("count >= 2")
    assert rows.count() <= vocab.select("l_partkey").distinct().count() and lists.count() > 0
    from segue.operators import train

    # two groups of items that never meet
    lists = spark.createDataFrame([([f"{'ab'[p % 2]}{(p * 7 + i * 3) % 10}" for i in range(8)],) for p in range(400)], "uris array<string>")
    vectors = {r["track_uri"]: r["embedding_norm"] for r in train.word2vec_vectors(lists, train.Config(vector_size=16, epochs=10, learning_rate=0.1, partitions=1)).collect()}
    product = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))
    own = [product(f"a{i}", f"a{j}") for i in range(10) for j in range(i)]
    other = [product(f"a{i}", f"b{j}") for i in range(10) for j in range(10)]
    assert sum(own) / len(own) > sum(other) / len(other) + 0.2


def test_every_item_of_the_vocabulary_is_trained(spark, sf_dir):
    rows = QUERIES["train_sgns"](spark, sf_dir)
    assert rows.where("dim = 64 and squared_length > 0").count() == rows.count() == QUERIES["vocab_index"](spark, sf_dir).count()
    again = {r["idx"]: r["squared_length"] for r in QUERIES["train_sgns"](spark, sf_dir).collect()}
    assert again == {r["idx"]: r["squared_length"] for r in rows.collect()}


def test_clusters_are_nearest_centres(spark, sf_dir):
    """Every track is in the cluster whose mean is nearest to it, as k-means ends."""
    import numpy as np

    from segue.plans import bindings as b

    found = {r["idx"]: r["cluster"] for r in QUERIES["item_clusters"](spark, sf_dir).collect()}
    vectors = {r["idx"]: np.array(r["embedding"]) for r in b.tracks(spark, sf_dir).select("idx", "embedding").collect()}
    assert found.keys() == vectors.keys() and len(set(found.values())) == 10
    centres = {c: np.mean([vectors[i] for i in found if found[i] == c], axis=0) for c in set(found.values())}
    near = sum(min(centres, key=lambda c: np.linalg.norm(vectors[i] - centres[c])) == found[i] for i in found)
    assert near >= 0.9 * len(found)


def test_factorisation_scores_its_own_lines_high(spark, sf_dir):
    rows = QUERIES["als_scores"](spark, sf_dir).toPandas()
    assert rows["score"].notna().all() and rows["score"].mean() > 0.1


def test_every_order_is_foretold_once(spark, sf_dir):
    """The folds read all orders, each once."""
    folds = QUERIES["recall_ndcg_folds"](spark, sf_dir).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]


def test_blocks_of_the_factorisation_follow_its_ratings(spark, monkeypatch):
    """A task holds a block whole; with ten blocks at any size a large table did not fit its memory."""
    from pyspark.ml.recommendation import ALS

    from segue.operators import analytics

    seen, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, rows: (seen.append((self.getNumUserBlocks(), self.getNumItemBlocks())), fit(self, rows))[1])
    monkeypatch.setattr(analytics, "BLOCK_RATINGS", 50)
    ratings = spark.range(1000).selectExpr("int(id div 5) pid", "int(id % 5 + id div 500 * 5) item", "float(1) rating")
    scored = analytics.als(ratings).transform(ratings)
    other = spark.range(1000).selectExpr("int(id div 5) pid", "int(id % 5 + (1 - id div 500) * 5) item", "float(1) rating")
    assert seen == [(20, 20)] and scored.agg(F.min("prediction")).first()[0] > 0.5
    assert analytics.als(ratings).transform(other).agg(F.max("prediction")).first()[0] < 0.5
    analytics.als(ratings.limit(300))
    assert seen[-1] == (10, 10)
