from __future__ import annotations

import pytest

from segue.operators import recommend
from segue.plans import bindings as b


@pytest.fixture(scope="module")
def tracks(spark, sf_dir):
    return b.tracks(spark, sf_dir).cache()


@pytest.mark.parametrize("preset", sorted(recommend.PRESETS))
def test_ranks_scores_and_seeds(spark, tracks, preset):
    options = recommend.Options(min_count=1, pool=100, recent_k=2)
    rows = recommend.hybrid(tracks, b.seeds(spark), recommend.weights(preset), options).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows
    scores = [r["score"] for r in rows]
    assert scores == sorted(scores, reverse=True) and not {r["idx"] for r in rows} & {p for _, p in b.SEED_PARTS}
    assert all(abs(r[c]) <= 1 + 1e-6 for r in rows for c in ("recent", "whole", "support", "popularity", "affinity")) and all(r["explanation"] for r in rows)


def test_unknown_seeds_and_bad_options(spark, tracks):
    with pytest.raises(recommend.NoSeeds):
        recommend.hybrid(tracks, spark.createDataFrame([(0, "track:-1")], "ord int, track_uri string"))
    for bad in ({"top_n": 0}, {"pool": 99}, {"recent_k": 0}, {"recent_k": 101}, {"side": "middle"}):
        with pytest.raises(ValueError):
            recommend.Options(**bad)
    for bad in ({"recent": 1.1}, {"popularity": -0.1}):
        with pytest.raises(ValueError):
            recommend.Weights(**bad)
    assert recommend.health(None)["status"] == "error" and recommend.health(tracks.limit(0))["status"] == "degraded" and recommend.health(tracks)["status"] == "ok"
    with pytest.raises(recommend.NotLoaded):
        recommend.loaded(None)
    with pytest.raises(ValueError, match="more than"):
        recommend.known_seeds(tracks, spark.range(recommend.MOST_SEEDS + 1).selectExpr("int(id) ord", "'track:1' track_uri"))
    assert recommend.weights(None, recommend.Weights(favorite=0.9)).favorite == 0.0 and recommend.weights("favorite").favorite == 0.35


def test_plans_do_not_shuffle_the_catalogue(spark, tracks):
    plan = recommend.without_duplicates(tracks, recommend.known_seeds(tracks, b.seeds(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_a_seed_of_other_letters_is_a_duplicate(spark):
    """Composed and decomposed accents and ligatures are one title, by stored keys and without them."""
    from segue.operators import catalog, recommend

    rows = [(0, "Cafe\u0301 (Live)", "A"), (1, "Café", "A & B"), (2, "\ufb01re", "A"), (3, "Fire - Remastered", "A"), (4, "Fire", "C"), (5, "caf", "")]
    tracks = catalog.with_keys(spark.createDataFrame(rows, "idx long, track_name string, artist_name string"))
    for own in (tracks, tracks.drop("title_key")):
        left = recommend.without_duplicates(own, own.where("idx IN (0, 2)"))
        assert sorted(r["idx"] for r in left.collect()) == [4]
