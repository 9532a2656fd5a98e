from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.operators import catalog, recommend
from segue.operators import vector_index as vi

OPTIONS = recommend.Options(min_count=2, pool=100, top_n=15, recent_k=2)


@pytest.fixture(scope="module")
def tracks(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(40, 6))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    # vectors are shared, so that products tie
    rows = [(i, f"u{i}", f"Song {i % 37} {'Live' if i % 3 else ''}", f"A{i % 9} & B{i % 5}" if i % 11 else "", int(rng.integers(1, 5)), float(rng.random()), vectors[i % 40].tolist()) for i in range(4000)]
    return catalog.with_keys(spark.createDataFrame(rows, "idx long, track_uri string, track_name string, artist_name string, count long, popularity double, embedding array<double>")).repartition(5).cache()


def brute(rows, seeds, w, o):
    """The recommendation of the definition, from all rows on the driver."""
    by_uri = {r["track_uri"]: r for r in rows}
    own = [by_uri[u] for u in seeds if u in by_uri]
    mean = lambda x: np.mean([r["embedding"] for r in x], axis=0)
    unit = lambda v: v / np.linalg.norm(v)
    canonical = lambda r: " ".join(t for t in r["title_key"].split() if t != "live")
    near, far = unit(mean(own[: o.recent_k])), unit(mean(own))
    matrix = np.array([r["embedding"] for r in rows])
    value = {"recent": vi.products(matrix, near), "whole": vi.products(matrix, far)}
    support = np.sort(np.stack([vi.products(matrix, np.array(s["embedding"])) for s in own], axis=1))[:, ::-1][:, :5].mean(axis=1)
    named = [a for r in own for a in r["artists"]]
    weight = {a: named.count(a) / max(named.count(b) for b in named) for a in named}
    affinity = [max([weight.get(a, 0.0) for a in r["artists"]] or [0.0]) for r in rows]
    same = lambda r, s: canonical(r) == canonical(s) != "" and (not r["artists"] or not s["artists"] or bool(set(r["artists"]) & set(s["artists"])))
    ids = {r["idx"] for r in own}
    fits = [r["idx"] not in ids and not any(same(r, s) for s in own) for r in rows]
    keep = max(o.pool, o.top_n + len(ids) + 100)
    reach = max(2 * keep, keep + 1000) if o.overfetch == "index" else keep
    chosen = set()
    for name in value:
        first = sorted(range(len(rows)), key=lambda i: (-value[name][i], rows[i]["idx"]))[:reach]
        chosen |= {i for i in first if fits[i] and (rows[i]["count"] >= o.min_count or w.favorite > 0 and affinity[i] > 0)}
    if w.favorite > 0:
        liked = [i for i in range(len(rows)) if fits[i] and affinity[i] > 0]
        chosen |= set(sorted(liked, key=lambda i: (-affinity[i], -rows[i]["count"], -rows[i]["idx"]))[: max(o.pool, o.top_n + 100)])
    score = {i: w.recent * value["recent"][i] + w.whole * value["whole"][i] + w.support * support[i] + w.popularity * rows[i]["popularity"] + w.favorite * affinity[i] for i in chosen}
    return [(rows[i]["idx"], round(score[i], 9)) for i in sorted(score, key=lambda i: (-round(score[i], 12), rows[i]["idx"]))[: o.top_n]]


@pytest.mark.parametrize("preset", ["balance", "favorite"])
@pytest.mark.parametrize("state", ["ready", "disabled"])
def test_equal_to_brute_force(spark, tracks, preset, state):
    index = vi.index_of(tracks, enabled=state == "ready")
    assert index.state == state
    seeds = ["u5", "u77", "u5", "nowhere", "u12"]
    got = recommend.hybrid(tracks, spark.createDataFrame(list(enumerate(seeds)), "ord int, track_uri string"), recommend.PRESETS[preset], OPTIONS, index).orderBy("rank").collect()
    from dataclasses import replace

    want = brute(tracks.collect(), seeds, recommend.PRESETS[preset], replace(OPTIONS, overfetch="index" if state == "ready" else "plain"))
    assert [(r["idx"], round(r["score"], 9)) for r in got] == want


def test_states(spark, tracks):
    assert vi.index_of(None).status() == {"enabled": True, "loaded": False, "error": "there are no vectors to index"}
    assert vi.index_of(tracks, enabled=False).status()["enabled"] is False and vi.index_of(tracks).status() == {"enabled": True, "loaded": True, "error": None}
    assert vi.index_of(tracks.where("false")).state == vi.index_of(tracks.drop("embedding")).state == "absent"
    assert vi.index_of(tracks.withColumn("embedding", F.expr("if(idx = 7, slice(embedding, 1, 3), embedding)"))).error == "vectors of 3 and of 6 components"
    broken = tracks.withColumn("embedding", F.expr("if(idx >= 0, raise_error('no disk'), embedding)"))
    assert vi.index_of(broken).state == "failed" and vi.index_of(broken).overfetch == "plain"


def test_a_request_reads_the_catalogue_once(spark, tracks, tmp_path):
    tracks.write.parquet(f"{tmp_path}/catalogue")
    stored = spark.read.parquet(f"{tmp_path}/catalogue")
    found = recommend.hybrid(stored, spark.createDataFrame([(0, "u3")], "ord int, track_uri string"), recommend.PRESETS["favorite"], OPTIONS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Relation [") == 1 and "Join" not in plan


def test_equal_vectors_have_equal_products():
    rng = np.random.default_rng(1)
    one, query = rng.normal(size=64), rng.normal(size=64)
    assert len({*vi.products(np.tile(one, (1001, 1)), query).tolist(), vi.products(one[None], query)[0]}) == 1
    assert np.allclose(vi.support_of(np.tile(one, (9, 1)), np.tile(query, (3, 1)), 5), one @ query)
