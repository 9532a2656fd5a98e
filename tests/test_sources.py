from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.operators import corpus, coverage, playlist, train
from segue.schemas import SEEDS, TEXTS
from segue.sources import corpus as src
from segue.sources import model, sinks


def track(n, **more):
    return {"track_uri": f"t:{n}", "track_name": f"Song {n}", "artist_name": f"Artist {n % 3}", "duration_ms": 1000 * n, **more}


@pytest.fixture
def slices(tmp_path):
    one = {"playlists": [{"pid": 1, "tracks": [track(1), track(2), track(1)]}, {"pid": 2, "tracks": [track(3)]}, {"pid": 3, "tracks": [track(2, track_name="Other"), {"track_uri": ""}, track(4, artist_name=None)]}]}
    two = {"playlists": [{"pid": 9, "tracks": [track(5), track(1, track_name="Late")]}, {"pid": 10, "tracks": []}]}
    (tmp_path / "mpd.slice.10000-10999.json").write_text(json.dumps(one))
    (tmp_path / "mpd.slice.2000-2999.json").write_text(json.dumps(two))
    (tmp_path / "other.json").write_text("{}")
    return str(tmp_path)


def test_scan_order_caps_and_vocabulary(spark, slices):
    assert [p.rsplit(".", 2)[1] for p in src.list_slices(spark, slices)] == ["10000-10999", "2000-2999"]
    lists = src.read_playlists(spark, slices)
    assert [(r["file_ord"], r["pid"]) for r in lists.orderBy("file_ord", "playlist_ord").collect()] == [(0, 1), (0, 2), (0, 3), (1, 9), (1, 10)]
    # the cap counts short playlists, which go afterwards
    assert sorted(r["pid"] for r in corpus.sentences(src.read_playlists(spark, slices, max_playlists=2)).collect()) == [1]
    rows = corpus.valid(src.occurrences(lists))
    vocab = {r["track_uri"]: r for r in corpus.vocabulary(rows, 1).collect()}
    assert [u for u, r in sorted(vocab.items(), key=lambda x: x[1]["idx"])] == ["t:1", "t:2", "t:3", "t:4", "t:5"]
    assert vocab["t:1"]["track_name"] == "Song 1" and vocab["t:1"]["count"] == 3 and vocab["t:4"]["artist_name"] == "" and vocab["t:4"]["album_uri"] == ""
    assert corpus.corpus_statistics(lists).first().asDict() == {"corpus_count": 3, "corpus_total_words": 7}
    with pytest.raises(FileNotFoundError):
        src.list_slices(spark, slices + "/..")


def test_model_round_trip(spark, slices, tmp_path):
    vocab = corpus.vocabulary(corpus.valid(src.occurrences(src.read_playlists(spark, slices))), 1)
    model.write_vocabulary(vocab, f"{tmp_path}/vocab")
    back = model.read_vocabulary(spark, f"{tmp_path}/vocab")
    assert sorted(r["idx"] for r in back.collect()) == [0, 1, 2, 3, 4] and back.where("idx = 0").first()["duration_ms"] == 1000
    np.save(f"{tmp_path}/m.npy", np.arange(10, dtype=np.float32).reshape(5, 2))
    vectors = model.read_matrix(spark, f"{tmp_path}/m.npy")
    model.write_vectors(vectors, f"{tmp_path}/vectors")
    tracks = model.catalogue(back, model.read_vectors(spark, f"{tmp_path}/vectors"))
    assert tracks.count() == 5 and abs(sum(x * x for x in tracks.where("idx = 3").first()["embedding"]) - 1) < 1e-6
    with pytest.raises(ValueError):
        model.catalogue(back, vectors.where("idx < 4"))
    model.write_description(spark, {"backend": "x", "config": {"vector_size": 2}, "stats": {"vocab_size": 5}, "files": {"a": "b"}}, f"{tmp_path}/meta")
    found = model.read_description(spark, f"{tmp_path}/meta", loaded=True).first()
    assert found["config"]["vector_size"] == 2 and found["loaded"] and found["files"] == {"a": "b"}


def test_export_and_read_back(spark, slices, tmp_path):
    from pyspark.ml.feature import Word2VecModel

    rows = corpus.valid(src.occurrences(src.read_playlists(spark, slices)))
    lists = corpus.sentences(src.read_playlists(spark, slices))
    config = train.Config(vector_size=4, epochs=1, min_count=1, partitions=1)
    fitted = train.word2vec(lists, config)
    model.export(fitted, lists, rows, f"{tmp_path}/model", config, max_files=2)
    vocab = model.read_vocabulary(spark, f"{tmp_path}/model/vocab")
    assert [(r["track_uri"], r["count"]) for r in vocab.orderBy("idx").collect()] == [("t:1", 3), ("t:2", 2), ("t:4", 1), ("t:5", 1)]
    tracks = model.catalogue(vocab, model.read_vectors(spark, f"{tmp_path}/model/item_vectors", normalized_rows=False))
    own = {r["word"]: r["vector"] for r in Word2VecModel.load(f"{tmp_path}/model/word2vec.model").getVectors().collect()}
    assert all(abs(a - b) < 1e-6 for r in tracks.collect() for a, b in zip(r["embedding"], own[r["track_uri"]])) and tracks.count() == 4
    told = model.read_description(spark, f"{tmp_path}/model/model_meta").first()
    assert (told["stats"]["vocab_size"], told["stats"]["corpus_count"], told["stats"]["corpus_total_words"], told["stats"]["max_files"]) == (4, 3, 7, 2) and told["config"]["vector_size"] == 4
    assert json.loads(sinks.as_json(vocab.where("idx = 2").select("track_uri", "album_name", "duration_ms")).first()["value"]) == {"track_uri": "t:4", "album_name": "", "duration_ms": 4000}


def test_playlist_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" A - B - C \n\t \n\u00a0only\t\r\nX - Y\n")
    rows = src.read_playlist_lines(spark, str(tmp_path / "list.txt")).orderBy("ord").collect()
    assert [(r["artist"], r["title"]) for r in rows] == [("A", "B - C"), ("", "only"), ("X", "Y")]
    (tmp_path / "in.csv").write_text('Название;Исполнитель\n"So; ng";"He said ""x"""\nlast;\n')
    rows = src.read_import(spark, str(tmp_path / "in.csv")).orderBy("ord").collect()
    assert [(r["artist_name"], r["track_name"]) for r in rows] == [('He said "x"', "So; ng"), ("", "last")]
    (tmp_path / "odd.txt").write_text("\t\nX\u00a0-\u00a0Y\n\tZ\u2003\n")
    rows = src.read_import(spark, str(tmp_path / "odd.txt")).orderBy("ord").collect()
    assert [(r["artist_name"], r["track_name"]) for r in rows] == [("X", "Y"), ("", "Z")]
    assert src.stem("/a/b.c.txt") == "b.c" and src.frame(spark, [("u",), ("v",)], SEEDS).count() == 2 and src.frame(spark, [], TEXTS).count() == 0


def test_reports(spark, slices, tmp_path):
    rows = corpus.metadata_defaults(corpus.valid(src.occurrences(src.read_playlists(spark, slices))))
    lines = coverage.entries(spark.createDataFrame([(0, "Artist 1 - Song 1", "Artist 1", "Song 1"), (1, "Me - Song 5", "Me", "Song 5"), (2, "Ё - нет | x", "Ё", "нет | x")], "ord long, raw string, artist string, title string"))
    matches = coverage.choose_matches(lines, coverage.candidates(rows, lines))
    assert [r["method"] for r in matches.orderBy("ord").collect()] == ["exact_title_same_artist_set", "unique_title_only", "unmatched"]
    assert [(r["artist"], r["n"]) for r in coverage.top_artists(matches).orderBy("first_ord").collect()] == [("Artist 1", 1), ("Me", 1), ("Ё", 1)]
    sinks.write_coverage(matches, f"{tmp_path}/coverage", "list", "corpus")
    back = sinks.read_coverage(spark, f"{tmp_path}/coverage")
    assert sorted(map(str, back.select(*matches.columns).collect())) == sorted(map(str, matches.collect()))
    report = spark.read.json(f"{tmp_path}/coverage/report").first()
    assert report["all"]["entries"] == 3 and report["all"]["methods"]["unmatched"] == 1 and report["cyrillic_subset"]["entries"] == 1 and report["playlist"] == "list"
    assert [(a["artist"], a["n"]) for a in report["top_cyrillic_playlist_artists"]] == [("Ё", 1)] and len(report["top_playlist_artists"]) == 3
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/coverage/summary.md").collect())
    assert "## Cyrillic unmatched examples\n- Ё - нет | x" in text and '"method":"unique_title_only"' in text
    (tmp_path / "report.json").write_text(json.dumps({"matches": [{"input": "Me - Song 5", "mpd": {"track_uri": "t:5", "track_name": "Song 5", "artist_name": "b", "occurrences": 3}, "method": "unique_title_only", "confidence": 0.55, "candidate_count": 1}, {"input": "x", "mpd": None, "method": "unmatched", "confidence": 0, "candidate_count": 0}]}, indent=2))
    read = sinks.read_report(spark, f"{tmp_path}/report.json")
    assert coverage.uncertain(read).count() == 1 and read.orderBy("ord").collect()[1]["track_uri"] is None
    sinks.write_uncertain(coverage.uncertain(back), f"{tmp_path}/uncertain")
    sheet = spark.read.option("header", True).csv(f"{tmp_path}/uncertain/csv")
    assert sheet.columns == sinks.UNCERTAIN and (sheet.first()["recognized_title"], sheet.first()["method"]) == ("Song 5", "unique_title_only")
    assert any(r["value"].startswith("| Song 5 | Me ") for r in spark.read.text(f"{tmp_path}/uncertain/md").collect())
    found = coverage.filtered_tracks(rows, "Song [12]$", columns=("track_name",))
    sinks.write_filtered(found, f"{tmp_path}/filtered", "Song [12]$")
    first = spark.read.option("header", True).csv(f"{tmp_path}/filtered/tracks").first()
    assert (first["track_uri"], first["occurrences"], first["example_pids"]) == ("t:1", "2", "[1,1]")
    told = spark.read.json(f"{tmp_path}/filtered/manifest").first()
    assert (told["total_occurrences"], told["filter"]) == (3, "Song [12]$")
    best = spark.createDataFrame([(1, 0.5, "t:1", "n", "a", "b", 3)], "rank int, score double, track_uri string, track_name string, artist_name string, album_name string, count long")
    sinks.write_recommendations(best, f"{tmp_path}/best", components=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/best").columns == sinks.HYBRID


def test_editing(spark):
    rows = spark.createDataFrame([(i, f"t:{i}", "a", "b") for i in range(4)], "ord long, track_uri string, artist_name string, track_name string")
    order = lambda df: [r["track_uri"] for r in df.orderBy("ord").collect()]
    assert order(playlist.removed(rows, 1)) == ["t:0", "t:2", "t:3"] and order(playlist.swapped(rows, 1)) == ["t:0", "t:2", "t:1", "t:3"]
    twice = spark.createDataFrame([(0, "t:1", "a", "b"), (1, "t:1", "a", "b"), (2, "t:2", "a", "b")], rows.schema)
    more = spark.createDataFrame([(0, "t:9", "a", "b"), (1, "t:2", "a", "b"), (2, "t:9", "a", "c")], rows.schema)
    assert order(playlist.merged(twice, more, prepend=True)) == ["t:9", "t:1", "t:1", "t:2"]
    assert order(playlist.merged(twice, more)) == ["t:1", "t:1", "t:2", "t:9"]
    assert playlist.duplicates(twice, more).first()["duplicates"] == 2


def test_added_rows_are_seeds_and_matching_leaves_others_alone(spark):
    from segue.operators import match

    added = spark.createDataFrame([(0, "t:1", None, "A", "", "T", 5), (1, None, "B", None, "U", None, None), (2, "", None, None, None, None, 0)], "ord long, track_uri string, artist_name string, artist string, track_name string, title string, count long")
    rows = playlist.normalized(added)
    assert [tuple(r) for r in rows.orderBy("ord").collect()] == [(0, "t:1", "A", "T", "", 5, True, "search_result", 1.0), (1, None, "B", "U", "", 0, False, "unverified", 0.0), (2, None, "", "", "", 0, False, "unverified", 0.0)]
    assert [r["track_uri"] for r in playlist.seeds(rows).collect()] == ["t:1"]
    assert sorted(r["ord"] for r in playlist.unverified(rows).collect()) == [1, 2]
    found = spark.createDataFrame([(1, "title_only_uncertain", 0.45, False, "t:7", "U2", "B2", "L", 9)], "ord long, status string, confidence double, matched boolean, track_uri string, track_name string, artist_name string, album_name string, count long")
    after = {r["ord"]: r for r in match.merge_matches(rows, found).collect()}
    assert after[0]["status"] == "search_result" and after[0]["confidence"] == 1.0 and after[2]["status"] == "unverified"
    assert (after[1]["track_uri"], after[1]["track_name"], after[1]["status"], after[1]["confidence"]) == (None, "U", "title_only_uncertain", 0.45)
    sure = found.withColumns({"matched": found.matched | True, "status": found.status, "album_name": found.album_name, "track_name": found.track_name.substr(1, 0)})
    one = match.merge_matches(rows, sure).where("ord = 1").first()
    assert (one["track_uri"], one["track_name"], one["artist_name"], one["album_name"], one["count"], one["matched"]) == ("t:7", "U", "B2", "L", 9, True)
    assert playlist.status_counts(match.merge_matches(rows, found)).first().asDict() == {"total": 3, "matched": 1, "uncertain": 1, "pending": 1}


def test_training_lowers_the_loss(spark):
    lists = spark.createDataFrame([(p, [(p % 4) * 5 + i % 5 for i in range(10)]) for p in range(60)], "pid long, ids array<long>")
    vocab = spark.createDataFrame([(i, 30) for i in range(20)], "idx long, count long")
    rows, losses = train.sgns(lists, vocab, train.Config(vector_size=8, window=2, epochs=4, learning_rate=0.05), partitions=2)
    assert rows.count() == 20 and losses[-1] < losses[0]
    whole, sequence = train.sgns(lists, vocab, train.Config(vector_size=8, window=2, epochs=4, learning_rate=0.05))
    assert sequence[-1] < losses[0] and whole.where("size(embedding) <> 8 or size(context) <> 8").count() == 0
    again = train.sgns(lists, vocab, train.Config(vector_size=8, window=2, epochs=4, learning_rate=0.05), partitions=2)[1]
    assert again == losses


def _groups(spark, train):
    """Lists within twelve groups of six items each, their vocabulary, and how much nearer items of a group are."""
    rng = np.random.default_rng(3)
    rows = [(p, [(p % 12) * 6 + i for i in rng.integers(0, 6, 12).tolist()]) for p in range(720)]
    lists = spark.createDataFrame(rows, "pid long, ids array<long>")
    vocab = spark.createDataFrame([(i, 120) for i in range(72)], "idx long, count long")

    def quality(vectors):
        held = {r["idx"]: np.array(r["embedding"]) for r in vectors.collect()}
        unit = np.stack([held[i] / np.linalg.norm(held[i]) for i in range(72)])
        near = unit @ unit.T
        same = np.arange(72)[:, None] // 6 == np.arange(72) // 6
        np.fill_diagonal(near, -2)
        return float(same[np.arange(72)[:, None], np.argsort(-near, axis=1)[:, :5]].mean())

    return lists, vocab, quality


def test_a_grid_trains_as_well_as_one_cell(spark):
    import os
    import re

    lists, vocab, quality = _groups(spark, train)
    config = train.Config(vector_size=12, window=3, epochs=2, learning_rate=0.05)
    one, six = (train.sgns(lists, vocab, config, partitions=n) for n in (1, 5))
    assert quality(one[0]) > 0.9 and quality(six[0]) > 0.95 * quality(one[0])
    vectors = train.skipgram(lists.withColumn("keep", F.transform("ids", lambda x: F.lit(1.0))), vocab, config, partitions=4)[0]
    assert quality(vectors) > 0.9
    # only the last table of vectors is left of each training, and no pairs by turn
    folder = re.sub("^file:", "", os.path.dirname(vectors.inputFiles()[0]).rsplit("/", 1)[0])
    left = {f.rsplit("/", 2)[-2] for f in vectors.inputFiles()}
    assert len(left) == 1 and not [x for x in os.listdir(folder) if x.startswith("turns-")]


def test_a_step_of_one_hot_item_stays_bounded():
    vectors, contexts = np.full((1, 2), 0.5), np.full((3, 2), 0.5)
    for _ in range(200):
        train.labelled_step(vectors, contexts, np.zeros(384, np.int64), np.arange(384) % 3, (np.arange(384) % 3 == 0) * 1.0, 0.2)
    assert np.abs(vectors).max() < 50 and np.abs(contexts).max() < 50
    assert vectors[0] @ contexts[0] > 1 and vectors[0] @ contexts[1] < -1


def test_blocks_by_items_pairs_and_cores():
    assert train.number_of_blocks(100, 1000, 8) == 1 and train.number_of_blocks(2000, 1_000_000, 8) == 8
    assert train.number_of_blocks(1_188_873, 600_000_000, 1000) == 174 and train.number_of_blocks(1_188_873, 600_000_000, 8) == 18 and train.number_of_blocks(0, 0, 8) == 1


def test_negatives_fit_the_distribution():
    """Over all blocks, every item is drawn as often as its share of all items says, for each center."""
    rng = np.random.default_rng(1)
    share = rng.random(40) ** 3
    share /= share.sum()
    asked, drawn = np.array([30_000, 0, 10_000]), np.zeros((3, 40))
    for items in np.array_split(rng.permutation(40), 4):
        center, item = train.drawn_negatives(asked, share[items], 5, rng)
        np.add.at(drawn, (center, items[item]), 1)
    assert not drawn[1].any()
    for c in (0, 2):
        wanted = asked[c] * 5 * share
        assert (np.abs(drawn[c] - wanted) < 5 * np.sqrt(wanted) + 1).all() and abs(drawn[c].sum() - asked[c] * 5) < 5 * np.sqrt(asked[c] * 5)


def test_occurrences_are_kept_as_often_as_their_share(spark):
    from segue.operators import pairs as pr

    rows = spark.createDataFrame([(p, i, f"u{0 if i < 8 else p * 2 + i}") for p in range(400) for i in range(10)], "pid long, pos int, track_uri string")
    vocab = rows.groupBy("track_uri").agg(F.count("*").alias("count")).withColumn("idx", F.substring("track_uri", 2, 9).cast("long"))
    lists = train.kept_lists(rows, vocab, 0.01)
    keep = {r["idx"]: r["keep"] for r in train.keep_probability(vocab, 0.01).collect()}
    often = 3200 / (0.01 * 4000)
    assert abs(keep[0] - (often**0.5 + 1) / often) < 1e-9 and {k for i, k in keep.items() if i} == {1.0}
    assert train.keep_probability(vocab, 0).where("keep < 1").count() == 0
    seen = []
    for epoch in range(3):
        places = pr.shrinking_pairs(lists, 5, 42, epoch).groupBy("pid", "center_pos").agg(F.first("center").alias("center"), F.max(F.abs(F.col("context_pos") - F.col("center_pos"))).alias("far"), F.count("*").alias("n")).collect()
        hot = sum(r["center"] == 0 for r in places)
        assert abs(hot - 3200 * keep[0]) < 5 * (3200 * keep[0]) ** 0.5 and all(r["far"] <= 5 and r["n"] <= 2 * r["far"] for r in places)
        seen.append({(r["pid"], r["center_pos"], r["center"]) for r in places})
    assert seen[0] != seen[1] != seen[2] and len({r["far"] for r in places}) > 1


def test_sampled_pairs(spark):
    from collections import Counter

    from segue.operators import pairs as pr

    lists = spark.createDataFrame([(p, list(range(n))) for p, n in enumerate([0, 1, 2, 3, 4, 7, 11, 40])], "pid long, ids array<long>")
    key = lambda df: Counter(map(tuple, df.collect()))
    whole = key(pr.skipgram_pairs(lists, 3))
    assert key(pr.sampled_pairs(lists, 3, 10_000)) == whole == key(pr.sampled_pairs(lists, 3, 0))
    drawn = Counter()
    for seed in range(60):
        found = key(pr.sampled_pairs(lists, 3, 10, seed))
        assert not found - whole and Counter(k[0] for k in found.elements()) == Counter({p: min(10, n) for p, n in Counter(k[0] for k in whole).items()})
        drawn.update(k for k in found if k[0] == 6)
    plan = pr.sampled_pairs(lists, 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    want = 60 * 10 / 54  # of the pairs of eleven items
    assert len(drawn) == 54 and sum((n - want) ** 2 / want for n in drawn.values()) < 100


def test_a_step_is_its_pairs_gradients():
    """A block of pairs without repeats, against the gradient pair by pair."""
    rng = np.random.default_rng(5)
    vectors, contexts = rng.normal(size=(6, 4)), rng.normal(size=(40, 4))
    center, context, negatives = np.array([0, 2, 4]), np.array([1, 3, 5]), np.arange(10, 22).reshape(3, 4)
    v, c, losses = vectors.copy(), contexts.copy(), []
    for i, o, others in zip(center, context, negatives):
        change, loss = np.zeros(4), 0.0
        for target, label in [(o, 1.0), *((n, 0.0) for n in others)]:
            p = 1 / (1 + np.exp(-vectors[i] @ contexts[target]))
            loss -= np.log((p if label else 1 - p) + 1e-7)
            change += (p - label) * contexts[target]
            c[target] -= 0.1 * (p - label) * vectors[i]
        v[i] -= 0.1 * change
        losses.append(loss)
    got = train.sgns_step(vectors, contexts, center, context, negatives, 0.1)
    assert np.allclose(vectors, v) and np.allclose(contexts, c) and abs(got - np.mean(losses)) < 1e-9


def test_stream_counts_go_on(spark, sf_dir, tmp_path):
    """Windows that have closed have the counts of the whole table, whatever arrived when; those still open are not told."""
    from pyspark.sql import functions as F

    from segue.streaming import counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.withColumn("ts", events.ts.cast("timestamp"))
    middle, last = events.agg(F.expr("percentile(cast(ts as double), 0.5)"), F.max(F.col("ts").cast("double"))).first()
    for part in ("<=", ">"):
        events.where(F.expr(f"cast(ts as double) {part} {middle}")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = counts.windowed_counts(counts.read_events(spark, f"{tmp_path}/in"), late="1 hour")
        counts.write_available(rows, f"{tmp_path}/out", f"{tmp_path}/state")
    told = spark.read.schema("window_start timestamp, event_type string, n long").parquet(f"{tmp_path}/out")
    batch = events.groupBy(F.window("ts", "1 hour").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    closed = batch.where(F.col("window_start").cast("double") + 3600 <= last - 3600)
    key = lambda df: sorted(map(tuple, df.select("window_start", "event_type", "n").collect()))
    assert key(told) == key(closed) and closed.count() > 0


def test_a_title_of_many_tracks_and_many_wants(spark):
    """Ten thousand tracks and as many wants of one title meet by artists, not all with all: a hundred million pairs."""
    found = spark.range(10_000).select(F.lit("t").alias("title_key"), F.concat(F.lit("u"), "id").alias("track_uri"), F.lit("T").alias("track_name"), F.col("id").cast("string").alias("artist_name"), (F.col("id") % 7).alias("occurrences"), F.struct(F.lit(0).alias("f"), F.col("id").alias("p"), F.lit(0).alias("i")).alias("first"))
    found = found.withColumn("artist_tokens", F.array(F.concat(F.lit("a"), F.col("artist_name"))))
    wanted = spark.range(10_000).select(F.col("id").alias("ord"), F.lit("raw").alias("raw"), F.lit("x").alias("artist"), F.lit("t").alias("title_key"), F.lit(False).alias("has_cyrillic"))
    token = lambda n: F.concat(F.lit("a"), n.cast("string"))
    wanted = wanted.withColumn("artist_tokens", F.when(F.col("ord") < 5000, F.array(token(F.col("ord")))).when(F.col("ord") < 8000, F.array(token(F.col("ord")), token(F.col("ord") + 1))).otherwise(F.array(F.lit("nobody"))))
    rows = {r["ord"]: r for r in coverage.choose_matches(wanted, found).collect()}
    assert len(rows) == 10_000 and all(r["candidate_count"] == 10_000 for r in rows.values())
    assert all(rows[i]["track_uri"] == f"u{i}" and rows[i]["method"] == "exact_title_same_artist_set" for i in range(5000))
    best = lambda i: i if i % 7 > (i + 1) % 7 else i + 1
    assert all(rows[i]["track_uri"] == f"u{best(i)}" and rows[i]["confidence"] == 0.92 for i in range(5000, 8000))
    assert all(rows[i]["track_uri"] is None and rows[i]["method"] == "ambiguous_title" for i in range(8000, 10_000))


def test_a_kept_table_follows_its_sources(spark, tmp_path):
    import shutil

    from segue.sources import stored

    made = []

    def make():
        made.append(1)
        return spark.read.parquet(f"{tmp_path}/t").selectExpr("id + 1 AS id")

    def kept():
        return sorted(r["id"] for r in stored.kept(spark, ("test", str(tmp_path)), make, "kept-test", (f"{tmp_path}/t",)).collect())

    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert kept() == kept() == [1, 2, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert kept() == [1, 2, 3, 4, 5] and len(made) == 2
    for path, _ in list(stored._KEPT.values()):
        if "kept-test" in path:
            shutil.rmtree(path.removeprefix("file:"))
    assert kept() == [1, 2, 3, 4, 5] and len(made) == 3


def test_factors_tell_groups_apart(spark):
    """Items of lists that never meet: a pid's own group scores above the other, also items that it does not hold."""
    from segue.operators import analytics

    rng = np.random.default_rng(6)
    held = {(p, (p % 2) * 12 + int(i)) for p in range(60) for i in rng.choice(12, 7, replace=False)}
    fitted = analytics.als(spark.createDataFrame([(p, i, 1.0) for p, i in sorted(held)], "pid int, item int, rating double"), rank=4)
    every = spark.createDataFrame([(p, i) for p in range(60) for i in range(24)], "pid int, item int")
    scores = {(r["pid"], r["item"]): r["prediction"] for r in fitted.transform(every).collect()}
    new = [scores[p, i] for p, i in scores if i // 12 == p % 2 and (p, i) not in held]
    other = [scores[p, i] for p, i in scores if i // 12 != p % 2]
    assert len(new) == 300 and np.mean(new) > np.mean(other) + 0.4 and np.quantile(new, 0.05) > np.quantile(other, 0.95)
