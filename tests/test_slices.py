from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from segue.operators import corpus
from segue.operators.ranking import nth_smallest
from segue.sources import corpus as src


def write(folder, rng):
    strange = ['a "quoted" [text', "back\\slash\\", "}{][", "\\\\\\", 'é"ü\\"', "", "日本 {", "line\nbreak\t"]
    for f in range(3):
        lists = []
        for p in range(rng.randrange(30, 60)):
            tracks = [{"track_uri": f"t:{rng.randrange(99)}", "track_name": rng.choice(strange) * rng.randrange(3), "artist_name": rng.choice(strange), "duration_ms": rng.randrange(9), "more": {"a": [{"b": 1}, []]}} for _ in range(rng.randrange(5))]
            lists.append({"name": rng.choice(strange), "pid": f * 1000 + p, **({} if p % 7 == 0 else {"tracks": tracks})})
        whole = {"info": {"x": [{"pid": -1}], "y": {"z": "\\"}}, "others": [{"pid": -2, "tracks": []}, {"pid": -3}], "playlists": lists, "last": [{"pid": -4}], "n": 5}
        (folder / f"mpd.slice.{f}.json").write_text(json.dumps(whole, ensure_ascii=f % 2 == 0, indent=[None, 2, 4][f]), encoding="utf-8")


@pytest.mark.parametrize("split_bytes", [1 << 20, 5000, 257, 64])
def test_ranges_of_a_file_give_its_playlists(spark, tmp_path, split_bytes):
    write(tmp_path, random.Random(5))
    rows = lambda df: [(r["file_ord"], r["playlist_ord"], r["pid"], r["tracks"]) for r in df.orderBy("file_ord", "playlist_ord").collect()]
    whole = src.read_playlists(spark, str(tmp_path), split_bytes=1 << 30)
    cut = src.read_playlists(spark, str(tmp_path), split_bytes=split_bytes)
    assert rows(cut) == rows(whole) and whole.count() > 90
    if split_bytes == 257:
        assert rows(src.read_playlists(spark, str(tmp_path), max_files=2, max_playlists=40, split_bytes=split_bytes)) == rows(whole)[:40]


def test_a_torn_file_is_no_document(spark, tmp_path):
    write(tmp_path, random.Random(6))
    path = tmp_path / "mpd.slice.1.json"
    path.write_bytes(path.read_bytes()[:-900])
    with pytest.raises(Exception, match="no whole JSON document"):
        src.read_playlists(spark, str(tmp_path), split_bytes=512).count()


def test_the_nth_place(spark):
    rng = random.Random(7)
    values = [rng.randrange(-(10**12), 10**12) for _ in range(500)] + [5] * 20
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    for n in (1, 2, 250, 262, 519, 520, 900):
        assert nth_smallest(df, "v", n, parts=16) == sorted(values)[min(n, len(values)) - 1]
    assert nth_smallest(df.where("false"), "v", 1) is None


def test_caps_without_a_limit(spark):
    rows = spark.range(300).select((F.col("id") % 5).cast("int").alias("file_ord"), (F.col("id") * 7).alias("playlist_ord"))
    places = sorted(map(tuple, rows.collect()))
    for most in (0, 1, 59, 60, 61, 299, 300, 400):
        found = corpus.capped(rows, most)
        assert sorted(map(tuple, found.collect())) == places[:most] and "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert corpus.capped(rows, None).count() == 300 and corpus.capped(rows.where("false"), 3).count() == 0
