from __future__ import annotations

import pytest

from segue.operators import catalog, search, search_index


@pytest.fixture(scope="module")
def tracks(spark):
    words = "small steel ring economy the box anodized smith smoke".split()
    rows = [(i, f"{words[i % 9]} {words[i * 7 % 5]} {i % 300}", f"The {words[(i + 3) % 9]} {i % 41}", i % 13) for i in range(9000)]
    return catalog.with_keys(spark.createDataFrame(rows, "idx long, track_name string, artist_name string, count long")).cache()


@pytest.fixture(scope="module")
def index(spark, tracks, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('words')}/index"
    search_index.write_index(tracks, path, row_group=64 << 10)
    return search_index.read_index(spark, path)


def test_pages_and_sources(spark, tracks, index):
    for query, limit, offset, source in (("sm", 20, 0, "index"), ("the smi", 20, 480, "index"), ("mall", 20, 0, "scan"), ("ring 17", 30, 0, "index"), ("nothing at-all", 5, 0, "scan"), ("", 5, 0, "scan")):
        page = search_index.search(tracks, index, query, limit, offset)
        found = search_index.found_by_words(index, query) if source == "index" else tracks
        want = [r["idx"] for r in search.scored(tracks.join(found.select("idx"), "idx", "left_semi") if source == "index" else tracks, query).orderBy(*search.order()).offset(offset).limit(limit).collect()]
        rows = search_index.with_tracks(page, tracks).collect()
        assert (page.source, [r["idx"] for r in rows], [r["place"] for r in rows]) == (source, want, list(range(offset, offset + len(want)))), query
    assert search_index.search(tracks, None, "sm", 20, 0).source == "scan"
    for bad in ((0, 0), (101, 0), (5, -1), (5, 5001)):
        with pytest.raises(ValueError):
            search_index.search(tracks, index, "sm", *bad)


def test_has_more(spark, tracks, index):
    few = tracks.where("idx < 40")
    n = search.scored(few, "ring").count()
    for offset in range(0, n + 2):
        assert search_index.search(few, None, "ring", 1, offset).has_more == search.has_more(few, "ring", 1, offset) == (n > offset + 1)
    assert search_index.search(tracks, index, "the", 100, 5000).has_more and search_index.search(tracks, index, "the", 100, 5000).rows.count() == 100


def test_only_ranges_of_words_are_read(spark, tracks, index):
    found = search_index.found_by_words(index, "smok")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,smok)" in plan and "PushedFilters" in plan
    found.write.format("noop").mode("overwrite").save()
    assert found.count() == tracks.where("concat(' ', artist_key, ' ', title_key) LIKE '% smok%'").count()
    files = index.inputFiles()
    import pyarrow.parquet as pq

    # words are sorted over files and row groups: few of them can hold what begins with `smok`
    groups = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in files]
    stats = [m.row_group(g).column(0).statistics for m in groups for g in range(m.num_row_groups)]
    assert sum(s.min <= "smok~" and s.max >= "smok" for s in stats) < len(stats) / 2
