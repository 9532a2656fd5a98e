"""Search by a stored index of words, with a scan of the catalogue where the index finds too little.

The index has a row for every word of every track, with all that ranking needs, sorted by word and track over files: a
query's words are prefixes of words, so its rows are ranges of the files, which filters on their statistics find, and
a word that very many tracks have lies in many files. Tracks with a word that begins with one of the query's are ranked
by the ladder; if fewer fit than are asked for, the whole catalogue is scored, which also finds what stands inside words.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.functions.text import folded, search_score
from segue.operators.catalog import tokens
from segue.operators.search import checked, order

# Ranked tracks that are asked for at least and at most.
LEAST_RANKED, MOST_RANKED = 500, 5100
COLUMNS = ("idx", "count", "artist_key", "title_key")


def index_rows(tracks: DataFrame) -> DataFrame:
    """(token, idx, count, artist_key, title_key) in order of token and idx."""
    rows = tracks.select(F.explode(tokens()).alias("token"), *COLUMNS)
    return rows.repartitionByRange("token", "idx").sortWithinPartitions("token", "idx")


def write_index(tracks: DataFrame, path: str, row_group: int = 1 << 20) -> None:
    """Stores the index. Row groups (of so many bytes) are small, as a search reads those that hold its words."""
    index_rows(tracks).write.option("parquet.block.size", row_group).option("parquet.enable.dictionary", "true").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def found_by_words(index: DataFrame, query: str) -> DataFrame:
    """The tracks that have a word which begins with a word of the query, each once."""
    test = F.lit(False)
    for word in sorted(set(folded(query).split())):
        test = test | F.col("token").startswith(word)
    return index.where(test).select(*COLUMNS).dropDuplicates(["idx"])


def _ranked(rows: DataFrame, key: str, most: int) -> pa.Table:
    """The first tracks of the ladder, MOST_RANKED and one at most."""
    scored = rows.select("idx", "count", search_score(key, "artist_key", "title_key").alias("score")).where("score > 0")
    return scored.orderBy(*order()).limit(most).toArrow()


@dataclass(frozen=True)
class Page:
    """A page of a search: (place, idx, score, count), whether there is one after it, and what the rows came from."""

    rows: DataFrame
    has_more: bool
    source: str  # `index` or `scan`


def search(tracks: DataFrame, index: DataFrame | None, query: str, limit: int = 20, offset: int = 0) -> Page:
    """A page of the tracks that fit best, by score, count, idx.

    One row more than the page's is ranked, LEAST_RANKED at least. Without an index, and where it finds fewer, the
    catalogue is scored. tracks need keys.
    """
    checked(limit, offset)
    key, spark = folded(query), tracks.sparkSession
    most = min(max(offset + limit + 1, LEAST_RANKED), MOST_RANKED + 1)
    found, source = None, "scan"
    if index is not None and key:
        found, source = _ranked(found_by_words(index, query), key, most), "index"
    if found is None or found.num_rows < most:
        found, source = _ranked(tracks, key, most), "scan"
    page = found.slice(offset, limit)
    page = page.append_column("place", pa.array(range(offset, offset + page.num_rows), pa.int64()))
    rows = spark.createDataFrame(page) if page.num_rows else spark.createDataFrame([], "idx long, count long, score int, place long")
    return Page(rows.select("place", "idx", "score", "count"), found.num_rows > offset + limit, source)


def with_tracks(page: Page, tracks: DataFrame) -> DataFrame:
    """The rows of a page with all columns of their tracks, in order; files are filtered by the idx of the page."""
    ids = [r["idx"] for r in page.rows.select("idx").collect()]
    own = tracks.where(F.col("idx").isin(ids)).drop("count")
    return F.broadcast(page.rows).join(own, "idx").orderBy("place")
