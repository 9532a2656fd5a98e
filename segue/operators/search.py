"""Catalogue search: every track is scored, so results do not depend on paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions.text import folded, search_score
from segue.operators.ranking import page


def order():
    return [F.desc("score"), F.desc("count"), F.col("idx")]


def checked(limit: int, offset: int) -> None:
    """The ranges of a page."""
    if not 1 <= limit <= 100 or not 0 <= offset <= 5000:
        raise ValueError("limit must be 1 to 100 and offset 0 to 5000")


def scored(tracks: DataFrame, query: str) -> DataFrame:
    """Tracks (with keys) that fit the query at all, with their score."""
    key = folded(query)
    return tracks.withColumn("score", search_score(key, "artist_key", "title_key")).where("score > 0")


def search(tracks: DataFrame, query: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the tracks that fit best: by score, count, idx."""
    checked(limit, offset)
    return page(scored(tracks, query), order(), offset, limit)


def has_more(tracks: DataFrame, query: str, limit: int = 20, offset: int = 0) -> bool:
    """Whether there is a page after this one: one row more is asked for."""
    return scored(tracks, query).orderBy(*order()).offset(offset).limit(limit + 1).count() > limit
