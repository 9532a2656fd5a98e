"""The catalogue: one row per track with keys for matching and search, and lookups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions.text import artists_key, text_key


def with_keys(tracks: DataFrame) -> DataFrame:
    """tracks with artist_key, title_key and the distinct normalised artists; to be stored, not made for each request."""
    return tracks.withColumns({"artist_key": text_key("artist_name"), "title_key": text_key("track_name"), "artists": artists_key("artist_name")})


def check_aligned(tracks: DataFrame, vectors: DataFrame) -> None:
    """Raise ValueError unless every vocabulary row has a vector and every vector a row."""
    for left, right, what in ((tracks, vectors, "a track without a vector"), (vectors, tracks, "a vector without a track")):
        lost = left.select("idx").join(right.select("idx"), "idx", "left_anti").take(1)
        if lost:
            raise ValueError(f"{what}: idx {lost[0]['idx']}")


def lookup(tracks: DataFrame, track_uri: str) -> DataFrame:
    """The row of one uri, or none."""
    return tracks.where(F.col("track_uri") == track_uri)


def batch_lookup(tracks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known tracks and unknown uris of a request (ord, track_uri), both in its order, repeats kept."""
    found = wanted.join(tracks, "track_uri").orderBy("ord")
    missing = wanted.join(tracks.select("track_uri"), "track_uri", "left_anti").orderBy("ord")
    return found, missing.select("ord", "track_uri")


def tokens(artist_key: Column | str = "artist_key", title_key: Column | str = "title_key") -> Column:
    """The distinct words of artist and title."""
    both = F.split(F.concat_ws(" ", artist_key, title_key), " ")
    return F.array_distinct(F.filter(both, lambda t: t != ""))


def token_postings(tracks: DataFrame) -> DataFrame:
    """(token, idx): an inverted index, one row for each posting, so that frequent tokens are not one row."""
    return tracks.select(F.explode(tokens()).alias("token"), "idx")


def artist_postings(tracks: DataFrame) -> DataFrame:
    """(artist, idx)."""
    return tracks.select(F.explode("artists").alias("artist"), "idx")


def posting_lists(postings: DataFrame, key: str, block: int = 10_000) -> DataFrame:
    """(key, block, ids): the ordered idx of every key, a row for each block of idx, so that no list is without bound."""
    return postings.groupBy(key, F.floor(F.col("idx") / block).alias("block")).agg(F.array_sort(F.collect_set("idx")).alias("ids"))


def title_uris(tracks: DataFrame) -> DataFrame:
    """(title_key, place, track_uri): the tracks of a title in order of idx, a row each."""
    from pyspark.sql.window import Window

    return tracks.select("title_key", (F.row_number().over(Window.partitionBy("title_key").orderBy("idx")) - 1).alias("place"), "track_uri")


def index_sizes(postings: DataFrame, key: str) -> DataFrame:
    """(key, postings, first, last) of an inverted index."""
    return postings.groupBy(key).agg(F.count("*").alias("postings"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def index_statistics(tracks: DataFrame) -> DataFrame:
    """One row: tracks, distinct tokens, distinct artists."""
    t = token_postings(tracks).agg(F.countDistinct("token").alias("tokens"))
    a = artist_postings(tracks).agg(F.countDistinct("artist").alias("artists"))
    return tracks.agg(F.count("*").alias("tracks")).crossJoin(t).crossJoin(a)


def prefix_postings(tracks: DataFrame, query_tokens: list[str]) -> DataFrame:
    """(query_token, idx) of tracks with a word that begins with a query token."""
    words = token_postings(tracks)
    hits = F.filter(F.array(*[F.lit(q) for q in query_tokens]), lambda q: F.col("token").startswith(q))
    return words.select("idx", F.explode(hits).alias("query_token")).distinct()


def title_index(tracks: DataFrame) -> DataFrame:
    """(title_key, tracks, first_idx): how many tracks share a title, and the first."""
    return tracks.groupBy("title_key").agg(F.count("*").alias("tracks"), F.min("idx").alias("first_idx"))


def exact_index(tracks: DataFrame) -> DataFrame:
    """(artist_key, title_key, idx): the first track of each pair of keys."""
    return tracks.groupBy("artist_key", "title_key").agg(F.min("idx").alias("idx"))
