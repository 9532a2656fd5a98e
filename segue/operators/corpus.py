"""The corpus as occurrences (track_uri, metadata, and the ordinals file_ord, playlist_ord, pos): counts, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions.text import or_empty
from segue.operators.ranking import nth_smallest, with_index

#: Where an occurrence stands in the scan of the corpus.
ORDINAL = ("file_ord", "playlist_ord", "pos")
METADATA = ("track_name", "artist_name", "artist_uri", "album_name", "album_uri", "duration_ms")


def ordinal(names: tuple[str, ...] = ORDINAL) -> Column:
    return F.struct(*names)


def valid(occurrences: DataFrame) -> DataFrame:
    """Occurrences with a track uri."""
    return occurrences.where("track_uri is not null and track_uri <> ''")


def metadata_defaults(df: DataFrame) -> DataFrame:
    """Missing text fields are empty; a missing duration stays null."""
    return df.withColumns({c: or_empty(c) for c in METADATA if c != "duration_ms" and c in df.columns})


def capped(playlists: DataFrame, most: int | None) -> DataFrame:
    """The first playlists of the scan, before any is dropped for its length.

    The file in which the cap falls is found by counts of files, then the place in it by counts of places; the rest is a
    filter, so nothing is sorted or limited as a whole. Places in a file are distinct.
    """
    if most is None:
        return playlists
    if most <= 0:
        return playlists.where("false")
    file = nth_smallest(playlists, "file_ord", most)
    if file is None:
        return playlists
    left = most - playlists.where(F.col("file_ord") < file).count()
    place = nth_smallest(playlists.where(F.col("file_ord") == file), "playlist_ord", left)
    return playlists.where((F.col("file_ord") < file) | (F.col("file_ord") == file) & (F.col("playlist_ord") <= place))


def sentences(playlists: DataFrame, least: int = 2) -> DataFrame:
    """(file_ord, playlist_ord, pid, uris): the uris of each playlist in order, of those with at least two."""
    uris = F.filter(F.transform("tracks", lambda t: t["track_uri"]), lambda u: u.isNotNull() & (u != ""))
    return playlists.select("file_ord", "playlist_ord", "pid", uris.alias("uris")).where(F.size("uris") >= least)


def occurrence_counts(occurrences: DataFrame, key: str = "track_uri") -> DataFrame:
    """(key, count): every occurrence counts, also several in a playlist."""
    return occurrences.groupBy(key).agg(F.count("*").alias("count"))


def first_seen(occurrences: DataFrame, key: str = "track_uri", columns: tuple[str, ...] = METADATA, order: tuple[str, ...] = ORDINAL) -> DataFrame:
    """(key, columns, first): the fields of a key's first occurrence, and where it stands."""
    kept = [c for c in columns if c in occurrences.columns]
    found = occurrences.groupBy(key).agg(F.min_by(F.struct(*kept), ordinal(order)).alias("m"), F.min(ordinal(order)).alias("first"))
    return found.select(key, *[F.col(f"m.{c}").alias(c) for c in kept], "first")


def metadata_of(occurrences: DataFrame, keys: DataFrame, key: str = "track_uri") -> DataFrame:
    """First-seen metadata of the keys of a vocabulary only."""
    return first_seen(occurrences.join(keys.select(key).distinct(), key, "left_semi"), key)


def vocabulary(occurrences: DataFrame, min_count: int = 2, key: str = "track_uri", order: tuple[str, ...] = ORDINAL) -> DataFrame:
    """Tracks with at least min_count occurrences, with idx by falling count, ties by first occurrence."""
    columns = [c for c in METADATA if c in occurrences.columns]
    kept = [F.min_by(F.struct(*columns), ordinal(order)).alias("m")] if columns else []
    counted = occurrences.groupBy(key).agg(F.count("*").alias("count"), F.min(ordinal(order)).alias("first"), *kept).where(F.col("count") >= min_count)
    rows = counted.select(key, *[F.col(f"m.{c}").alias(c) for c in columns], "count", "first")
    return metadata_defaults(with_index(rows, [F.desc("count"), F.col("first")])).drop("first")


def in_vocabulary(occurrences: DataFrame, vocab: DataFrame, playlist: str = "pid", key: str = "track_uri", pos: str = "pos", least: int = 2) -> DataFrame:
    """(playlist, ids): the idx of each playlist's known tracks in order, positions closed up, of those with at least two."""
    known = occurrences.join(vocab.select(key, "idx"), key)
    lists = known.groupBy(playlist).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "idx"))), lambda e: e["idx"]).alias("ids"))
    return lists.where(F.size("ids") >= least)


def popularity(tracks: DataFrame, count: str = "count") -> DataFrame:
    """tracks with popularity: log1p(count) over its largest value."""
    most = tracks.agg(F.greatest(F.max(F.log1p(count)), F.lit(1e-12)).alias("__most"))
    return tracks.crossJoin(F.broadcast(most)).withColumn("popularity", F.log1p(count) / F.col("__most")).drop("__most")


def sampling_distribution(vocab: DataFrame, power: float = 0.75, count: str = "count") -> DataFrame:
    """vocab with probability: count to the power, over the sum."""
    total = vocab.agg(F.sum(F.pow(F.col(count).cast("double"), F.lit(power))).alias("__total"))
    return vocab.crossJoin(F.broadcast(total)).withColumn("probability", F.pow(F.col(count).cast("double"), F.lit(power)) / F.col("__total")).drop("__total")


def corpus_statistics(playlists: DataFrame) -> DataFrame:
    """One row: playlists with at least two uris, occurrences in them."""
    return sentences(playlists).agg(F.count("*").alias("corpus_count"), F.coalesce(F.sum(F.size("uris")), F.lit(0)).alias("corpus_total_words"))
