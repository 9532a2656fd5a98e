"""Titles that are alike: a similarity join by trigrams, and matching of whole lists with misspelt titles.

Two titles are alike if their sets of trigrams have a Jaccard similarity of `least` at least. All trigrams are put in
one order, rare ones first. A title of n trigrams that is that similar to another has one in common with it among its
first n - ceil(least n) + 1, and the other title has one there too; so titles meet by these few, mostly rare, trigrams,
not all with all. Lengths that cannot be alike do not meet. A pair that shares several is compared where it shares
the first. Every distinct title is compared once, however many tracks have it.

Keys are normalised text: 69 characters, so there are at most 69^3 trigrams, and the table of their counts is small
whatever the catalogue's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.operators.ranking import first_per
from segue.sources.stored import written


def trigrams(key: str) -> Column:
    """The distinct trigrams of a key; of a shorter one itself."""
    return F.array_distinct(F.expr(f"transform(sequence(1, greatest(1, length(`{key}`) - 2)), i -> substr(`{key}`, i, 3))"))


def gram_counts(*titles: DataFrame) -> DataFrame:
    """(gram, n): in how many distinct titles (title) of all tables a trigram is."""
    grams = None
    for t in titles:
        own = t.select(F.explode(trigrams("title")).alias("gram"))
        grams = own if grams is None else grams.union(own)
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def _sorted(titles: DataFrame, order: DataFrame) -> DataFrame:
    """(title, grams): the trigrams of titles, rare ones first."""
    rows = titles.select("title", F.explode(trigrams("title")).alias("gram")).join(F.broadcast(order), "gram")
    return rows.groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda e: e["gram"]).alias("grams"))


def fuzzy_index(titles: DataFrame, order: DataFrame, least: float) -> DataFrame:
    """(gram, title, grams, size, place): a row for each trigram by which a title can be met; to be stored for many lists."""
    size = F.size("grams")
    first = F.slice("grams", 1, size - F.ceil(size * least - 1e-9).cast("int") + 1)
    return _sorted(titles, order).select("title", "grams", size.alias("size"), F.posexplode(first).alias("place", "gram"))


def distinct_titles(rows: DataFrame, key: str = "title_key") -> DataFrame:
    return rows.select(F.col(key).alias("title")).where("title <> ''").distinct()


def meetings(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_title, right_title, l, r): pairs of two indexes that may be alike, each once."""
    name = lambda df, p: df.select("gram", *[F.col(c).alias(f"{p}_{c}") for c in ("title", "grams", "size")])
    long = (F.col("r_size") >= F.col("l_size") * least - 1e-9) & (F.col("l_size") >= F.col("r_size") * least - 1e-9)
    both = name(left, "l").join(name(right, "r"), "gram").where(long)
    first = lambda p: F.slice(f"{p}_grams", 1, F.col(f"{p}_size") - F.ceil(F.col(f"{p}_size") * least - 1e-9).cast("int") + 1)
    once = both.where(F.array_intersect(first("l"), first("r"))[0] == F.col("gram"))
    return once.select(F.col("l_title").alias("left_title"), F.col("r_title").alias("right_title"), F.col("l_grams").alias("l"), F.col("r_grams").alias("r"))


def similar_titles(left: DataFrame, right: DataFrame, least: float = 0.5, key: str = "title_key") -> DataFrame:
    """(left_title, right_title, similarity) of all distinct titles of two tables that are alike."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0, 1 at most")
    a, b = written(distinct_titles(left, key), "titles"), written(distinct_titles(right, key), "titles")
    order = written(gram_counts(a, b), "gram-counts")
    common = F.size(F.array_intersect("l", "r"))
    similarity = common / (F.size("l") + F.size("r") - common)
    found = meetings(fuzzy_index(a, order, least), fuzzy_index(b, order, least), least)
    return found.select("left_title", "right_title", similarity.alias("similarity")).where(F.col("similarity") >= least)


def fuzzy_match(wanted: DataFrame, tracks: DataFrame, least: float = 0.5) -> DataFrame:
    """(ord, idx, similarity, artist_meets): the best track for every wanted song (ord, title_key, artists) that has one.

    The most similar title comes first, then a track that shares an artist, then most occurrences, then the smallest idx.
    The best track of each title, and of each title and artist, is found before songs meet them.
    """
    pairs = similar_titles(wanted, tracks, least)
    order = [-F.col("count"), F.col("idx")]
    songs = wanted.select("ord", F.col("title_key").alias("left_title"), F.col("artists").alias("want")).join(pairs, "left_title")
    by_title = first_per(tracks.select("title_key", "idx", "count"), ["title_key"], order).select(F.col("title_key").alias("right_title"), F.struct((-F.col("count")).alias("minus"), "idx").alias("any"))
    by_artist = first_per(tracks.select("title_key", F.explode("artists").alias("artist"), "idx", "count"), ["title_key", "artist"], order).select(F.col("title_key").alias("right_title"), "artist", F.struct((-F.col("count")).alias("minus"), "idx").alias("own"))
    near = songs.select("ord", "right_title", F.explode("want").alias("artist")).join(by_artist, ["right_title", "artist"]).groupBy("ord", "right_title").agg(F.min("own").alias("own"))
    met = songs.join(by_title, "right_title").join(near, ["ord", "right_title"], "left")
    place = F.struct((-F.col("similarity")).alias("minus"), F.col("own").isNull().alias("other"), F.coalesce("own", "any").alias("track"))
    chosen = met.groupBy("ord").agg(F.min(place).alias("b"))
    return chosen.select("ord", F.col("b.track.idx").alias("idx"), (-F.col("b.minus")).alias("similarity"), (~F.col("b.other")).alias("artist_meets"))
