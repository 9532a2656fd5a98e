"""Coverage of a list of songs by the corpus, and the table of tracks whose names pass a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions.text import CYRILLIC, artists_key, markdown_cell, or_empty, split_line, text_key
from segue.operators.corpus import METADATA, ORDINAL, ordinal
from segue.sources.stored import written

# Methods of a match and their confidence; the first two count as sure.
METHODS = {"exact_title_same_artist_set": 1.0, "exact_title_artist_overlap": 0.92, "unique_title_only": 0.55, "ambiguous_title": 0.0, "unmatched": 0.0}
CONFIDENT = ("exact_title_same_artist_set", "exact_title_artist_overlap")


def _first_pids(occurrences: DataFrame, keys: list[str], order: tuple[str, ...], n: int = 5) -> DataFrame:
    """(keys, example_pids) of the first n occurrences of each key, cut down in every task before the shuffle."""
    from pyspark.sql.window import Window

    firsts = occurrences.select(*keys, "pid", *order).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n)
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "pid"))), lambda e: e["pid"]).alias("example_pids"))


def entries(lines: DataFrame) -> DataFrame:
    """Input lines (ord, raw, artist, title) with keys."""
    return lines.withColumns({"title_key": text_key("title"), "artist_tokens": artists_key("artist"), "has_cyrillic": F.coalesce(F.col("raw").rlike(CYRILLIC), F.lit(False))})


def candidates(occurrences: DataFrame, wanted: DataFrame, order: tuple[str, ...] = ORDINAL, examples: bool = True) -> DataFrame:
    """Tracks whose normalised title is wanted, by title and uri: counts, first metadata, and, if asked for, example playlists.

    playlist_count counts occurrences too, as repeats in a playlist are not told apart. Every distinct title is
    normalised once; the corpus is cut down to the wanted ones before it is grouped.
    """
    titles = occurrences.select("track_name").distinct().withColumn("title_key", text_key("track_name"))
    titles = titles.join(wanted.select("title_key").distinct(), "title_key", "left_semi").select(F.col("track_name").alias("__name"), "title_key")
    found = occurrences.join(titles, F.coalesce("track_name", F.lit("")) == F.coalesce("__name", F.lit(""))).drop("__name")
    keys = ["title_key", "track_uri"]
    counted = found.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min_by(F.struct("track_name", "artist_name"), ordinal(order)).alias("m"), F.min(ordinal(order)).alias("first"))
    rows = counted.select(*keys, "m.track_name", "m.artist_name", "occurrences", F.col("occurrences").alias("playlist_count"), "first")
    rows = rows.withColumn("artist_tokens", artists_key("artist_name"))
    return rows.join(_first_pids(found, keys, order), keys) if examples else rows


def choose_matches(lines: DataFrame, found: DataFrame) -> DataFrame:
    """A row for every entry: the best candidate of its title, method, confidence, candidate count.

    Equal artist sets come first, then overlapping ones, then a title's only candidate; most occurrences win in each,
    ties by first occurrence.
    """
    left = lines.select("ord", "raw", "artist", "title_key", F.col("artist_tokens").alias("want"), "has_cyrillic")
    wants = left.select("title_key", "want").distinct()
    best = F.struct((-F.col("occurrences")).alias("minus"), "first", "track_uri", "track_name", "artist_name", "occurrences")
    # the best track of each title and artist set; what else is asked for follows from these
    sets = written(found.groupBy("title_key", "artist_tokens").agg(F.min(best).alias("b"), F.count("*").alias("n")), "title-sets")
    titles = sets.groupBy("title_key").agg(F.min("b").alias("any"), F.sum("n").alias("candidate_count"))
    same = sets.where(F.size("artist_tokens") > 0).select("title_key", F.col("artist_tokens").alias("want"), F.col("b").alias("same"))
    # a set that shares an artist is met by that artist: as many rows as wants name artists, however many tracks a title has
    by_artist = sets.select("title_key", F.explode("artist_tokens").alias("a"), "b").groupBy("title_key", "a").agg(F.min("b").alias("b"))
    shared = wants.select("title_key", "want", F.explode("want").alias("a")).join(by_artist, ["title_key", "a"]).groupBy("title_key", "want").agg(F.min("b").alias("shared"))
    met = wants.join(titles, "title_key").join(same, ["title_key", "want"], "left").join(shared, ["title_key", "want"], "left")
    level = F.when(F.col("same").isNotNull(), 0).when(F.col("shared").isNotNull(), 1).otherwise(2)
    met = met.select("title_key", "want", "candidate_count", level.alias("tier"), F.coalesce("same", "shared", "any").alias("b"))
    rows = left.join(met, ["title_key", "want"], "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    tier = F.col("tier")
    method = F.when(tier == 0, "exact_title_same_artist_set").when(tier == 1, "exact_title_artist_overlap").when(F.col("candidate_count") == 1, "unique_title_only").when(F.col("candidate_count") == 0, "unmatched").otherwise("ambiguous_title")
    rows = rows.withColumn("method", method)
    confidence = F.element_at(F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair]), F.col("method"))
    known = F.col("confidence") > 0
    taken = [F.when(known, F.col(f"b.{c}")).alias(c) for c in ("track_uri", "track_name", "artist_name", "occurrences")]
    return rows.withColumn("confidence", confidence).select("ord", F.col("raw").alias("input"), F.col("artist").alias("input_artist"), "has_cyrillic", "method", "confidence", "candidate_count", *taken)


def summary(matches: DataFrame) -> DataFrame:
    """One row of counts and rates."""
    is_matched, sure = F.col("track_uri").isNotNull(), F.col("method").isin(*CONFIDENT)
    n = F.count("*")
    rate = lambda c: F.when(n > 0, F.round(F.count_if(c) / F.greatest(n, F.lit(1)), 4)).otherwise(0.0)
    return matches.agg(
        n.alias("entries"), F.countDistinct("input").alias("unique_entries"), F.count_if(is_matched).alias("matched_entries"), F.countDistinct("track_uri").alias("matched_unique_track_uris"),
        F.count_if(sure).alias("confident_matched_entries"), F.count_if(~is_matched).alias("unmatched_or_ambiguous_entries"), rate(is_matched).alias("match_rate"), rate(sure).alias("confident_match_rate"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("total_occurrences_for_matched"),
    )


def methods(matches: DataFrame) -> DataFrame:
    return matches.groupBy("method").agg(F.count("*").alias("n"))


def top_artists(matches: DataFrame, n: int = 20) -> DataFrame:
    """(artist, n, first_ord): the artists that all entries name as given, most frequent first, ties by first entry."""
    named = matches.where("coalesce(input_artist, '') <> ''").groupBy(F.col("input_artist").alias("artist"))
    return named.agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).orderBy(F.desc("n"), "first_ord").limit(n)


def examples(matches: DataFrame, n: int = 30) -> DataFrame:
    """(kind, ord, input): the first n entries that matched, that did not, and that did not with Cyrillic letters."""
    kinds = {"matched": "track_uri is not null", "unmatched": "track_uri is null", "cyrillic_unmatched": "track_uri is null and has_cyrillic"}
    found = None
    for kind, where in kinds.items():
        rows = matches.where(where).orderBy("ord").limit(n).select(F.lit(kind).alias("kind"), "ord", "input")
        found = rows if found is None else found.union(rows)
    return found


def uncertain(matches: DataFrame) -> DataFrame:
    """Rows matched by their title only, with the input cut into artist and title."""
    artist, title = split_line("input")
    rows = matches.where("track_uri is not null and method = 'unique_title_only'")
    return rows.select("ord", artist.alias("input_artist"), title.alias("input_title"), F.col("track_name").alias("recognized_title"), F.col("artist_name").alias("recognized_artist"), "method", "confidence", "candidate_count", F.col("occurrences").alias("mpd_occurrences"), "track_uri")


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a Markdown table row for each row."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[or_empty(markdown_cell(c)) for c in columns]), F.lit(" |")).alias("line"))


def filtered_tracks(occurrences: DataFrame, pattern: str = CYRILLIC, columns: tuple[str, ...] = ("track_name", "artist_name", "album_name"), order: tuple[str, ...] = ORDINAL) -> DataFrame:
    """Tracks with an occurrence whose names match a pattern: counts, first such metadata, example playlists."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    found = occurrences.where(hit)
    extra = [c for c in METADATA if c in occurrences.columns and c not in columns]
    counted = found.groupBy("track_uri").agg(F.count("*").alias("occurrences"), F.min_by(F.struct(*columns, *extra), ordinal(order)).alias("m"), F.min(ordinal(order)).alias("first"))
    rows = counted.select("track_uri", *[F.col(f"m.{c}").alias(c) for c in (*columns, *extra)], "occurrences", "first")
    return rows.join(_first_pids(found, ["track_uri"], order), "track_uri")


def manifest(rows: DataFrame) -> DataFrame:
    """One row: tracks and occurrences of a filtered table."""
    return rows.agg(F.count("*").alias("unique_tracks"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("total_occurrences"))
