"""Importing and editing a playlist: rows (ord, artist_name, track_name, ...) of one user's list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions.text import or_empty, strip

# Names of header cells.
ARTIST_HEADERS = ("artist", "artist_name", "исполнитель")
TITLE_HEADERS = ("title", "track", "track_name", "name", "трек", "название")


def cells(line: Column) -> Column:
    """A line's cells: cut at commas and semicolons outside quotes, doubled quotes are a quote, trimmed."""
    # a doubled quote is put aside; what is left in quotes is kept whole
    aside = F.replace(line, F.lit('""'), F.lit("\x00"))
    parts = F.split(aside, r'[,;](?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda p: strip(F.replace(F.replace(p, F.lit('"'), F.lit("")), F.lit("\x00"), F.lit('"'))))


def parse_import(lines: DataFrame) -> DataFrame:
    """Artist and title of each line (ord, value) of an import, by its header, a dash, two cells, or as a title."""
    rows = lines.select("ord", strip("value").alias("line")).where("line <> ''").withColumn("cells", cells(F.col("line")))
    head = rows.agg(F.min_by(F.transform("cells", F.lower), "ord").alias("header"), F.min("ord").alias("first"))
    place = lambda names: F.least(*[F.when(F.array_position("header", n) > 0, F.array_position("header", n)) for n in names])
    head = head.select("first", place(ARTIST_HEADERS).alias("a"), place(TITLE_HEADERS).alias("t")).withColumn("headed", F.col("a").isNotNull() & F.col("t").isNotNull())
    rows = rows.crossJoin(F.broadcast(head)).where("not (headed and ord = first)")
    dash = F.split("line", r"(?U)\s[-–—]\s")
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    artist = F.when(F.col("headed"), cell((F.col("a") - 1).cast("int"))).when(F.size(dash) > 1, strip(F.get(dash, F.lit(0)))).when(F.size("cells") > 1, cell(F.lit(0))).otherwise("")
    title = F.when(F.col("headed"), cell((F.col("t") - 1).cast("int"))).when(F.size(dash) > 1, strip(F.array_join(F.slice(dash, 2, 1 << 20), " - "))).when(F.size("cells") > 1, cell(F.lit(1))).otherwise(F.col("line"))
    return rows.select("ord", artist.alias("artist_name"), title.alias("track_name")).where("track_name <> ''")


def identity() -> Column:
    """What makes two rows the same: the uri, or else artist and title."""
    return F.when(or_empty("track_uri") != "", F.col("track_uri")).otherwise(F.concat_ws("|", or_empty("artist_name"), or_empty("track_name")))


def normalized(rows: DataFrame) -> DataFrame:
    """Rows to be added as rows of a playlist: ord, and eight fields with their fallbacks.

    Names may come as artist_name or artist, track_name or title; what is missing or empty falls back. A row with a
    uri counts as matched, as a search result; others are unverified.
    """
    text = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns], F.lit(""))
    uri = F.nullif(F.col("track_uri"), F.lit("")) if "track_uri" in rows.columns else F.lit(None).cast("string")
    count = F.coalesce(F.col("count").cast("long"), F.lit(0)) if "count" in rows.columns else F.lit(0).cast("long")
    known = uri.isNotNull()
    return rows.select(
        "ord", uri.alias("track_uri"), text("artist_name", "artist").alias("artist_name"), text("track_name", "title").alias("track_name"), text("album_name").alias("album_name"), count.alias("count"),
        known.alias("matched"), F.when(known, "search_result").otherwise("unverified").alias("status"), known.cast("double").alias("confidence"),
    )


def _fresh(playlist: DataFrame, added: DataFrame) -> DataFrame:
    """The added rows whose identity the playlist does not list, each identity once."""
    listed = playlist.select(identity().alias("__identity")).distinct()
    rest = added.columns
    new = added.withColumn("__identity", identity()).join(listed, "__identity", "left_anti")
    return new.groupBy("__identity").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("r.*")


def merged(playlist: DataFrame, added: DataFrame, prepend: bool = False) -> DataFrame:
    """The playlist with the added rows behind or before it, but for those that are listed; ord counts from 0.

    Rows of the playlist all stay, repeats among them too.
    """
    rest = [c for c in playlist.columns if c != "ord"]
    both = playlist.withColumn("__src", F.lit(1)).unionByName(_fresh(playlist, added).withColumn("__src", F.lit(0 if prepend else 2)))
    return reordered(both, ["__src", "ord"]).select("ord", *rest)


def duplicates(playlist: DataFrame, added: DataFrame) -> DataFrame:
    """One row: how many added rows merged() leaves out."""
    fresh = _fresh(playlist, added).agg(F.count("*").alias("fresh"))
    return added.agg(F.count("*").alias("n")).crossJoin(F.broadcast(fresh)).select((F.col("n") - F.col("fresh")).alias("duplicates"))


def reordered(rows: DataFrame, by: list[str]) -> DataFrame:
    from segue.operators.ranking import with_index

    names = [F.col(c) for c in by]
    return with_index(rows, names, "__ord").drop("ord").withColumnRenamed("__ord", "ord")


def removed(playlist: DataFrame, at: int) -> DataFrame:
    """Without the row at a place; later rows move up."""
    return playlist.where(F.col("ord") != at).withColumn("ord", F.when(F.col("ord") > at, F.col("ord") - 1).otherwise(F.col("ord")))


def swapped(playlist: DataFrame, at: int) -> DataFrame:
    """The rows at a place and the next one change places."""
    last = F.lit(at + 1)
    return playlist.withColumn("ord", F.when(F.col("ord") == at, last).when(F.col("ord") == last, F.lit(at)).otherwise(F.col("ord")))


def status_counts(playlist: DataFrame) -> DataFrame:
    """One row: rows, and how many are matched, uncertain and pending."""
    return playlist.agg(F.count("*").alias("total"), F.count_if(F.col("matched") & (or_empty("track_uri") != "")).alias("matched"), F.count_if(F.col("status") == "title_only_uncertain").alias("uncertain"), F.count_if(F.col("status") == "unverified").alias("pending"))


def seeds(playlist: DataFrame) -> DataFrame:
    """(ord, track_uri) of rows with a uri that are matched."""
    return playlist.where("matched and coalesce(track_uri, '') <> ''").select("ord", "track_uri")


def unverified(playlist: DataFrame) -> DataFrame:
    """Rows that are to be matched: those without a status, and unverified ones."""
    return playlist.where("coalesce(status, '') in ('', 'unverified')")
