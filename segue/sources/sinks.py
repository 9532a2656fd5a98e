"""Writing results and reports, and reading reports.

Tables that can grow are written in as many files as they have partitions; only reports of a bounded number of rows,
and those that are one document by definition, are one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.operators.coverage import manifest, methods, summary, top_artists

# The columns of exported tables, in their order.
SIMPLE = ["rank", "score", "track_uri", "track_name", "artist_name", "album_name", "duration_ms", "count"]
HYBRID = [*SIMPLE, "recent_similarity", "whole_playlist_similarity", "multi_seed_support", "popularity_prior"]
FILTERED = ["track_uri", "track_name", "artist_name", "artist_uri", "album_name", "album_uri", "duration_ms", "occurrences", "example_pids"]
UNCERTAIN = ["input_artist", "input_title", "recognized_artist", "recognized_title", "method", "confidence", "candidate_count", "mpd_occurrences", "track_uri"]
UNCERTAIN_HEADS = ["Песня в плейлисте", "Артист в плейлисте", "Распознанная песня", "Распознанный артист", "Вхождений в MPD"]
# The schema of a match in a coverage report.
MATCH = "input: string, mpd: struct<track_uri: string, track_name: string, artist_name: string, occurrences: bigint>, method: string, confidence: double, candidate_count: bigint"
EXAMPLES = 30


def _csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def _named(rows: DataFrame, names: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    for old, new in (aliases or {}).items():
        if old in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    return rows.select(*[F.col(n) if n in rows.columns else F.lit("").alias(n) for n in names])


def write_recommendations(rows: DataFrame, path: str, components: bool = False) -> None:
    """Recommendations by rank, 8 columns, or 12 with the components of the score."""
    names = {"recent": HYBRID[8], "whole": HYBRID[9], "support": HYBRID[10], "popularity": HYBRID[11]}
    _csv(_named(rows, HYBRID if components else SIMPLE, names).orderBy("rank").coalesce(1), path)  # 200 rows at most


def write_filtered(rows: DataFrame, path: str, pattern: str = "", n: int = EXAMPLES) -> None:
    """The filtered tracks, most frequent first, in files by rank, and beside them a manifest: filter, counts, first n."""
    order = [F.desc("occurrences"), F.col("first")]
    _csv(_named(rows.withColumn("example_pids", F.to_json("example_pids")).orderBy(*order), FILTERED), f"{path}/tracks")
    best = rows.orderBy(*order).limit(n).select(F.struct("track_name", "artist_name", "occurrences").alias("t"), "occurrences", "first")
    top = best.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("minus"), "first", "t"))), lambda e: e["t"]).alias("top_tracks"))
    manifest(rows).crossJoin(top).withColumn("filter", F.lit(pattern)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def _first_inputs(matches: DataFrame, fields: list[str], n: int = EXAMPLES) -> DataFrame:
    """One row (rows): fields of the first n matches in order."""
    first = matches.orderBy("ord").limit(n).select("ord", F.struct(*fields).alias("f"))
    return first.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "f"))), lambda e: e["f"]).alias("rows"))


def _report(matches: DataFrame) -> DataFrame:
    """One row: summaries of all and of the Cyrillic entries, and the most frequent artists of both."""
    told = matches.where("has_cyrillic")
    found = None
    for name, rows, artists, n in (("all", matches, "top_playlist_artists", 20), ("cyrillic_subset", told, "top_cyrillic_playlist_artists", 30)):
        by_method = methods(rows).agg(F.map_from_entries(F.collect_list(F.struct("method", "n"))).alias("methods"))
        one = summary(rows).crossJoin(by_method)
        one = one.select(F.struct(*[F.col(c).alias("total_mpd_occurrences_for_matched" if c == "total_occurrences_for_matched" else c) for c in one.columns]).alias(name))
        best = top_artists(rows, n).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "first_ord", "artist", "n"))), lambda e: F.struct(e["artist"].alias("artist"), e["n"].alias("n"))).alias(artists))
        both = one.crossJoin(best)
        found = both if found is None else found.crossJoin(both)
    return found


def write_coverage(matches: DataFrame, path: str, playlist: str = "", corpus: str = "") -> None:
    """A coverage report: every match as a line of JSON, one JSON document of summaries, and a short Markdown text."""
    mpd = F.when(F.col("track_uri").isNotNull(), F.struct("track_uri", "track_name", "artist_name", "occurrences"))
    matches.orderBy("ord").select("ord", "input", "input_artist", "has_cyrillic", mpd.alias("mpd"), "method", "confidence", "candidate_count").write.mode("overwrite").json(f"{path}/matches")
    report = _report(matches).withColumns({"playlist": F.lit(playlist), "mpd_data_dir": F.lit(corpus)})
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    matched, unmatched = matches.where("track_uri is not null"), matches.where("track_uri is null")
    listed = lambda rows: _first_inputs(rows, ["input"]).select(F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["input"])), "\n").alias("t"))
    parts = [
        ("All tracks", report.select(F.to_json("all").alias("t"))),
        ("Cyrillic subset", report.select(F.to_json("cyrillic_subset").alias("t"))),
        ("Matched examples", _first_inputs(matched, ["input", "track_name", "artist_name", "occurrences", "method"]).select(F.to_json("rows").alias("t"))),
        ("Unmatched examples", listed(unmatched)),
        ("Cyrillic unmatched examples", listed(unmatched.where("has_cyrillic"))),
    ]
    text = None
    for i, (head, one) in enumerate(parts):
        part = one.select(F.lit(i).alias("i"), F.concat(F.lit(f"## {head}\n"), F.coalesce("t", F.lit("")), F.lit("\n")).alias("value"))
        text = part if text is None else text.union(part)
    text.orderBy("i").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/summary.md")


def _match_schema(*more: str):
    """The fields of a match, behind some others."""
    from pyspark.sql import types as T

    return T.DataType.fromDDL(f"struct<{', '.join([*more, MATCH])}>")


def read_coverage(spark, path: str) -> DataFrame:
    """The matches of a written coverage report."""
    rows = spark.read.schema(_match_schema("ord: bigint", "input_artist: string", "has_cyrillic: boolean")).json(f"{path}/matches")
    return rows.select("ord", "input", "input_artist", "has_cyrillic", "method", "confidence", "candidate_count", "mpd.*")


def read_report(spark, path: str) -> DataFrame:
    """(ord, input, method, confidence, candidate_count, track_uri, ..) of a report in one JSON document with a list of matches."""
    from pyspark.sql import types as T

    whole = T.StructType([T.StructField("matches", T.ArrayType(_match_schema()))])
    rows = spark.read.schema(whole).option("multiLine", True).json(path)
    return rows.select(F.posexplode("matches").alias("ord", "m")).select("ord", "m.input", "m.method", "m.confidence", "m.candidate_count", "m.mpd.*")


def write_uncertain(rows: DataFrame, path: str) -> None:
    """Uncertain matches as CSV and as a Markdown table, in order of the entries."""
    _csv(_named(rows.orderBy("ord"), UNCERTAIN), f"{path}/csv")
    columns = ["input_title", "input_artist", "recognized_title", "recognized_artist", "mpd_occurrences"]
    head = ["| " + " | ".join(UNCERTAIN_HEADS) + " |", "|---|---|---|---|---:|"]
    first = rows.sparkSession.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "ord long, line string")
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    lines = rows.select(F.col("ord").cast("long").alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    first.union(lines).orderBy("ord").select("line").write.mode("overwrite").text(f"{path}/md")


def as_json(rows: DataFrame) -> DataFrame:
    """(value): a JSON document for every row, with null fields, as a service answers."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
