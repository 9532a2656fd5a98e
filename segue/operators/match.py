"""Text tracks (ord, artist, title) to catalogue tracks: exact, then by title and artist, then by title only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions.text import artists_key, or_empty, text_key

# Tiers of a match: status, confidence, whether it counts as matched.
TIERS = (("exact", 1.0, True), ("artist_title_fallback", 0.85, True), ("title_only_uncertain", 0.45, False), ("not_found", 0.0, False))


def match_detailed(texts: DataFrame, tracks: DataFrame) -> DataFrame:
    """A row for every text: its best track, status and confidence. Within a tier the smallest idx wins."""
    asked = texts.select("ord", or_empty("artist").alias("input_artist"), or_empty("title").alias("input_title"))
    asked = asked.withColumns({"ak": text_key("input_artist"), "tk": text_key("input_title"), "tokens": artists_key("input_artist")})
    known = tracks.select("idx", "artist_key", "title_key", "artists")
    both = asked.join(known, asked["tk"] == known["title_key"])
    tier = F.when(F.col("ak") == F.col("artist_key"), 0).when(F.coalesce(F.arrays_overlap("tokens", "artists"), F.lit(False)), 1).otherwise(2)
    best = both.groupBy("ord").agg(F.min(F.struct(tier.alias("tier"), "idx")).alias("best")).select("ord", "best.tier", "best.idx")
    fields = tracks.select("idx", "track_uri", "track_name", "artist_name", "album_name", "count")
    rows = asked.join(best, "ord", "left").join(fields, "idx", "left")
    at = F.coalesce(F.col("tier"), F.lit(3)) + 1
    pick = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in TIERS]), at)
    return rows.select(
        "ord", "input_artist", "input_title", pick(0).alias("status"), pick(1).alias("confidence"), pick(2).alias("matched"), "track_uri",
        *[or_empty(c).alias(c) for c in ("track_name", "artist_name", "album_name")], F.coalesce("count", F.lit(0)).alias("count"),
    )


def matched_seeds(matches: DataFrame) -> DataFrame:
    """(ord, track_uri) of the matches that count."""
    return matches.where("matched and track_uri is not null").select("ord", "track_uri")


def match_summary(matches: DataFrame) -> DataFrame:
    """One row: texts, and how many matched."""
    return matches.agg(F.count("*").alias("tracks"), F.count_if("matched").alias("matched_count"))


def merge_matches(playlist: DataFrame, matches: DataFrame) -> DataFrame:
    """A playlist of normalised rows (playlist.normalized) after matching some of them.

    A matched row takes the catalogue's fields, as far as they say anything; of another only matched, status and
    confidence change. Rows that were not asked about stay as they are.
    """
    told = ("track_name", "artist_name", "album_name", "count")
    m = matches.select("ord", *[F.col(c).alias(f"m_{c}") for c in ("track_uri", *told, "status", "confidence", "matched")])
    rows = playlist.join(m, "ord", "left")
    asked = F.col("m_status").isNotNull()
    taken = asked & F.col("m_matched") & (or_empty("m_track_uri") != "")
    said = lambda c: F.when(F.col(f"m_{c}") != (0 if c == "count" else ""), F.col(f"m_{c}")).otherwise(F.col(c))
    fields = {"track_uri": F.when(taken, F.col("m_track_uri")).otherwise(F.col("track_uri"))}
    fields |= {c: F.when(taken, said(c)).otherwise(F.col(c)) for c in told}
    fields |= {"matched": F.when(asked, taken).otherwise(F.col("matched")), "status": F.coalesce("m_status", "status")}
    fields |= {"confidence": F.when(asked, F.coalesce("m_confidence", F.lit(0.0))).otherwise(F.col("confidence"))}
    return rows.select(*[fields.get(c, F.col(c)).alias(c) for c in playlist.columns])
