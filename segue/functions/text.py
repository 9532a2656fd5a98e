"""Text functions as column expressions.

Normalisation has two forms: native expressions that are exact for PLAIN text, and Arrow functions that fold
compatibility characters and compose accents. The keys take the native one where that is exact and send only other
values through the Arrow one.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mark a variant of a recording, the separators of artist credits, and reasons of a
# recommendation.
VARIANT_WORDS = ("acoustic", "anniversary", "bonus", "demo", "edit", "explicit", "instrumental", "karaoke", "live", "mono", "radio", "remaster", "remastered", "remix", "single", "stereo", "version")
ARTIST_SEPARATORS = r"(?iu)\s*(?:,|&| feat\.? | ft\.? | featuring | x |х|\+|/)\s*"
# What a normalised text keeps, and the letters of the Cyrillic check.
OTHER_CHARACTERS = "[^0-9a-zа-я]+"
REASONS = {
    "favorite": "совпадает с любимыми артистами плейлиста",
    "recent": "похож на последние треки",
    "whole": "попадает в общий стиль плейлиста",
    "support": "поддержан несколькими seed-треками",
    "popularity": "часто встречается в MPD-плейлистах",
    "default": "имеет близкий playlist-context в MPD",
}
CYRILLIC = "[А-Яа-яЁё]"
#: Text whose native normalisation is exact: ASCII, Latin letters and Cyrillic without compatibility forms, punctuation.
PLAIN = r"^[\x00-\x7F\u00A0-\u00A9\u00AB-\u00B1\u00B4-\u00B8\u00BB\u00BF-\u0130\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u045F\u2010-\u2027]*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(c: Column) -> Column:
    for old, new in (("ё", "е"), ("ß", "ss")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(c, OTHER_CHARACTERS, " "))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def folded(value: str | None) -> str:
    """normalize_text of one value, with compatibility normalisation (NFKC) and full case folding."""
    low = unicodedata.normalize("NFKC", value or "").casefold().replace("ё", "е")
    return " ".join(re.sub(OTHER_CHARACTERS, " ", low, flags=re.I).split())


def normalize_text(c: Column | str) -> Column:
    """Lower case, ё as е, every run of other characters than digits, a-z, а-я as one blank, trimmed; null as empty."""
    return _fold(F.lower(F.coalesce(_col(c), F.lit(""))))


@F.pandas_udf(T.StringType())
def normalize_text_full(values: pd.Series) -> pd.Series:
    """normalize_text of any text; null stays null."""
    return values.map(folded, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_artists_full(values: pd.Series) -> pd.Series:
    """split_artists of any text; null stays null."""
    cut = re.compile(ARTIST_SEPARATORS.replace("(?iu)", "(?i)"))
    return values.map(lambda v: sorted({folded(p) for p in cut.split(v)} - {""}), na_action="ignore")


def _not_plain(c: Column) -> Column:
    return F.when(~c.rlike(PLAIN), c)


def text_key(c: Column | str) -> Column:
    """normalize_text, exact for every text."""
    return F.coalesce(normalize_text_full(_not_plain(_col(c))), normalize_text(c))


def artists_key(c: Column | str) -> Column:
    """split_artists, exact for every text."""
    return F.coalesce(split_artists_full(_not_plain(_col(c))), split_artists(c))


def split_artists(c: Column | str) -> Column:
    """The distinct normalised names of an artist credit, sorted."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ARTIST_SEPARATORS), normalize_text)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def without_variants(title_key: Column | str) -> Column:
    """A normalised title without words that mark a variant."""
    return F.array_join(F.filter(F.split(_col(title_key), " "), lambda w: ~w.isin(*VARIANT_WORDS)), " ")


def canonical_title(c: Column | str) -> Column:
    """The normalised title without words that mark a variant, exact for every text."""
    return without_variants(text_key(c))


def has_cyrillic(*columns: Column | str) -> Column:
    """Whether any of the columns holds a Cyrillic letter."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(_col(c).rlike(CYRILLIC), F.lit(False))
    return found


# The rungs of the search score.
RUNGS = {"equal": 100, "artist_starts": 92, "title_starts": 88, "artist_holds": 82, "title_holds": 78, "both_hold": 70, "every_word": 60, "some_words": 10}


def search_score(query: str, artist_key: Column | str, title_key: Column | str) -> Column:
    """How well a normalised query fits an artist and a title, from 100 (equal) down to 0."""
    artist, title, tokens = _col(artist_key), _col(title_key), query.split()
    if not query:
        return F.lit(0)
    found = [(artist.contains(t) | title.contains(t)) for t in tokens]
    hits = sum((f.cast("int") for f in found), F.lit(0))
    every = found[0]
    for f in found[1:]:
        every = every & f
    ladder = F.when((artist == query) | (title == query), RUNGS["equal"]).when(artist.startswith(query), RUNGS["artist_starts"]).when(title.startswith(query), RUNGS["title_starts"])
    ladder = ladder.when(artist.contains(query), RUNGS["artist_holds"]).when(title.contains(query), RUNGS["title_holds"])
    ladder = ladder.when(F.concat_ws(" ", artist, title).contains(query), RUNGS["both_hold"]).when(every, RUNGS["every_word"])
    if len(tokens) > 1:
        ladder = ladder.when(hits > 0, RUNGS["some_words"] + hits)
    return ladder.otherwise(0)


def explanation(recent: Column, whole: Column, support: Column, popularity: Column, favorite: Column) -> Column:
    """The reasons for a recommendation, by thresholds on its components."""
    text = F.concat_ws(
        "; ",
        F.when(favorite >= 0.5, REASONS["favorite"]),
        F.when((recent >= whole) & (recent >= 0.35), REASONS["recent"]),
        F.when(whole >= 0.35, REASONS["whole"]),
        F.when(support >= 0.35, REASONS["support"]),
        F.when(popularity >= 0.55, REASONS["popularity"]),
    )
    return F.when(text == "", REASONS["default"]).otherwise(text)


def split_line(c: Column | str) -> tuple[Column, Column]:
    """Artist and title of `artist - title`, cut at the first ` - `; without it all is title."""
    line = _col(c)
    parts = F.split(line, " - ", 2)
    cut = F.instr(line, " - ") > 0
    return F.when(cut, F.get(parts, F.lit(0))).otherwise(""), F.when(cut, F.get(parts, F.lit(1))).otherwise(line)


def markdown_cell(c: Column | str) -> Column:
    return F.replace(_col(c).cast("string"), F.lit("|"), F.lit("\\|"))


def track_link(uri: Column | str, prefix: str = "spotify:track:", site: str = "https://open.spotify.com/track/") -> Column:
    """The web address of a track uri, empty for others."""
    c = _col(uri)
    return F.when(c.startswith(prefix), F.concat(F.lit(site), F.substring(c, len(prefix) + 1, 1 << 30))).otherwise("")


def duration_text(seconds: Column | str) -> Column:
    """Seconds as `1h 2m 3s`."""
    s = F.greatest(F.lit(0), _col(seconds).cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def percent(score: Column | str) -> Column:
    return F.round(_col(score) * 100).cast("int")


def component(value: Column | str) -> Column:
    """A component of a score with three decimals; 0 for null."""
    return F.format_string("%.3f", F.coalesce(_col(value).cast("double"), F.lit(0.0)))


def or_empty(c: Column | str) -> Column:
    """The column, empty for null."""
    return F.coalesce(_col(c), F.lit(""))
