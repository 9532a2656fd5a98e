"""Playlist continuation: nearest tracks to a playlist's vectors, filtered and ranked.

Seeds are a request, of 5000 rows at most; the catalogue can be of any size and is scanned, never shuffled: what meets
it (query vectors, seeds' titles and artists) has a proven bound and is broadcast.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from segue.functions.text import canonical_title, explanation, without_variants
from segue.functions.vectors import FLOOR, dot, mean_vector, normalized
from segue.operators.ranking import with_rank
from segue.operators.vector_index import Index, Request, ranked

# Most seeds of a request, and seeds whose similarities are averaged.
MOST_SEEDS, SUPPORT_SEEDS = 5000, 5


# The defaults and ranges of weights and options.
@dataclass(frozen=True)
class Weights:
    recent: float = 0.45
    whole: float = 0.25
    support: float = 0.20
    popularity: float = 0.10
    favorite: float = 0.0

    def __post_init__(self) -> None:
        for name in ("recent", "whole", "support", "popularity", "favorite"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must be 0 to 1")


# The named presets.
PRESETS = {
    "balance": Weights(0.45, 0.25, 0.20, 0.10, 0.00),
    "balanced": Weights(0.45, 0.25, 0.20, 0.10, 0.00),
    "more_recent": Weights(0.65, 0.15, 0.15, 0.05, 0.00),
    "favorite": Weights(0.25, 0.20, 0.15, 0.05, 0.35),
    "more_popular": Weights(0.35, 0.20, 0.20, 0.25, 0.00),
}


def weights(preset: str | None = None, given: Weights = Weights()) -> Weights:
    """A preset replaces all weights; without one there is no favourite-artist weight."""
    return PRESETS[preset] if preset in PRESETS else replace(given, favorite=0.0)


@dataclass(frozen=True)
class Options:
    top_n: int = 20
    recent_k: int = 5
    side: str = "first"
    min_count: int = 10
    pool: int = 10_000
    #: What is read of either ranking: `index` reads max(2 keep, keep + 1000), `plain` reads keep.
    overfetch: str = "index"
    duplicates: bool = True

    def __post_init__(self) -> None:
        ranges = (("top_n", 1, 200), ("recent_k", 1, 100), ("min_count", 1, 1 << 31), ("pool", 100, 100_000))
        for name, low, high in ranges:  # the command line took any number, and 0 recent seeds for all
            if not (low if self.overfetch == "index" else 0) <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be {low} to {high}")
        if self.side not in ("first", "last") or self.overfetch not in ("index", "plain"):
            raise ValueError("side is first or last, overfetch index or plain")


#: What the command line took: the last seeds are the recent ones.
CLI = Options(side="last", min_count=5, pool=5000, overfetch="plain", duplicates=False)


class NoSeeds(ValueError):
    """None of the seeds is in the catalogue."""


class NotLoaded(RuntimeError):
    """There is no catalogue to recommend from."""


def health(tracks: DataFrame | None, error: str | None = None) -> dict:
    """The state of a service: ok with a catalogue, degraded with an empty one, error without one."""
    if tracks is None:
        return {"status": "error", "model_loaded": False, "vocab_size": 0, "error": error or "no catalogue"}
    size = tracks.count()
    return {"status": "ok" if size else "degraded", "model_loaded": size > 0, "vocab_size": size, "error": error}


def loaded(tracks: DataFrame | None) -> DataFrame:
    """The catalogue; NotLoaded if there is none or it is empty."""
    if tracks is None or tracks.isEmpty():
        raise NotLoaded("the catalogue is not loaded")
    return tracks


SEED_COLUMNS = ("idx", "track_uri", "track_name", "artists", "embedding")


def _known_rows(tracks: DataFrame, seeds: DataFrame) -> tuple[pa.Table, list[dict]]:
    """The tracks of seeds (ord, track_uri) in order, as a table and as rows with their canonical titles.

    A request has MOST_SEEDS seeds at most, which is looked at before anything is sent to tasks; the catalogue is
    asked for their uris, which its files filter by.
    """
    asked = sorted(seeds.select("ord", "track_uri").limit(MOST_SEEDS + 1).collect())
    if len(asked) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} seeds")
    columns = [*SEED_COLUMNS, *[c for c in ("title_key",) if c in tracks.columns]]
    found = tracks.where(F.col("track_uri").isin(sorted({r["track_uri"] for r in asked if r["track_uri"]}))).select(*columns, _canonical(tracks).alias("__canonical")).toArrow()
    place: dict[str, list[int]] = {}
    for i, uri in enumerate(found.column("track_uri").to_pylist()):
        place.setdefault(uri, []).append(i)
    order = [(r["ord"], i) for r in asked for i in place.get(r["track_uri"], ())]
    table = found.take(pa.array([i for _, i in order], pa.int64()))
    table = table.add_column(0, "ord", pa.array([o for o, _ in order], pa.int64() if isinstance(seeds.schema["ord"].dataType, LongType) else pa.int32()))
    return table, table.to_pylist()


def known_seeds(tracks: DataFrame, seeds: DataFrame) -> DataFrame:
    """The tracks of seeds (ord, track_uri) in order; repeats stay, unknown uris go.

    They are a table of the driver, so that what is made of them alone needs no job.
    """
    rows = _known_rows(tracks, seeds)[0].drop_columns(["__canonical"])
    if rows.num_rows:
        return tracks.sparkSession.createDataFrame(rows)
    return seeds.select("ord").crossJoin(tracks.select(*[c for c in rows.column_names if c != "ord"])).limit(0)


def recent(seeds: DataFrame, k: int, side: str = "first") -> DataFrame:
    """The first or last k seeds; all if k is 0."""
    order = F.col("ord") if side == "first" else F.desc("ord")
    return seeds if k <= 0 else seeds.orderBy(order).limit(k)


def playlist_vector(seeds: DataFrame) -> DataFrame:
    """One row (mean): the mean of the seeds' vectors, scaled to length one."""
    return mean_vector(seeds).select(normalized(F.col("mean")).alias("mean"))


def _mean_query(rows: list, k: int = 0, side: str = "first") -> np.ndarray:
    """The mean vector of the first or last k of the seeds' rows (all, if k is 0), scaled to length one."""
    rows = sorted(rows, key=lambda r: r["ord"], reverse=side == "last")
    mean = np.mean([r["embedding"] for r in (rows[:k] if k > 0 else rows)], axis=0)
    return mean / max(float(np.linalg.norm(mean)), FLOOR)


def _query_vector(rows: list, k: int = 0, side: str = "first") -> Column:
    """_mean_query as a constant."""
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in _mean_query(rows, k, side)) + ")")


def _one_row(df: DataFrame, **columns) -> DataFrame:
    """A table of the driver with one row, of values (kind, value)."""
    arrays = [pa.array([value], kind) for kind, value in columns.values()]
    return df.sparkSession.createDataFrame(pa.Table.from_arrays(arrays, names=list(columns)))


def artist_weights(seeds: DataFrame | list) -> dict[str, float]:
    """Of every artist the seeds that name it, over the most of any artist. seeds are a table or rows."""
    rows = seeds if isinstance(seeds, list) else seeds.select("artists").collect()
    counted = Counter(a for r in rows for a in r["artists"])
    most = max(counted.values(), default=1)
    return {a: n / most for a, n in counted.items()}


def with_affinity(tracks: DataFrame, seeds: DataFrame) -> DataFrame:
    """tracks with affinity: the largest weight of their artists, 0 if none is a favourite."""
    table = _one_row(tracks, __w=(pa.map_(pa.string(), pa.float64()), list(artist_weights(seeds).items())))
    found = F.array_max(F.transform("artists", lambda a: F.coalesce(F.col("__w")[a], F.lit(0.0))))
    return tracks.crossJoin(F.broadcast(table)).withColumn("affinity", F.coalesce(found, F.lit(0.0))).drop("__w")


def without_seeds(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    return candidates.where(~F.col("idx").isin(sorted({r["idx"] for r in seeds.select("idx").collect()})))


def _canonical(tracks: DataFrame) -> Column:
    """The canonical title, by the stored key where tracks have it."""
    return without_variants("title_key") if "title_key" in tracks.columns else canonical_title("track_name")


def without_duplicates(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """Without tracks that have a seed's canonical title and share an artist with it (or either names none)."""
    keys = seeds.select(_canonical(seeds).alias("seed_title"), F.col("artists").alias("seed_artists"))
    rows = candidates.withColumn("__title", _canonical(candidates))
    same = (F.col("__title") == F.col("seed_title")) & (F.col("__title") != "")
    meet = (F.size("artists") == 0) | (F.size("seed_artists") == 0) | F.coalesce(F.arrays_overlap("artists", "seed_artists"), F.lit(False))
    return rows.join(F.broadcast(keys), same & meet, "left_anti").drop("__title")


def with_support(candidates: DataFrame, seeds: DataFrame, most: int = SUPPORT_SEEDS) -> DataFrame:
    """candidates with support: the mean of their largest similarities to seeds, repeats included."""
    vectors = [list(r["embedding"]) for r in seeds.select("embedding").collect()]
    held = _one_row(candidates, __seeds=(pa.list_(pa.list_(pa.float64())), vectors))
    sims = F.sort_array(F.transform("__seeds", lambda s: dot(F.col("embedding"), s)), asc=False)
    mean = F.aggregate(F.slice(sims, 1, most), F.lit(0.0), lambda s, x: s + x) / F.least(F.lit(most), F.size("__seeds"))
    return candidates.crossJoin(F.broadcast(held)).withColumn("support", mean).drop("__seeds")


def with_similarities(tracks: DataFrame, seeds: DataFrame, options: Options) -> DataFrame:
    """tracks with recent and whole: their products with the two query vectors."""
    rows = seeds.select("ord", "embedding").collect()
    near, far = _query_vector(rows, options.recent_k, options.side), _query_vector(rows)
    return tracks.withColumns({"recent": dot(F.col("embedding"), near), "whole": dot(F.col("embedding"), far)})


def nearest(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows with the largest value, ties by idx."""
    return rows.orderBy(F.desc(by), "idx").limit(n)


def favorite_pool(rows: DataFrame, keep: int) -> DataFrame:
    """The tracks of favourite artists, by affinity, count, idx, all falling."""
    return rows.where("affinity > 0").orderBy(F.desc("affinity"), F.desc("count"), F.desc("idx")).limit(keep)


def keep_of(options: Options, distinct_seeds: int) -> int:
    return max(options.pool, options.top_n + distinct_seeds + 100)


def _request(rows: list, w: Weights, options: Options, favorites: dict[str, float]) -> Request:
    """What a pass over the catalogue needs to know of the seeds, MOST_SEEDS at most."""
    own = {r["idx"] for r in rows}
    keep = keep_of(options, len(own))
    titles: dict[str, list[frozenset[str]]] = {}
    for r in rows if options.duplicates else ():
        if r["__canonical"]:
            titles.setdefault(r["__canonical"], []).append(frozenset(r["artists"]))
    return Request(
        recent=_mean_query(rows, options.recent_k, options.side),
        whole=_mean_query(rows),
        seeds=np.array([r["embedding"] for r in rows], np.float64),
        support=SUPPORT_SEEDS,
        own=np.array(sorted(own), np.int64),
        artists=favorites,
        titles=titles,
        reach=max(2 * keep, keep + 1000) if options.overfetch == "index" else keep,
        pool=max(options.pool, options.top_n + 100) if w.favorite > 0 else 0,
        min_count=options.min_count,
    )


def candidates(tracks: DataFrame, seeds: DataFrame, w: Weights, options: Options) -> DataFrame:
    """Distinct candidates from the rankings by recent, whole and favourite artists, with their components.

    The catalogue is read once. seeds are those of known_seeds.
    """
    return _candidates(tracks, seeds.withColumn("__canonical", _canonical(seeds)).collect(), w, options)


def _candidates(tracks: DataFrame, rows: list, w: Weights, options: Options) -> DataFrame:
    if not rows:
        raise NoSeeds("no seed is in the catalogue")
    request = _request(rows, w, options, artist_weights(rows))
    return ranked(tracks.withColumn("__canonical", _canonical(tracks)), request, "__canonical")


def hybrid(tracks: DataFrame, seeds: DataFrame, w: Weights = Weights(), options: Options = Options(), index: Index | None = None) -> DataFrame:
    """The top_n candidates with rank, score, components and explanation. tracks need popularity; seeds are (ord, track_uri).

    With an index that is not ready, rankings are read no further than they are kept.
    """
    if index is not None and options.overfetch != index.overfetch:
        options = replace(options, overfetch=index.overfetch)
    rows = _candidates(tracks, _known_rows(tracks, seeds)[1], w, options)
    score: Column = w.recent * F.col("recent") + w.whole * F.col("whole") + w.support * F.col("support") + w.popularity * F.col("popularity") + w.favorite * F.col("affinity")
    rows = rows.withColumn("score", score)
    best = with_rank(rows.orderBy(F.desc("score"), "idx").limit(options.top_n), [F.desc("score"), F.col("idx")])
    why = explanation(F.col("recent"), F.col("whole"), F.col("support"), F.col("popularity"), F.col("affinity"))
    return best.withColumn("explanation", why)


def simple(tracks: DataFrame, seeds: DataFrame, top_n: int = 20) -> DataFrame:
    """The top_n tracks nearest to the mean of all seeds, without the seeds."""
    own = _known_rows(tracks, seeds)[1]
    if not own:
        raise NoSeeds("no seed is in the catalogue")
    rows = tracks.where(~F.col("idx").isin(sorted({r["idx"] for r in own}))).withColumn("score", dot(F.col("embedding"), _query_vector(own)))
    return with_rank(rows.orderBy(F.desc("score"), "idx").limit(top_n), [F.desc("score"), F.col("idx")])
