"""Nearest tracks to a request's vectors in one pass over the catalogue.

A task multiplies the vectors of its rows, as they come in Arrow batches, with both query vectors of a request and keeps
the first rows of each ranking in lists of bounded length; rows that are in a list carry all that a recommendation
needs (names, affinity, support by the seeds), so the catalogue is read once. The lists of all tasks are then ranked.

Products are summed up row by row in one fixed order, so equal vectors have equal products wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The rankings: by the recent seeds' vector, by all seeds' vector, by favourite artists.
RECENT, WHOLE, FAVORITE = range(3)
#: Products of rows and seeds that are held at once.
HELD = 2_000_000
#: What a pass adds to the columns of the catalogue.
ADDED = (("recent", "double"), ("whole", "double"), ("affinity", "double"), ("support", "double"), ("kind", "int"), ("fits", "boolean"))


@dataclass(frozen=True)
class Index:
    """What vectors a request can use: `ready`, or why not (`disabled`, `absent`, `failed`)."""

    tracks: DataFrame | None
    state: str
    error: str | None = None

    @property
    def overfetch(self) -> str:
        """How a request reads its rankings: with the index some more rows than it keeps, without it those it keeps."""
        return "index" if self.state == "ready" else "plain"

    def status(self) -> dict:
        return {"enabled": self.state != "disabled", "loaded": self.state == "ready", "error": self.error}


def index_of(tracks: DataFrame | None, enabled: bool = True) -> Index:
    """The index over a catalogue: disabled by configuration, absent without vectors, failed if their lengths differ."""
    if not enabled:
        return Index(tracks, "disabled", "the vector index is disabled by configuration")
    if tracks is None or "embedding" not in tracks.columns:
        return Index(tracks, "absent", "there are no vectors to index")
    try:
        n, low, high = tracks.agg(F.count("embedding"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    except Exception as e:  # whatever keeps a catalogue from being read is a state of the service, not its end
        return Index(tracks, "failed", str(e).split("\n")[0])
    if not n or not high:
        return Index(tracks, "absent", "there are no vectors to index")
    if low != high:
        return Index(tracks, "failed", f"vectors of {low} and of {high} components")
    return Index(tracks, "ready")


@dataclass(frozen=True)
class Request:
    recent: np.ndarray
    whole: np.ndarray
    seeds: np.ndarray  # a row for each seed, repeats included
    support: int  # seeds whose similarities are averaged
    own: np.ndarray  # the seeds' idx
    artists: dict[str, float]  # favourite artists and their weights
    titles: dict[str, list[frozenset[str]]] = field(default_factory=dict)  # the seeds' artists by title, {} to keep duplicates
    reach: int = 0
    pool: int = 0  # rows of the favourite ranking; 0: none
    min_count: int = 1


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (vectors * query).sum(axis=1)


def support_of(vectors: np.ndarray, seeds: np.ndarray, most: int) -> np.ndarray:
    """The mean of each row's largest products with the seeds."""
    most, out = min(most, len(seeds)), np.empty(len(vectors))
    step = max(1, HELD // max(1, seeds.size))
    for at in range(0, len(vectors), step):
        found = (vectors[at : at + step, None, :] * seeds).sum(axis=2)
        out[at : at + step] = -np.sort(np.partition(-found, most - 1, axis=1)[:, :most], axis=1).sum(axis=1) / most
    return out


def _affinity(artists: pa.Array, weights: dict[str, float]) -> np.ndarray:
    """The largest weight of a row's artists."""
    sizes = pc.fill_null(pc.list_value_length(artists), 0).to_numpy(zero_copy_only=False)
    flat = artists.flatten().dictionary_encode()
    weight = np.array([weights.get(a, 0.0) for a in flat.dictionary.to_pylist()] + [0.0])[flat.indices.fill_null(len(flat.dictionary)).to_numpy(zero_copy_only=False)]
    found = np.zeros(sizes.size)
    np.maximum.at(found, np.repeat(np.arange(sizes.size), sizes), weight)
    return found


def _duplicates(titles: pa.Array, artists: pa.Array, known: dict[str, list[frozenset[str]]]) -> np.ndarray:
    """Rows with a seed's title that share an artist with it, or either of which names none."""
    found = np.zeros(len(titles), bool)
    same = pc.is_in(titles, pa.array(list(known), pa.string())).to_numpy(zero_copy_only=False) if known else found
    for i in np.flatnonzero(same).tolist():
        own = set(artists[i].as_py() or ())
        found[i] = any(not own or not seed or own & seed for seed in known[titles[i].as_py()])
    return found


class _Lists:
    """The first rows of every ranking of a task."""

    def __init__(self, request: Request):
        self.request = request
        self.held: dict[int, pa.Table] = {}

    def add(self, batch: pa.RecordBatch, title: str) -> None:
        r = self.request
        lists = batch.column("embedding")
        vectors = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        near, far = products(vectors, r.recent), products(vectors, r.whole)
        idx, count = batch.column("idx").to_numpy(), batch.column("count").to_numpy()
        affinity = _affinity(batch.column("artists"), r.artists) if r.artists else np.zeros(batch.num_rows)
        plain = np.zeros(batch.num_rows)
        orders = {RECENT: (idx, plain, -near), WHOLE: (idx, plain, -far)}
        fits = ~np.isin(idx, r.own) & ~_duplicates(batch.column(title), batch.column("artists"), r.titles)
        if r.pool:
            orders[FAVORITE] = (-idx, -count, -affinity)
        for kind, keys in orders.items():
            rows = np.arange(batch.num_rows) if kind != FAVORITE else np.flatnonzero(fits & (affinity > 0))
            rows = rows[np.lexsort([k[rows] for k in keys])[: self.most(kind)]]
            if rows.size:
                own = batch.drop_columns(["embedding", title] if title.startswith("__") else ["embedding"]).take(pa.array(rows))
                enough = count[rows] >= r.min_count
                if r.pool:
                    enough |= affinity[rows] > 0
                more = [near[rows], far[rows], affinity[rows], support_of(vectors[rows], r.seeds, r.support), np.full(rows.size, kind, np.int32), fits[rows] & (enough | (kind == FAVORITE))]
                own = pa.Table.from_arrays([*own.columns, *map(pa.array, more)], names=[*own.schema.names, *[n for n, _ in ADDED]])
                self.held[kind] = self.cut(kind, pa.concat_tables([self.held[kind], own]) if kind in self.held else own)

    def most(self, kind: int) -> int:
        return self.request.pool if kind == FAVORITE else self.request.reach

    def cut(self, kind: int, rows: pa.Table) -> pa.Table:
        if rows.num_rows <= self.most(kind):
            return rows
        column = lambda c: rows.column(c).to_numpy()
        keys = (-column("idx"), -column("count"), -column("affinity")) if kind == FAVORITE else (column("idx"), -column("recent" if kind == RECENT else "whole"))
        return rows.take(pa.array(np.sort(np.lexsort(keys)[: self.most(kind)])))


def _scanned(batches: Iterator[pa.RecordBatch], request: Request, title: str) -> Iterator[pa.RecordBatch]:
    lists = _Lists(request)
    for batch in batches:
        if batch.num_rows:
            lists.add(batch, title)
    for rows in lists.held.values():
        yield from rows.combine_chunks().to_batches()


def ranked(tracks: DataFrame, request: Request, title: str) -> DataFrame:
    """The tracks of all rankings of a request that fit it, each once, with recent, whole, affinity and support.

    title is the column of canonical titles. Either ranking is cut to `reach` before it is filtered, the favourite
    one is filtered before.
    """
    dropped = {"embedding", *({title} if title.startswith("__") else ())}
    kept = [f for f in tracks.schema.fields if f.name not in dropped]
    schema = T.StructType([*kept, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in ADDED]])
    found = tracks.mapInArrow(partial(_scanned, request=request, title=title), schema)
    value = F.when(F.col("kind") == RECENT, F.col("recent")).when(F.col("kind") == WHOLE, F.col("whole")).otherwise(F.col("affinity"))
    favorite = F.col("kind") == FAVORITE
    order = [F.desc(value), F.desc(F.when(favorite, F.col("count")).otherwise(0)), F.when(favorite, -F.col("idx")).otherwise(F.col("idx"))]
    place = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
    first = found.withColumn("__place", place).where((F.col("__place") <= F.when(favorite, request.pool).otherwise(request.reach)) & F.col("fits"))
    return first.dropDuplicates(["idx"]).drop("__place", "kind", "fits")
