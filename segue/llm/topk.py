"""Exact top-k search by inner product with vector-approximation files.

Vectors become integers: floor(256 x) of each component x. Once over all vectors of a length, each component is cut
into CELLS equal intervals between its least and largest value; a vector's cells, a byte for each component, are
written as a column beside its exact integers. A search scans the cells alone: they bound a vector's inner product
with a query from above and below. What may be among a query's first k by its bounds (its upper bound reaches the k-th
largest lower bound) is kept: first by the tasks that scan, each with a running k-th bound, then over all tasks. Exact
vectors are then read in the order of their bounds: the k most promising of every query first, and of the others those
whose bound reaches the k-th exact result.

Queries are dealt into blocks of about QUERY_BLOCK by a hash; one block at a time is sent to the tasks, and its results
are written before the next, so neither driver nor tasks hold more than one block.

Defined results: vectors that are null or empty, or hold null or non-finite components, and rows without an id take
no part. Only vectors of a query's length are its candidates. A row is no candidate of itself; another row of the same
id is. Repeated query rows have one result each. Ties go to the smaller id. OverflowError is raised if components are
so large that a score might not fit a long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segue.llm.common import written

CELLS = 256
QUERY_BLOCK = 16_384
#: Numbers in a block of bounds; candidates that a task holds.
HELD, HELD_CANDIDATES = 2_000_000, 2_000_000


def scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The flat components times 256, rounded down; where each vector starts; its length (0: takes no part)."""
    lists = column.cast(pa.list_(pa.float64()))
    values = lists.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    sizes[bad[starts + sizes] > bad[starts]] = 0
    with np.errstate(over="ignore", invalid="ignore"):
        return np.floor(values * 256.0), starts, sizes


def by_length(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of every length, and their vectors as a matrix."""
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and largest value of each component, by length."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for _, vectors in by_length(*scaled(batch.column(0))):
            low, high = vectors.min(axis=0), vectors.max(axis=0)
            if old := found.get(low.size):
                low, high = np.minimum(low, old[0]), np.maximum(high, old[1])
            found[low.size] = (low, high)
    for size, (low, high) in found.items():
        columns = [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(low), pa.array(high)]
        yield pa.RecordBatch.from_arrays(columns, names=["size", "place", "low", "high"])


class Grid:
    """The cells of all vectors of a length."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        if float((np.maximum(np.abs(low), np.abs(high)) ** 2).sum()) >= 2.0**63:
            raise OverflowError("components are so large that scores may not fit a long")
        self.low = low.astype(np.int64)
        self.width = -(-(high.astype(np.int64) - self.low + 1) // CELLS)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def asked(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of queries: factors of the cells, what is added to their product, and how far it may be from the exact one."""
        q = queries.astype(np.float64)
        half, factors = (self.width - 1) / 2.0, q * self.width
        middle = self.low + half
        size = self.low.size + 4  # and rounding: factors and products are in single precision, what is added in double
        rounding = size * (2.0**-23 * (CELLS - 1) * np.abs(factors).sum(axis=1) + 2.0**-52 * (np.abs(q) @ np.abs(middle))) + 1.0
        return factors.astype(np.float32), q @ middle, np.abs(q) @ half + rounding


def grids(rows: DataFrame) -> dict[int, Grid]:
    """The grid of every length; the driver gets two numbers for each component of each length."""
    found = rows.select("v").mapInArrow(_ranges, "size int, place int, low double, high double")
    parts: dict[int, list] = defaultdict(list)
    for size, place, low, high in found.groupBy("size", "place").agg(F.min("low"), F.max("high")).collect():
        parts[size].append((place, low, high))
    return {size: Grid(*(np.array(x) for x in list(zip(*sorted(p)))[1:])) for size, p in parts.items()}


def _quantised(batches: Iterator[pa.RecordBatch], known: dict[int, Grid]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, vectors in by_length(*scaled(batch.column(3))):
            vectors = vectors.astype(np.int64)
            size = vectors.shape[1]
            cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(known[size].cells(vectors).tobytes())]).cast(pa.binary())
            exact = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(vectors.ravel()))
            own = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(np.full(len(rows), size, np.int32)), cells, exact], names=["row", "id", "asked", "size", "cells", "vector"])


def approximated(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> tuple[DataFrame, dict[int, Grid]]:
    """The written table (row, id, asked, size, cells, vector), and the grids of its cells."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.col(vector_col).alias("v"))
    known = grids(rows)
    made = rows.select(F.monotonically_increasing_id().alias("row"), "id", "asked", "v")
    schema = "row long, id long, asked boolean, size int, cells binary, vector array<long>"
    return written(made.mapInArrow(partial(_quantised, known=known), schema), "vector-cells"), known


class Scan:
    """Candidates of a block of queries of one length, among the cells seen so far: those whose bounds reach the k-th."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, grid: Grid, k: int):
        order = np.argsort(own)
        self.own, self.k = own[order], k
        self.factors, self.added, self.slack = (x[order] for x in grid.asked(queries))
        self.best = np.full((own.size, k), -np.inf)  # the largest middles of bounds
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def least(self) -> np.ndarray:
        """The middle that a candidate of each query must reach."""
        return self.best.min(axis=1) - 2 * self.slack

    def read(self, rows: np.ndarray, cells: np.ndarray) -> None:
        cells = cells.astype(np.float32).T
        at = np.searchsorted(self.own, rows)
        itself = np.flatnonzero(self.own[np.minimum(at, self.own.size - 1)] == rows)
        step = max(1, HELD // rows.size)
        for lo in range(0, self.own.size, step):
            part = slice(lo, lo + step)
            middle = self.factors[part] @ cells + self.added[part, None]
            mine = itself[(at[itself] >= lo) & (at[itself] < lo + step)]
            middle[at[mine] - lo, mine] = -np.inf
            better = np.flatnonzero((middle > self.best[part].min(axis=1)[:, None]).any(axis=1))
            if better.size:
                new = middle[better]
                if new.shape[1] > self.k:
                    new = np.partition(new, new.shape[1] - self.k, axis=1)[:, -self.k :]
                both = np.hstack([self.best[lo + better], new])
                self.best[lo + better] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            query, place = np.nonzero((middle >= self.least()[part, None]) & (middle > -np.inf))
            self.found.append((query + lo, rows[place], middle[query, place]))
            self.size += query.size

    def candidates(self) -> pa.RecordBatch:
        query, rows, middle = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        near = middle >= self.least()[query]
        query, rows, middle = query[near], rows[near], middle[near]
        self.found, self.size = [], 0
        slack = self.slack[query]
        return pa.RecordBatch.from_arrays([pa.array(self.own[query]), pa.array(rows), pa.array(middle - slack), pa.array(middle + slack)], names=["query", "row", "low", "high"])


def _bounded(batches: Iterator[pa.RecordBatch], asked, known: dict[int, Grid], k: int) -> Iterator[pa.RecordBatch]:
    scans = {size: Scan(own, queries, known[size], k) for size, (own, queries) in asked.value.items()}
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        for size in np.unique(sizes).tolist():
            if scan := scans.get(size):
                part = batch.filter(pa.array(sizes == size))
                flat = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8)
                scan.read(part.column(0).to_numpy(), flat.reshape(-1, size))
                if scan.size > HELD_CANDIDATES:
                    yield scan.candidates()
    for scan in scans.values():
        yield scan.candidates()


def candidates(stored: DataFrame, asked, known: dict[int, Grid], k: int) -> DataFrame:
    """(query, row, low, high, place): rows whose upper bound reaches a query's k-th lower bound, in the order of their bounds."""
    found = stored.select("row", "size", "cells").mapInArrow(partial(_bounded, asked=asked, known=known, k=k), "query long, row long, low double, high double")
    by_low = Window.partitionBy("query").orderBy(F.desc("low"), "row")
    kth = F.nth_value("low", k).over(by_low.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = found.withColumn("kth", kth).where("kth is null or high >= kth").drop("kth")
    return near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("high"), "row")))


def _exact(near: DataFrame, stored: DataFrame) -> DataFrame:
    """(query, row, id, score): the exact products of candidates."""
    other = stored.select("row", "id", "vector")
    own = stored.where("asked").select(F.col("row").alias("query"), F.col("vector").alias("q"))
    product = F.aggregate(F.zip_with("q", "vector", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    return near.select("query", "row").join(other, "row").join(own, "query").select("query", "row", "id", product.alias("score"))


def searched(stored: DataFrame, asked, known: dict[int, Grid], k: int) -> DataFrame:
    """(query, row, id, score) of exact vectors that were read for a block of queries, the first k of each among them."""
    near = written(candidates(stored, asked, known, k), "candidates")
    first = written(_exact(near.where(F.col("place") <= k), stored), "first-exact")
    sure = first.groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    rest = near.where(F.col("place") > k).join(sure, "query").where((F.col("n") < k) | (F.col("high") >= F.col("kth")))
    return first.union(_exact(rest, stored))


def _block(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    rows = rows.combine_chunks()
    own, sizes = rows.column("row").to_numpy(), rows.column("size").to_numpy()
    lists = rows.column("vector").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes, dtype=np.int64)
    return {size: (own[at], flat[(ends[at] - size)[:, None] + np.arange(size)]) for size in np.unique(sizes).tolist() if (at := np.flatnonzero(sizes == size)).size}


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner products for every row that is_query holds for."""
    spark = vectors.sparkSession
    stored, known = approximated(vectors, is_query, id_col, vector_col)
    queries = stored.where("asked").select("row", "size", "vector")
    blocks = -(-queries.count() // query_block)
    found = None
    for b in range(blocks):
        held = _block(queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow())
        if not held:
            continue
        asked = spark.sparkContext.broadcast(held)
        exact = searched(stored, asked, known, k)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        best = written(exact.withColumn("rank", rank).where(F.col("rank") <= k), "nearest")
        asked.unpersist()
        found = best if found is None else found.union(best)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = stored.where("asked").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return found.join(own, "query").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
