"""The table of nearest tracks of every track, and its update when tracks are added.

All pairs are work that grows with the square of the catalogue, so it is dealt out. Vectors are cut into blocks by a hash
and written once, a file or more for each block. A task reads two blocks from their files, multiplies them slice by
slice and keeps the best n of the rows of both; so a pair of blocks is met once for both sides, vectors are never
shuffled, and what is shuffled are results. Products are rounded to DIGITS places before they are ranked, as sums of
equal vectors may differ in their last bits with their place in a matrix.

Blocks are first met with themselves, which tells how near a row's n-th neighbour is at least. Then products are made in
single precision, and only those that may reach that, by the bound of what single precision loses, are made exactly.

Files are opened through pyarrow.fs, so the shared folder has to be in a store that it opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segue.sources.stored import new_path, read_folder

#: Rows of a block at most, and at least where cores are to spare; numbers of a slice of products; results held by a task.
BLOCK_MOST, BLOCK_LEAST, SLICE, HELD = 32_768, 256, 4_000_000, 4_000_000
DIGITS = 12
#: Exact products that are made at once.
EXACT = 50_000
RESULT = "idx long, neighbor long, similarity double"


def number_of_blocks(rows: int, cores: int) -> int:
    return max(1, -(-rows // BLOCK_MOST), min(cores, -(-rows // BLOCK_LEAST)))


def _block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col("idx").cast("long")), F.lit(blocks)).cast("int")


def write_blocks(tracks: DataFrame) -> tuple[str, int]:
    """Where the vectors are written by block, and how many blocks there are."""
    spark = tracks.sparkSession
    blocks = number_of_blocks(tracks.count(), spark.sparkContext.defaultParallelism)
    path = new_path(spark, "vector-blocks")
    rows = tracks.select(F.col("idx").cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("v"), _block_of(blocks).alias("b"))
    rows.repartition("b").write.partitionBy("b").parquet(path)
    return path, blocks


class _Block:
    """A block's rows in order of idx; least: what the n-th neighbour of each that is known so far has, -inf where there are fewer."""

    def __init__(self, path: str, block: int, best: str | None, n: int):
        rows = read_folder(f"{path}/b={block}", "idx", "v")
        self.ids, self.vectors = np.zeros(0, np.int64), np.zeros((0, 1))
        if rows is not None and rows.num_rows:
            ids = rows.column("idx").to_numpy()
            vectors = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(ids.size, -1)
            order = np.argsort(ids, kind="stable")
            self.ids, self.vectors = ids[order], vectors[order]
        self.least = np.full(self.ids.size, -np.inf)
        known = read_folder(f"{best}/b={block}", "idx", "similarity") if best and self.ids.size else None
        if known is not None and known.num_rows:
            row, value = known.column("idx").to_numpy(), known.column("similarity").to_numpy()
            order = np.lexsort([-value, row])
            row, value = row[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            nth = first[np.diff(np.append(first, row.size)) >= n] + n - 1
            slots = np.searchsorted(self.ids, row[nth]).clip(0, self.ids.size - 1)
            met = self.ids[slots] == row[nth]
            self.least[slots[met]] = value[nth[met]]
        # lengths by which single precision is told apart from exact products
        self.lengths = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.longest = float(self.lengths.max(initial=0.0))
        self.plain = bool(np.isfinite(self.longest) and self.longest < 1e15 and (self.ids[1:] != self.ids[:-1]).all())
        self.single = self.vectors.astype(np.float32) if self.plain else None

    def loses(self, other: _Block) -> np.ndarray:
        """How much a product of each row with the other's rows may differ in single precision, and by rounding to DIGITS."""
        return (self.vectors.shape[1] + 8) * 2.0**-23 * self.lengths * other.longest + 10.0**-DIGITS + 1e-30


def _cut(row: np.ndarray, other: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best n of every row, by value, ties by the other's idx."""
    order = np.lexsort([other, -value, row])
    row, other, value = row[order], other[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if row.size else np.zeros(0, np.int64)
    place = np.arange(row.size) - np.repeat(first, np.diff(np.append(first, row.size)))
    keep = place < n
    return row[keep], other[keep], value[keep]


class _Best:
    def __init__(self, n: int):
        self.n, self.parts, self.size = n, [], 0

    def add(self, products: np.ndarray, rows: np.ndarray, others: np.ndarray) -> None:
        """The best of every row of a matrix of products; -inf is no product."""
        if not products.size:
            return
        if products.shape[1] > self.n:
            near = products >= np.partition(products, products.shape[1] - self.n, axis=1)[:, -self.n, None]
            near &= products > -np.inf
        else:
            near = products > -np.inf
        r, c = np.nonzero(near)
        self.add_found(rows[r], others[c], products[r, c])

    def add_found(self, rows: np.ndarray, others: np.ndarray, values: np.ndarray) -> None:
        self.parts.append(_cut(rows, others, values, self.n))
        self.size += self.parts[-1][0].size
        if self.size > HELD:
            self.parts = [self.all()]
            self.size = self.parts[0][0].size

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return _cut(*(np.concatenate(x) for x in zip(*self.parts)), self.n)


def _reaching(products: np.ndarray, rows: np.ndarray, columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where a matrix of products reaches the least of its row or of its column."""
    least = lambda x: np.nextafter(x.astype(np.float32), np.float32(-np.inf))
    near = products >= least(rows)[:, None]
    if columns is not None:
        near |= products >= least(columns)
    near = near.ravel()
    end = near.size // 8 * 8  # few are, so eight are looked at in one
    at = (np.flatnonzero(near[:end].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[near[at]], end + np.flatnonzero(near[end:])])
    return at // products.shape[1], at % products.shape[1]


def _exact(left: _Block, right: _Block, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", left.vectors[r[at : at + EXACT]], right.vectors[c[at : at + EXACT]]) for at in range(0, r.size, EXACT)]
    return np.round(np.concatenate([np.zeros(0), *parts]), DIGITS)


def _all_products(left: _Block, right: _Block, own: _Best, theirs: _Best | None) -> None:
    step = max(1, SLICE // right.ids.size)
    for at in range(0, left.ids.size, step):
        part = slice(at, at + step)
        products = np.round(left.vectors[part] @ right.vectors.T, DIGITS)
        products[left.ids[part][:, None] == right.ids[None, :]] = -np.inf
        own.add(products, left.ids[part], right.ids)
        if theirs:
            theirs.add(products.T, right.ids, left.ids[part])


def _near_products(left: _Block, right: _Block, own: _Best, theirs: _Best | None) -> None:
    """As _all_products; for a block with itself (without theirs) rows have no least, so it is found in each slice."""
    step, lost = max(1, SLICE // right.ids.size), left.loses(right)
    columns = None if theirs is None else right.least - right.loses(left)
    for at in range(0, left.ids.size, step):
        part = slice(at, at + step)
        products = left.single[part] @ right.single.T
        if theirs is None:
            slots = np.arange(len(products))
            products[slots, at + slots] = -np.inf
            place = right.ids.size - own.n
            rows = np.partition(products, place, axis=1)[:, place] - 2 * lost[part]
        else:
            rows = left.least[part] - lost[part]
        r, c = _reaching(products, rows, columns)
        r = r + at
        other = left.ids[r] != right.ids[c]
        r, c = r[other], c[other]
        value = _exact(left, right, r, c)
        for best, one, two, least, place in ((own, left.ids[r], right.ids[c], left.least - lost, r), (theirs, right.ids[c], left.ids[r], columns, c)):
            if best:
                enough = value >= least[place]
                best.add_found(one[enough], two[enough], value[enough])


def _met(batches: Iterator[pa.RecordBatch], left_path: str, right_path: str, left_best: str | None, right_best: str | None, n: int) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, _Block] = {}
    for batch in batches:
        for one, two in zip(*(c.to_pylist() for c in batch.columns)):
            wanted = [(left_path, one, left_best), (right_path, two, right_best)]
            held = {k: held[k] if k in held else _Block(*k, n) for k in dict.fromkeys(wanted)}
            left, right = (held[k] for k in wanted)
            if not left.ids.size or not right.ids.size:
                continue
            same = wanted[0] == wanted[1]
            own, theirs = _Best(n), None if same else _Best(n)
            plain = left.plain and right.plain
            near = plain and (right.ids.size > n + 1 if same else min(left.least.min(), right.least.min()) > -np.inf)
            (_near_products if near else _all_products)(left, right, own, theirs)
            for b, best in ((one, own), (two, theirs)):
                if best:
                    row, other, value = best.all()
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(other), pa.array(value), pa.array(np.full(row.size, b, np.int32))], names=["idx", "neighbor", "similarity", "b"])


def _meet(spark: SparkSession, left: tuple[str, int, str | None], right: tuple[str, int, str | None], n: int) -> DataFrame:
    """Results (RESULT, b) of all pairs of blocks of two sets of vectors, with the best that is known of each; of one set every
    pair of two once, without what is known every block with itself."""
    rows = spark.range(left[1] * right[1]).select((F.col("id") / right[1]).cast("int").alias("l"), (F.col("id") % right[1]).cast("int").alias("r"))
    if left[0] == right[0]:
        rows = rows.where("l < r" if left[2] else "l = r")
    tasks = min(left[1] * right[1], 4 * spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(tasks, F.xxhash64("l", F.floor(F.col("r") / 4)))
    return dealt.mapInArrow(partial(_met, left_path=left[0], right_path=right[0], left_best=left[2], right_best=right[2], n=n), f"{RESULT}, b int")


def _stored(found: DataFrame) -> tuple[DataFrame, str]:
    """Results (RESULT, b) written by block, and where."""
    spark, path = found.sparkSession, new_path(found.sparkSession, "best")
    found.write.partitionBy("b").parquet(path)
    return spark.read.schema(f"{RESULT}, b int").parquet(path), path


def _within(spark: SparkSession, path: str, blocks: int, n: int) -> tuple[DataFrame, str]:
    """The best of all rows of a set of vectors: those of their own blocks, then of pairs of blocks; where the former are."""
    own, best = _stored(_meet(spark, (path, blocks, None), (path, blocks, None), n))
    more = [_meet(spark, (path, blocks, best), (path, blocks, best), n)] if blocks > 1 else []
    return reduce(DataFrame.union, [own, *more]).drop("b"), best


def _ranked(found: DataFrame, n: int, source: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("similarity"), "neighbor"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select("idx", "rank", "neighbor", "similarity", F.lit(source).alias("source"))


def neighbor_table(tracks: DataFrame, n: int = 10, source: str = "embedding") -> DataFrame:
    """(idx, rank, neighbor, similarity, source): the n nearest of every track (idx, embedding); source says by what."""
    return _ranked(_within(tracks.sparkSession, *write_blocks(tracks), n)[0], n, source)


def with_added(table: DataFrame, tracks: DataFrame, added: DataFrame, n: int = 10, source: str = "embedding") -> DataFrame:
    """neighbor_table of tracks and added, from the table of tracks: only pairs with an added track are met."""
    spark = tracks.sparkSession
    old, new = write_blocks(tracks), write_blocks(added)
    found, known = _stored(table.where(F.col("source") == source).select("idx", "neighbor", "similarity", _block_of(old[1]).alias("b")))
    within, best = _within(spark, *new, n)
    met = _meet(spark, (*old, known), (*new, best), n).drop("b")
    return _ranked(found.drop("b").union(within).union(met), n, source)
