"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words; a document of it is to be taken target / source size times, so once or twice
for sure and once more with the fractional probability. Pivotal rounding pairs two documents with fractional
probabilities and moves words of probability from one to the other, at random but with unchanged means, until one of
them is taken for sure or not at all; the other goes on to the next pair. So a source's words differ from its target
by less than one document. Documents are dealt into blocks by a hash of their rows; what a block leaves over (one
document) goes up a tree of blocks, FAN at a time; the last one of a source is rounded. Large documents are paired
first, so that what is left over is mostly small. All random numbers are hashes, so reruns agree.

Defined results: a null text has size 0; null sources are one source, ordered last; sources whose texts are all empty
have target 0; documents of size 0 are taken target-ratio times like others, which adds no words. Repeated rows
are rounded one by one. An empty table gives no rows. Columns other than id, source and text are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from segue.llm.common import spare_prefix, written

#: Weights by a source's place in code point order; the mix's share of all sizes; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Rows of a block, and blocks that meet in one of the next level.
BLOCK_ROWS, FAN = 1_000, 16
WORD = r"[^\x20\x09-\x0D]+"


def words(text_col: str = "text") -> Column:
    return F.coalesce(F.expr(f"regexp_count(`{text_col}`, r'{WORD}')"), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, rows, source_size, target) of sized (source, size): the capped shares of SHARE of all sizes."""
    totals = written(sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")), "sources")
    spread = written(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources-by-name")
    before, offsets = 0, []
    for part, n in sorted(spread.groupBy("part").count().collect()):  # a row for each partition
        offsets.append((part, before))
        before += n
    offset = sized.sparkSession.createDataFrame(offsets, "part int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    placed = written(spread.join(F.broadcast(offset), "part").withColumn("place", place).withColumn("weight", weight).drop("part", "before"), "sources-placed")
    words_in_all = placed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight; rises until the sources that it caps are all found
    while words_in_all:
        capped = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(MOST)
        free, taken = placed.agg(F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, F.col("source_size") * MOST))).first()
        rest = SHARE * words_in_all - (taken or 0.0)
        if not free or rest / free <= level:
            break
        level = rest / free
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(MOST))
    return written(placed.select("source", "rows", "source_size", target.alias("target")), "targets")


def _unit(a: int, b: int, n: int) -> float:
    """A uniform number in (0, 1) from two row hashes and a position."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + n * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) + 0.5) / 2.0**64


def pair(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """New probabilities of two documents of sizes s and t: p s + q t and both means stay, one becomes 0 or 1."""
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (up + down) < down:  # words move to the first
        return (1.0, max(0.0, q - up / t)) if (1 - p) * s <= q * t else (p + up / s, 0.0)
    return (0.0, min(1.0, q + down / t)) if p * s <= (1 - q) * t else (max(0.0, p - down / s), 1.0)


def _rounded(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by source and block; the columns end with hash, size, place, block, p, extra (null: not yet known)."""
    open_row, open_key, n, schema, done = None, None, 0, None, []

    def closed(row: list, p: float) -> None:
        row[-2] = p
        row[-1] = None if 0.0 < p < 1.0 else int(p)
        if last and row[-1] is None:
            row[-1] = int(p >= 0.5)
        done.append(row)

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        done.clear()
        return out

    for batch in batches:
        schema = batch.schema
        for row in map(list, zip(*(c.to_pylist() for c in batch.columns))):
            key, size, p = row[-4:-2], row[-5], row[-2]
            if key != open_key:
                if open_row is not None:
                    closed(open_row, open_row[-2])
                open_row, open_key, n = None, key, 0
            n += 1
            if not 0.0 < p < 1.0:
                closed(row, p)
            elif not size:
                closed(row, float(_unit(row[-6], 0, n) < p))
            elif open_row is None:
                open_row = row
            else:
                first, second = pair(open_row[-2], open_row[-5], p, size, _unit(open_row[-6], row[-6], n))
                if 0.0 < first < 1.0:
                    closed(row, second)
                    open_row[-2] = first
                else:
                    closed(open_row, first)
                    row[-2] = second
                    open_row = row
                    if not 0.0 < second < 1.0:
                        closed(row, second)
                        open_row = None
        if done:
            yield flush()
    if open_row is not None:
        closed(open_row, open_row[-2])
    if done:
        yield flush()


def mix(docs: DataFrame, keys: list[str] | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of keys (doc_id), size, source_size, target, copies for every row of docs."""
    keys = keys or ["doc_id"]
    sized = written(docs.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col(source_col).alias("source"), words(text_col).alias("size")), "sized")
    goal = targets(sized.select("source", "size"))
    own = [f"__key{i}" for i in range(len(keys))]
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    row_hash = F.xxhash64(*own, "source", "size")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    rows = (
        sized.join(goal.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
        .select(*own, "source_size", "target", F.floor(ratio).cast("int").alias("sure"), row_hash.alias("hash"), "size", F.xxhash64(F.lit(7), "source").alias("place"), F.pmod(F.col("hash"), blocks).alias("block"), (ratio - F.floor(ratio)).alias("p"))
        .withColumn("extra", F.lit(None).cast("int"))
    )
    most = goal.agg(F.max(blocks)).first()[0] or 1
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    levels = []
    while True:
        last = most <= 1
        dealt = rows.repartition("place", "block").sortWithinPartitions("place", "block", F.desc("size"), "hash", *own)
        level = written(dealt.mapInArrow(partial(_rounded, last=last), schema), "rounded")
        levels.append(level.where("extra is not null"))
        if last:
            break
        most = -(-most // FAN)
        rows = level.where("extra is null").withColumn("block", F.floor(F.col("block") / FAN))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], "size", "source_size", "target", (F.col("sure") + F.col("extra")).alias("copies"))


def _row_hash(columns: list[str]) -> Column:
    """A hash of all columns, which tells nulls from values and from each other."""
    return F.xxhash64(*columns, F.concat(*[F.col(c).isNull().cast("string") for c in columns]))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that are equal in all columns take what is taken of them together."""
    p = spare_prefix(docs)
    keyed = docs.withColumn(f"{p}hash", _row_hash(docs.columns))
    decided = mix(keyed, [id_col, f"{p}hash"], source_col, text_col).select(F.col(id_col).alias("i"), F.col(f"{p}hash").alias("h"), "copies")
    taken = written(decided.groupBy("i", "h").agg(F.sum("copies").cast("int").alias("c"), F.count("*").alias("n")).where("c > 0").toDF(*(f"{p}{n}" for n in ("i", "h", "c", "n"))), "taken")
    met = lambda keys: keyed.join(keys, F.col(id_col).eqNullSafe(F.col(f"{p}i")) & (F.col(f"{p}hash") == F.col(f"{p}h")))
    both, again = met(taken.where(F.col(f"{p}n") == 1)), taken.where(F.col(f"{p}n") > 1)
    if not again.isEmpty():  # equal rows are one row, which is taken as often as all of them
        both = both.union(met(again).dropDuplicates([f"{p}i", f"{p}h"]))
    return both.withColumn(f"{p}k", F.explode(F.sequence(F.lit(1), F.col(f"{p}c")))).select(*docs.columns)
