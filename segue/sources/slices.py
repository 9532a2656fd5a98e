"""Large corpus slices in many tasks: byte ranges of one JSON document, cut at its playlists.

Whether a byte is inside a string, and how deep, depends on all bytes before it. So a first pass tells of every range
how many quotes it holds and by how much it changes the depth, for both cases: that it begins inside a string or
outside. Sums of these over the ranges of a file give each range its case and depth. A second pass then cuts out the
objects that begin in a range (reading on where the last one ends), at the depth of playlists; Spark parses them.
Which array they are in is known from the last array that was opened at the top level, in the range or before it.

Files are opened through pyarrow.fs. ValueError (in a task) if a file is not one whole JSON document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segue.sources.npy import _open
from segue.sources.stored import written

SPLIT_BYTES = 16 << 20
#: Bytes before a range that tell the name of an array, and bytes that are read on at a time.
NAME_BYTES, ON_BYTES = 4096, 1 << 20
QUOTE, BACKSLASH = 0x22, 0x5C
OPENS, CLOSES = (0x7B, 0x5B), (0x7D, 0x5D)
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)


def _escaped(before: bytes) -> bool:
    """Whether what follows is escaped: an odd number of backslashes stands before it."""
    return (len(before) - len(before.rstrip(b"\\"))) % 2 == 1


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """The places of quotes that begin or end strings."""
    at = np.flatnonzero(data == QUOTE)
    if not at.size:
        return at
    plain = np.flatnonzero(data != BACKSLASH)
    # the last byte before a quote that is no backslash; between them stand backslashes only
    index = np.searchsorted(plain, at) - 1
    last = np.where(index >= 0, plain[np.maximum(index, 0)], -1)
    run = at - 1 - last + ((last < 0) & escaped)
    return at[run % 2 == 0]


def structure(data: np.ndarray, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets outside of strings, their changes of depth, and whether the data end inside a string."""
    edge = quotes(data, escaped)
    brackets = np.flatnonzero(np.isin(data, np.array(OPENS + CLOSES, np.uint8)))
    odd = (np.searchsorted(edge, brackets) + inside) % 2 == 1
    brackets = brackets[~odd]
    return brackets, np.where(np.isin(data[brackets], np.array(OPENS, np.uint8)), 1, -1), bool((edge.size + inside) % 2)


def _range(path: str, low: int, high: int) -> tuple[np.ndarray, bytes]:
    """The bytes of a range, and those before it."""
    with _open(path) as file:
        before = max(0, low - NAME_BYTES)
        head = file.read_at(low - before, before)
        while head and not head.strip(b"\\") and before:  # nothing but backslashes
            before = max(0, before - NAME_BYTES)
            head = file.read_at(low - before, before)
        return np.frombuffer(file.read_at(high - low, low), np.uint8), head


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every range, whether it holds an odd number of quotes, and its changes of depth if it begins outside or inside a string."""
    for batch in batches:
        rows = []
        for path, low, high in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
            data, head = _range(path, low, high)
            changes = [int(structure(data, _escaped(head), inside)[1].sum()) for inside in (False, True)]
            rows.append((int(quotes(data, _escaped(head)).size % 2), *changes))
        more = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "odd", "outside", "inside"])


def _cut(batches: Iterator[pa.RecordBatch], size_of: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(file_ord, part, n, name, value): the objects of depth three that begin in a range, and the arrays that are opened there.

    name is that of the array an object is in, null if it was opened before the range; a row without a value tells
    the last array that the range opens.
    """
    for batch in batches:
        for ord_, path, part, low, high, in_string, depth in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 6))):
            data, head = _range(path, low, high)
            if low == 0 and (in_string or depth):
                raise ValueError(f"{path} is no whole JSON document")
            at, change, inside = structure(data, _escaped(head), bool(in_string))
            after = depth + np.cumsum(change)
            rows, name, n = [], None, 0
            opened = ended = None
            raw = data.tobytes()
            for place, step, level in zip(at.tolist(), change.tolist(), after.tolist()):
                if step > 0 and level == 2:
                    found = _NAME.search((head + raw[:place])[-NAME_BYTES:]) if raw[place] == OPENS[1] else None
                    name = found[1].decode("utf-8", "replace") if found else ""
                elif step > 0 and level == 3 and raw[place] == OPENS[0]:
                    opened = place
                elif step < 0 and level == 2 and opened is not None:
                    rows.append((n, name, raw[opened : place + 1]))
                    n, opened = n + 1, None
            if opened is not None:  # it ends in a later range
                rest, level, to, size, tail = [raw[opened:]], int(after[-1]), high, size_of[path], raw[-1:]
                escaped = _escaped((head + raw)[-NAME_BYTES:])
                with _open(path) as file:
                    while ended is None and to < size:
                        more = file.read_at(min(ON_BYTES, size - to), to)
                        on, steps, inside = structure(np.frombuffer(more, np.uint8), escaped, inside)
                        levels = level + np.cumsum(steps)
                        hit = np.flatnonzero((steps < 0) & (levels == 2))
                        ended = int(on[hit[0]]) if hit.size else None
                        rest.append(more if ended is None else more[: ended + 1])
                        level, to, tail = int(levels[-1]) if levels.size else level, to + len(more), more
                        escaped = _escaped(tail) if tail.strip(b"\\") else escaped ^ (len(tail) % 2 == 1)
                if ended is None:
                    raise ValueError(f"{path} is no whole JSON document")
                rows.append((n, name, b"".join(rest)))
            rows.append((-1, name, None))
            columns = [pa.array([ord_] * len(rows), pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([None if r[2] is None else r[2].decode("utf-8", "replace") for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["file_ord", "part", "n", "name", "value"])


def objects(spark: SparkSession, files: list[tuple[int, str, int]], name: str = "playlists", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file_ord, playlist_ord, value): the objects of the array `name` of files (file_ord, path, bytes), as JSON text, numbered in order."""
    ranges = [(o, p, k, k * split_bytes, min((k + 1) * split_bytes, size)) for o, p, size in files for k in range(-(-size // split_bytes))]
    rows = spark.createDataFrame(ranges, "file_ord int, path string, part long, low long, high long").repartition(len(ranges) or 1, "file_ord", "part")
    told = rows.mapInArrow(_told, "file_ord int, path string, part long, low long, high long, odd long, outside long, inside long")
    before = Window.partitionBy("file_ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cased = written(told, "slice-ranges").withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    cased = cased.withColumn("depth", F.coalesce(F.sum(F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    known = cased.select("file_ord", "path", "part", "low", "high", "in_string", "depth").repartition(len(ranges) or 1, "file_ord", "part")
    cut = written(known.mapInArrow(partial(_cut, size_of={p: size for _, p, size in files}), "file_ord int, part long, n long, name string, value string"), "slice-objects")
    # what array a range begins in, and how many objects of the wanted one are before it
    parts = cut.groupBy("file_ord", "part").agg(F.max(F.when(F.col("n") < 0, F.col("name"))).alias("last"), F.count(F.when(F.col("name") == name, F.col("value"))).alias("own"), F.count(F.when(F.col("name").isNull(), F.col("value"))).alias("open"))
    parts = parts.withColumn("first", F.last("last", True).over(before))
    here = F.col("own") + F.when(F.col("first") == name, F.col("open")).otherwise(0)
    parts = written(parts.withColumn("skipped", F.coalesce(F.sum(here).over(before), F.lit(0))).select("file_ord", "part", "first", "skipped"), "slice-parts")
    found = cut.where("value IS NOT NULL").join(parts, ["file_ord", "part"]).where(F.coalesce("name", "first") == name)
    place = F.row_number().over(Window.partitionBy("file_ord", "part").orderBy("n")) - 1
    return found.select("file_ord", (F.col("skipped") + place).cast("int").alias("playlist_ord"), "value")
