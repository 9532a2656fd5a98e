"""A data source for .npy matrices: `spark.read.format("npy").load(path)`, rows in byte ranges of one file.

The header tells the type, the shape and the order of the numbers; a task reads the bytes of its rows alone (of a matrix
in column order its part of every column), piece by piece. So a matrix of any size is read by many tasks, none of which
holds more than a piece. Files are opened through pyarrow.fs.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of rows that a task reads by default, and that it holds at once; bytes in which a header ends.
TASK_BYTES, PIECE_BYTES, HEADER_BYTES = 32 << 20, 4 << 20, 1 << 16


def _open(path: str):
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return store.open_input_file(place)


class Header:
    """What stands before the numbers of a matrix."""

    def __init__(self, path: str):
        with _open(path) as file:
            self.size = file.size()
            raw = io.BytesIO(file.read_at(min(HEADER_BYTES, self.size), 0))
        try:
            version = np.lib.format.read_magic(raw)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, self.by_column, self.dtype = read(raw)
        except ValueError as e:
            raise ValueError(f"{path}: {e}") from None
        if len(shape) != 2 or self.dtype.kind not in "fiu":
            raise ValueError(f"{path}: not a matrix of numbers, but {self.dtype} of shape {shape}")
        self.rows, self.width = shape
        self.start = raw.tell()
        if self.size < self.start + self.rows * self.width * self.dtype.itemsize:
            raise ValueError(f"{path}: the file ends before its {self.rows} rows do")


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class NpyReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes
        self.header = Header(path)

    def partitions(self) -> list[Rows]:
        h = self.header
        step = max(1, self.task_bytes // max(1, h.width * h.dtype.itemsize))
        return [Rows(at, min(at + step, h.rows)) for at in range(0, h.rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h, size = self.header, self.header.dtype.itemsize
        step = max(1, PIECE_BYTES // max(1, h.width * size))
        with _open(self.path) as file:
            for low in range(partition.low, partition.high, step):
                n = min(step, partition.high - low)
                if h.by_column:
                    columns = [np.frombuffer(file.read_at(n * size, h.start + (c * h.rows + low) * size), h.dtype) for c in range(h.width)]
                    matrix = np.stack(columns, axis=1) if columns else np.zeros((n, 0))
                else:
                    matrix = np.frombuffer(file.read_at(n * h.width * size, h.start + low * h.width * size), h.dtype)
                flat = pa.array(np.ascontiguousarray(matrix).ravel().astype(np.float64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h.width, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + n)), lists], names=["idx", "embedding"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "idx long, embedding array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))


def read_matrix(spark: SparkSession, path: str, normalized_path: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(idx, embedding) of a .npy matrix; with a second matrix of scaled rows also embedding_norm, ValueError if their shapes differ."""
    spark.dataSource.register(NpySource)
    read = lambda p: spark.read.format("npy").option("taskBytes", task_bytes).load(p)
    if normalized_path is None:
        return read(path)
    one, two = Header(path), Header(normalized_path)
    if (one.rows, one.width) != (two.rows, two.width):
        raise ValueError(f"matrices of {one.rows} x {one.width} and {two.rows} x {two.width} do not belong together")
    return read(path).join(read(normalized_path).select("idx", F.col("embedding").alias("embedding_norm")), "idx")
