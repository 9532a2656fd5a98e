"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset and all runs in one process, as in tests, a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="segue-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_folder(path: str, *columns: str):
    """Columns of the Parquet files in a folder as an Arrow table, read by a task itself; None if there is no such folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    if store.get_file_info(place).type == fs.FileType.NotFound:
        return None
    return ds.dataset(place, filesystem=store, format="parquet").to_table(columns=list(columns)).combine_chunks()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that this job has written and needs no more, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """What tells whether tables are still the same: names, sizes and times of their files."""
    jvm, found = spark.sparkContext._jvm, []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(path):
            found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in store.listStatus(path)]
    return tuple(sorted(found))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


_KEPT: dict[tuple, tuple[str, StructType]] = {}


def kept(spark: SparkSession, key: tuple, make, name: str, sources: tuple[str, ...] = ()) -> DataFrame:
    """The table that make() gives, written once in an application for a key, as a service stores its catalogue when it starts.

    It is made anew if the files of its sources have changed, or if it is gone.
    """
    own = (spark.sparkContext.applicationId, *key, fingerprint(spark, *sources))
    if own not in _KEPT or not _exists(spark, _KEPT[own][0]):
        path, made = new_path(spark, name), make()
        made.write.parquet(path)
        _KEPT[own] = (path, made.schema)
    path, schema = _KEPT[own]
    return spark.read.schema(schema).parquet(path)
