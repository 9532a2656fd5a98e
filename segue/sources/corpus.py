"""Reading a corpus of playlist slices and playlist files."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segue.schemas import SLICE
from segue.sources.slices import SPLIT_BYTES, objects

PATTERN = "mpd.slice.*.json"


def _slices(spark: SparkSession, folder: str, max_files: int | None) -> list[tuple[str, int]]:
    """(path, bytes) of the slice files of a folder in order of their names (as text), the first max_files of them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in store.listStatus(path) if fnmatch(s.getPath().getName(), PATTERN))
    if not found:
        raise FileNotFoundError(f"no {PATTERN} in {folder}")
    return [(full, size) for _, full, size in found[:max_files]]


def list_slices(spark: SparkSession, folder: str, max_files: int | None = None) -> list[str]:
    """The slice files of a folder in order of their names (as text), the first max_files of them.

    The folder is listed through Hadoop, so it can be in any store that Spark reads.
    """
    return [path for path, _ in _slices(spark, folder, max_files)]


def read_playlists(spark: SparkSession, folder: str, max_files: int | None = None, max_playlists: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file_ord, playlist_ord, pid, tracks) of a folder's slices; the cap counts playlists in scan order.

    A slice is one JSON document. Spark reads small ones whole, a task each; where one is larger than split_bytes, all
    are cut at their playlists into ranges of that size, a task each. Both give the same rows.
    """
    from segue.operators.corpus import capped

    found = _slices(spark, folder, max_files)
    of_playlist = SLICE["playlists"].dataType.elementType
    if max(size for _, size in found) > split_bytes:
        raw = objects(spark, [(i, path, size) for i, (path, size) in enumerate(found)], "playlists", split_bytes).select("file_ord", "playlist_ord", F.from_json("value", of_playlist).alias("p"))
    else:
        ords = spark.createDataFrame([(p.rsplit("/", 1)[-1], i) for i, (p, _) in enumerate(found)], "file string, file_ord int")
        raw = spark.read.option("multiLine", True).schema(SLICE).json([p for p, _ in found]).select(F.col("_metadata.file_name").alias("file"), F.posexplode("playlists").alias("playlist_ord", "p")).join(F.broadcast(ords), "file")
    rows = raw.select("file_ord", "playlist_ord", "p.pid", F.coalesce("p.tracks", F.array().cast(of_playlist["tracks"].dataType)).alias("tracks"))
    return capped(rows, max_playlists)


def occurrences(playlists: DataFrame) -> DataFrame:
    """A row for each track of each playlist, with its place."""
    return playlists.select("file_ord", "playlist_ord", "pid", F.posexplode("tracks").alias("pos", "t")).select("file_ord", "playlist_ord", "pid", "pos", "t.*")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value, file) of a text file's lines, numbered in order."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("ord", "value"))


def read_playlist_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, raw, artist, title) of a list of `artist - title` lines; blank lines go, lines without ` - ` are titles."""
    from segue.functions.text import split_line, strip

    rows = _lines(spark, path).select("ord", strip("value").alias("raw")).where("raw <> ''")
    artist, title = split_line("raw")
    return rows.select(F.col("ord").cast("long"), "raw", strip(artist).alias("artist"), strip(title).alias("title"))


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """(ord, artist_name, track_name) of a CSV or text file."""
    from segue.operators.playlist import parse_import

    return parse_import(_lines(spark, path).select(F.col("ord").cast("long"), "value"))


def stem(path: str) -> str:
    """A file's name without its folder and last suffix."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def frame(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A request's rows as a table; rows without ord get their place."""
    if schema.fieldNames()[0] == "ord" and rows and len(rows[0]) == len(schema) - 1:
        rows = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, schema)
