"""The test tables as a playlist corpus: parts with a vector are tracks, orders are playlists, lines are occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segue.operators.catalog import with_keys
from segue.operators.corpus import popularity
from segue.operators.search_index import index_rows
from segue.sources.stored import kept

#: Seeds of the registered recommendations: (ord, part); one twice, one unknown.
SEED_PARTS = ((0, 7), (1, 11), (2, 42), (3, 99), (4, 7), (5, -1))
#: Text tracks of the registered matches: (ord, artist, title).
TEXTS = ((0, "Brand#2 feat. ECONOMY", "Small Ring!"), (1, "brand 17", "RED widget"), (2, "Nobody", "blue bolt"), (3, "Brand#4", "no such title"), (4, "", ""), (5, "Brand#3 & Brand#5", "hot-gear"), (6, "Brand#2 feat. ECONOMY", "Small Ring!"))
#: Where a line stands: by order, then in it.
ORDER = ("pid", "pos")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, pos, track_uri, part) of every line; one order's lines are one sort, orders are independent."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lines.select(F.col("l_orderkey").alias("pid"), (F.row_number().over(order) - 1).alias("pos"), F.concat(F.lit("track:"), "l_partkey").alias("track_uri"), F.col("l_partkey").alias("part"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, track_name, artist_name, album_name); the artist is a credit of two names."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("track_name"), F.concat("p_brand", F.lit(" feat. "), "p_type").alias("artist_name"), F.col("p_type").alias("album_name"))


def named_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(spark, sf_dir).join(parts(spark, sf_dir), "part")


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_ord, playlist_ord, pid, tracks): orders as playlists."""
    rows = named_occurrences(spark, sf_dir)
    tracks = F.transform(F.array_sort(F.collect_list(F.struct("pos", "track_uri", "track_name", "artist_name", "album_name"))), lambda t: t.dropFields("pos"))
    return rows.groupBy("pid").agg(tracks.alias("tracks")).select(F.lit(0).alias("file_ord"), F.col("pid").alias("playlist_ord"), "pid", "tracks")


def _catalogue(spark: SparkSession, sf_dir: str, vector_of) -> DataFrame:
    """(idx, track_uri, names, keys, count, popularity, embedding) of the parts with lines and a vector; idx is the part's key."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("count"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = vector_of(parts(spark, sf_dir), vectors).join(vectors, "vec_id").drop("vec_id").join(counts, "part")
    return popularity(with_keys(rows.withColumn("track_uri", F.concat(F.lit("track:"), "part")).withColumnRenamed("part", "idx")))


def _sources(sf_dir: str) -> tuple[str, ...]:
    return tuple(f"{sf_dir}/{t}.parquet" for t in ("part", "lineitem", "embeddings"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical track table: parts whose key a vector has. Written once and read by every query, as a catalogue is."""
    own = lambda rows, vectors: rows.withColumn("vec_id", F.col("part"))
    return kept(spark, ("tracks", sf_dir), lambda: _catalogue(spark, sf_dir, own), "catalogue", _sources(sf_dir))


def all_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a track: vectors are dealt to parts in turn, so several parts share one and products tie."""

    def dealt(rows: DataFrame, vectors: DataFrame) -> DataFrame:
        size = vectors.agg((F.max("vec_id") + 1).alias("size"))
        return rows.crossJoin(F.broadcast(size)).withColumn("vec_id", F.col("part") % F.col("size")).drop("size")

    return kept(spark, ("all-tracks", sf_dir), lambda: _catalogue(spark, sf_dir, dealt), "catalogue", _sources(sf_dir))


def word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored search index of all_tracks."""
    return kept(spark, ("words", sf_dir), lambda: index_rows(all_tracks(spark, sf_dir)), "word-index", _sources(sf_dir))


def covered_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """named_occurrences in which every eleventh part has a title of its own."""
    own = F.when(F.col("part") % 11 == 0, F.concat_ws(" ", "track_name", "part")).otherwise(F.col("track_name"))
    return named_occurrences(spark, sf_dir).withColumn("track_name", own)


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, f"track:{p}") for o, p in SEED_PARTS], "ord int, track_uri string")


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS), "ord int, artist string, title string")
