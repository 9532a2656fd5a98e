"""Reading and writing a trained model: vocabulary, vectors, description."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.functions.vectors import normalized
from segue.schemas import MODEL, VOCABULARY
from segue.sources.npy import read_matrix

__all__ = ["catalogue", "export", "read_description", "read_matrix", "read_vectors", "read_vocabulary", "write_description", "write_vectors", "write_vocabulary"]


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary rows from JSON lines; a duration that is no number is null."""
    loose = VOCABULARY.fieldNames()
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in loose)).json(path)
    return raw.select(*[F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in VOCABULARY])


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """JSON lines in files by ranges of idx, in its order; a missing duration is an empty text."""
    rows = vocab.select(*[F.coalesce(F.col("duration_ms").cast("string"), F.lit("")).alias(c) if c == "duration_ms" else F.col(c) for c in VOCABULARY.fieldNames() if c in vocab.columns])
    rows.orderBy("idx").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors and their scaled form, as Parquet."""
    vectors.select("idx", F.col("embedding").cast("array<float>").alias("embedding"), normalized(F.col("embedding")).cast("array<float>").alias("embedding_norm")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, normalized_rows: bool = True) -> DataFrame:
    column = "embedding_norm" if normalized_rows else "embedding"
    return spark.read.parquet(path).select("idx", F.col(column).cast("array<double>").alias("embedding"))


def write_description(spark: SparkSession, description: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(description, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_description(spark: SparkSession, path: str, **live) -> DataFrame:
    """One row of the model's description, with further facts as columns."""
    found = spark.read.schema(MODEL).option("multiLine", True).json(path)
    return found.withColumns({k: F.lit(v) for k, v in live.items()}) if live else found


def export(model, lists: DataFrame, occurrences: DataFrame, path: str, config, order: tuple[str, ...] | None = None, max_files: int | None = None, max_playlists: int | None = None) -> None:
    """A fitted word2vec model as a folder: the model itself, vectors, vocabulary with metadata, description.

    The vocabulary is that of the model: its words by their count in lists, ties by first occurrence.
    """
    from dataclasses import asdict

    from pyspark.ml.functions import vector_to_array

    from segue.operators.corpus import ORDINAL, first_seen, metadata_defaults
    from segue.operators.ranking import with_index

    spark = lists.sparkSession
    model.write().overwrite().save(f"{path}/word2vec.model")
    words = model.getVectors().select(F.col("word").alias("track_uri"), vector_to_array("vector").alias("embedding"))
    counts = lists.select(F.explode("uris").alias("track_uri")).groupBy("track_uri").agg(F.count("*").alias("count"))
    seen = metadata_defaults(first_seen(occurrences, order=order or ORDINAL))
    rows = with_index(words.join(counts, "track_uri").join(seen, "track_uri", "left"), [F.desc("count"), F.col("first"), F.col("track_uri")])
    write_vectors(rows, f"{path}/item_vectors")
    write_vocabulary(rows.drop("embedding", "first"), f"{path}/vocab")
    sizes = lists.agg(F.count("*").alias("corpus_count"), F.coalesce(F.sum(F.size("uris")), F.lit(0)).alias("corpus_total_words"))
    stats = {"vocab_size": rows.count(), **sizes.first().asDict(), "max_files": max_files, "max_playlists": max_playlists}
    files = {"word2vec_model": "word2vec.model", "item_vectors": "item_vectors", "vocab": "vocab"}
    write_description(spark, {"backend": "pyspark.ml.Word2Vec", "config": asdict(config), "stats": stats, "files": files}, f"{path}/model_meta")


def catalogue(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """The canonical track table; ValueError if vectors and vocabulary do not fit."""
    from segue.operators.catalog import check_aligned, with_keys
    from segue.operators.corpus import popularity

    check_aligned(vocab, vectors)
    return popularity(with_keys(vocab.join(vectors, "idx")))
