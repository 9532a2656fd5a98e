"""The registered queries of the training-data operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.llm import ball_tree, bpe, fingerprints, language_id, line_dedup, minhash, mixing, pages, phrases, topk, toxicity, url_filter, warc
from segue.llm.common import id_share


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_passages(docs, removed_col="lines_removed")


def op1_modulus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classic cut at a divisible rolling hash, beside op1_line_dedup."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs, removed_col="chunks_removed")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary_path())


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_classes(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_table(spark, sf_dir, "documents"))


def _learning_folds(docs: DataFrame) -> DataFrame:
    return docs.where(id_share("doc_id", 3) != 1).select("text", "lang")


def learned_profiles(docs: DataFrame) -> dict[str, list[int]]:
    return language_id.profiles(_learning_folds(docs))


def learned_limits(docs: DataFrame, profiles: dict[str, list[int]]) -> list[float]:
    return language_id.limits(_learning_folds(docs), profiles)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs, learned_profiles(docs), ["doc_id"])
    return found.select("doc_id", (id_share("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "distance")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    permitted = id_share("doc_id", 5) != 0
    scored = toxicity.score(docs, toxicity.learn(docs.where(permitted), _table(spark, sf_dir, "labels").where(permitted)))
    return scored.select("doc_id", (id_share("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_byte_bpe, op3_fingerprints, op4_minhash, op5_language_id, op6_warc, op7_url_filter, op8_toxicity, op9_mixing, op10_exact_top_k, op11_ranked_search, op12_main_text, op13_collocations, op1_modulus_chunks)}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op1_modulus_chunks": line_dedup.ORACLE_MODULUS,
    "op7_url_filter": url_filter.oracle(),
    "op11_ranked_search": ball_tree.ORACLE,
    "op13_collocations": phrases.ORACLE,
    "op10_exact_top_k": """
        WITH whole AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                       WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             scores AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
                        FROM whole q JOIN whole c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
