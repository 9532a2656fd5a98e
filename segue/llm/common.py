"""What the training-data operators share: places for written tables, row keys, column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.sources.stored import new_path, shared_dir, written

__all__ = ["filter_words", "id_share", "may_be_held", "new_path", "shared_dir", "spare_prefix", "text_of", "written"]


def id_share(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def spare_prefix(df: DataFrame) -> str:
    """The start of names that no column of df has."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


#: Bits of a filter of hashes; its words are at most FILTER_BITS / 64 rows.
FILTER_BITS = 1 << 25


def filter_words(hashes: DataFrame, column: str) -> DataFrame:
    """(word, bits): a filter of the 64-bit hashes in a column, of bounded size whatever their number."""
    place = hashes.select(F.pmod(F.col(column), F.lit(FILTER_BITS)).alias("p"))
    return place.select(F.expr("p div 64 AS word"), F.expr("shiftleft(1L, int(p % 64)) AS bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def may_be_held(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """The rows of df whose hash the filter may hold: all that it holds, few others. The filter is broadcast."""
    p = spare_prefix(df)
    place = df.withColumn(f"{p}p", F.pmod(F.col(column), F.lit(FILTER_BITS))).withColumn(f"{p}word", F.expr(f"`{p}p` div 64"))
    held = place.join(F.broadcast(words.select(F.col("word").alias(f"{p}word"), F.col("bits").alias(f"{p}bits"))), f"{p}word")
    return held.where(F.expr(f"shiftright(`{p}bits`, int(`{p}p` % 64)) & 1 = 1")).select(*[df[c] for c in df.columns])
