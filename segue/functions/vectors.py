"""Vector and model arithmetic as column expressions; all sums are in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """The vector scaled to length one; the divisor is FLOOR at least."""
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(F.greatest(norm(a), F.lit(FLOOR)), F.size(a)).alias("n")), lambda e: e["x"].cast("double") / e["n"])


def mean_vector(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row (mean): the mean of a column of vectors, component by component."""
    parts = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("mean"))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def pair_loss(score: Column, label: Column, eps: float = 1e-7) -> Column:
    """Cross entropy of a pair's predicted probability."""
    return -(label * F.log(score + eps) + (1 - label) * F.log(1 - score + eps))


def learning_rate(start: float, epoch: int, epochs: int) -> float:
    """The rate falls to a quarter over the epochs."""
    return start * (1 - 0.75 * epoch / max(epochs, 1))
