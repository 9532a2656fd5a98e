"""Total orders over whole tables, without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segue.sources.stored import written


def with_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """df with the dense place (from 0) of each row in a total order.

    Rows are sorted by range and written, with the number of their range; each range numbers its own rows, and the
    sizes of ranges (one number each, added up on the driver) give the offsets. order must be total, so that a rerun
    ranks alike.
    """
    sorted_rows = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for part, n in sorted(sorted_rows.groupBy("__part").count().collect()):
        offsets.append((part, before))
        before += n
    spark = df.sparkSession
    offset = spark.createDataFrame(offsets, "__part int, __before long")
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return sorted_rows.join(F.broadcast(offset), "__part").withColumn(name, place).drop("__part", "__before")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of a total order."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df, a short result, with ranks from 1."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in an order: the least of an order struct, so it is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(least.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def nth_smallest(df: DataFrame, column: str, n: int, parts: int = 1024) -> int | None:
    """The n-th smallest value (from 1) of a whole-number column, the largest if there are fewer; None without rows.

    The range of values is cut into parts and counted, then the part that holds the n-th is: a few aggregations of
    bounded size, no sort.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    before = 0
    while low is not None and low < high:
        width = -(-(high - low + 1) // parts)
        own = df.where(F.col(column).between(low, high)).select(F.expr(f"(`{column}` - {low}) div {width}").alias("part"))
        for part, count in sorted(map(tuple, own.groupBy("part").count().collect())):
            if before + count >= n:
                break
            before += count
        low, high = low + part * width, min(high, low + (part + 1) * width - 1)
    return low
