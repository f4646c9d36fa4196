"""Running sums and ranks over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.sources.shared import materialize

#: Hex digits of a seeded rank that name a bucket: 4,096 buckets.
DIGITS = 3


def hex_bucket(rank: Column) -> Column:
    """The bucket of a rank that begins with evenly spread hex digits; it rises with the rank."""
    return F.conv(F.substring(rank, 1, DIGITS), 16, 10).cast("int")


def value_bucket(value: Column) -> Column:
    """The bucket of a number that mostly lies from 0 to 1, as a confidence; it rises with the number, and NaN comes last."""
    x = F.when(F.isnan(value), 2.0).otherwise(F.least(F.greatest(value, F.lit(-1.0)), F.lit(2.0)))
    return F.floor(x * 4096).cast("int")


def by_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in ranges of the order, of about the same number of rows: a table with the number of each row's range as __range."""
    return materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def running_sums(
    df: DataFrame, bucket: Column | str, order: list[Column], sums: dict[str, Column], by: list[str] = [], before: bool = False, total: str | None = None  # noqa: B006
) -> DataFrame:
    """df with each of `sums` (name: value) summed up over the rows of `by` up to the row (before: without it) in an order.

    bucket must not fall in that order, and only the rows of one bucket meet in a task; the buckets' own sums, one row each, are
    summed up by a second, small window. Ties in the order must be broken by the caller. Columns of `by` must not be null. total: a name for
    the first sum over all rows of `by`, which comes from the same small window.
    """
    bucket = F.col(bucket) if isinstance(bucket, str) else bucket
    df = df.withColumns({"__b": bucket, **{f"__v{i}": v for i, v in enumerate(sums.values())}})
    inner = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    of = df.groupBy(*by, "__b").agg(*[F.sum(f"__v{i}").alias(f"__s{i}") for i in range(len(sums))])
    outer = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("__s0").over(outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total)] if total else []
    of = of.select(*by, "__b", *[F.coalesce(F.sum(f"__s{i}").over(outer), F.lit(0)).alias(f"__o{i}") for i in range(len(sums))], *whole)
    df = df.withColumns({f"__i{i}": F.coalesce(F.sum(f"__v{i}").over(inner), F.lit(0)) for i in range(len(sums))}).join(of, [*by, "__b"])
    df = df.withColumns({name: F.col(f"__i{i}") + F.col(f"__o{i}") for i, name in enumerate(sums)})
    return df.drop("__b", *[f"__{k}{i}" for k in "vio" for i in range(len(sums))])


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """df with aggregates of all its rows beside each row: one row is broadcast, and no rows are gathered."""
    return df.join(F.broadcast(df.agg(*[v.alias(k) for k, v in totals.items()])))
