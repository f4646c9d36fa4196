"""Pieces shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends here and every later
    use reads the same rows, whichever executors are lost meanwhile."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_sum(
    df: DataFrame, by: list[str], order: list[Column], value: Column, out: str, bucket: Column, before: bool = True
) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of `by` up to (before: up to but without) the row, in
    the order `order`.

    A group may hold any share of the rows: `bucket` must not decrease in that order, and only rows of one
    bucket meet in one task; the buckets' sums are added up by a second, small window. Window and join
    deal out by the same keys, so df is shuffled once. The columns `by` must not be null. Ties in the order
    must be broken by the caller.
    """
    df = df.withColumn("__b", bucket.cast("long"))
    inner = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.groupBy(*by, "__b").agg(F.sum(value).alias("__s"))
    outer = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = F.sum("__s").over(outer.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "__b", F.coalesce(earlier, F.lit(0)).alias("__off"))
    df = df.withColumn("__in", F.sum(value).over(inner) - (value if before else F.lit(0)))
    return df.join(sums, [*by, "__b"]).withColumn(out, F.col("__in") + F.col("__off")).drop("__b", "__in", "__off")


def text_key(col: str = "text") -> Column:
    """64 bits of a text; null and empty differ."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("\x00null")))


def long_struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
