"""Structured Streaming over the log of served requests, and a budget kept as state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.sources.shared import shared_dir


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it wrote: a table in the shared folder, in which a batch
    that is run again replaces its own rows."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{base}/out/batch=*")
    batches = spark.read.schema(f"{stream.schema.simpleString()[7:-1].replace(':', ' ')}, batch int").option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*")
    last = batches.agg(F.max("batch")).first()[0]
    return batches.filter(F.col("batch") == last).drop("batch")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, id_: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each request once, while repeats arrive within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_])


def windowed_counts(stream: DataFrame, by: str, ts: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, by, n) of tumbling windows; rows later than the watermark are dropped."""
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")


def admitted(stream: DataFrame, key: str, order: str, need: str, cap: int) -> DataFrame:
    """(key, order, accepted): entries of each key are taken, in their order within a batch, while the sum stays within
    the cap; what is refused takes nothing. The sum is the key's state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, n in zip(rows[order], rows[need], strict=True):
            ok = taken + n <= cap
            taken += n if ok else 0
            out.append((k[0], o, ok))
        state.update((int(taken),))
        yield pd.DataFrame(out, columns=["key", "entry", "accepted"])

    return stream.groupBy(key).applyInPandasWithState(
        step, "key long, entry long, accepted boolean", "taken long", "append", GroupStateTimeout.NoTimeout
    )
