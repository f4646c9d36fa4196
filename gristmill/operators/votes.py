"""Observations of one input merged into one example, and labels decided by strict majority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = "array_position(array('train', 'valid', 'test'), split)"
# Names of the splits.
_ALIASES = {"train": "train", "valid": "valid", "validation": "valid", "val": "valid", "dev": "valid", "test": "test"}


def canonical_split(c: Column | str) -> Column:
    """train, valid or test from their usual names; null for blank or null; an error for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.lower(F.trim(c))
    out = F.when(c.isNull() | (x == ""), None)
    for alias, name in _ALIASES.items():
        out = out.when(x == alias, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown split: "), c)).cast("string"))


def majority(df: DataFrame, by: str, value: str, seq: str, weight: Column | None = None) -> DataFrame:
    """(by, value, votes, total): the value with more than half of the votes, null without one. Null values and
    weights below 1 abstain. Counts by value come first, so a hot key is a few sums."""
    w = F.lit(1) if weight is None else weight
    df = df.select(F.col(by).alias("__by"), F.col(value).alias("__value"), F.col(seq).alias("__seq"), w.alias("__w"))
    counts = df.filter(F.col("__value").isNotNull() & (F.col("__w") >= 1)).groupBy("__by", "__value").agg(F.sum("__w").alias("__v"), F.min("__seq").alias("__s"))
    best = F.max(F.struct(F.col("__v").alias("v"), (-F.col("__s")).alias("s"), F.col("__value").alias("value")))
    top = counts.groupBy("__by").agg(F.sum("__v").alias("__total"), best.alias("__m"))
    out = df.select("__by").distinct().join(top, "__by", "left")
    won = F.col("__m.v") * 2 > F.col("__total")
    return out.select(
        F.col("__by").alias(by), F.when(won, F.col("__m.value")).alias(value), F.when(won, F.col("__m.v")).alias("votes"),
        F.coalesce("__total", F.lit(0)).alias("total"),
    )


def first_wins(df: DataFrame, by: str, meta: str, seq: str) -> DataFrame:
    """(by, key, value, conflict) of maps merged key by key: the first value stays, conflict says whether others differ."""
    kv = df.select(by, seq, F.explode(meta).alias("key", "value")).filter(F.col("value").isNotNull())
    return kv.groupBy(by, "key").agg(F.min_by("value", seq).alias("value"), (F.min("value") != F.max("value")).alias("conflict"))


def repeats(df: DataFrame, by: str) -> DataFrame:
    """(by, repeats): copies beyond the first, per origin and split, summed per origin, the largest of the origins."""
    one = df.groupBy(by, "origin", "split").agg((F.count("*") - 1).alias("r")).groupBy(by, "origin").agg(F.sum("r").alias("r"))
    return one.groupBy(by).agg(F.max("r").alias("repeats"))


def resolve_clusters(df: DataFrame) -> DataFrame:
    """df (cluster, id, teacher, votes, gold): (cluster, survivor, teacher, gold). The teacher with the strict majority of
    votes decides; the first member with it survives, the first member where none is labelled. Without a
    majority the cluster goes (null survivor). Gold: strict majority, else the survivor's own."""
    t = majority(df, "cluster", "teacher", "id", F.coalesce("votes", F.lit(0))).select("cluster", F.col("teacher").alias("won"), F.col("total").alias("labelled"))
    g = majority(df, "cluster", "gold", "id").select("cluster", F.col("gold").alias("gold_won"))
    m = df.join(t, "cluster").join(g, "cluster")
    keep = (F.col("labelled") == 0) | (F.col("teacher") == F.col("won"))
    first = F.min(F.when(keep, F.struct("id", "gold")))
    return m.groupBy("cluster").agg(first.alias("f"), F.first("won").alias("teacher"), F.first("gold_won").alias("g")).select(
        "cluster", F.col("f.id").alias("survivor"), "teacher", F.coalesce("g", F.col("f.gold")).alias("gold")
    )
