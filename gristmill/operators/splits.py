"""Seeded splits: an order by hash that does not depend on how rows arrive."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.running import hex_bucket, running_sums, with_totals
from gristmill.sources.shared import materialize


def seeded_rank(seed: str, kind: str, key: Column) -> Column:
    """The first 16 hex digits of SHA-256 over seed, kind and key; they sort as the number they are."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}\0{kind}\0"), key.cast("string")), 256), 1, 16)


def quota(n: Column, fraction: float) -> Column:
    return F.floor(n * F.lit(fraction) + 0.5)


def _cut(df: DataFrame, bucket: Column, order: list[Column], test: float, valid: float) -> DataFrame:
    """bucket must not fall in the order; only the rows of one are ranked in one task."""
    df = with_totals(running_sums(df, bucket, order, {"__r": F.lit(1)}), __n=F.count(F.lit(1)))
    n_test, n_valid = quota(F.col("__n"), test), quota(F.col("__n"), valid)
    split = F.when(F.col("__r") <= n_test, "test").when(F.col("__r") <= n_test + n_valid, "valid").otherwise("train")
    return df.withColumn("split", split).drop("__r", "__n")


def random_split(df: DataFrame, key: str, seed: str, test: float, valid: float) -> DataFrame:
    """The first rows by hash are the test split, the next the validation split."""
    rank = seeded_rank(seed, "random", F.col(key))
    return _cut(df, hex_bucket(rank), [rank, F.col(key)], test, valid)


def stratified_split(df: DataFrame, key: str, label: str, seed: str, test: float, valid: float) -> DataFrame:
    """Rows in the order of (place in their stratum + an offset) / size of the stratum, so every cut takes a like share of
    each. Rows are joined by stratum and bucket, never by stratum alone, so a large stratum is no one task's."""
    rank = seeded_rank(seed, "stratum", F.col(key))
    # A null label is a stratum; a prefix tells it from a label of that name.
    df = df.withColumn("__stratum", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null")))
    df = running_sums(df, hex_bucket(rank), [rank, F.col(key)], {"__i": F.lit(1)}, by=["__stratum"], before=True, total="__m")
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}\0offset\0"), F.col(label)), 256), 1, 8), 16, 10).cast("double") / 2**32
    df = materialize(df.withColumn("__place", (F.col("__i") + F.coalesce(offset, F.lit(0.0))) / F.col("__m")), "strata")
    cut = _cut(df, F.floor(F.col("__place") * 4096), [F.col("__place"), F.col(label), F.col("__i")], test, valid)
    return cut.drop("__i", "__m", "__place", "__stratum")


def water_quota(counts: DataFrame, label: str, n: str, size) -> DataFrame:
    """counts (label, n) with the quota of each label: size rows over all, or all there are, dealt as evenly as the counts
    allow. What a label lacks goes to those that have more, what is left over to the largest, one row each."""
    w = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum(n).over(w.orderBy(n, label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.count("*").over(w) - F.row_number().over(w.orderBy(n, label)) + 1
    df = counts.withColumn("__level", F.floor((F.lit(size) - before) / open_))
    # Labels with fewer rows than the level so far are taken whole; the level of the first that has more holds.
    df = df.withColumn("__level", F.max(F.when(F.col(n) > F.col("__level"), F.col("__level"))).over(w))
    df = df.withColumn("quota", F.least(n, "__level"))
    more = F.col(n) > F.col("quota")
    rank = F.row_number().over(w.orderBy(F.desc(n), label))
    df = df.withColumns({"__over": F.lit(size) - F.sum("quota").over(w), "__r": rank})
    return df.withColumn("quota", F.col("quota") + F.when(more & (F.col("__r") <= F.col("__over")), 1).otherwise(0)).drop("__level", "__over", "__r")


def fill_groups(groups: list[tuple[str, int]], target: int, keep: int) -> list[str]:
    """Of groups (name, rows), in the order given, those that a split of about `target` rows takes: each whose middle row
    still falls within the target, or the smallest (the first of those) where none does. `keep` groups stay for other splits."""
    free = len(groups) - keep
    if target <= 0 or free <= 0:
        return []
    taken, names = 0, []
    for name, rows in groups:
        if 2 * taken + rows < 2 * target:
            taken += rows
            names.append(name)
    return names[:free] or [min(groups, key=lambda g: g[1])[0]]


def grouped_split(df: DataFrame, key: str, group: str, seed: str, test: float, valid: float) -> DataFrame:
    """Whole groups go to one split; a row without a group is one of its own. Groups' sizes are one row each; the choice
    among them, which is a fold in the order of their hashes, is made on the driver, and its result is a table that is joined.
    A group is kept for train unless test and valid are to take all rows."""
    name = F.when(F.col(group).isNotNull(), F.concat(F.lit("group\0"), F.col(group).cast("string")))
    df = df.withColumn("__g", F.coalesce(name, F.concat(F.lit("row\0"), F.col(key).cast("string"))))
    sizes = [(r["__g"], r["n"]) for r in df.groupBy("__g").agg(F.count("*").alias("n")).orderBy(seeded_rank(seed, "group", F.col("__g")), "__g").collect()]
    total = sum(n for _, n in sizes)
    n_test, n_valid = (math.floor(total * f + 0.5) for f in (test, valid))
    keep = int(total > n_test + n_valid)
    split = dict.fromkeys(fill_groups(sizes, n_test, keep), "test")
    rest = [g for g in sizes if g[0] not in split]
    split |= dict.fromkeys(fill_groups(rest, n_valid, keep), "valid")
    named = df.sparkSession.createDataFrame([(g, split.get(g, "train")) for g, _ in sizes], "__g string, split string")
    return df.join(named, "__g").drop("__g")
