"""How far confidences can be trusted: bins, calibration errors, ranking, and monotone recalibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.running import by_ranges, running_sums, value_bucket
from gristmill.sources.shared import materialize

BINS = 15
#: Blocks of an isotonic map that one task may pool, and knots that go with tasks.
TOGETHER = 50_000


def _bin(confidence: str):
    return F.least(F.floor(F.col(confidence) * BINS), F.lit(BINS - 1)).cast("int")


def reliability(df: DataFrame, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """(bin, n, mean_confidence, accuracy) of 15 bins of one width, the last closed; empty bins have null means."""
    spark = df.sparkSession
    got = df.filter(F.col(confidence).isNotNull()).groupBy(_bin(confidence).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    )
    every = spark.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def errors(df: DataFrame, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """One row: n, ece (summed gaps between confidence and accuracy by bin, over n) and brier. Rows without a
    confidence are left out; over none all are null but n."""
    hit = F.col(correct).cast("double")
    by = df.filter(F.col(confidence).isNotNull()).groupBy(_bin(confidence).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(confidence).alias("c"), F.sum(hit).alias("h"), F.sum((F.col(confidence) - hit) ** 2).alias("b")
    )
    n = F.sum("n")
    return by.agg(F.coalesce(n, F.lit(0)).alias("n"), (F.sum(F.abs(F.col("h") - F.col("c"))) / n).alias("ece"), (F.sum("b") / n).alias("brier"))


def auroc(df: DataFrame, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """One row: the probability that a right answer has the higher confidence, ties counting half; null if all are
    right or none. Computed over different confidences, so hot values are sums."""
    by = df.filter(F.col(confidence).isNotNull()).groupBy(confidence).agg(
        F.count_if(F.col(correct)).alias("pos"), F.count_if(~F.col(correct)).alias("neg")
    )
    by = running_sums(by, value_bucket(F.col(confidence)), [F.col(confidence)], {"__below": F.col("neg")}, before=True)
    by = by.withColumn("wins", F.col("pos") * (F.col("__below") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return by.agg(F.when(pairs > 0, F.sum("wins") / pairs).alias("auroc"))


_BLOCK = "first double, last double, s double, n long"


def _pooled(frame: pd.DataFrame) -> pd.DataFrame:
    """Blocks in order, of which neighbours that don't rise are one."""
    out: list[list[float]] = []
    for first, last, s, n in frame.sort_values("first")[["first", "last", "s", "n"]].itertuples(index=False):
        while out and out[-1][2] * n >= s * out[-1][3]:
            first, _, before, m = out.pop()
            s, n = s + before, n + m
        out.append([first, last, s, n])
    return pd.DataFrame(out, columns=["first", "last", "s", "n"]).astype({"n": "int64"})


def isotonic_fit(df: DataFrame, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """Knots (x, y) of the monotone map from confidence to correctness: the ends of each block of confidences that have one value.
    Null and NaN confidences are left out; without any there are no knots.

    Neighbours that don't rise are pooled within ranges of confidences, then within ranges that are shifted by half, in turn,
    until nothing changes; in which order neighbours are pooled does not matter. What is left when there are TOGETHER blocks
    at most is pooled in one task.
    """
    known = df.filter(F.col(confidence).isNotNull() & ~F.isnan(F.col(confidence)))
    by = known.groupBy(F.col(confidence).cast("double").alias("first")).agg(F.sum(F.col(correct).cast("double")).alias("s"), F.count("*").alias("n"))
    blocks = by_ranges(by.select("first", F.col("first").alias("last"), "s", "n"), "first")

    def in_ranges(frame: pd.DataFrame) -> pd.DataFrame:
        out = _pooled(frame)
        half = np.arange(len(out)) >= len(out) / 2
        return out.assign(__range=frame["__range"].iloc[0], __shifted=frame["__range"].iloc[0] + half.astype(np.int32))

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        """A block belongs to the range that its first confidence is in."""
        out = _pooled(frame)
        return out.assign(__range=out["first"].map(dict(zip(frame["first"], frame["__range"], strict=True))).astype(np.int32))

    before = None
    while True:
        blocks = materialize(blocks.groupBy("__range").applyInPandas(in_ranges, f"{_BLOCK}, __range int, __shifted int"), "isotonic")
        n = blocks.count()
        if n <= TOGETHER:
            blocks = blocks.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(_pooled, _BLOCK)
            break
        shifted = materialize(blocks.groupBy("__shifted").applyInPandas(across, f"{_BLOCK}, __range int"), "isotonic")
        blocks, after = shifted, shifted.count()
        if before == n == after:
            break
        before = after
    return blocks.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("x"), (F.col("s") / F.col("n")).alias("y"))


def isotonic_apply(df: DataFrame, knots: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Adds calibrated: linear between knots, level outside them; null for a null or NaN confidence and without knots. Up to TOGETHER knots
    go with the tasks; more are met by a merge of knots and different confidences in ranges."""
    n = knots.count()
    if n > TOGETHER:
        return _merged(df, knots, confidence)
    rows = knots.orderBy("x").collect()
    x, y = (np.array([r[c] for r in rows], float) for c in ("x", "y"))

    @F.pandas_udf("double")
    def mapped(c: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([None] * len(c), dtype="float64")
        return pd.Series(np.where(c.isna(), np.nan, np.interp(c.fillna(0.0), x, y)))

    return df.withColumn("calibrated", F.nanvl(mapped(F.col(confidence).cast("double")), F.lit(None).cast("double")))


def _merged(df: DataFrame, knots: DataFrame, confidence: str) -> DataFrame:
    c = F.col(confidence).cast("double")
    asked = df.filter(c.isNotNull() & ~F.isnan(c)).select(c.alias("x")).distinct()
    rows = asked.withColumn("y", F.lit(None).cast("double")).unionByName(knots.select("x", "y"))
    rows = by_ranges(rows, "x").withColumn("k", F.when(F.col("y").isNotNull(), F.struct("x", "y")))
    ends = rows.groupBy("__range").agg(F.max("k").alias("__last"), F.min("k").alias("__first"))
    every = Window.partitionBy(F.lit(0)).orderBy("__range")  # a row for each range
    ends = ends.select(
        "__range", F.max("__last").over(every.rowsBetween(Window.unboundedPreceding, -1)).alias("__under"),
        F.min("__first").over(every.rowsBetween(1, Window.unboundedFollowing)).alias("__over"),
    )
    own = Window.partitionBy("__range").orderBy("x")
    low, high = F.max("k").over(own.rangeBetween(Window.unboundedPreceding, 0)), F.min("k").over(own.rangeBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"__low": low, "__high": high}).filter("y IS NULL").join(ends, "__range")
    a, b = F.coalesce("__low", "__under"), F.coalesce("__high", "__over")
    a, b = F.coalesce(a, b), F.coalesce(b, a)
    share = F.when(b["x"] > a["x"], (F.col("x") - a["x"]) / (b["x"] - a["x"])).otherwise(0.0)
    found = rows.select(F.col("x").alias("__x"), (a["y"] + share * (b["y"] - a["y"])).alias("calibrated"))
    return df.join(found, c == F.col("__x"), "left").drop("__x")
