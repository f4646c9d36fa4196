"""Confidence thresholds of a cascade: what is answered by the student at t or above, the teacher answers below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.metrics import match
from gristmill.operators.running import running_sums, value_bucket, with_totals

EPSILON = 1e-9


def usable(df: DataFrame, ref: str) -> DataFrame:
    """Rows with a reference."""
    return df.filter(F.col(ref).isNotNull())


def curve(df: DataFrame, ref: str = "teacher", pred: str = "pred", fallback: str = "teacher", confidence: str = "confidence") -> DataFrame:
    """(t, escalation_rate, quality) for each different finite confidence and infinity: rows of confidence t or
    above keep the student's answer, all others (null or NaN confidence too) take the fallback.

    Counts are summed by confidence first, so the sums run over different confidences, not rows, and in buckets of
    confidences; rows with one confidence move together.
    """
    c = F.col(confidence)
    known = c.isNotNull() & ~F.isnan(c)
    by = df.select(
        F.when(known, c).alias("t"), match(pred, ref).cast("long").alias("own"), match(fallback, ref).cast("long").alias("other"),
    ).groupBy("t").agg(F.count("*").alias("n"), F.sum("own").alias("own"), F.sum("other").alias("other"))
    by = with_totals(by, rows=F.sum("n"), all_other=F.sum("other")).filter(F.col("t").isNotNull())
    down = {"answered": F.col("n"), "right": F.col("own"), "covered": F.col("other")}
    by = running_sums(by, -value_bucket(F.col("t")), [F.col("t").desc()], down)
    points = by.select(
        "t", (1 - F.col("answered") / F.col("rows")).alias("escalation_rate"),
        ((F.col("right") + F.col("all_other") - F.col("covered")) / F.col("rows")).alias("quality"),
    )
    never = df.agg(F.count("*").alias("rows"), F.avg(match(fallback, ref).cast("double")).alias("quality")).filter("rows > 0")
    return points.unionByName(
        never.select(F.lit(float("inf")).alias("t"), F.lit(1.0).alias("escalation_rate"), "quality")
    )


def choose(points: DataFrame, target: float | Column) -> DataFrame:
    """The point of the lowest escalation whose quality reaches the target, the higher t at a tie; infinity, with met
    false, if there is none. One row."""
    goal = target if isinstance(target, Column) else F.lit(float(target))
    fits = F.col("quality") >= goal - EPSILON
    best = F.min(F.when(fits, F.struct(F.col("escalation_rate"), (-F.col("t")).alias("m"), F.col("quality"))))
    return points.agg(best.alias("b"), F.max_by("quality", "t").alias("at_inf")).select(
        F.coalesce(-F.col("b.m"), F.lit(float("inf"))).alias("t"),
        F.coalesce(F.col("b.escalation_rate"), F.lit(1.0)).alias("escalation_rate"),
        F.coalesce(F.col("b.quality"), F.col("at_inf")).alias("quality"),
        F.col("b").isNotNull().alias("met"),
    )


def apply(df: DataFrame, t: Column, pred: str = "pred", fallback: str = "teacher", confidence: str = "confidence") -> DataFrame:
    keep = F.coalesce((F.col(confidence) >= t) & ~F.isnan(confidence), F.lit(False))
    return df.withColumns({"cascade": F.when(keep, F.col(pred)).otherwise(F.col(fallback)), "escalated": ~keep})


def macro_f1_curve(df: DataFrame, labels: list[str], ref: str = "gold", pred: str = "pred", fallback: str = "teacher", confidence: str = "confidence") -> DataFrame:
    """(t, macro_f1) of the cascade at each different confidence and infinity. Per label and confidence the counts of
    student and fallback are summed, then run down the confidences."""
    c = F.col(confidence)
    t = F.when(c.isNotNull() & ~F.isnan(c), c)
    is_ = lambda col, label: F.coalesce(F.col(col) == label, F.lit(False))
    aggs = []
    for i, label in enumerate(labels):
        g = is_(ref, label)
        for name, col in (("s", pred), ("f", fallback)):
            aggs += [F.count_if(g & is_(col, label)).alias(f"{name}tp{i}"), F.count_if(is_(col, label)).alias(f"{name}p{i}")]
        aggs.append(F.count_if(g).alias(f"g{i}"))
    by = df.groupBy(t.alias("t")).agg(*aggs)
    counts = [c for c in by.columns if c != "t"]
    both = with_totals(by, **{f"all_{c}": F.sum(c) for c in counts})
    both = running_sums(both, F.coalesce(-value_bucket(F.col("t")), F.lit(8192)), [F.col("t").desc_nulls_last()], {f"run_{c}": F.col(c) for c in counts})
    f1 = lambda tp, both: F.when(both > 0, 2 * tp / both).otherwise(0.0)
    at, never = F.lit(0.0), F.lit(0.0)
    for i in range(len(labels)):
        run, whole = (lambda name: F.col(f"run_{name}")), (lambda name: F.col(f"all_{name}"))
        tp = run(f"stp{i}") + whole(f"ftp{i}") - run(f"ftp{i}")
        p = run(f"sp{i}") + whole(f"fp{i}") - run(f"fp{i}")
        at = at + f1(tp, whole(f"g{i}") + p)
        never = never + f1(whole(f"ftp{i}"), whole(f"g{i}") + whole(f"fp{i}"))
    both = both.withColumns({"at": at / len(labels), "never": never / len(labels)})
    ends = both.limit(1).select(F.lit(float("inf")).alias("t"), F.col("never").alias("macro_f1"))
    return both.filter(F.col("t").isNotNull()).select("t", F.col("at").alias("macro_f1")).unionByName(ends)
