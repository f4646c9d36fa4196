"""Quality metrics over rows (pred, reference ...). A null reference or prediction is never a match; over no
rows a rate is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two numbers agree within half a cent; slack for their binary form.
NUMBER_TOLERANCE, SLACK = 0.005, 1e-9


def match(pred: str | Column, ref: str | Column) -> Column:
    p, r = (F.col(c) if isinstance(c, str) else c for c in (pred, ref))
    return F.coalesce(p == r, F.lit(False))


def rate(condition: Column) -> Column:
    """The share of rows that meet it, 0 over none."""
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))


def agreement(df: DataFrame, pred: str, ref: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), rate(match(pred, ref)).alias("rate"))


def label_counts(df: DataFrame, pred: str, ref: str, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, label, tp, n_gold, n_pred) for each of the declared labels, zeros included. One pass: the label set is
    declared, so its counts are columns of one aggregate, which is then unpivoted."""
    aggs = []
    for i, label in enumerate(labels):
        is_ref, is_pred = (F.coalesce(F.col(c) == label, F.lit(False)) for c in (ref, pred))
        aggs += [
            F.count_if(is_ref & is_pred).alias(f"tp{i}"), F.count_if(is_ref).alias(f"g{i}"), F.count_if(is_pred).alias(f"p{i}"),
        ]
    wide = df.groupBy(*(by or [])).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"g{i}").alias("n_gold"), F.col(f"p{i}").alias("n_pred"))
            for i, label in enumerate(labels)
        ]
    )
    return wide.select(*(by or []), F.inline(rows))


def macro_f1(df: DataFrame, pred: str, ref: str, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """The mean over the declared labels of 2 tp / (gold + predicted), 0 where neither occurs. Values outside the
    labels count as wrong, but are no label of the mean."""
    counts = label_counts(df, pred, ref, labels, by)
    both = F.col("n_gold") + F.col("n_pred")
    f1 = F.when(both > 0, 2 * F.col("tp") / both).otherwise(0.0)
    return counts.groupBy(*(by or [])).agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"))


def traits(df: DataFrame, column: str = "traits") -> DataFrame:
    """A row per row and different trait; '(none)' for rows without any."""
    t = F.array_distinct(F.coalesce(F.col(column), F.array().cast("array<string>")))
    none = F.array(F.lit("(none)"))
    return df.withColumn("trait", F.explode(F.when(F.size(t) > 0, t).otherwise(none)))


def number_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= NUMBER_TOLERANCE + SLACK


def field_counts(df: DataFrame, pred: Column, ref: Column, equal: Column, by: list[str]) -> DataFrame:
    """tp, fp, fn of a field: a wrong value that is not null is both false positive and false negative."""
    hit = pred.isNotNull() & ref.isNotNull() & F.coalesce(equal, F.lit(False))
    return df.groupBy(*by).agg(
        F.count_if(hit).alias("tp"), F.count_if(pred.isNotNull() & ~hit).alias("fp"),
        F.count_if(ref.isNotNull() & ~hit).alias("fn"),
        rate(hit | (pred.isNull() & ref.isNull())).alias("exact"),
    )


def micro_f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def percentiles(c: str | Column, *at: float) -> list[Column]:
    """Exact percentiles with linear interpolation, null over no values."""
    return [F.percentile(c, F.lit(p)).alias(f"p{round(100 * p)}") for p in at]


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95 % score interval of k of n; null for n = 0."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))
