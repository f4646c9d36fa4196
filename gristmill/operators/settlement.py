"""What closes a reservation: it is open until it is settled at a charge or released, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.sources.shared import materialize

#: What becomes of a closing: it takes effect, or it is refused for one of the others.
OUTCOMES = ("settled", "released", "already settled", "already released", "unknown", "invalid")


def _valid() -> Column:
    """A release, or a settlement at a charge that is a number and not negative."""
    amount = F.col("amount").cast("double")
    return (F.col("kind") == "release") | ((F.col("kind") == "settle") & F.coalesce((amount >= 0) & (amount < float("inf")) & ~F.isnan(amount), F.lit(False)))


def close(reservations: DataFrame, closings: DataFrame) -> DataFrame:
    """closings (res_id, at, line, kind, amount, any more) with outcome and overrun.

    reservations: (res_id, at, reserved), one row for each id. A closing comes in the order of at and line. 'invalid': neither a
    release nor a settlement at a charge that is a number and not negative; 'unknown': no reservation of that id was made before
    (at the same time counts as before); else the first takes effect, and later ones are refused, naming what it was. overrun: a
    settlement that takes effect at more than was reserved. Null ids are unknown. Two closings of one reservation at the
    same time and line: the release comes first, then the smaller charge; of equal ones any one. The first closing of each id is found by an
    aggregation, so that many closings of one id don't meet in one task.
    """
    # Rows are numbered in a table, so that of equal ones the same is meant wherever it is read.
    rows = materialize(closings.withColumn("__row", F.monotonically_increasing_id()), "closings").withColumn("__valid", _valid())
    known = reservations.select("res_id", F.col("at").alias("__made"), "reserved")
    place = F.struct("at", "line", "kind", "amount", "__row")
    could = rows.filter("__valid").join(known, "res_id").filter("at >= __made")
    first = could.groupBy("res_id").agg(F.min(place).alias("__first"), F.first("__made").alias("__made"), F.first("reserved").alias("reserved"))
    rows = rows.join(first, "res_id", "left")
    won = F.col("__first.kind")
    did = F.when(won == "settle", "settled").otherwise("released")
    effective = place == F.col("__first")
    outcome = (
        F.when(~F.col("__valid"), "invalid").when(F.col("__made").isNull() | (F.col("at") < F.col("__made")), "unknown")
        .when(effective, did).otherwise(F.concat(F.lit("already "), did))
    )
    rows = rows.withColumn("outcome", outcome)
    overrun = (F.col("outcome") == "settled") & (F.col("amount") > F.col("reserved"))
    return rows.withColumn("overrun", F.coalesce(overrun, F.lit(False))).drop("__row", "__valid", "__made", "__first", "reserved")


def balances(reservations: DataFrame, closed: DataFrame) -> DataFrame:
    """reservations with status (open, settled or released) and charged (null while open), from what close() returned."""
    done = closed.filter(F.col("outcome").isin("settled", "released")).select("res_id", F.col("outcome").alias("status"), "amount")
    charged = F.when(F.col("status") == "settled", F.col("amount")).when(F.col("status") == "released", 0)
    return reservations.join(done, "res_id", "left").withColumn("charged", charged).withColumn("status", F.coalesce("status", F.lit("open"))).drop("amount")
