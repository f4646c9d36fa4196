"""Settlements and releases, in batch and as a stream, against rows worked out by hand."""

import uuid

from pyspark.sql import functions as F

from gristmill.operators import settlement
from gristmill.streaming import ledger
from gristmill.streaming.served import run_to_end

MADE = [(1, 10, 100), (2, 20, 100), (3, 30, 100), (4, 40, 100), (5, 50, None)]
CLOSINGS = [
    (1, 11, 0, "settle", 50.0, "settled"), (1, 12, 0, "settle", 50.0, "already settled"), (1, 13, 0, "release", None, "already settled"),
    (2, 19, 0, "settle", 1.0, "unknown"), (2, 20, 1, "release", None, "released"), (2, 21, 0, "settle", 1.0, "already released"),
    (3, 31, 0, "settle", -1.0, "invalid"), (3, 32, 0, "settle", float("nan"), "invalid"), (3, 33, 0, "cancel", 1.0, "invalid"), (3, 34, 0, "settle", 101.0, "settled"),
    (4, 41, 0, "settle", None, "invalid"), (99, 1, 0, "release", None, "unknown"), (5, 51, 0, "settle", 0.0, "settled"),
]


def frames(spark):
    made = spark.createDataFrame(MADE, "res_id long, at long, reserved long")
    return made, spark.createDataFrame([c[:5] for c in CLOSINGS], "res_id long, at long, line long, kind string, amount double")


def test_closings_take_effect_once(spark):
    made, closings = frames(spark)
    closed = settlement.close(made, closings.withColumns({"outcome": F.lit("x"), "note": F.lit(1)}))
    got = {(r["res_id"], r["at"]): (r["outcome"], r["overrun"]) for r in closed.collect()}
    assert got == {c[:2]: (c[5], c[:2] == (3, 34)) for c in CLOSINGS} and "note" in closed.columns
    rows = settlement.balances(made, closed).collect()
    assert {r["res_id"]: (r["status"], r["charged"]) for r in rows} == {
        1: ("settled", 50), 2: ("released", 0), 3: ("settled", 101), 4: ("open", None), 5: ("settled", 0)
    }
    assert settlement.close(made, closings.limit(0)).collect() == []
    twice = settlement.close(made, closings.filter("at = 11").union(closings.filter("at = 11"))).collect()
    assert sorted(r["outcome"] for r in twice) == ["already settled", "settled"]


def events(spark):
    made, closings = frames(spark)
    made = made.select("res_id", "at", F.lit(0).cast("long").alias("line"), F.lit("reserve").alias("kind"), F.col("reserved").cast("double").alias("amount"))
    return made.unionByName(closings)


def streamed(spark, parts, tmp_path):
    """The outcomes of a stream that gets the parts one after another."""
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    return {(r["res_id"], r["at"]): (r["outcome"], r["overrun"], r["late"]) for r in run_to_end(ledger.closings(stream)).collect()}


def test_the_stream_tells_the_same(spark, tmp_path):
    all_ = events(spark)
    want = {c[:2]: (c[5], c[:2] == (3, 34), False) for c in CLOSINGS}
    assert streamed(spark, [all_], tmp_path) == want
    # Over several batches, in order.
    assert streamed(spark, [all_.filter(f"at % 10 = {d}") for d in (9, 0, 1, 2, 3, 4)], tmp_path) == want


def test_what_comes_late_is_marked_and_handled_as_it_comes(spark, tmp_path):
    all_ = events(spark).filter("res_id = 1")
    got = streamed(spark, [all_.filter("at <> 11"), all_.filter("at = 11")], tmp_path)
    assert got == {(1, 12): ("settled", False, False), (1, 13): ("already settled", False, False), (1, 11): ("already settled", False, True)}


def test_consecutive_ids_share_a_row_of_state(spark, tmp_path):
    """Over two batches: 600 ids are three rows of state, and each id keeps its own."""
    made = spark.range(600).select(F.col("id").alias("res_id"), F.lit(10).cast("long").alias("at"), F.lit(0).cast("long").alias("line"), F.lit("reserve").alias("kind"), F.lit(5.0).alias("amount"))
    done = made.filter("res_id % 2 = 0").select("res_id", F.lit(11).cast("long").alias("at"), "line", F.lit("settle").alias("kind"), F.col("res_id").cast("double").alias("amount"))
    for p in (made, done.union(made.limit(0)), done.withColumns({"at": F.lit(12).cast("long"), "kind": F.lit("release")})):
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = ledger.closings(spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events"))
    seen = []
    write = lambda batch, n: seen.extend(map(tuple, batch.select("res_id", "at", "outcome", "overrun", "late").collect()))
    q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    want = [(i, 11, "settled", i > 5, False) for i in range(0, 600, 2)] + [(i, 12, "already settled", False, False) for i in range(0, 600, 2)]
    assert sorted(seen) == sorted(want)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
