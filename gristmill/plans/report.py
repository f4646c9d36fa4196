"""Reports: served traffic, drift, latency and cost of a cascade, bake-offs and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators import metrics
from gristmill.operators.running import with_totals
from gristmill.registry import query
from gristmill.sources.views import LEDGER, PREDS, SERVED, ledger, preds, served, table

R = lambda c, n=9: F.round(c, n)

ESC = "reason IS NOT NULL AND route <> 'student'"


def _escalated():
    return F.col("reason").isNotNull() & (F.col("route") != "student")


@query("since_window", f"WITH {SERVED} SELECT id, ts FROM served WHERE ts >= (SELECT max(ts) FROM served) - INTERVAL 24 HOUR")
def since_window(spark, sf_dir):
    s = served(spark, sf_dir)
    now = s.agg((F.max("ts") - F.expr("interval 24 hours")).alias("since"))
    return s.join(F.broadcast(now), F.col("ts") >= F.col("since")).select("id", "ts")


@query("served_report", f"""WITH {SERVED} SELECT route, count(*) AS n, round(count(*) / (SELECT count(*) FROM served), 9) AS share, count(*) FILTER ({ESC}) AS escalated,
    count(*) FILTER ({ESC} AND route <> 'teacher') AS failed, round(quantile_cont(total_ms, 0.5), 6) AS p50, round(quantile_cont(total_ms, 0.95), 6) AS p95, round(sum(teacher_cost_usd), 9) AS spend
    FROM served GROUP BY route""")
def served_report(spark, sf_dir):
    s = served(spark, sf_dir)
    by = s.groupBy("route").agg(
        F.count("*").alias("n"), F.count_if(_escalated()).alias("escalated"), F.count_if(_escalated() & (F.col("route") != "teacher")).alias("failed"),
        *metrics.percentiles("total_ms", 0.5, 0.95), F.sum("teacher_cost_usd").alias("spend"),
    )
    by = by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
    return by.select("route", "n", R("share").alias("share"), "escalated", "failed", R("p50", 6).alias("p50"), R("p95", 6).alias("p95"), R("spend").alias("spend"))


Z = "1.959963984540054"
WILSON = f"""greatest(0.0, (p + {Z}*{Z}/(2*n) - {Z}*sqrt(p*(1-p)/n + {Z}*{Z}/(4.0*n*n))) / (1 + {Z}*{Z}/n)) AS low, least(1.0, (p + {Z}*{Z}/(2*n) + {Z}*sqrt(p*(1-p)/n + {Z}*{Z}/(4.0*n*n))) / (1 + {Z}*{Z}/n)) AS high"""


@query("drift_check", f"""WITH {SERVED}, d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (reason = 'low_confidence') AS k FROM served WHERE route = 'student' OR reason = 'low_confidence' GROUP BY 1),
    w AS (SELECT *, k * 1.0::DOUBLE / n AS p FROM d), i AS (SELECT day, n, k, {WILSON} FROM w) SELECT CAST(day AS TIMESTAMP) AS day, n, k, round(low, 9) AS low, round(high, 9) AS high, NOT (0.15 BETWEEN low AND high) AS drift FROM i""")
def drift_check(spark, sf_dir):
    """Per day, whether the interval of the low-confidence rate leaves out what was expected."""
    low_conf = F.coalesce(F.col("reason") == "low_confidence", F.lit(False))
    s = served(spark, sf_dir).filter((F.col("route") == "student") | low_conf)
    d = s.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(low_conf).alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    d = d.withColumns({"low": low, "high": high})
    return d.select("day", "n", "k", R("low").alias("low"), R("high").alias("high"), (~F.lit(0.15).between(F.col("low"), F.col("high"))).alias("drift"))


@query("prom_counters", f"""WITH {SERVED} SELECT route, CAST(b AS INTEGER) AS bucket, count(*) FILTER (total_ms <= 2 ** b) AS n FROM served, range(15) r(b) GROUP BY ALL""")
def prom_counters(spark, sf_dir):
    """Cumulative latency histograms by route: counts fall into one bucket each and are then run up."""
    b = F.least(F.greatest(F.ceil(F.log2("total_ms")), F.lit(0)), F.lit(15)).cast("int")
    b = F.when(F.col("total_ms") <= 1, 0).otherwise(b)
    s = served(spark, sf_dir)
    got = s.groupBy("route", b.alias("bucket")).agg(F.count("*").alias("c"))
    every = s.select("route").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(14))))
    x = every.join(got, ["route", "bucket"], "left")
    w = Window.partitionBy("route").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("route", "bucket", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("n"))


@query("bench_summary", f"""WITH {SERVED} SELECT count(*) AS n, count(*) FILTER (status = 200) AS ok, count(*) FILTER ({ESC}) AS escalated, count(*) FILTER ({ESC} AND route <> 'teacher') AS failed,
    round(quantile_cont(total_ms, 0.5) FILTER (status = 200), 6) AS p50, round(quantile_cont(total_ms, 0.95) FILTER (status = 200), 6) AS p95, round(avg(total_ms) FILTER (status = 200), 6) AS mean FROM served""")
def bench_summary(spark, sf_dir):
    ok = F.when(F.col("status") == 200, F.col("total_ms"))
    s = served(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == 200).alias("ok"), F.count_if(_escalated()).alias("escalated"),
        F.count_if(_escalated() & (F.col("route") != "teacher")).alias("failed"), *metrics.percentiles(ok, 0.5, 0.95), F.avg(ok).alias("mean"),
    )
    return s.select("n", "ok", "escalated", "failed", R("p50", 6).alias("p50"), R("p95", 6).alias("p95"), R("mean", 6).alias("mean"))


@query("cascade_router", f"""WITH {SERVED} SELECT id, CASE WHEN reason = 'unsupported' THEN 'teacher' WHEN reason = 'input_unparsed' THEN 'teacher' WHEN confidence >= 0.5 THEN 'student' WHEN status = 200 THEN 'teacher' ELSE 'fallback' END AS decision FROM served""")
def cascade_router(spark, sf_dir):
    c = (
        F.when(F.col("reason").isin("unsupported", "input_unparsed"), "teacher").when(F.col("confidence") >= 0.5, "student")
        .when(F.col("status") == 200, "teacher").otherwise("fallback")
    )
    return served(spark, sf_dir).select("id", c.alias("decision"))


COSTS = f"""WITH {PREDS}, c AS (SELECT id, coalesce(confidence < 0.5, true) AS escalated, CASE WHEN id % 9 = 0 THEN NULL ELSE (id % 10 + 1) / 1000.0::DOUBLE END AS cost, latency_ms FROM preds),
m AS (SELECT *, coalesce(cost, avg(cost) OVER ()) AS full_cost, coalesce(latency_ms, avg(latency_ms) OVER ()) AS full_ms FROM c)"""


def _costs(spark, sf_dir):
    id_ = F.col("id")
    c = preds(spark, sf_dir).select("id", F.coalesce(F.col("confidence") < 0.5, F.lit(True)).alias("escalated"), F.when(id_ % 9 == 0, None).otherwise((id_ % 10 + 1) / 1000.0).alias("cost"), "latency_ms")
    c = with_totals(c, __cost=F.avg("cost"), __ms=F.avg("latency_ms"))
    return c.withColumns({"full_cost": F.coalesce("cost", "__cost"), "full_ms": F.coalesce("latency_ms", "__ms")}).drop("__cost", "__ms")


@query("cost_latency", COSTS + """ SELECT count(*) AS n, count(*) FILTER (cost IS NULL) AS imputed_costs, count(*) FILTER (latency_ms IS NULL) AS imputed_latencies, round(1000 * avg(full_cost), 9) AS teacher_per_1k,
    round(1000 * sum(CASE WHEN escalated THEN full_cost ELSE 0 END) / count(*), 9) AS cascade_per_1k, round(quantile_cont(CASE WHEN escalated THEN full_ms + 20 ELSE 20 END, 0.5), 6) AS p50, round(quantile_cont(CASE WHEN escalated THEN full_ms + 20 ELSE 20 END, 0.95), 6) AS p95 FROM m""")
def cost_latency(spark, sf_dir):
    ms = F.when(F.col("escalated"), F.col("full_ms") + 20).otherwise(20.0)
    x = _costs(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(F.col("cost").isNull()).alias("imputed_costs"), F.count_if(F.col("latency_ms").isNull()).alias("imputed_latencies"),
        R(1000 * F.avg("full_cost")).alias("teacher_per_1k"), R(1000 * F.sum(F.when(F.col("escalated"), F.col("full_cost")).otherwise(0.0)) / F.count("*")).alias("cascade_per_1k"),
        *metrics.percentiles(ms, 0.5, 0.95),
    )
    return x.withColumns({"p50": R("p50", 6), "p95": R("p95", 6)})


@query("break_even", COSTS + """, k AS (SELECT avg(full_cost) - sum(CASE WHEN escalated THEN full_cost ELSE 0 END) / count(*) AS saved, sum(full_cost) AS labelling FROM m)
SELECT CASE WHEN saved > 0 THEN CAST(ceil((labelling + 0.25) / saved - 1e-9) AS BIGINT) END AS requests FROM k""")
def break_even(spark, sf_dir):
    k = _costs(spark, sf_dir).agg(
        (F.avg("full_cost") - F.sum(F.when(F.col("escalated"), F.col("full_cost")).otherwise(0.0)) / F.count("*")).alias("saved"), F.sum("full_cost").alias("labelling")
    )
    return k.select(F.when(F.col("saved") > 0, F.ceil((F.col("labelling") + 0.25) / F.col("saved") - 1e-9).cast("long")).alias("requests"))


@query("local_cost", "SELECT CAST(h AS INTEGER) AS hours, round(40 * h * 0.15 / 1000, 9) AS energy, round(40 * h * 0.15 / 1000 + 1800.0 * h / 9000, 9) AS with_machine FROM range(1, 25) r(h)")
def local_cost(spark, sf_dir):
    h = F.col("id")
    energy = 40 * h * 0.15 / 1000
    return spark.range(1, 25).select(h.cast("int").alias("hours"), R(energy).alias("energy"), R(energy + 1800.0 * h / 9000).alias("with_machine"))



@query("labelling_cost", f"WITH {LEDGER} SELECT task, CAST(coalesce(sum(actual_nusd) FILTER (phase = 'label'), sum(reserved_nusd), 0) AS BIGINT) AS nusd FROM ledger GROUP BY task")
def labelling_cost(spark, sf_dir):
    label = F.sum(F.when(F.col("phase") == "label", F.col("actual_nusd")))
    return ledger(spark, sf_dir).groupBy("task").agg(F.coalesce(label, F.sum("reserved_nusd"), F.lit(0)).alias("nusd"))


CANDIDATES = f"""{LEDGER}, b AS (SELECT model, count(*) AS n, avg((status = 'settled')::INT) AS score, round(1000 * avg(CASE WHEN status = 'settled' THEN actual_nusd END) / 1e9, 9) AS cost_per_1k, count(*) FILTER (status = 'released') AS errors FROM ledger GROUP BY model)"""


def _candidates(spark, sf_dir):
    done = F.col("status") == "settled"
    return ledger(spark, sf_dir).groupBy("model").agg(
        F.count("*").alias("n"), metrics.rate(done).alias("score"), R(1000 * F.avg(F.when(done, F.col("actual_nusd"))) / 1e9).alias("cost_per_1k"), F.count_if(F.col("status") == "released").alias("errors")
    )


@query("bakeoff_summary", f"WITH {CANDIDATES} SELECT model, n, round(score, 9) AS score, cost_per_1k, errors FROM b")
def bakeoff_summary(spark, sf_dir):
    return _candidates(spark, sf_dir).withColumn("score", R("score"))


@query("bakeoff_select", f"WITH {CANDIDATES} SELECT model FROM b WHERE score >= (SELECT max(score) FROM b) - 0.02 ORDER BY cost_per_1k, score DESC, model LIMIT 1")
def bakeoff_select(spark, sf_dir):
    w = Window.partitionBy(F.lit(0))
    c = _candidates(spark, sf_dir).withColumn("best", F.max("score").over(w)).filter(F.col("score") >= F.col("best") - 0.02)
    return c.orderBy("cost_per_1k", F.desc("score"), "model").limit(1).select("model")


@query("dataset_table", f"WITH {PREDS} SELECT split, count(*) AS n FROM preds GROUP BY split")
def dataset_table(spark, sf_dir):
    return preds(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query("quality_table", f"""WITH {PREDS}, u AS (SELECT 'teacher' AS system, split, teacher = gold AS ok FROM preds UNION ALL SELECT 'student', split, pred = gold FROM preds
    UNION ALL SELECT 'cascade', split, CASE WHEN confidence >= 0.5 THEN pred ELSE teacher END = gold FROM preds) SELECT system, split, count(*) AS n, round(avg(ok::INT), 9) AS accuracy FROM u GROUP BY ALL""")
def quality_table(spark, sf_dir):
    keep = F.coalesce(F.col("confidence") >= 0.5, F.lit(False))
    answers = F.array(
        F.struct(F.lit("teacher").alias("system"), F.col("teacher").alias("answer")), F.struct(F.lit("student").alias("system"), F.col("pred").alias("answer")),
        F.struct(F.lit("cascade").alias("system"), F.when(keep, F.col("pred")).otherwise(F.col("teacher")).alias("answer")),
    )
    u = preds(spark, sf_dir).select("split", "gold", F.inline(answers))
    return u.groupBy("system", "split").agg(F.count("*").alias("n"), R(metrics.rate(metrics.match("answer", "gold"))).alias("accuracy"))


@query("student_seed_groups", f"""WITH {PREDS}, r AS (SELECT grp, id % 3 AS seed, avg((pred = gold)::INT) AS m FROM preds WHERE grp IS NOT NULL GROUP BY ALL)
SELECT grp, count(*) AS seeds, round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS std, arg_min(seed, (-m, seed)) AS best FROM r GROUP BY grp""")
def student_seed_groups(spark, sf_dir):
    r = preds(spark, sf_dir).filter("grp IS NOT NULL").groupBy("grp", (F.col("id") % 3).alias("seed")).agg(metrics.rate(metrics.match("pred", "gold")).alias("m"))
    return r.groupBy("grp").agg(F.count("*").alias("seeds"), R(F.avg("m")).alias("mean"), R(F.stddev_samp("m")).alias("std"), F.min_by("seed", F.struct(-F.col("m"), "seed")).alias("best"))


@query("compare_reports", f"""WITH {PREDS}, a AS (SELECT grp, avg((pred = gold)::INT) AS accuracy, avg((pred = teacher)::INT) AS agreement FROM preds WHERE id % 2 = 0 AND grp IS NOT NULL GROUP BY grp),
b AS (SELECT grp, avg((pred = gold)::INT) AS accuracy, avg((pred = teacher)::INT) AS agreement FROM preds WHERE id % 2 = 1 AND grp IS NOT NULL GROUP BY grp),
u AS (SELECT a.grp, 'accuracy' AS metric, 100 * (a.accuracy - b.accuracy) AS d FROM a JOIN b USING (grp) UNION ALL SELECT a.grp, 'agreement', 100 * (a.agreement - b.agreement) FROM a JOIN b USING (grp))
SELECT grp, metric, round(d, 6) AS points, abs(d) <= 2.0 AS within FROM u""")
def compare_reports(spark, sf_dir):
    p = preds(spark, sf_dir).filter("grp IS NOT NULL")
    side = lambda k, s: p.filter(F.col("id") % 2 == k).groupBy("grp").agg(metrics.rate(metrics.match("pred", "gold")).alias(f"accuracy{s}"), metrics.rate(metrics.match("pred", "teacher")).alias(f"agreement{s}"))
    j = side(0, "a").join(side(1, "b"), "grp")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), (100 * (F.col(f"{m}a") - F.col(f"{m}b"))).alias("d")) for m in ("accuracy", "agreement")])
    return j.select("grp", F.inline(rows)).select("grp", "metric", R("d", 6).alias("points"), (F.abs("d") <= 2.0).alias("within"))


@query("attach_predictions", f"WITH {PREDS} SELECT d.doc_id, p.pred FROM documents d LEFT JOIN preds p ON d.doc_id = p.id WHERE d.doc_id % 10 >= 8")
def attach_predictions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_id % 10 >= 8").select("doc_id")
    return d.join(preds(spark, sf_dir).select(F.col("id").alias("doc_id"), "pred"), "doc_id", "left")


@query("nan_to_null", "SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE round(value, 9) END AS value FROM events")
def nan_to_null(spark, sf_dir):
    v = F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", R(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)).alias("value"))
