"""Evaluation queries over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators import bootstrap, calibration, metrics, running, threshold
from gristmill.registry import query
from gristmill.sources.views import PREDS, preds

LABELS = ["0", "1"]
R = lambda c, n=9: F.round(c, n)


def _correct(df: DataFrame) -> DataFrame:
    return df.withColumn("correct", metrics.match("pred", "gold"))


CURVE = f"""WITH {PREDS}, p AS (SELECT * FROM preds), c AS (
    SELECT DISTINCT confidence AS t FROM p WHERE confidence IS NOT NULL UNION ALL SELECT 'Infinity'::DOUBLE
), curve AS (
    SELECT t, avg(CASE WHEN confidence >= t THEN 0.0 ELSE 1.0 END) AS escalation_rate,
           avg(CASE WHEN (CASE WHEN confidence >= t THEN pred ELSE teacher END) = REF THEN 1.0 ELSE 0.0 END) AS quality
    FROM c, p GROUP BY t
)"""


@query("threshold_curve", CURVE.replace("REF", "gold") + "SELECT t, round(escalation_rate, 9) AS escalation_rate, round(quality, 9) AS quality FROM curve")
def threshold_curve(spark, sf_dir):
    c = threshold.curve(preds(spark, sf_dir), ref="gold")
    return c.select("t", R("escalation_rate").alias("escalation_rate"), R("quality").alias("quality"))


CHOOSE = CURVE.replace("REF", "gold") + """, best AS (
    SELECT t, escalation_rate, quality FROM curve WHERE quality >= TARGET - 1e-9 ORDER BY escalation_rate, t DESC LIMIT 1
), never AS (SELECT quality AS q FROM curve WHERE t = 'Infinity'::DOUBLE)
SELECT coalesce(t, 'Infinity'::DOUBLE) AS t, round(coalesce(escalation_rate, 1.0), 9) AS escalation_rate,
       round(coalesce(quality, q), 9) AS quality, t IS NOT NULL AS met FROM never LEFT JOIN best ON true"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("t", R("escalation_rate").alias("escalation_rate"), R("quality").alias("quality"), "met")


@query("choose_threshold", CHOOSE.replace("TARGET", "0.86"))
def choose_threshold(spark, sf_dir):
    return _rounded(threshold.choose(threshold.curve(preds(spark, sf_dir), ref="gold"), 0.86))


@query("max_drop_target", CHOOSE.replace("TARGET", "(SELECT quality - 0.02 FROM curve WHERE t = 'Infinity'::DOUBLE)"))
def max_drop_target(spark, sf_dir):
    points = threshold.curve(preds(spark, sf_dir), ref="gold")
    goal = points.filter(F.col("t") == float("inf")).select((F.col("quality") - 0.02).alias("goal"))
    return _rounded(threshold.choose(points.crossJoin(F.broadcast(goal)), F.col("goal")))


@query("apply_threshold", f"WITH {PREDS} SELECT id, CASE WHEN confidence >= 0.5 THEN pred ELSE teacher END AS cascade, NOT coalesce(confidence >= 0.5, false) AS escalated FROM preds")
def apply_threshold(spark, sf_dir):
    return threshold.apply(preds(spark, sf_dir), F.lit(0.5)).select("id", "cascade", "escalated")


@query("operating_point", f"""WITH {PREDS}, x AS (SELECT split, gold, teacher, CASE WHEN confidence >= 0.5 THEN pred ELSE teacher END AS answer,
    NOT coalesce(confidence >= 0.5, false) AS escalated FROM preds WHERE split IN ('valid', 'test'))
SELECT split, count(*) AS n, round(avg(escalated::INT), 9) AS escalation_rate, round(avg((answer = gold)::INT), 9) AS quality,
       round(avg((teacher = gold)::INT), 9) AS teacher_quality, avg((answer = gold)::INT) >= 0.85 - 1e-9 AS met FROM x GROUP BY split""")
def operating_point(spark, sf_dir):
    x = threshold.apply(preds(spark, sf_dir).filter(F.col("split").isin("valid", "test")), F.lit(0.5))
    q = metrics.rate(metrics.match("cascade", "gold"))
    return x.groupBy("split").agg(
        F.count("*").alias("n"), R(metrics.rate(F.col("escalated"))).alias("escalation_rate"), R(q).alias("quality"),
        R(metrics.rate(metrics.match("teacher", "gold"))).alias("teacher_quality"), (q >= 0.85 - 1e-9).alias("met"),
    )


F1 = "avg(CASE WHEN n_gold + n_pred > 0 THEN 2.0 * tp / (n_gold + n_pred) ELSE 0.0 END)"


@query("macro_f1_curve", f"""WITH {PREDS}, c AS (SELECT DISTINCT confidence AS t FROM preds WHERE confidence IS NOT NULL UNION ALL SELECT 'Infinity'::DOUBLE),
a AS (SELECT t, gold, CASE WHEN confidence >= t THEN pred ELSE teacher END AS answer FROM c, preds),
k AS (SELECT t, l, count(*) FILTER (gold = l AND answer = l) AS tp, count(*) FILTER (gold = l) AS n_gold, count(*) FILTER (answer = l) AS n_pred
      FROM a, (VALUES ('0'), ('1')) v(l) GROUP BY t, l)
SELECT t, round({F1}, 9) AS macro_f1 FROM k GROUP BY t""")
def macro_f1_curve(spark, sf_dir):
    return threshold.macro_f1_curve(preds(spark, sf_dir), LABELS).select("t", R("macro_f1").alias("macro_f1"))


for name, ref in (("accuracy", "gold"), ("agreement", "teacher")):

    @query(name, f"WITH {PREDS} SELECT count(*) AS n, round(coalesce(avg((pred = {ref})::INT), 0.0), 9) AS rate FROM preds")
    def _rate(spark, sf_dir, ref=ref):
        return metrics.agreement(preds(spark, sf_dir), "pred", ref).select("n", R("rate").alias("rate"))


COUNTS = f"""WITH {PREDS}, k AS (SELECT KEY l, count(*) FILTER (gold = l AND pred = l) AS tp, count(*) FILTER (gold = l) AS n_gold,
    count(*) FILTER (pred = l) AS n_pred FROM preds, (VALUES ('0'), ('1'), ('2')) v(l) GROUP BY KEY l)"""


@query("macro_f1", COUNTS.replace("KEY", "") + f" SELECT round({F1}, 9) AS macro_f1 FROM k")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(preds(spark, sf_dir), "pred", "gold", ["0", "1", "2"]).select(R("macro_f1").alias("macro_f1"))


@query("score", COUNTS.replace("KEY", "split,") + f" SELECT split, round({F1}, 9) AS macro_f1 FROM k GROUP BY split")
def score(spark, sf_dir):
    return metrics.macro_f1(preds(spark, sf_dir), "pred", "gold", ["0", "1", "2"], ["split"]).select("split", R("macro_f1").alias("macro_f1"))


@query("per_group_scores", f"WITH {PREDS} SELECT coalesce(grp, '(none)') AS grp, count(*) AS n, round(avg((pred = gold)::INT), 9) AS rate FROM preds GROUP BY ALL")
def per_group_scores(spark, sf_dir):
    df = preds(spark, sf_dir).withColumn("grp", F.coalesce("grp", F.lit("(none)")))
    return metrics.agreement(df, "pred", "gold", ["grp"]).select("grp", "n", R("rate").alias("rate"))


@query("per_trait_breakdown", f"""WITH {PREDS} SELECT trait, count(*) AS n, round(avg((pred = gold)::INT), 9) AS rate
FROM (SELECT pred, gold, unnest(CASE WHEN len(traits) = 0 THEN ['(none)'] ELSE list_distinct(traits) END) AS trait FROM preds) GROUP BY trait""")
def per_trait_breakdown(spark, sf_dir):
    return metrics.agreement(metrics.traits(preds(spark, sf_dir)), "pred", "gold", ["trait"]).select("trait", "n", R("rate").alias("rate"))


@query("usable_records", f"WITH {PREDS} SELECT id FROM preds WHERE gold IS NOT NULL")
def usable_records(spark, sf_dir):
    return threshold.usable(preds(spark, sf_dir), "gold").select("id")


@query("primary_correct", f"WITH {PREDS} SELECT id, coalesce(pred = coalesce(gold, teacher), false) AS correct FROM preds")
def primary_correct(spark, sf_dir):
    return preds(spark, sf_dir).select("id", metrics.match("pred", F.coalesce("gold", "teacher")).alias("correct"))


@query("teacher_vs_gold", f"WITH {PREDS} SELECT split, count(*) AS n, round(avg((teacher = gold)::INT), 9) AS rate FROM preds GROUP BY split")
def teacher_vs_gold(spark, sf_dir):
    return metrics.agreement(preds(spark, sf_dir), "teacher", "gold", ["split"]).select("split", "n", R("rate").alias("rate"))


# Extraction: the orders' fields, with a disturbed copy as prediction.
EXTRACT = """x AS (
    SELECT o_orderkey AS id, o_orderpriority AS g_text, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE lower(o_orderpriority) END AS p_text,
           CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS g_number,
           CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice + CASE o_orderkey % 5 WHEN 0 THEN 0.004 WHEN 1 THEN 0.1 ELSE 0 END END AS p_number,
           o_orderkey % 21 <> 0 AS valid FROM orders
), f AS (
    SELECT id, valid, 'text' AS field, g_text IS NOT NULL AS g, valid AND p_text IS NOT NULL AS p, coalesce(valid AND lower(g_text) = lower(p_text), false) AS hit FROM x
    UNION ALL SELECT id, valid, 'number', g_number IS NOT NULL, valid AND p_number IS NOT NULL, coalesce(valid AND abs(g_number - p_number) <= 0.005 + 1e-9, false) FROM x
)"""


def _fields(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    valid = k % 21 != 0
    p_text = F.when(k % 9 == 0, None).when(k % 9 == 1, "x").otherwise(F.lower("o_orderpriority"))
    off = F.when(k % 5 == 0, 0.004).when(k % 5 == 1, 0.1).otherwise(0.0)
    p_number = F.when(k % 8 == 0, None).otherwise(F.col("o_totalprice") + off)
    g_number = F.when(k % 10 == 0, None).otherwise(F.col("o_totalprice"))
    field = lambda name, g, p, equal: F.struct(
        F.lit(name).alias("field"), g.isNotNull().alias("g"), (valid & p.isNotNull()).alias("p"), F.coalesce(valid & equal, F.lit(False)).alias("hit")
    )
    rows = F.array(
        field("text", F.col("o_orderpriority"), p_text, F.lower("o_orderpriority") == F.lower(p_text)),
        field("number", g_number, p_number, metrics.number_equal(g_number, p_number)),
    )
    return o.select(k.alias("id"), valid.alias("valid"), F.inline(rows))


TPFPFN = "count(*) FILTER (hit) AS tp, count(*) FILTER (p AND NOT hit) AS fp, count(*) FILTER (g AND NOT hit) AS fn"


def _tpfpfn():
    return F.count_if("hit").alias("tp"), F.count_if(F.col("p") & ~F.col("hit")).alias("fp"), F.count_if(F.col("g") & ~F.col("hit")).alias("fn")


@query("document_counts", f"WITH {EXTRACT} SELECT id, {TPFPFN} FROM f GROUP BY id")
def document_counts(spark, sf_dir):
    return _fields(spark, sf_dir).groupBy("id").agg(*_tpfpfn())


@query("field_equal", f"WITH {EXTRACT} SELECT id, field, hit OR (valid AND NOT g AND NOT p) AS equal FROM f")
def field_equal(spark, sf_dir):
    return _fields(spark, sf_dir).select("id", "field", (F.col("hit") | (F.col("valid") & ~F.col("g") & ~F.col("p"))).alias("equal"))


@query("per_field_em", f"WITH {EXTRACT} SELECT field, count(*) AS n, round(avg((hit OR (valid AND NOT g AND NOT p))::INT), 9) AS exact, {TPFPFN} FROM f GROUP BY field")
def per_field_em(spark, sf_dir):
    exact = F.col("hit") | (F.col("valid") & ~F.col("g") & ~F.col("p"))
    return _fields(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"), R(metrics.rate(exact)).alias("exact"), *_tpfpfn())


@query("extraction_scores", f"""WITH {EXTRACT}, d AS (SELECT id, any_value(valid) AS valid, bool_and(hit OR (valid AND NOT g AND NOT p)) AS whole, {TPFPFN},
    count(*) FILTER (hit OR (valid AND NOT g AND NOT p)) AS same, count(*) AS fields FROM f GROUP BY id)
SELECT round(avg(valid::INT), 9) AS validity, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1,
       round(sum(tp) / (sum(tp) + sum(fp)), 9) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 9) AS recall,
       round(sum(same) / sum(fields), 9) AS field_em, round(avg(whole::INT), 9) AS document_em FROM d""")
def extraction_scores(spark, sf_dir):
    same = F.col("hit") | (F.col("valid") & ~F.col("g") & ~F.col("p"))
    d = _fields(spark, sf_dir).groupBy("id").agg(F.first("valid").alias("valid"), *_tpfpfn(), F.count_if(same).alias("same"), F.count("*").alias("fields"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return d.agg(
        R(metrics.rate(F.col("valid"))).alias("validity"), R(metrics.micro_f1(tp, fp, fn)).alias("micro_f1"),
        R(tp / (tp + fp)).alias("precision"), R(tp / (tp + fn)).alias("recall"), R(F.sum("same") / F.sum("fields")).alias("field_em"),
        R(metrics.rate(F.col("same") == F.col("fields"))).alias("document_em"),
    )


@query("micro_f1", f"WITH {EXTRACT}, c AS (SELECT field, {TPFPFN} FROM f GROUP BY field) SELECT field, round(2.0 * tp / (2 * tp + fp + fn), 9) AS micro_f1 FROM c")
def micro_f1(spark, sf_dir):
    c = _fields(spark, sf_dir).groupBy("field").agg(*_tpfpfn())
    return c.select("field", R(metrics.micro_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("micro_f1"))


BINNED = f"""WITH {PREDS}, b AS (SELECT least(CAST(floor(confidence * 15) AS INTEGER), 14) AS bin, confidence AS c, (pred = gold)::INT AS h FROM preds WHERE confidence IS NOT NULL)"""


@query("reliability_bins", BINNED + """, g AS (SELECT bin, count(*) AS n, avg(c) AS mean_confidence, avg(h) AS accuracy FROM b GROUP BY bin)
SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mean_confidence, 9) AS mean_confidence, round(accuracy, 9) AS accuracy FROM range(15) r(bin) LEFT JOIN g ON r.bin = g.bin""")
def reliability_bins(spark, sf_dir):
    b = calibration.reliability(_correct(preds(spark, sf_dir)))
    return b.select("bin", "n", R("mean_confidence").alias("mean_confidence"), R("accuracy").alias("accuracy"))


ECE = BINNED + ", g AS (SELECT bin, count(*) AS n, sum(c) AS c, sum(h) AS h, sum((c - h) * (c - h)) AS s FROM b GROUP BY bin)"


@query("ece", ECE + " SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(h - c)) / sum(n), 9) AS ece FROM g")
def ece(spark, sf_dir):
    return calibration.errors(_correct(preds(spark, sf_dir))).select("n", R("ece").alias("ece"))


@query("brier", ECE + " SELECT round(sum(s) / sum(n), 9) AS brier FROM g")
def brier(spark, sf_dir):
    return calibration.errors(_correct(preds(spark, sf_dir))).select(R("brier").alias("brier"))


AUROC = """(SELECT avg(CASE WHEN p.c > n.c THEN 1.0 WHEN p.c = n.c THEN 0.5 ELSE 0.0 END) FROM (SELECT c FROM b WHERE h = 1) p, (SELECT c FROM b WHERE h = 0) n)"""


@query("auroc", BINNED + f" SELECT round({AUROC}, 9) AS auroc")
def auroc(spark, sf_dir):
    return calibration.auroc(_correct(preds(spark, sf_dir))).select(R("auroc").alias("auroc"))


@query("calibration_report", ECE + f" SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(h - c)) / sum(n), 9) AS ece, round(sum(s) / sum(n), 9) AS brier, round({AUROC}, 9) AS auroc FROM g")
def calibration_report(spark, sf_dir):
    df = _correct(preds(spark, sf_dir))
    e = calibration.errors(df).crossJoin(F.broadcast(calibration.auroc(df)))
    return e.select("n", R("ece").alias("ece"), R("brier").alias("brier"), R("auroc").alias("auroc"))


COMPARE = f"""WITH {PREDS}, u AS (SELECT 'primary' AS which, confidence AS c, (pred = gold)::INT AS h FROM preds WHERE confidence IS NOT NULL
    UNION ALL SELECT 'alternative', alt_confidence, (pred = gold)::INT FROM preds)
SELECT which, count(*) AS n, round(avg(c), 9) AS mean_confidence, round(avg(h), 9) AS accuracy FROM u GROUP BY which"""


@query("confidence_comparison", COMPARE)
def confidence_comparison(spark, sf_dir):
    df = _correct(preds(spark, sf_dir))
    rows = F.array(*[F.struct(F.lit(n).alias("which"), F.col(c).alias("c")) for n, c in (("primary", "confidence"), ("alternative", "alt_confidence"))])
    long = df.select("correct", F.inline(rows)).filter(F.col("c").isNotNull())
    return long.groupBy("which").agg(F.count("*").alias("n"), R(F.avg("c")).alias("mean_confidence"), R(metrics.rate(F.col("correct"))).alias("accuracy"))


@query("percentiles", f"""WITH {PREDS} SELECT split, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
    round(avg(latency_ms), 6) AS mean, count(latency_ms) AS n FROM preds GROUP BY split""")
def percentiles(spark, sf_dir):
    df = preds(spark, sf_dir).groupBy("split").agg(*metrics.percentiles("latency_ms", 0.5, 0.95), F.avg("latency_ms").alias("mean"), F.count("latency_ms").alias("n"))
    return df.select("split", R("p50", 6).alias("p50"), R("p95", 6).alias("p95"), R("mean", 6).alias("mean"), "n")


@query("mean_std", f"WITH {PREDS} SELECT grp, round(avg(latency_ms), 6) AS mean, round(stddev_samp(latency_ms), 6) AS std FROM preds GROUP BY grp")
def mean_std(spark, sf_dir):
    return preds(spark, sf_dir).groupBy("grp").agg(R(F.avg("latency_ms"), 6).alias("mean"), R(F.stddev_samp("latency_ms"), 6).alias("std"))


@query("wilson_interval", f"""WITH {PREDS}, k AS (SELECT split, count(*) FILTER (pred = gold) AS k, count(*) AS n FROM preds GROUP BY split), z AS (SELECT *, 1.959963984540054 AS z, k * 1.0::DOUBLE / n AS p FROM k)
SELECT split, n, round(greatest(0.0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 9) AS low,
       round(least(1.0, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 9) AS high FROM z""")
def wilson_interval(spark, sf_dir):
    k = preds(spark, sf_dir).groupBy("split").agg(F.count_if(metrics.match("pred", "gold")).alias("k"), F.count("*").alias("n"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return k.select("split", "n", R(low).alias("low"), R(high).alias("high"))


# Selection among runs: a run is a remainder of the id, its metric the agreement on validation rows.
RUNS = f"{PREDS}, runs AS (SELECT id % 5 AS run, count(*) AS n, avg((pred = teacher)::INT) AS metric, avg(alt_confidence) AS loss FROM preds WHERE split = 'valid' GROUP BY 1)"


def _runs(spark, sf_dir):
    v = preds(spark, sf_dir).filter("split = 'valid'")
    return v.groupBy((F.col("id") % 5).alias("run")).agg(F.count("*").alias("n"), metrics.rate(metrics.match("pred", "teacher")).alias("metric"), F.avg("alt_confidence").alias("loss"))


@query("score_runs", f"WITH {RUNS} SELECT run, n, round(metric, 9) AS metric FROM runs")
def score_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("run", "n", R("metric").alias("metric"))


@query("select_run", f"WITH {RUNS} SELECT run, round(metric, 9) AS metric FROM runs WHERE metric >= (SELECT max(metric) FROM runs) - 1e-12 ORDER BY run LIMIT 1")
def select_run(spark, sf_dir):
    r = _runs(spark, sf_dir)
    w = Window.partitionBy(F.lit(0))
    best = r.withColumn("best", F.max("metric").over(w)).filter(F.col("metric") >= F.col("best") - 1e-12)
    return best.orderBy("run").limit(1).select("run", R("metric").alias("metric"))


@query("select_checkpoint", f"WITH {RUNS} SELECT run, round(loss, 9) AS loss FROM runs WHERE NOT isnan(loss) ORDER BY loss, run LIMIT 1")
def select_checkpoint(spark, sf_dir):
    r = _runs(spark, sf_dir).filter(~F.isnan("loss"))
    return r.orderBy("loss", "run").limit(1).select("run", R("loss").alias("loss"))


@query("choose_base_model", f"""WITH {PREDS}, s AS (SELECT id % 2 AS large, avg((pred = gold)::INT) AS q, quantile_cont(latency_ms, 0.95) AS p95 FROM preds GROUP BY 1)
SELECT round(l.q - s.q, 9) AS gain, round(l.p95 / s.p95, 9) AS ratio, CASE WHEN l.q - s.q >= 0.01 - 1e-9 AND l.p95 / s.p95 < 3 THEN 'large' ELSE 'small' END AS chosen
FROM s l, s s WHERE l.large = 1 AND s.large = 0""")
def choose_base_model(spark, sf_dir):
    by = preds(spark, sf_dir).withColumn("large", F.col("id") % 2)
    q = lambda k: F.avg(F.when(F.col("large") == k, metrics.match("pred", "gold").cast("double")))
    p95 = lambda k: F.percentile(F.when(F.col("large") == k, F.col("latency_ms")), F.lit(0.95))
    one = by.agg((q(1) - q(0)).alias("gain"), (p95(1) / p95(0)).alias("ratio"))
    chosen = F.when((F.col("gain") >= 0.01 - 1e-9) & (F.col("ratio") < 3), "large").otherwise("small")
    return one.select(R("gain").alias("gain"), R("ratio").alias("ratio"), chosen.alias("chosen"))


# Bootstrap and recalibration have no SQL; tests hold them against numpy.
def _units(df: DataFrame, by=None) -> tuple[DataFrame, int]:
    """Rows (or groups, in the order of their names) numbered from 0, with additive counts."""
    ok = lambda c: metrics.match(c, "gold").cast("double")
    key = F.coalesce("grp", F.lit("(none)")) if by else F.col("id")
    g = df.groupBy(key.alias("key")).agg(F.count("*").cast("double").alias("n"), F.sum(ok("pred")).alias("student"), F.sum(ok("teacher")).alias("teacher"))
    g = running.by_ranges(g, "key")
    g = running.running_sums(g, "__range", [F.col("key")], {"unit": F.lit(1)}, before=True).drop("__range")
    return g, g.count()


def _bootstrap(spark, sf_dir, by=None):
    units, n = _units(preds(spark, sf_dir).filter("split = 'test'"), by)
    s = bootstrap.sums(units, ["n", "student", "teacher"], n, seed=11)
    s = s.select((F.col("student") / F.col("n")).alias("student"), (F.col("teacher") / F.col("n")).alias("teacher"), ((F.col("student") - F.col("teacher")) / F.col("n")).alias("difference"))
    return bootstrap.interval(s, ["student", "teacher", "difference"])


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    return _bootstrap(spark, sf_dir).filter("statistic <> 'difference'")


@query("bootstrap_diff")
def bootstrap_diff(spark, sf_dir):
    return _bootstrap(spark, sf_dir).filter("statistic = 'difference'")


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf_dir):
    return _bootstrap(spark, sf_dir, by="grp")


# The monotone fit as its min-max formula: at each confidence the largest of the least means of stretches around it.
def _isotonic_sql(name: str, ref: str) -> str:
    return f"""{name}_by AS (SELECT confidence AS x, CAST(sum((pred = {ref})::INT) AS DOUBLE) AS s, count(*) AS n FROM preds WHERE split = 'valid' AND confidence IS NOT NULL GROUP BY 1),
{name}_c AS (SELECT x, s, n, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM {name}_by),
{name}_m AS (SELECT a.x AS a, b.x AS b, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.x ORDER BY b.x DESC) AS m FROM {name}_c a JOIN {name}_c b ON a.x <= b.x),
{name}_y AS (SELECT b AS x, round(max(m), 12) AS y FROM {name}_m GROUP BY b), {name} AS (SELECT min(x) AS x, y FROM {name}_y GROUP BY y UNION SELECT max(x), y FROM {name}_y GROUP BY y)"""


@query("isotonic_fit", f"WITH {PREDS}, {_isotonic_sql('k', 'gold')} SELECT round(x, 9) AS x, round(y, 9) AS y FROM k")
def isotonic_fit(spark, sf_dir):
    return calibration.isotonic_fit(_correct(preds(spark, sf_dir).filter("split = 'valid'"))).select(R("x").alias("x"), R("y").alias("y"))


@query("isotonic_apply", f"""WITH {PREDS}, {_isotonic_sql('k', 'gold')}, e AS (SELECT p.id, confidence AS c, max(k.x) FILTER (k.x <= confidence) AS lo, min(k.x) FILTER (k.x >= confidence) AS hi FROM preds p LEFT JOIN k ON true GROUP BY ALL)
SELECT id, round(CASE WHEN c IS NULL THEN NULL WHEN lo IS NULL THEN h.y WHEN hi IS NULL OR hi = lo THEN l.y ELSE l.y + (c - lo) / (hi - lo) * (h.y - l.y) END, 9) AS calibrated FROM e LEFT JOIN k l ON l.x = lo LEFT JOIN k h ON h.x = hi""")
def isotonic_apply(spark, sf_dir):
    df = _correct(preds(spark, sf_dir))
    return calibration.isotonic_apply(df, calibration.isotonic_fit(df.filter("split = 'valid'"))).select("id", R("calibrated").alias("calibrated"))


REFERENCES = {"gold": "gold", "teacher": "teacher", "primary": "coalesce(gold, teacher)"}


@query("isotonic_per_reference", f"WITH {PREDS}, {', '.join(_isotonic_sql(f'map_{n}', c) for n, c in REFERENCES.items())} "
       + " UNION ALL ".join(f"SELECT '{n}' AS reference, round(x, 9) AS x, round(y, 9) AS y FROM map_{n}" for n in REFERENCES))
def isotonic_per_reference(spark, sf_dir):
    """A map against gold labels, one against the teacher's, and one against gold where there is one and else the teacher."""
    out = None
    for name, column in REFERENCES.items():
        df = preds(spark, sf_dir).filter("split = 'valid'").filter(f"{column} IS NOT NULL").withColumn("correct", metrics.match("pred", F.expr(column)))
        part = calibration.isotonic_fit(df).select(F.lit(name).alias("reference"), R("x").alias("x"), R("y").alias("y"))
        out = part if out is None else out.unionByName(part)
    return out
