"""Queries over runs and their bookkeeping: training pairs, candidates, thresholds, staleness, confidences and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import metrics, running, splits, votes
from gristmill.registry import query
from gristmill.sources.views import CAPTURES, IMPORTS, PREDS, SERVED, captures, imports, preds, served, table

R = lambda c, n=9: F.round(c, n)


@query("load_train_pairs", f"WITH {PREDS} SELECT id, teacher FROM preds WHERE split = 'train' AND teacher IS NOT NULL")
def load_train_pairs(spark, sf_dir):
    return preds(spark, sf_dir).filter("split = 'train' AND teacher IS NOT NULL").select("id", "teacher")


@query("group_resolve", f"WITH {PREDS} SELECT id, coalesce(grp, split) AS grp FROM preds")
def group_resolve(spark, sf_dir):
    return preds(spark, sf_dir).select("id", F.coalesce("grp", "split").alias("grp"))


@query("traits_resolve", f"WITH {PREDS} SELECT id, len(list_distinct(traits)) AS n, traits[1] AS first FROM preds")
def traits_resolve(spark, sf_dir):
    return preds(spark, sf_dir).select("id", F.size(F.array_distinct("traits")).cast("long").alias("n"), F.get("traits", F.lit(0)).alias("first"))


@query("value_typing", f"WITH {CAPTURES} SELECT id, CASE WHEN response = 'body' THEN CAST(id % 30 + 1 AS BIGINT) END AS tokens FROM captures")
def value_typing(spark, sf_dir):
    """A value that is a JSON object has its fields; anything else is null."""
    v = F.try_parse_json("response_body")
    return captures(spark, sf_dir).select("id", F.try_variant_get(v, "$.usage.completion_tokens", "bigint").alias("tokens"))


RUN = f"{PREDS}, runs AS (SELECT id % 7 AS run, id % 7 % 3 <> 1 AS adapter, CASE WHEN id % 7 = 5 THEN 'gold' ELSE 'teacher' END AS labels, CASE WHEN id % 7 < 4 THEN 'small' ELSE 'large' END AS base, avg(alt_confidence) AS loss, count(*) AS n FROM preds GROUP BY 1)"


def _runs(spark, sf_dir):
    r = F.col("run")
    by = preds(spark, sf_dir).groupBy((F.col("id") % 7).alias("run")).agg(F.avg("alt_confidence").alias("loss"), F.count("*").alias("n"))
    return by.withColumns({"adapter": r % 3 != 1, "labels": F.when(r == 5, "gold").otherwise("teacher"), "base": F.when(r < 4, "small").otherwise("large")})




@query("training_table", f"WITH {RUN} SELECT run, base, labels, n, round(loss, 9) AS loss FROM runs")
def training_table(spark, sf_dir):
    return _runs(spark, sf_dir).select("run", "base", "labels", "n", R("loss").alias("loss"))


@query("collect_training", f"WITH {RUN} SELECT base, coalesce(min(run) FILTER (run = 2), min(run)) AS run, list(run ORDER BY run) AS seeds FROM runs GROUP BY base")
def collect_training(spark, sf_dir):
    chosen = F.coalesce(F.min(F.when(F.col("run") == 2, F.col("run"))), F.min("run"))
    return _runs(spark, sf_dir).groupBy("base").agg(chosen.alias("run"), F.sort_array(F.collect_list("run")).alias("seeds"))


@query("ablation_summary", f"WITH {RUN} SELECT base, round(avg(loss), 9) AS mean, round(stddev_samp(loss), 9) AS std, count(*) FILTER (loss > 0.5) AS diverged FROM runs GROUP BY base")
def ablation_summary(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("base").agg(R(F.avg("loss")).alias("mean"), R(F.stddev_samp("loss")).alias("std"), F.count_if(F.col("loss") > 0.5).alias("diverged"))





ORDER = "substr(sha256('13' || chr(0) || 'train' || chr(0) || CAST(id AS VARCHAR)), 1, 16)"


@query("prepare_run_data", f"WITH {PREDS} SELECT id, gold AS label, row_number() OVER (ORDER BY {ORDER}, id) AS place FROM preds WHERE split = 'train' AND gold IS NOT NULL")
def prepare_run_data(spark, sf_dir):
    p = preds(spark, sf_dir).filter("split = 'train' AND gold IS NOT NULL")
    rank = splits.seeded_rank("13", "train", F.col("id"))
    p = running.running_sums(p.select("id", F.col("gold").alias("label")), running.hex_bucket(rank), [rank, F.col("id")], {"place": F.lit(1)})
    return p.select("id", "label", F.col("place").cast("long").alias("place"))


@query("operating_point_table", f"""WITH {PREDS}, x AS (SELECT split, CASE WHEN confidence >= 0.5 THEN pred ELSE teacher END = gold AS ok, NOT coalesce(confidence >= 0.5, false) AS esc FROM preds)
SELECT round(avg(esc::INT) FILTER (split = 'valid'), 9) AS escalation_valid, round(avg(esc::INT) FILTER (split = 'test'), 9) AS escalation_test,
       round(avg(ok::INT) FILTER (split = 'test') - avg(ok::INT) FILTER (split = 'valid'), 9) AS quality_difference FROM x""")
def operating_point_table(spark, sf_dir):
    keep = F.coalesce(F.col("confidence") >= 0.5, F.lit(False))
    x = preds(spark, sf_dir).select("split", metrics.match(F.when(keep, F.col("pred")).otherwise(F.col("teacher")), "gold").cast("double").alias("ok"), (~keep).cast("double").alias("esc"))
    of = lambda s, c: F.avg(F.when(F.col("split") == s, F.col(c)))
    return x.agg(R(of("valid", "esc")).alias("escalation_valid"), R(of("test", "esc")).alias("escalation_test"), R(of("test", "ok") - of("valid", "ok")).alias("quality_difference"))


@query("cascade_minus_teacher", f"WITH {PREDS} SELECT split, round(avg((CASE WHEN confidence >= 0.5 THEN pred ELSE teacher END = gold)::INT) - avg((teacher = gold)::INT), 9) AS difference FROM preds GROUP BY split")
def cascade_minus_teacher(spark, sf_dir):
    keep = F.coalesce(F.col("confidence") >= 0.5, F.lit(False))
    own = metrics.match(F.when(keep, F.col("pred")).otherwise(F.col("teacher")), "gold")
    return preds(spark, sf_dir).groupBy("split").agg(R(metrics.rate(own) - metrics.rate(metrics.match("teacher", "gold"))).alias("difference"))


NORM = r"trim(regexp_replace(input, '[\s]+', ' ', 'g'))"


@query("bakeoff_inputs", f"""WITH {IMPORTS}, i AS (SELECT id, sha256({NORM}) AS h, CASE WHEN gold IN ('0', '1') THEN gold END AS gold,
    CASE lower(trim(split)) WHEN 'train' THEN 1 WHEN 'validation' THEN 2 WHEN 'dev' THEN 2 WHEN 'test' THEN 3 END AS rank FROM imports WHERE {NORM} <> ''),
e AS (SELECT h, min(id) AS id, max(rank) AS rank, count(gold) AS votes, count(*) FILTER (gold = '1') AS ones, count(*) FILTER (gold = '0') AS zeros FROM i GROUP BY h)
SELECT h, id, CASE WHEN 2 * ones > votes THEN '1' ELSE '0' END AS gold FROM e WHERE rank = 2 AND (2 * ones > votes OR 2 * zeros > votes)""")
def bakeoff_inputs(spark, sf_dir):
    """(h, id, gold), one per hash of imported inputs: those whose most protected split is valid, with the strict majority of their
    valid golds. id is the first row with that input, which has its text. Texts are hashed where they are read."""
    norm = tx.normalise("text")
    h = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), norm.alias("norm")).filter("norm <> ''").select("id", F.sha2("norm", 256).alias("h"))
    gold = F.when(F.col("gold").isin("0", "1"), F.col("gold"))
    i = imports(spark, sf_dir).select("id", gold.alias("gold"), votes.canonical_split("split").alias("split")).join(h, "id")
    e = i.groupBy("h").agg(F.max(F.expr(votes.RANK)).alias("rank"), F.min("id").alias("id")).filter("rank = 2")
    g = votes.majority(i, "h", "gold", "id").filter("gold IS NOT NULL")
    return e.join(g, "h").select("h", "id", "gold")


@query("bench_inputs", f"WITH {PREDS} SELECT p.id, length(d.text) AS n_chars FROM preds p JOIN documents d ON d.doc_id = p.id WHERE split = 'test' ORDER BY id")
def bench_inputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n_chars"))
    return preds(spark, sf_dir).filter("split = 'test'").join(d, "id").select("id", "n_chars").orderBy("id")


@query("bench_align", f"WITH {PREDS}, {SERVED} SELECT p.id, s.route, p.pred FROM preds p JOIN served s ON s.id = p.id WHERE p.split = 'test'")
def bench_align(spark, sf_dir):
    p = preds(spark, sf_dir).filter("split = 'test'").select("id", "pred")
    return p.join(served(spark, sf_dir).select("id", "route"), "id").select("id", "route", "pred")


@query("live_bench_check", f"WITH {SERVED} SELECT route, round(quantile_cont(total_ms, 0.5) / quantile_cont(student_ms, 0.5), 6) AS ratio FROM served GROUP BY route")
def live_bench_check(spark, sf_dir):
    ratio = F.percentile("total_ms", F.lit(0.5)) / F.percentile("student_ms", F.lit(0.5))
    return served(spark, sf_dir).groupBy("route").agg(R(ratio, 6).alias("ratio"))


@query("label_examples", f"""WITH {PREDS}, j AS (SELECT p.id, p.split, l.quality, p.id % 6 = 0 AS missing, p.id % 13 = 0 AS invalid FROM preds p JOIN labels l ON l.doc_id = p.id)
SELECT id, CASE WHEN missing OR invalid THEN NULL ELSE CAST(quality AS VARCHAR) END AS teacher FROM j WHERE NOT (missing OR invalid) OR split = 'test'""")
def label_examples(spark, sf_dir):
    """Pending rows take the recorded answer; one that is missing or invalid drops the row unless it is a test row."""
    recorded = table(spark, sf_dir, "labels").filter("doc_id % 6 <> 0")
    answer = F.when(F.col("doc_id") % 13 == 0, "not a label").otherwise(F.col("quality").cast("string"))
    p = preds(spark, sf_dir).select("id", "split").join(recorded.select(F.col("doc_id").alias("id"), answer.alias("answer")), "id", "left")
    p = p.withColumn("teacher", F.when(F.col("answer").isin("0", "1"), F.col("answer")))
    return p.filter(F.col("teacher").isNotNull() | (F.col("split") == "test")).select("id", "teacher")



@query("render_template", f"WITH {PREDS} SELECT id, 'The label is ' || pred || '.' AS text FROM preds")
def render_template(spark, sf_dir):
    return preds(spark, sf_dir).select("id", F.replace(F.lit("The label is {label}."), F.lit("{label}"), F.col("pred")).alias("text"))





@query("settings_hash", f"WITH {RUN} SELECT run, sha256('base=' || base || ',labels=' || labels) AS h FROM runs")
def settings_hash(spark, sf_dir):
    pairs = F.sort_array(F.array(F.concat(F.lit("labels="), "labels"), F.concat(F.lit("base="), "base")))
    return _runs(spark, sf_dir).select("run", F.sha2(F.array_join(pairs, ","), 256).alias("h"))


@query("classification_confidence", "SELECT l_orderkey AS id, round(exp(sum(-l_tax)), 9) AS confidence FROM lineitem GROUP BY 1")
def classification_confidence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(R(F.exp(F.least(F.sum(-F.col("l_tax")), F.lit(0.0)))).alias("confidence"))



@query("tfidf_lr_baseline")
def tfidf_lr_baseline(spark, sf_dir):
    from gristmill.operators.baseline import tfidf_baseline

    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("text", F.col("quality").cast("string").alias("label"), (F.col("doc_id") % 10).alias("k"))
    return tfidf_baseline(d.filter("k < 6"), d.filter("k >= 6 AND k < 8"))[2]
