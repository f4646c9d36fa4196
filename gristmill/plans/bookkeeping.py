"""Queries over runs, names, schedules, projections and confidences; suppliers stand for runs, parts for models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import bookkeeping as bk
from gristmill.registry import query
from gristmill.sources.views import LEDGER, PREDS, ledger, preds, table

R = lambda c, n=9: F.round(c, n)


def _form(key, forms: list[str], value):
    return F.replace(F.element_at(F.array(*map(F.lit, forms)), (key % len(forms) + 1).cast("int")), F.lit("{}"), value)


MODELS = ["org/Net{}B-Instruct-4bit", "Net{}-3bit-bf16", "a/b/Net{}b-chat/", "-instruct", "c:\\m\\Ün Net{}b-MLX", "/", "x.{}b-0.5b-fp16"]


def _models(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), _form(k, MODELS, (k % 9).cast("string")).alias("model"))


NAMES = """m AS (SELECT p_partkey AS id, CAST(p_partkey % 9 AS VARCHAR) AS s, p_partkey % 7 AS f FROM part),
n AS (SELECT id, CASE f WHEN 0 THEN 'net' || s || 'b' WHEN 1 THEN 'net' || s WHEN 2 THEN 'net' || s || 'b-chat' WHEN 3 THEN 'instruct' WHEN 4 THEN 'n-net' || s || 'b' WHEN 5 THEN 'model' ELSE 'x.' || s || 'b-0.5b' END AS name, f, s FROM m)"""


@query("short_model_name", f"WITH {NAMES} SELECT id, name FROM n")
def short_model_name(spark, sf_dir):
    return _models(spark, sf_dir).select("id", bk.short_model_name(F.col("model")).alias("name"))


@query("base_size", f"WITH {NAMES} SELECT id, CASE WHEN f IN (0, 2, 4) THEN CAST(s AS DOUBLE) WHEN f = 6 THEN 0.5 END AS size FROM n")
def base_size(spark, sf_dir):
    return _models(spark, sf_dir).select("id", bk.base_size(F.col("model")).alias("size"))


@query("run_id", f"""WITH {NAMES} SELECT id, name || '-full-s' || CAST(id % 3 AS VARCHAR) || CASE WHEN id % 4 = 0 THEN '-gold' ELSE '' END || CASE WHEN id % 5 = 0 THEN '-torch' ELSE '' END
    || CASE WHEN id % 2 = 0 THEN '-constant' ELSE '' END AS run_id FROM n""")
def run_id(spark, sf_dir):
    k = F.col("id")
    of = lambda n, one, other: F.when(k % n == 0, one).otherwise(other)
    name = bk.run_id(F.col("model"), F.lit("full"), k % 3, of(4, "gold", "teacher"), of(5, "torch", "mlx"), of(2, "constant", "warmup_cosine"))
    return _models(spark, sf_dir).select("id", name.alias("run_id"))


TEXTS = ["see /home/me/work/run{}.json, ok", "--out=/home/me/work/a/b{} x", "'/data/store/t/{}.parquet'", "in (/tmp/x/y{}) and /etc/{}", "and/or 1/{}", "/home/me/work", "http://h/home/{}"]


@query("scrub_paths", """SELECT s_suppkey AS id, replace(['see run{}.json, ok', '--out=a/b{} x', '''$STORE/t/{}.parquet''', 'in (y{}) and /etc/{}', 'and/or 1/{}', '.', 'http://h/home/{}'][CAST(s_suppkey % 7 + 1 AS INTEGER)],
    '{}', CAST(s_suppkey AS VARCHAR)) AS text FROM supplier""")
def scrub_paths(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), bk.scrub_paths(_form(k, TEXTS, k.cast("string")), "/home/me/work", "/data/store").alias("text"))


@query("parse_duration", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_partkey * 60.0 WHEN 1 THEN p_partkey * 3600.0 WHEN 2 THEN p_partkey * 86400.0 WHEN 3 THEN 0.5 WHEN 4 THEN NULL END::DOUBLE AS seconds FROM part""")
def parse_duration(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), bk.seconds(_form(k, ["{}m", " {} h ", "{}d", "0.5s", "{}w", "m{}"], k.cast("string"))).alias("seconds"))


@query("lr_schedule", """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 400 AS steps, o_orderkey % 97 AS step, CASE WHEN o_orderkey % 5 = 0 THEN 'constant' ELSE 'warmup_cosine' END AS s FROM orders),
w AS (SELECT *, CASE WHEN steps <= 1 THEN 0 ELSE greatest(1, least(100, CAST(round_even(steps * 0.1::DOUBLE, 0) AS INTEGER))) END AS warm FROM r)
SELECT id, round(CASE WHEN s = 'constant' THEN 0.001 WHEN step < warm THEN 0.001 * (step + 1) / warm ELSE 0.0001 + 0.00045 * (1 + cos(pi() * least(1.0::DOUBLE, (step - warm) / greatest(1, steps - warm)))) END::DOUBLE, 12) AS rate FROM w""")
def lr_schedule(spark, sf_dir):
    k = F.col("o_orderkey")
    rate = bk.learning_rate(k % 97, F.lit(0.001), k % 400, F.when(k % 5 == 0, "constant").otherwise("warmup_cosine"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), R(rate, 12).alias("rate"))


@query("iterations", """SELECT o_orderkey AS id, CAST(CASE WHEN o_custkey % 10 = 0 OR o_orderkey % 9 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN least(300, greatest(1, ceil(o_custkey % 10 * 100 * 1.5::DOUBLE / (o_orderkey % 9))))
    ELSE greatest(1, ceil(o_custkey % 10 * 100 * 1.5::DOUBLE / (o_orderkey % 9))) END AS BIGINT) AS steps FROM orders""")
def iterations(spark, sf_dir):
    k = F.col("o_orderkey")
    n = bk.iterations(F.lit(1.5), F.col("o_custkey") % 10 * 100, k % 9, F.when(k % 2 == 0, "quick").otherwise("full"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), n.alias("steps"))


# Runs: suppliers by key k. Their adapter is a hash, which is another if the run was trained again.
RUNS = """runs AS (SELECT 'r' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS run_id, s_suppkey AS k, CASE WHEN s_suppkey % 5 > 0 THEN sha256(s_name) END AS adapter, CASE WHEN s_suppkey % 7 > 0 THEN 'log' END AS log,
    CASE WHEN s_suppkey % 3 = 0 THEN 'gold' ELSE 'teacher' END AS labels, CASE WHEN s_suppkey % 4 = 0 THEN 'torch' ELSE 'mlx' END AS backend FROM supplier)"""


def _runs(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("r"), F.lpad(k.cast("string"), 5, "0")).alias("run_id"), k.alias("k"), F.when(k % 5 > 0, F.sha2("s_name", 256)).alias("adapter"), F.when(k % 7 > 0, "log").alias("log"),
        F.when(k % 3 == 0, "gold").otherwise("teacher").alias("labels"), F.when(k % 4 == 0, "torch").otherwise("mlx").alias("backend"),
    )


@query("discover_candidates", f"WITH {RUNS} SELECT run_id FROM runs WHERE adapter IS NOT NULL AND log IS NOT NULL AND labels = 'teacher' AND backend = 'mlx'")
def discover_candidates(spark, sf_dir):
    return bk.candidates(_runs(spark, sf_dir), "mlx").select("run_id")


@query("provisional_selection", f"WITH {RUNS} SELECT min(run_id) FILTER (labels = 'teacher') AS run_id FROM runs")
def provisional_selection(spark, sf_dir):
    """Nothing was given or chosen yet."""
    r = _runs(spark, sf_dir)
    return bk.selected_run(r, None, r.limit(0).select("run_id", F.col("k").alias("at")))


@query("resolve_run", f"WITH {RUNS} SELECT 'given' AS how, 'r00002' AS run_id UNION ALL SELECT 'chosen', arg_max(run_id, k * 7 % 11) FROM (SELECT * FROM runs WHERE k <= 10) UNION ALL SELECT 'unknown', NULL")
def resolve_run(spark, sf_dir):
    r = _runs(spark, sf_dir)
    chosen = r.filter("k <= 10").select("run_id", (F.col("k") * 7 % 11).alias("at"))
    parts = [bk.selected_run(r, g, chosen).select(F.lit(how).alias("how"), "run_id") for how, g in (("given", "r00002"), ("chosen", None), ("unknown", "r99999"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("resolve_threshold", f"""WITH {RUNS} SELECT run_id, CASE WHEN k = 2 THEN 0.9 WHEN k % 2 = 1 THEN CASE WHEN k % 3 = 0 THEN 'Infinity' ELSE k / 1000.0::DOUBLE END ELSE 0.9 END::DOUBLE AS t,
    CASE WHEN k = 2 OR k % 2 = 0 THEN 'task' ELSE 'run' END AS source, CASE WHEN k % 2 = 0 AND k <> 2 THEN 'of another run' WHEN k % 2 = 1 AND k % 5 > 0 AND k % 7 = 1 THEN 'of another adapter' END AS warning FROM runs""")
def resolve_threshold(spark, sf_dir):
    """The task's threshold was chosen for run 2; odd runs have their own, some of them from before they were trained again."""
    r, k = _runs(spark, sf_dir), F.col("k")
    task = r.filter("k = 2").select("run_id", F.lit(0.9).alias("t"), "adapter")
    own = r.filter("k % 2 = 1").select("run_id", F.when(k % 3 > 0, k / 1000.0).alias("t"), F.when(k % 7 == 1, "old").otherwise(F.col("adapter")).alias("adapter"))
    return bk.resolve_threshold(r, task, own)


@query("invalidate_stale", f"WITH {RUNS} SELECT run_id, kind FROM runs, (VALUES ('eval'), ('threshold')) v(kind) WHERE (adapter IS NULL AND k % 5 = 0 AND k % 10 = 0) OR (k % 5 > 0 AND (kind = 'eval' OR k % 2 > 0))")
def invalidate_stale(spark, sf_dir):
    """Evaluations are of the adapters as they are; thresholds of even runs, and all results of those without an adapter, are older.
    Runs whose key is divisible by 10 are not among the trained ones."""
    r, k = _runs(spark, sf_dir), F.col("k")
    kinds = spark.createDataFrame([("eval",), ("threshold",)], "kind string")
    results = r.join(kinds).select("run_id", "kind", F.when(k % 5 == 0, "old").when((F.col("kind") == "threshold") & (k % 2 == 0), "old").otherwise(F.col("adapter")).alias("adapter"))
    trained = r.filter("k % 10 > 0").select("run_id", F.coalesce("adapter", F.lit("new")).alias("adapter"))
    return bk.invalidate(results, trained).select("run_id", "kind")


@query("adapter_hash", """SELECT p_brand AS folder, sha256(string_agg(sha256(p_name) || ' ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), chr(10) ORDER BY sha256(p_name) || ' ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'))) AS hash FROM part GROUP BY p_brand""")
def adapter_hash(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("path"), F.sha2("p_name", 256).alias("sha256"))
    return bk.files_hash(files, "folder", "path", "sha256")


@query("cache_compatible", "SELECT s_suppkey AS id, s_suppkey % 4 <> 1 AND s_suppkey % 3 <> 2 AS fits FROM supplier")
def cache_compatible(spark, sf_dir):
    """Of four pairs of headers one lacks the alternatives that are wanted; of three, one has other settings."""
    k = F.col("s_suppkey")
    has = lambda yes: F.when(yes, ',"alternatives":true}').otherwise(',"alternatives":false}')
    cached = F.concat(F.lit('{"backend":"b","settings":'), F.when(k % 3 == 2, "2").otherwise("1"), has(k % 4 >= 2))
    wanted = F.concat(F.lit('{"settings":1.0,"backend":"b"'), has((k % 4 == 1) | (k % 4 == 2)))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), bk.header_fits(cached, wanted).alias("fits"))


# Costs.
SAMPLES = "s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'cache' ELSE 'live' END AS source, o_orderkey % 100 / 1e4::DOUBLE AS cost, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 50 END AS p, o_orderkey % 20 AS c FROM orders)"


def _samples(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "cache").otherwise("live").alias("source"), (k % 100 / 1e4).alias("cost"), F.when(k % 7 > 0, k % 50).alias("prompt_tokens"), (k % 20).alias("completion_tokens"),
    )


@query("project_cost", f"""WITH {SAMPLES} SELECT 'live' AS which, count(*) AS n, count(*) FILTER (source = 'live') AS live_n, round(avg(cost) FILTER (source = 'live'), 12) AS mean, round(1000 * avg(cost) FILTER (source = 'live'), 9) AS projected FROM s
UNION ALL SELECT 'cached', count(*), 0, NULL, NULL FROM s WHERE source = 'cache' UNION ALL SELECT 'none left', count(*), 0, NULL, 0 FROM s WHERE source = 'cache' UNION ALL SELECT 'replay', count(*), 0, NULL, 0 FROM s""")
def project_cost(spark, sf_dir):
    s = _samples(spark, sf_dir)
    cases = [("live", s, 1000), ("cached", s.filter("source = 'cache'"), 1000), ("none left", s.filter("source = 'cache'"), 0), ("replay", s.withColumn("source", F.lit("replay")), 1000)]
    out = [bk.project_cost(df, F.lit(n)).select(F.lit(w).alias("which"), "n", "live_n", R("mean", 12).alias("mean"), R("projected").alias("projected")) for w, df, n in cases]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("confirm_spend", "SELECT s_suppkey AS id, s_suppkey % 4 = 0 OR s_suppkey / 10.0 > 0.5 AS confirm FROM supplier")
def confirm_spend(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), bk.must_confirm(F.when(k % 4 > 0, k / 10.0)).alias("confirm"))


@query("project_bakeoff", f"""WITH {SAMPLES}, m AS (SELECT coalesce(sum(cost) FILTER (source = 'live'), 0) AS spent, avg(cost) FILTER (source = 'live') AS mean, avg(p) AS p, avg(c) FILTER (p IS NOT NULL) AS c FROM s),
c AS (SELECT CASE WHEN r_regionkey = 0 THEN mean ELSE p * r_regionkey * 1e-6::DOUBLE + c * 2e-6::DOUBLE + 0.001 END * 10 * r_regionkey AS cost, r_regionkey AS i FROM region, m)
SELECT 'priced' AS which, round(any_value(spent) + sum(cost), 9) AS projected, round(any_value(spent), 9) AS spent, round(any_value(p), 9) AS mean_prompt, round(any_value(m.c), 9) AS mean_completion FROM c, m
UNION ALL SELECT 'unknown', NULL, round(spent, 9), round(p, 9), round(m.c, 9) FROM m""")
def project_bakeoff(spark, sf_dir):
    """Regions stand for candidates; once the last one has no price."""
    i = F.col("r_regionkey")
    plans = table(spark, sf_dir, "region").select(i.alias("place"), (i * 10).alias("calls"), (i * 1e-6).alias("prompt"), F.lit(2e-6).alias("completion"), F.lit(0.001).alias("request"))
    unknown = plans.withColumn("prompt", F.when(F.col("place") < 4, F.col("prompt")))
    out = [bk.project_bakeoff(_samples(spark, sf_dir), p).select(F.lit(w).alias("which"), *[R(c).alias(c) for c in ("projected", "spent", "mean_prompt", "mean_completion")]) for w, p in (("priced", plans), ("unknown", unknown))]
    return out[0].unionByName(out[1])


@query("spend_cap_bound", f"""WITH {LEDGER}, x AS (SELECT id, run_id, coalesce(actual_nusd, 0) AS added, CASE WHEN id % 3 > 0 THEN reserved_nusd END AS worst FROM ledger),
y AS (SELECT id, run_id, worst, coalesce(sum(added) OVER w, 0) AS spent, coalesce(max(added) OVER w, 0) AS largest FROM x WINDOW w AS (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, spent < 3000000000 AND spent + greatest(largest, coalesce(worst, 0)) <= 3000000000 AS fits FROM y)
SELECT id, run_id, id < coalesce((SELECT min(s.id) FROM z s WHERE s.run_id = z.run_id AND NOT s.fits), 9223372036854775807) AS sent FROM z""")
def spend_cap_bound(spark, sf_dir):
    x = ledger(spark, sf_dir).select("id", "run_id", F.coalesce("actual_nusd", F.lit(0)).alias("added"), F.when(F.col("id") % 3 > 0, F.col("reserved_nusd")).alias("worst"))
    return bk.sent_under_cap(x, "run_id", "id", "added", "worst", 3_000_000_000).select("id", "run_id", "sent")


# Extracted fields.
@query("json_value_spans", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 4 THEN 6 + o END AS "start", CASE WHEN o_orderkey % 5 < 4 THEN 6 + o + length(CAST(o_orderkey AS VARCHAR)) END AS "end",
    CASE WHEN o_orderkey % 5 < 4 THEN length(o_orderpriority) + 2 END AS size FROM (SELECT *, CASE o_orderkey % 5 WHEN 1 THEN 8 WHEN 2 THEN 5 ELSE 0 END AS o FROM orders)""")
def json_value_spans(spark, sf_dir):
    """Of field a: start and end; of field s: its size with quotes. Answers are fenced, in prose, or no object."""
    k = F.col("o_orderkey")
    value = F.concat(F.lit('{ "a":'), k.cast("string"), F.lit(' , "s" : "'), F.col("o_orderpriority"), F.lit('"}'))
    said = F.concat(F.when(k % 5 == 1, "```json\n").when(k % 5 == 2, "Yes: ").otherwise(""), F.when(k % 5 == 4, "none").otherwise(value), F.when(k % 5 == 1, "\n```").when(k % 5 == 3, " and {").otherwise(""))
    spans = table(spark, sf_dir, "orders").select(k.alias("id"), bk.json_value_spans(said).alias("v"))
    of = lambda n: F.try_element_at(F.filter("v", lambda s: s["name"] == n), F.lit(1))
    return spans.select("id", of("a")["start"].alias("start"), of("a")["end"].alias("end"), (of("s")["end"] - of("s")["start"]).alias("size"))


CONFIDENCE = """t AS (SELECT l_orderkey AS id, l_linenumber * 7 AS ts, l_linenumber * 7 + CASE WHEN l_linenumber = 3 THEN 0 ELSE 5 END AS te, -l_tax AS lp FROM lineitem),
f AS (SELECT id, v, sum(lp) AS lp FROM t, (VALUES (0, 10), (15, 30)) s(v, e) WHERE CASE WHEN te > ts THEN ts < e AND te > v ELSE ts >= v AND ts < e END GROUP BY ALL),
o AS (SELECT id, sum(lp) AS lp FROM t GROUP BY id)"""


@query("extraction_confidence", f"""WITH {CONFIDENCE} SELECT o.id, round(CASE WHEN o.id % 7 = 0 THEN 0 WHEN o.id % 5 = 0 THEN exp(o.lp) ELSE least(coalesce((SELECT exp(lp) FROM f WHERE f.id = o.id AND v = 0), 1),
    coalesce((SELECT exp(lp) FROM f WHERE f.id = o.id AND v = 15), 1)) END, 9) AS confidence FROM o""")
def extraction_confidence(spark, sf_dir):
    """Order lines stand for tokens; two values have spans. Every seventh answer is not valid, every fifth has no field of the schema."""
    n, k = F.col("l_linenumber"), F.col("id")
    token = F.struct((n * 7).alias("s"), (n * 7 + F.when(n == 3, 0).otherwise(5)).alias("e"), (-F.col("l_tax")).alias("lp"))
    tokens = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(token).alias("t"))
    spans = F.array(*[F.struct(F.lit(x).alias("name"), F.lit(a).alias("start"), F.lit(b).alias("end")) for x, a, b in (("a", 0, 10), ("b", 15, 30))])
    some = F.when(k % 5 == 0, F.filter(spans, lambda s: F.lit(False))).otherwise(spans)
    return tokens.select("id", R(bk.extraction_confidence(some, F.col("t"), ["a", "b"], k % 7 > 0)).alias("confidence"))


@query("resolve_fields", """WITH k AS (SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN ['k', event_type] WHEN 1 THEN [event_type, 'z'] ELSE ['k'] END) AS key, generate_subscripts(CASE event_id % 3 WHEN 0 THEN ['k', event_type] WHEN 1 THEN [event_type, 'z'] ELSE ['k'] END, 1) AS i FROM events),
f AS (SELECT key, min(event_id * 10 + i) AS first FROM k GROUP BY key) SELECT key, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS place FROM f""")
def resolve_fields(spark, sf_dir):
    """Fields of JSON objects in the order in which they first appear."""
    t = F.col("event_type")
    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k":1,"'), t, F.lit('":2}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"'), t, F.lit('":[{"q":1}],"z":null}'))).otherwise('{"k":0}')
    return bk.first_seen_keys(table(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "event_id", "doc")


@query("tune_C", f"""WITH {PREDS}, s AS (SELECT c, round(avg(CASE WHEN coalesce(confidence, 0) >= 1 / (1 + c) THEN (pred = teacher)::INT ELSE (gold = teacher)::INT END), 9) AS agreement FROM preds, (VALUES (0.1), (0.3), (1.0), (3.0), (10.0), (30.0)) v(c) WHERE split = 'valid' GROUP BY c)
SELECT CAST(c AS DOUBLE) AS c, agreement FROM s ORDER BY agreement DESC, c LIMIT 1""")
def tune_c(spark, sf_dir):
    """The strength of a grid whose answers agree most with the teacher on the validation split. The trained grid is that of
    tfidf_lr_baseline; here a strength says from which confidence on the student's answer is taken."""
    grid = spark.createDataFrame([(c,) for c in (0.1, 0.3, 1.0, 3.0, 10.0, 30.0)], "c double")
    p = preds(spark, sf_dir).filter("split = 'valid'").join(F.broadcast(grid))
    own = F.coalesce("confidence", F.lit(0.0)) >= 1 / (1 + F.col("c"))
    agrees = F.when(own, F.col("pred")).otherwise(F.col("gold")) == F.col("teacher")
    return bk.best_c(p.groupBy("c").agg(R(F.avg(agrees.cast("double"))).alias("agreement")))
