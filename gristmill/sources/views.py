"""The driver's tables as the tables the engine works on: logged calls, imported rows, predictions, served
requests and ledger entries. Each view has the SQL of the same rows for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a student beside a teacher's labels and gold labels: (id, grp, traits, gold, teacher, pred,
    confidence, alt_confidence, latency_ms, split)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    x = d.join(table(spark, sf_dir, "labels"), "doc_id")
    id_, q = F.col("doc_id"), F.col("quality")
    text = lambda c: c.cast("string")
    return x.select(
        id_.alias("id"),
        F.when(id_ % 31 == 0, None).otherwise(F.col("lang")).alias("grp"),
        F.when(id_ % 4 == 0, F.array().cast("array<string>"))
        .when(id_ % 4 == 1, F.array("lang"))
        .when(id_ % 4 == 2, F.array("lang", "source"))
        .otherwise(F.array("source", "lang", "source"))
        .alias("traits"),
        text(q).alias("gold"),
        F.when(id_ % 7 == 0, text(1 - q)).otherwise(text(q)).alias("teacher"),
        F.when((id_ % 11).isin(0, 1), text(1 - q)).otherwise(text(q)).alias("pred"),
        F.when(id_ % 50 == 0, None).otherwise(((id_ * 7919) % 97).cast("double") / 97).alias("confidence"),
        (((id_ * 104729) % 89).cast("double") / 89).alias("alt_confidence"),
        F.when(id_ % 23 == 0, None).otherwise(((id_ * 31) % 700).cast("double")).alias("latency_ms"),
        F.when(id_ % 10 < 6, "train").when(id_ % 10 < 8, "valid").otherwise("test").alias("split"),
    )


PREDS = """preds AS (
    SELECT d.doc_id AS id, CASE WHEN d.doc_id % 31 = 0 THEN NULL ELSE d.lang END AS grp,
           CASE d.doc_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [d.lang] WHEN 2 THEN [d.lang, d.source]
                ELSE [d.source, d.lang, d.source] END AS traits,
           CAST(quality AS VARCHAR) AS gold,
           CAST(CASE WHEN d.doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS VARCHAR) AS teacher,
           CAST(CASE WHEN d.doc_id % 11 IN (0, 1) THEN 1 - quality ELSE quality END AS VARCHAR) AS pred,
           CASE WHEN d.doc_id % 50 = 0 THEN NULL ELSE CAST((d.doc_id * 7919) % 97 AS DOUBLE) / 97 END AS confidence,
           CAST((d.doc_id * 104729) % 89 AS DOUBLE) / 89 AS alt_confidence,
           CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE CAST((d.doc_id * 31) % 700 AS DOUBLE) END AS latency_ms,
           CASE WHEN d.doc_id % 10 < 6 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'valid' ELSE 'test' END AS split
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of served requests: (id, ts, user_id, route, reason, confidence, student_ms, teacher_ms, total_ms,
    teacher_cost_usd, status)."""
    e = table(spark, sf_dir, "events")
    id_ = F.col("event_id")
    route = (
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "teacher")
        .when(F.col("event_type") == "signup", "student-fallback").otherwise("student")
    )
    e = e.withColumn("route", route)
    reason = F.when(F.col("route") != "student", F.element_at(F.array(*map(F.lit, ("low_confidence", "unsupported", "input_unparsed"))), (id_ % 3 + 1).cast("int")))
    return e.select(
        id_.alias("id"), "ts", "user_id", "route", reason.alias("reason"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
        (F.col("value") / 2).alias("student_ms"),
        F.when(F.col("route") == "teacher", F.col("value") / 2).alias("teacher_ms"),
        F.col("value").alias("total_ms"),
        F.when(F.col("route") == "teacher", (id_ % 100).cast("double") / 100000).alias("teacher_cost_usd"),
        F.when(F.col("route") == "error", 502).otherwise(200).alias("status"),
    )


SERVED = """served AS (
    SELECT event_id AS id, ts, user_id, route,
           CASE WHEN route <> 'student' THEN ['low_confidence', 'unsupported', 'input_unparsed'][CAST(event_id % 3 + 1 AS INTEGER)] END AS reason,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence, value / 2 AS student_ms,
           CASE WHEN route = 'teacher' THEN value / 2 END AS teacher_ms, value AS total_ms,
           CASE WHEN route = 'teacher' THEN CAST(event_id % 100 AS DOUBLE) / 100000 END AS teacher_cost_usd,
           CASE WHEN route = 'error' THEN 502 ELSE 200 END AS status
    FROM (SELECT *, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'teacher'
                    WHEN 'signup' THEN 'student-fallback' ELSE 'student' END AS route FROM events)
)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend entries in nano-dollars: (id, ts, task, phase, run_id, model, reserved_nusd, actual_nusd, status)."""
    o = table(spark, sf_dir, "orders")
    id_ = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "open").otherwise("released")
    reserved = F.floor(F.col("o_totalprice") * 1000).cast("long")
    return o.select(
        id_.alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("task"),
        F.element_at(F.array(*map(F.lit, ("label", "bakeoff", "eval", "serve"))), (id_ % 4 + 1).cast("int")).alias("phase"),
        (F.col("o_custkey") % 20).alias("run_id"), F.concat(F.lit("model-"), (id_ % 3).cast("string")).alias("model"),
        reserved.alias("reserved_nusd"), F.when(status == "settled", reserved - id_ % 1000).alias("actual_nusd"),
        status.alias("status"),
    )


LEDGER = """ledger AS (
    SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS task,
           ['label', 'bakeoff', 'eval', 'serve'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS phase, o_custkey % 20 AS run_id,
           'model-' || CAST(o_orderkey % 3 AS VARCHAR) AS model, CAST(floor(o_totalprice * 1000) AS BIGINT) AS reserved_nusd,
           CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice * 1000) AS BIGINT) - o_orderkey % 1000 END AS actual_nusd,
           CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'O' THEN 'open' ELSE 'released' END AS status
    FROM orders
)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged calls, one per conversation: the request is what precedes the last assistant turn, the answer that turn."""
    c = table(spark, sf_dir, "conversations")
    last = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("text", "turn").alias("answer"))
    before = c.join(last, "conv_id").filter(F.col("turn") < F.col("last"))
    messages = F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
        lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")),
    )
    x = before.groupBy("conv_id").agg(messages.alias("messages"), F.first("answer").alias("answer"))
    id_ = F.col("conv_id")
    model = F.concat(F.lit("model-"), (id_ % 3).cast("string"))
    request = F.to_json(F.struct(model.alias("model"), F.col("messages"), F.lit(0).alias("temperature")))
    response = F.to_json(
        F.struct(
            F.array(F.struct(F.struct(F.col("answer").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"),
            F.struct((id_ % 50 + 10).alias("prompt_tokens"), (id_ % 30 + 1).alias("completion_tokens")).alias("usage"),
        )
    )
    return x.select(
        id_.alias("id"), F.concat(F.lit("task"), (id_ % 3).cast("string")).alias("task"),
        F.timestamp_seconds(F.lit(1704067200) + id_ * 60).alias("ts"),
        F.when(id_ % 5 == 0, "import").otherwise("proxy").alias("source"),
        request.alias("request_body"),
        F.when(id_ % 13 == 0, None).when(id_ % 17 == 0, "").otherwise(response).alias("response_body"),
        F.when(id_ % 11 == 0, 500).otherwise(200).alias("status"), ((id_ * 37) % 1000).cast("double").alias("latency_ms"),
        F.when(id_ % 7 == 0, None).otherwise(id_ % 50 + 10).alias("prompt_tokens"), (id_ % 30 + 1).alias("completion_tokens"),
        F.when(id_ % 7 == 0, None).otherwise((id_ % 10).cast("double") / 1000).alias("cost_usd"), model.alias("upstream_model"),
        (id_ % 9 != 0).alias("captured"),
    )


CAPTURES = """last_turn AS (
    SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), captures AS (
    SELECT c.conv_id AS id, 'task' || CAST(c.conv_id % 3 AS VARCHAR) AS task,
           CAST(make_timestamp(1704067200000000 + c.conv_id * 60000000) AS TIMESTAMP) AS ts,
           CASE WHEN c.conv_id % 5 = 0 THEN 'import' ELSE 'proxy' END AS source,
           list({'role': role, 'content': text} ORDER BY turn) AS messages, any_value(answer) AS answer,
           CASE WHEN c.conv_id % 13 = 0 THEN 'null' WHEN c.conv_id % 17 = 0 THEN 'empty' ELSE 'body' END AS response,
           CASE WHEN c.conv_id % 11 = 0 THEN 500 ELSE 200 END AS status, CAST((c.conv_id * 37) % 1000 AS DOUBLE) AS latency_ms,
           CASE WHEN c.conv_id % 7 = 0 THEN NULL ELSE c.conv_id % 50 + 10 END AS prompt_tokens, c.conv_id % 30 + 1 AS completion_tokens,
           CASE WHEN c.conv_id % 7 = 0 THEN NULL ELSE CAST(c.conv_id % 10 AS DOUBLE) / 1000 END AS cost_usd,
           'model-' || CAST(c.conv_id % 3 AS VARCHAR) AS upstream_model, c.conv_id % 9 <> 0 AS captured
    FROM conversations c JOIN last_turn l ON c.conv_id = l.conv_id AND c.turn < l.last GROUP BY c.conv_id
)"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported rows, one per document: (id, format, input, output, gold, split, grp, source)."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    id_, q = F.col("doc_id"), F.col("quality")
    split = F.element_at(F.array(*map(F.lit, ("train", "validation", "test", "dev", " Train ", ""))), (id_ % 6 + 1).cast("int"))
    return d.select(
        id_.alias("id"), F.when(id_ % 3 == 0, "inputs").otherwise("pairs").alias("format"), F.col("text").alias("input"),
        F.when(id_ % 3 == 0, None).otherwise(F.coalesce(F.when(id_ % 7 == 0, 1 - q).otherwise(q), id_ % 2).cast("string")).alias("output"),
        q.cast("string").alias("gold"), split.alias("split"), F.col("lang").alias("grp"), "source",
    )


IMPORTS = """imports AS (
    SELECT d.doc_id AS id, CASE WHEN d.doc_id % 3 = 0 THEN 'inputs' ELSE 'pairs' END AS format, d.text AS input,
           CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE CAST(coalesce(CASE WHEN d.doc_id % 7 = 0 THEN 1 - quality ELSE quality END, d.doc_id % 2) AS VARCHAR) END AS output,
           CAST(quality AS VARCHAR) AS gold,
           ['train', 'validation', 'test', 'dev', ' Train ', ''][CAST(d.doc_id % 6 + 1 AS INTEGER)] AS split, d.lang AS grp, d.source
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
