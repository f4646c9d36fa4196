"""Queries that write files and read them again: exports, imports, splits, recordings, stored tables and captured streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from gristmill.registry import query
from gristmill.sources import files
from gristmill.sources.shared import shared_dir
from gristmill.sources.views import CAPTURES, IMPORTS, captures, imports, table
from gristmill.streaming import served as st


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


USABLE = "captured AND status = 200 AND response = 'body'"


@query("export_jsonl", f"WITH {CAPTURES} SELECT id, answer, len(messages) AS messages FROM captures WHERE {USABLE}")
def export_jsonl(spark, sf_dir):
    """What the exported, gzipped lines hold."""
    path = _folder(spark, "export")
    c = captures(spark, sf_dir)
    files.export_jsonl(c, path, zipped=True)
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    get = lambda p, kind="string": F.try_variant_get("v", p, kind)
    # The answer's token counts tell the call: they were made from its id.
    lines = lines.select(F.to_json(get("$.request", "variant")).alias("req"), get("$.response.choices[0].message.content").alias("answer"), F.size(get("$.request.messages", "array<variant>")).cast("long").alias("messages"))
    ids = c.filter("captured AND status = 200").select("id", F.to_json(F.parse_json("request_body")).alias("req"), F.get_json_object("response_body", "$.choices[0].message.content").alias("answer"))
    return lines.join(ids.filter("answer IS NOT NULL"), ["req", "answer"]).select("id", "answer", "messages").distinct()


@query("import_jsonl", f"""WITH {IMPORTS} SELECT id, input, CASE WHEN id % 2 = 0 THEN output WHEN output IS NOT NULL THEN '{{"label":"' || output || '"}}' END AS output, gold, '{{"split":"' || split || '"}}' AS meta FROM imports WHERE format = 'pairs'""")
def import_jsonl(spark, sf_dir):
    """Imported pairs, from the lines that another job wrote; ids come back by their lines' numbers in the meta of those lines."""
    path = _folder(spark, "import")
    i = imports(spark, sf_dir).filter("format = 'pairs'")
    meta = F.to_json(F.struct(F.col("id"), "split"))
    line = F.concat(
        F.lit('{"input":'), _json("input"), F.lit(',"output":'), F.when(F.col("id") % 2 == 0, _json("output")).otherwise(F.concat(F.lit('{"label":'), _json("output"), F.lit("}"))),
        F.when(F.col("gold").isNotNull(), F.concat(F.lit(',"gold":'), _json("gold"))).otherwise(""), F.lit(',"meta":'), meta, F.lit("}"),
    )
    i.select(line.alias("value")).write.option("compression", "gzip").text(path)
    got = files.import_jsonl(spark, path, "pairs")
    return got.select(
        F.get_json_object("meta", "$.id").cast("long").alias("id"), "input", "output", F.get_json_object(F.concat(F.lit('{"g":'), "gold", F.lit("}")), "$.g").alias("gold"),
        F.to_json(F.struct(F.get_json_object("meta", "$.split").alias("split"))).alias("meta"),
    )


def _json(column: str):
    """A column's text as a JSON string."""
    return F.substring(F.to_json(F.array(column)), 2, 2**31 - 1).substr(F.lit(1), F.length(F.to_json(F.array(column))) - 2)


@query("sink_append", f"WITH {CAPTURES} SELECT task, count(*) AS n, count(cost_usd) AS priced FROM captures GROUP BY task")
def sink_append(spark, sf_dir):
    """Calls of each task, appended to a table in two jobs."""
    path, c = _folder(spark, "captures"), captures(spark, sf_dir)
    files.append(c.filter("id % 2 = 0"), path)
    files.append(c.filter("id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("task").agg(F.count("*").alias("n"), F.count("cost_usd").alias("priced"))


CURATED = f"{IMPORTS}, c AS (SELECT id, CASE lower(trim(split)) WHEN 'validation' THEN 'valid' WHEN 'dev' THEN 'valid' WHEN 'test' THEN 'test' ELSE 'train' END AS split, sha256(input) AS h, input, gold, output FROM imports)"


def _curated(spark, sf_dir):
    s = F.lower(F.trim("split"))
    split = F.when(s.isin("validation", "dev"), "valid").when(s == "test", "test").otherwise("train")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(message("user", F.col("input")), message("assistant", F.coalesce("output", F.lit(""))))
    i = imports(spark, sf_dir)
    return i.select(split.alias("split"), F.sha2("input", 256).alias("input_hash"), messages.alias("messages"), "gold", F.col("output").alias("teacher"), F.struct("id", "grp").alias("meta"))


CURATED_SCHEMA = "input_hash string, messages array<struct<role:string,content:string>>, gold string, teacher string, meta struct<id:bigint,grp:string>"


@query("curated_sink", f"WITH {CURATED} SELECT split, count(*) AS n, count(DISTINCT h) AS hashes, count(gold) AS golds FROM c GROUP BY split")
def curated_sink(spark, sf_dir):
    """Rows of each split as they are read from its files, all of which have a checksum."""
    path = _folder(spark, "curated")
    sums = files.write_splits(_curated(spark, sf_dir), path)
    rows = spark.read.schema(f"{CURATED_SCHEMA}, split string").json(path)
    rows = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("input_hash").alias("hashes"), F.count("gold").alias("golds"))
    return rows.join(sums.filter(F.length("sha256") == 64).select("split").distinct(), "split", "left_semi")


@query("read_split", f"WITH {CURATED} SELECT id, h AS input_hash, gold, output AS teacher, length(input) AS n_chars FROM c WHERE split = 'valid'")
def read_split(spark, sf_dir):
    path = _folder(spark, "curated")
    files.write_splits(_curated(spark, sf_dir), path)
    rows = files.read_split(spark, path, "valid", CURATED_SCHEMA)
    return rows.select(F.col("meta.id").alias("id"), "input_hash", "gold", "teacher", F.length(F.col("messages")[0]["content"]).cast("long").alias("n_chars"))


MANIFEST = {"schema_version": 1, "task": "orders", "teacher_model": "org/m1", "provider": "p", "teacher_prompt_sha256": "0" * 64, "generation": {"temperature": 0, "max_tokens": 16}, "pricing_snapshot_date": "2024-01-01", "created": 0.0}


@query("recording_read", """SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS key, o_orderpriority AS output, o_orderkey % 30 AS completion_tokens, CASE WHEN o_orderkey % 5 > 0 THEN 'p' END AS provider,
    CAST(o_orderkey % 700 AS DOUBLE) AS latency_ms, (SELECT count(*) FROM orders) AS records FROM orders""")
def recording_read(spark, sf_dir):
    """A recording of one answer per order, written and read with all its checks."""
    path, k = _folder(spark, "recording"), F.col("o_orderkey")
    usage = F.to_json(F.struct((k % 30).alias("completion_tokens")))
    records = table(spark, sf_dir, "orders").select(
        F.sha2(k.cast("string"), 256).alias("key"), F.col("o_orderpriority").alias("output"), usage.alias("usage"), (k % 700).cast("double").alias("latency_ms"),
        F.when(k % 5 > 0, "p").alias("provider"), F.lit("stop").alias("finish_reason"), F.lit(0.0).alias("timestamp"),
    )
    files.write_recording(records, MANIFEST, path)
    manifest, rows = files.read_recording(spark, path)
    return rows.select("key", "output", F.get_json_object("usage", "$.completion_tokens").cast("long").alias("completion_tokens"), "provider", "latency_ms", F.lit(manifest["records"]).cast("long").alias("records"))


@query("check_manifest", """SELECT * FROM (VALUES (0, NULL), (1, 'task'), (2, 'generation.max_tokens'), (3, 'generation.temperature'), (4, 'teacher_model'), (5, NULL)) v(id, difference)""")
def check_manifest(spark, sf_dir):
    """The first difference of some manifests and the one of the recording; the last differs in a field that is not compared."""
    generation = MANIFEST["generation"]
    changes = [
        {}, {"task": "t", "provider": "x"}, {"generation": {**generation, "max_tokens": 8, "a": 1}}, {"generation": {"a": 1, "max_tokens": 8}}, {"teacher_model": None, "generation": {}}, {"created": 1.0},
    ]
    rows = [(i, files.manifest_difference(json.loads(json.dumps({**MANIFEST, **c})), MANIFEST)) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "id int, difference string")


@query("parse_csv", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(13), '') ELSE 'a \"quoted\" text, ' || chr(10) || lang END AS text, source AS category FROM documents WHERE length(text) > 0")
def parse_csv(spark, sf_dir):
    """Text and category from CSV files with quotes, commas and line breaks in their fields."""
    path = _folder(spark, "csv")
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\r"), F.lit(""))).otherwise(F.concat(F.lit('a "quoted" text, \n'), "lang"))
    d = table(spark, sf_dir, "documents").filter("length(text) > 0").select("doc_id", text.alias("text"), F.col("source").alias("category"))
    d.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return spark.read.schema(d.schema).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)


@query("test_access_count", "SELECT o_custkey % 20 AS run_id, count(*) AS accesses, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def test_access_count(spark, sf_dir):
    """Entries of a log of looks at the test split, to which jobs append, per run."""
    path, o = _folder(spark, "access"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    log = o.select((F.col("o_custkey") % 20).alias("run_id"), F.col("o_orderkey").alias("entry"))
    for half in range(2):
        files.append(log.filter(F.col("entry") % 2 == half), path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("accesses"), F.min("entry").alias("first"))


@query("capture_stream", f"WITH {CAPTURES} SELECT id, task, status, captured AND id % 4 > 0 AS captured FROM captures")
def capture_stream(spark, sf_dir):
    """Calls that arrive as files become rows of a table; those that were streamed are logged as not captured."""
    path = _folder(spark, "arriving")
    c = captures(spark, sf_dir).select("id", "task", "status", "captured", F.to_json(F.struct((F.col("id") % 4 == 0).alias("stream"))).alias("request"))
    c.write.json(path)
    stream = spark.readStream.schema(c.schema).json(path)
    streamed = F.coalesce(F.get_json_object("request", "$.stream") == "true", F.lit(False))
    return st.run_to_end(stream.select("id", "task", "status", (F.col("captured") & ~streamed).alias("captured")))


@query("synthetic_invoices")
def synthetic_invoices(spark, sf_dir):
    """One invoice per customer."""
    return files.invoices(spark, table(spark, sf_dir, "customer").count())
