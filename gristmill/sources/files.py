"""Files of logged calls: JSON lines with line numbers, exports, curated splits and recordings. Checks come before anything is
written, and a write is one job, so it is there as a whole or not at all."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.calls import completion_problem

#: Fields of a line of each format.
FORMATS = {"openai": ("request", "response"), "pairs": ("input", "output", "gold", "meta"), "inputs": ("input", "gold", "meta")}
# Fields of a recording's records, of its manifest's generation settings, and those that are compared.
RECORD_FIELDS = ("key", "output", "usage", "latency_ms", "provider", "finish_reason", "timestamp")
GENERATION_FIELDS = ("temperature", "max_tokens", "response_format", "extra_body")
COMPARED_FIELDS = ("schema_version", "task", "teacher_model", "provider", "teacher_prompt_sha256", "generation")
MANIFEST_FIELDS = ("type", "schema_version", "task", "teacher_model", "provider", "teacher_prompt_sha256", "generation", "pricing_snapshot_date", "created", "records")
#: Blocks of files whose offsets are broadcast, at most; beyond, they are joined by a shuffle.
BROADCAST_BLOCKS = 100_000


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path (a file, a folder, or a pattern), by name; those that begin with a dot or a _ are left out."""
    _, at, fs = _filesystem(spark, path)
    found = []
    for s in fs.globStatus(at) or []:
        inside = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [x.getPath() for x in inside if not x.isDirectory() and x.getPath().getName()[0] not in "._"]
    return sorted(p.toString() for p in found)


def is_gzip(spark: SparkSession, file: str) -> bool:
    """Whether a file begins as gzip does, whatever its name."""
    _, at, fs = _filesystem(spark, file)
    stream = fs.open(at)
    try:
        return (stream.read(), stream.read()) == (0x1F, 0x8B)
    finally:
        stream.close()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): all lines, numbered from 1 in their file. A large file is read in blocks by many tasks; a line's number is
    that of the lines in earlier blocks and its place in its own. Gzip files go by their first bytes: one whose name does not
    end in .gz is unpacked in one task, in memory. A byte order mark before the first line is taken off."""
    files = list_files(spark, path)
    if not files:
        raise FileNotFoundError(path)
    odd = [f for f in files if not f.endswith(".gz") and is_gzip(spark, f)]
    plain = [f for f in files if f not in set(odd)]
    parts = []
    if plain:
        raw = spark.read.text(plain).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("text"),
        )
        blocks = raw.groupBy("file", "block").agg(F.min("m").alias("first"), F.count("*").alias("n")).collect()  # a row per 128 MB
        upto: dict[str, int] = {}
        offsets = []
        for r in sorted(blocks, key=lambda r: (r["file"], r["block"])):
            offsets.append((r["file"], r["block"], upto.get(r["file"], 0) + 1 - r["first"]))
            upto[r["file"]] = upto.get(r["file"], 0) + r["n"]
        table = spark.createDataFrame(offsets, "file string, block long, offset long")
        table = F.broadcast(table) if len(offsets) <= BROADCAST_BLOCKS else table
        parts.append(raw.join(table, ["file", "block"]).select("file", (F.col("m") + F.col("offset")).alias("line"), "text"))
    if odd:

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    lines = gzip.decompress(content).decode("utf-8", "replace").split("\n")
                    lines = lines[:-1] if not lines[-1] else lines
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(lines), pa.string()), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(lines, pa.string())], names=["file", "line", "text"]
                    )

        binary = spark.read.format("binaryFile").load(odd).select("path", "content")
        parts.append(binary.mapInArrow(unpack, "file string, line long, text string"))
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    text = F.when(F.col("line") == 1, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))
    return lines.select("file", "line", F.regexp_replace(text, "\r$", "").alias("text"))


def line_problem(text: Column, kind: str) -> Column:
    """Why a line is no row of the format, the first reason, or null."""
    v = F.try_parse_json(text)
    kind_of = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    absent = lambda name: F.coalesce(kind_of(name) == "VOID", F.lit(True))
    unknown = F.array_except(F.json_object_keys(text), F.array(*map(F.lit, FORMATS[kind])))
    out = F.when(v.isNull(), "not JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not a JSON object")
    out = out.when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_min(unknown)))
    if kind == "openai":
        part = lambda name: F.to_json(F.try_variant_get(v, f"$.{name}", "variant"))
        return out.otherwise(completion_problem(part("request"), part("response")))
    out = out.when(kind_of("input") != "STRING", "input is no text").when(absent("input"), "input is no text")
    if kind == "pairs":
        is_answer = F.coalesce((kind_of("output") == "STRING") | kind_of("output").startswith("OBJECT"), F.lit(False))
        out = out.when(~is_answer, "output is neither text nor an object")
    return out.when(~absent("meta") & ~kind_of("meta").startswith("OBJECT"), "meta is no object")


def import_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of JSON lines files: file, line, and the format's fields (as JSON text, but input and an output that is text). Blank lines
    are passed over. A line that is no row is an error that names the first such line, before any row is returned."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}, expected one of {', '.join(FORMATS)}")
    lines = numbered_lines(spark, path).filter(F.trim(F.col("text")) != "")
    bad = lines.select("file", "line", line_problem(F.col("text"), kind).alias("why")).filter("why IS NOT NULL")
    if first := bad.orderBy("file", "line").limit(1).collect():
        r = first[0]
        raise ValueError(f"{r['file'].rsplit('/', 1)[-1]}:{r['line']}: {r['why']}")
    v = F.try_parse_json("text")

    def field(name: str) -> Column:
        part = F.try_variant_get(v, f"$.{name}", "variant")
        said = F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(part, "$", "string"))
        kept = F.when(~F.coalesce(F.is_variant_null(part), F.lit(True)), F.to_json(part))
        return (F.coalesce(said, kept) if name in ("input", "output") else kept).alias(name)

    return lines.select("file", "line", *[field(n) for n in FORMATS[kind]])


def export_jsonl(captures: DataFrame, path: str, zipped: bool = False) -> int:
    """Writes the usable calls among captures (captured, status, request_body, response_body) as lines {"request", "response"}, and
    returns how many there are."""
    usable = captures.filter(F.col("captured") & (F.col("status") == 200)).filter(completion_problem(F.col("request_body"), F.col("response_body")).isNull())
    pair = F.struct(F.parse_json("request_body").alias("request"), F.parse_json("response_body").alias("response"))
    usable.select(F.to_json(pair).alias("value")).write.mode("overwrite").option("compression", "gzip" if zipped else "none").text(path)
    return captures.sparkSession.read.text(path).count()


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table, in one job."""
    rows.write.mode("append").parquet(path)


def write_splits(curated: DataFrame, path: str) -> DataFrame:
    """Writes curated (split, input_hash, messages, gold, teacher, meta) as JSON lines by split, and returns (split, file, sha256)."""
    curated.repartition("split", F.substring("input_hash", 1, 1)).sortWithinPartitions("split", "input_hash").write.mode("overwrite").partitionBy("split").json(path)
    return checksums(curated.sparkSession, f"{path}/split=*").withColumn("split", F.regexp_extract("file", "split=([^/]*)/", 1))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of the files of a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def read_split(spark: SparkSession, path: str, split: str, schema: str) -> DataFrame:
    """The rows of a split, whose folder alone is read."""
    return spark.read.schema(f"{schema}, split string").json(path).filter(F.col("split") == split)


def write_recording(records: DataFrame, manifest: dict, path: str) -> None:
    """records (RECORD_FIELDS; usage as JSON text) as gzip JSON lines in the order of their keys, a manifest first. Two records of
    one key are an error."""
    twice = records.groupBy("key").count().filter("count > 1").orderBy("key").limit(1).collect()
    if twice:
        raise ValueError(f"two records of the key {twice[0]['key']}")
    spark = records.sparkSession
    head = json.dumps({**manifest, "type": "manifest", "records": records.count()}, sort_keys=True)
    fields = [F.parse_json("usage").alias("usage") if f == "usage" else F.col(f) for f in RECORD_FIELDS]
    body = records.select(F.col("key").alias("__key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    lines = spark.createDataFrame([("", head)], "__key string, value string").unionByName(body)
    lines = lines.repartitionByRange("__key").sortWithinPartitions("__key")
    lines.select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def read_recording(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The manifest and the records of a recording. ValueError if it does not begin with a manifest of known fields, if a record has
    other fields or a key twice, or if their number is not that of the manifest."""
    lines = numbered_lines(spark, path)
    first = lines.orderBy("file", "line").limit(1).collect()
    manifest = json.loads(first[0]["text"]) if first else None
    if not isinstance(manifest, dict) or manifest.get("type") != "manifest":
        raise ValueError("a recording begins with its manifest")
    if unknown := sorted(set(manifest) - set(MANIFEST_FIELDS)):
        raise ValueError(f"unknown field of the manifest: {unknown[0]}")
    body = lines.filter((F.col("file") != first[0]["file"]) | (F.col("line") != first[0]["line"]))
    body = body.withColumn("keys", F.json_object_keys("text"))
    want = F.array(*map(F.lit, RECORD_FIELDS))
    odd = F.coalesce((F.size(F.array_except("keys", want)) > 0) | (F.size(F.array_except(want, F.col("keys"))) > 0), F.lit(True))
    rows = body.select("text", odd.alias("odd"), F.get_json_object("text", "$.key").alias("key"))
    checks = rows.agg(F.count("*").alias("n"), F.count_if("odd").alias("odd")).first()
    if checks["odd"]:
        raise ValueError(f"{checks['odd']} records have other fields than a record has")
    if twice := rows.groupBy("key").count().filter("count > 1").orderBy("key").limit(1).collect():
        raise ValueError(f"two records of the key {twice[0]['key']}")
    if checks["n"] != manifest.get("records"):
        raise ValueError(f"{checks['n']} records, but the manifest says {manifest.get('records')}")
    schema = "key string, output string, usage string, latency_ms double, provider string, finish_reason string, timestamp double"
    return manifest, body.select(F.from_json("text", schema).alias("r")).select("r.*")


def manifest_difference(recorded: dict, expected: dict) -> str | None:
    """The path of the first compared field in which two manifests differ, the settings of generation in their own order before
    other fields; null if they agree."""

    rank = lambda k: (GENERATION_FIELDS.index(k) if k in GENERATION_FIELDS else len(GENERATION_FIELDS), k)
    missing = object()
    todo = [(f, recorded.get(f, missing), expected.get(f, missing)) for f in reversed(COMPARED_FIELDS)]
    while todo:
        path, one, two = todo.pop()
        if isinstance(one, dict) and isinstance(two, dict):
            todo += [(f"{path}.{k}", one.get(k, missing), two.get(k, missing)) for k in sorted({*one, *two}, key=rank, reverse=True)]
        elif one is not two and (one != two or isinstance(one, bool) != isinstance(two, bool)):
            return path
    return None


def invoices(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """n synthetic invoices in 30 templates (6 layouts in 5 languages): id, template, split, input, gold (JSON), traits. Every choice
    is a hash of the seed, the id and the field, so rows are made in any number of tasks and are the same in each run. Templates
    are dealt to splits whole."""
    words = [  # invoice, date, due, total, tax, order
        ("Invoice", "Date", "Due", "Total", "VAT", "PO"), ("Rechnung", "Datum", "Fällig", "Summe", "MwSt", "Bestellung"), ("Facture", "Date", "Échéance", "Total", "TVA", "Commande"),
        ("Factura", "Fecha", "Vence", "Total", "IVA", "Pedido"), ("Faktura", "Data", "Termin", "Razem", "VAT", "Zamówienie"),
    ]
    layouts = [
        "{v}\n{0} {n}\n{1}: {d}\n{2}: {u}\n{5}: {p}\n{4} {x}\n{3} {t} {c}", "{0} no. {n} | {1} {d}\n{v}\n\n{3}: {t} {c} ({4} {x})\n{2} {u}\n{5} {p}", "{v} - {0}\n#{n}\n{d} / {u}\n{5} {p}\n\n{3} {c} {t}\n{4} {c} {x}",
        "{1} {d}\n{0} {n}\n\n{v}\n{4}: {x}\n{3}: {t} {c}\n{2}: {u} {5}: {p}", "{0}\n{v}\n{n}\n{1}={d};{2}={u};{5}={p};{4}={x};{3}={t} {c}", "{v}\n=====\n{3} {t} {c}\n{4} {x}\n{0} {n}, {1} {d}, {2} {u}, {5} {p}",
    ]
    pick = lambda field, m: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(field)), F.lit(m))
    some = lambda field, values: F.element_at(F.array(*map(F.lit, values)), (pick(field, len(values)) + 1).cast("int"))
    df = spark.range(n).withColumn("template", (F.col("id") % 30).cast("int"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), pick("day", 700).cast("int"))
    cents = pick("total", 900_000) + 1000
    money = lambda c: (c / 100).cast("decimal(12,2)")
    df = df.withColumns({
        "vendor_name": F.concat_ws(" ", some("v1", ("Brask", "Lumen", "Orto", "Vela", "Nord", "Kessel")), some("v2", ("Works", "Supply", "Labs", "Trading")), some("v3", ("GmbH", "Ltd", "SA", "BV"))),
        "invoice_number": F.format_string("INV-%04d-%05d", F.year(day), pick("number", 100_000)), "invoice_date": day.cast("string"),
        "due_date": F.when(pick("due", 10) > 0, F.date_add(day, 14 + 7 * pick("term", 4).cast("int")).cast("string")), "currency": some("currency", ("EUR", "USD", "GBP", "CHF", "PLN")),
        "total_amount": money(cents).cast("double"), "tax_amount": F.when(pick("tax", 8) > 0, money(F.floor(cents * 0.19 / 1.19)).cast("double")),
        "po_number": F.when(pick("po", 3) > 0, F.format_string("PO-%05d", pick("order", 100_000))),
    })
    fields = ("vendor_name", "invoice_number", "invoice_date", "due_date", "currency", "total_amount", "tax_amount", "po_number")
    text = F.element_at(F.array(*[F.lit(layout) for layout in layouts]), (F.col("template") % 6 + 1).cast("int"))
    for i in range(6):
        name = F.element_at(F.array(*[F.lit(w[i]) for w in words]), (F.floor(F.col("template") / 6) + 1).cast("int"))
        text = F.replace(text, F.lit(f"{{{i}}}"), name)
    amount = lambda c: F.format_string("%.2f", c)
    for mark, value in (("v", "vendor_name"), ("n", "invoice_number"), ("d", "invoice_date"), ("u", "due_date"), ("c", "currency"), ("p", "po_number")):
        text = F.replace(text, F.lit(f"{{{mark}}}"), F.coalesce(F.col(value), F.lit("-")))
    text = F.replace(F.replace(text, F.lit("{t}"), amount(F.col("total_amount"))), F.lit("{x}"), F.when(F.col("tax_amount").isNull(), "-").otherwise(amount(F.col("tax_amount"))))
    traits = F.array_compact(F.array(F.when(F.col("due_date").isNull(), "no_due_date"), F.when(F.col("tax_amount").isNull(), "no_tax"), F.when(F.col("po_number").isNull(), "no_po")))
    split = F.when(F.col("template") % 5 == 0, "test").when(F.col("template") % 5 == 1, "valid").otherwise("train")
    return df.select("id", "template", split.alias("split"), text.alias("input"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("gold"), traits.alias("traits"))
