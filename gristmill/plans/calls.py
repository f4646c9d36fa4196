"""Queries over requests and answers: bounds, costs, features, problems and prices. Orders stand for requests, suppliers for models;
every branch of an operator occurs among their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import calls
from gristmill.registry import query
from gristmill.sources.views import table

R = lambda c, n=12: F.round(c, n)


def _by(key, n: int, texts: dict[int, object]):
    """The text of key % n, empty where there is none."""
    out = F.lit("")
    for k, text in texts.items():
        out = F.when(key % n == k, text if not isinstance(text, str) else F.lit(text)).otherwise(out)
    return out


def requests(spark, sf_dir) -> DataFrame:
    """(id, text, body, usage, response, reason, v): v is the body as a variant."""
    k, said = F.col("o_orderkey"), F.col("o_orderpriority")
    parts = F.concat(F.lit('[{"type":"text","text":"'), said, F.lit('"},{"type":"text","text":"!"}]'))
    image = F.concat(F.lit('[{"type":"image_url","image_url":{"url":"u"}},{"type":"text","text":"'), said, F.lit('"}]'))
    content = F.when(k % 4 == 1, parts).when(k % 4 == 2, image).otherwise(F.concat(F.lit('"'), said, F.lit('"')))
    messages = F.when(k % 13 == 0, "[]").otherwise(F.concat(F.lit('[{"role":"system","content":"Answer."},{"role":"user","content":'), content, F.lit("}]")))
    more = [
        _by(k, 3, {1: F.concat(F.lit(',"max_tokens":'), (k % 5).cast("string")), 2: ',"max_completion_tokens":7'}),
        _by(k, 5, {0: ',"n":2', 1: ',"n":1', 2: ',"n":null'}),
        _by(k, 7, {3: ',"tools":[{"b":1,"a":"x"}]', 4: ',"tools":[]', 5: ',"tool_choice":"auto"'}),
        _by(k, 11, {0: ',"logprobs":true', 1: ',"logprobs":false', 2: ',"top_logprobs":3'}),
    ]
    body = F.concat(F.lit('{"model":"org/m'), (k % 8 + 1).cast("string"), F.lit('","messages":'), messages, *more, F.lit("}"))
    usage = _by(k, 6, {
        0: '{"cost":0.25}', 1: '{"cost":-1,"prompt_tokens":10,"completion_tokens":5}', 2: '{"prompt_tokens":10}', 3: "{}",
        4: '{"cost":"0.5","completion_tokens":4}', 5: '{"cost":0}',
    })
    response = _by(k, 9, {
        0: F.lit(None).cast("string"), 1: "[]", 2: '{"error":{"code":1},"choices":[{}]}', 3: '{"choices":[]}', 4: '{"choices":[1]}',
        5: '{"choices":[{"finish_reason":"error"}]}', 6: '{"choices":[{"error":"x"}]}', 7: '{"choices":[{"message":{"content":"\\ud800"}}]}',
        8: '{"error":null,"choices":[{"message":{"content":"\\ud83d\\ude00 ok"}}]}',
    })
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), said.alias("text"), F.when(k % 10 == 9, "null").otherwise(body).alias("body"), F.try_parse_json(body).alias("v"),
        F.try_parse_json(usage).alias("usage"), response.alias("response"), F.when(k % 17 == 0, "length").otherwise("stop").alias("reason"),
    )


BODY = """r AS (SELECT o_orderkey AS id, o_orderpriority AS text, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 39 + length(o_orderpriority) + (o_orderkey % 4 = 1)::INT END
    + CASE o_orderkey % 7 WHEN 3 THEN 17 WHEN 4 THEN 2 ELSE 0 END AS prompt, CASE o_orderkey % 3 WHEN 1 THEN nullif(o_orderkey % 5, 0) WHEN 2 THEN 7 END AS lim,
    CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS n, CASE o_orderkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 0 END AS most FROM orders)"""


def _most():
    return F.when(F.col("id") % 4 == 0, 1000).when(F.col("id") % 4 == 1, 0).cast("long")


@query("extract_input", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 4 = 2 THEN NULL ELSE o_orderpriority || CASE WHEN o_orderkey % 4 = 1 THEN '!' ELSE '' END END AS input FROM orders")
def extract_input(spark, sf_dir):
    return requests(spark, sf_dir).select("id", calls.last_input(F.col("v")).alias("input"))


@query("request_prompt_bound", f"WITH {BODY} SELECT id, CAST(prompt AS BIGINT) AS bound FROM r")
def request_prompt_bound(spark, sf_dir):
    return requests(spark, sf_dir).select("id", calls.prompt_upper_bound(F.col("v")).alias("bound"))


@query("completion_upper_bound", f"WITH {BODY} SELECT id, CAST(coalesce(lim, nullif(most, 0), 4096) * n AS BIGINT) AS bound FROM r")
def completion_upper_bound(spark, sf_dir):
    return requests(spark, sf_dir).select("id", calls.completion_upper_bound(F.col("v"), _most()).alias("bound"))


COST = "prompt * 1e-6::DOUBLE + coalesce(lim, nullif(most, 0), 4096) * n * 2e-6::DOUBLE + 0.001::DOUBLE"


def _price():
    return [F.lit(x) for x in (1e-6, 2e-6, 0.001)]


@query("worst_case_cost", f"WITH {BODY} SELECT id, round({COST}, 12) AS usd, CAST(ceil(({COST}) * 1e9 - 1e-6) AS BIGINT) AS nusd FROM r")
def worst_case_cost(spark, sf_dir):
    cost = calls.worst_case_cost(F.col("v"), *_price(), _most())
    return requests(spark, sf_dir).select("id", R(cost).alias("usd"), calls.nano(cost, up=True).alias("nusd"))


@query("reservation_cost", f"WITH {BODY} SELECT id, CASE WHEN lim IS NOT NULL OR most > 0 THEN round({COST}, 12) END AS usd FROM r")
def reservation_cost(spark, sf_dir):
    """Null: the request is refused, as nothing bounds its answer."""
    return requests(spark, sf_dir).select("id", R(calls.reservation_cost(F.col("v"), *_price(), _most())).alias("usd"))


@query("usage_cost", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 0.25 WHEN 1 THEN 0.00102 WHEN 2 THEN 0.00101 WHEN 4 THEN 0.001008 WHEN 5 THEN 0 END::DOUBLE AS cost FROM orders""")
def usage_cost(spark, sf_dir):
    return requests(spark, sf_dir).select("id", R(calls.usage_cost(F.col("usage"), *_price())).alias("cost"))


@query("is_truncated", f"WITH {BODY} SELECT id, id % 17 = 0 OR coalesce(CASE id % 6 WHEN 1 THEN 5 WHEN 4 THEN 4 END > lim * n, false) AS truncated FROM r")
def is_truncated(spark, sf_dir):
    return requests(spark, sf_dir).select("id", calls.is_truncated(F.col("v"), F.col("usage"), F.col("reason")).alias("truncated"))


@query("unsupported_feature", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 3 THEN 'tools' WHEN o_orderkey % 7 = 5 THEN 'tool_choice' WHEN o_orderkey % 5 = 0 THEN 'n'
    WHEN o_orderkey % 11 IN (0, 2) THEN 'logprobs' END AS feature FROM orders""")
def unsupported_feature(spark, sf_dir):
    return requests(spark, sf_dir).select("id", calls.unsupported_feature(F.col("v")).alias("feature"))


PROBLEM = """CASE WHEN o_orderkey % 10 = 9 THEN 'request is no object' WHEN o_orderkey % 13 = 0 THEN 'no messages' WHEN o_orderkey % 9 <= 1 THEN 'response is no object' WHEN o_orderkey % 9 = 2 THEN 'error'
    WHEN o_orderkey % 9 = 3 THEN 'no choices' WHEN o_orderkey % 9 = 4 THEN 'a choice is no object' WHEN o_orderkey % 9 <= 6 THEN 'error in a choice' WHEN o_orderkey % 9 = 7 THEN 'half a character' END"""


@query("completion_problem", f"SELECT o_orderkey AS id, {PROBLEM} AS problem FROM orders")
def completion_problem(spark, sf_dir):
    return requests(spark, sf_dir).select("id", calls.completion_problem(F.col("body"), F.col("response")).alias("problem"))


@query("utf8_safe", "SELECT o_orderkey AS id, o_orderkey % 9 <> 7 AS safe FROM orders WHERE o_orderkey % 9 > 0")
def utf8_safe(spark, sf_dir):
    return requests(spark, sf_dir).filter("response IS NOT NULL").select("id", calls.utf8_safe(F.col("response")).alias("safe"))


@query("build_teacher_request", """SELECT o_orderkey AS id, '{"model":"org/m' || CAST(o_orderkey % 8 + 1 AS VARCHAR) || '","messages":[{"role":"system","content":"Answer with a label."},{"role":"user","content":"'
    || o_orderpriority || '"}],"temperature":0.0,"max_tokens":' || '16,"response_format":{"type":"json_object"}}' AS body FROM orders""")
def build_teacher_request(spark, sf_dir):
    model = F.concat(F.lit("org/m"), (F.col("id") % 8 + 1).cast("string"))
    body = calls.teacher_request(model, "Answer with a label.", F.col("text"), 0, 16, '{"type":"json_object"}')
    return requests(spark, sf_dir).select("id", body.alias("body"))


@query("build_student_messages", """SELECT o_orderkey AS id, '[{"role":"system","content":"Label it."},{"role":"user","content":"' || o_orderpriority || '"}]' AS messages FROM orders""")
def build_student_messages(spark, sf_dir):
    return requests(spark, sf_dir).select("id", calls.student_messages("Label it.", F.col("text")).alias("messages"))


@query("zero_shot_prompt", """SELECT 'Label it.' || chr(10) || chr(10) || 'Labels:' || chr(10) || string_agg(p, chr(10) ORDER BY p) || chr(10) || chr(10) || 'Answer with exactly one label from the list.' AS prompt
    FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)""")
def zero_shot_prompt(spark, sf_dir):
    labels = [r[0] for r in table(spark, sf_dir, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # a label set
    return spark.createDataFrame([(calls.zero_shot_prompt(" Label it. ", labels),)], "prompt string")


@query("sse_usage_scan", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN '{"completion_tokens":' || CAST(o_orderkey % 3 AS VARCHAR) || '}' END AS usage, CASE WHEN o_orderkey % 2 = 0 THEN 'prov' END AS provider FROM orders""")
def sse_usage_scan(spark, sf_dir):
    """The last usage and provider of a stream of events; usage comes in the first events too, and broken lines occur."""
    k = F.col("o_orderkey")
    chunk = '{"choices":[{"delta":{"content":"x"}}],"usage":null%s}'
    first = F.concat(F.lit('data: {"usage":{"completion_tokens":'), (k % 3 - 1).cast("string"), F.lit('}}\r\n\r\n'))
    last = F.concat(F.lit('data:{"usage":{"completion_tokens":'), (k % 3).cast("string"), F.lit("}}\n\ndata: [DONE]\n\n"))
    stream = F.concat(
        F.lit(": ping\n\n"), F.when(k % 3 == 2, first).otherwise(""), F.when(k % 2 == 0, "data: " + chunk % ',"provider":"prov"').otherwise("data: " + chunk % ""),
        F.lit("\n\ndata: {broken\n\n"), F.when(k % 3 > 0, last).otherwise(""),
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), calls.sse_usage(stream).alias("u")).select("id", "u.usage", "u.provider")


# Prices. A supplier's key k stands for a model with a list price, and endpoints if k is odd.
SNAPSHOT = """s AS (SELECT s_suppkey AS k FROM supplier), ends AS (SELECT k, tag, i FROM s, (VALUES ('P1', 1), ('p/fast', 2), ('p/slow', 3), ('q', 4), ('q', 5)) v(tag, i) WHERE k % 2 = 1),
prices AS (SELECT 'org/m' || CAST(k AS VARCHAR) AS model, NULL AS tag, (k % 9 + 1) / 1e6::DOUBLE AS prompt, (k % 7 + 1) / 1e6::DOUBLE AS completion, CASE WHEN k % 4 = 0 THEN 0 ELSE (k % 3) / 1e3::DOUBLE END AS request,
    nullif(CASE WHEN k % 3 = 0 AND k > 0 THEN 100 * k WHEN k % 5 > 0 THEN 1000 * k END, 0) AS "limit", k FROM s
  UNION ALL SELECT 'org/m' || CAST(k AS VARCHAR), tag, max((k % 9 + i) / 1e6::DOUBLE), max((9 - i) / 1e6::DOUBLE), 0.0, CAST(max(CASE WHEN i <> 2 THEN 10 * k + i END) AS BIGINT), k FROM ends GROUP BY k, tag)"""


def _snapshot(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    num = lambda n: n.cast("string")
    ends = [
        F.struct(
            F.lit(tag).alias("tag"), F.struct(num((k % 9 + i) / 1e6).alias("prompt"), num((F.lit(9.0) - i) / 1e6).alias("completion")).alias("pricing"),
            (F.when(k > 0, 10 * k + i) if i != 2 else F.lit(None).cast("long")).alias("max_completion_tokens"),
        )
        for i, tag in enumerate(("P1", "p/fast", "p/slow", "q", "q"), start=1)
    ]
    free = F.struct(F.lit("free").alias("tag"), F.struct(F.lit("-1").alias("prompt"), F.lit("-1").alias("completion")).alias("pricing"), F.lit(None).cast("long").alias("max_completion_tokens"))
    model = F.struct(
        F.concat(F.lit("org/m"), num(k)).alias("id"), F.concat(F.lit("org/m"), num(k), F.lit("-2024")).alias("canonical_slug"),
        F.struct(num((k % 9 + 1) / 1e6).alias("prompt"), num((k % 7 + 1) / 1e6).alias("completion"), F.when(k % 4 > 0, num((k % 3) / 1e3)).alias("request")).alias("pricing"),
        F.when(k % 5 > 0, 1000 * k).alias("context_length"), F.when(k % 3 == 0, F.struct((100 * k).alias("max_completion_tokens"))).alias("top_provider"),
        F.when(k % 2 == 1, F.array(*ends, free)).alias("endpoints"),
    )
    return table(spark, sf_dir, "supplier").select(F.to_json(model).alias("json"))


def _wanted(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    model = F.concat(F.lit("org/m"), (k % 8 + 1).cast("string"), F.when(k % 3 == 0, "-2024").otherwise(""))
    tag = F.element_at(F.array(*map(F.lit, ("P1", "p/FAST", "p", "Q", "zz", "p/none"))), (k % 7).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), model.alias("model"), F.when(k % 7 > 0, tag).alias("tag"))


WANTED = """w AS (SELECT o_orderkey AS id, o_orderkey % 8 + 1 AS k, ['P1', 'p/FAST', 'p', 'Q', 'zz', 'p/none'][CAST(o_orderkey % 7 AS INTEGER)] AS tag FROM orders),
c AS (SELECT w.id, p.*, CASE WHEN p.tag = w.tag THEN 1 WHEN lower(p.tag) = lower(w.tag) THEN 2 WHEN w.tag NOT LIKE '%/%' AND split_part(lower(p.tag), '/', 1) = lower(w.tag) THEN 3 WHEN p.tag IS NOT NULL THEN 4 ELSE 5 END AS rank
    FROM w JOIN prices p ON p.k = w.k)"""


@query("pricing_load", f"""WITH {SNAPSHOT} SELECT model, tag, prompt, completion, request, CAST("limit" AS BIGINT) AS "limit" FROM prices""")
def pricing_load(spark, sf_dir):
    return calls.load_prices(_snapshot(spark, sf_dir), "json").drop("slug")


@query("price_lookup", f"""WITH {SNAPSHOT}, {WANTED}, b AS (SELECT id, min(rank) AS rank FROM c GROUP BY id)
SELECT id, CAST(b.rank AS INTEGER) AS rank, max(prompt) AS prompt, max(completion) AS completion, max(request) AS request FROM c JOIN b USING (id, rank) GROUP BY ALL""")
def price_lookup(spark, sf_dir):
    """The tag itself, the tag in another case, the endpoints of a base name, any endpoint, the list price; models by id or slug."""
    found = calls.price_lookup(_wanted(spark, sf_dir), calls.load_prices(_snapshot(spark, sf_dir), "json"))
    return found.select("id", "rank", "prompt", "completion", "request")


@query("max_completion_lookup", f"""WITH {SNAPSHOT}, {WANTED}, l AS (SELECT * FROM c WHERE "limit" IS NOT NULL), b AS (SELECT id, min(rank) AS rank FROM l GROUP BY id)
SELECT w.id, CAST(max(CASE WHEN b.rank > 3 OR l.rank = b.rank THEN "limit" END) AS BIGINT) AS "limit" FROM w LEFT JOIN b USING (id) LEFT JOIN l ON l.id = w.id GROUP BY w.id""")
def max_completion_lookup(spark, sf_dir):
    return calls.limit_lookup(_wanted(spark, sf_dir), calls.load_prices(_snapshot(spark, sf_dir), "json"))
