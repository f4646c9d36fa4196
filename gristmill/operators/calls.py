"""Chat requests and their answers, as columns over the JSON of their bodies: bounds, costs, features and problems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens counted for a message beside its text; the limit of tokens assumed where none is set.
PER_MESSAGE, DEFAULT_TOKENS = 16, 4096
#: Fields by which a request asks for tools.
TOOL_FIELDS = ("tools", "functions", "tool_choice", "function_call")
#: What stands before a label list or a schema in a zero-shot prompt. Fixed values.
LABEL_INSTRUCTION = "Answer with exactly one label from the list."
SCHEMA_INSTRUCTION = "Extract the fields as a single JSON object matching this JSON Schema: {schema}. Output JSON only."


def _field(body: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(body, f"$.{name}", kind)


def _is(value: Column, *kinds: str) -> Column:
    return F.coalesce(F.split_part(F.schema_of_variant(value), F.lit("<"), F.lit(1)).isin(*kinds), F.lit(False))


def _there(value: Column) -> Column:
    """Whether a field is there and is not null."""
    return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))


def _positive(body: Column, name: str) -> Column:
    n = _field(body, name, "bigint")
    return F.when(_is(_field(body, name), "BIGINT") & (n > 0), n)


def content_text(content: Column) -> Column:
    """The text of a message's content: a string, or the texts of its parts of type text, joined. Null for anything else."""
    parts = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.try_variant_get(p, "$.type", "string") == "text")
    texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    return F.when(_is(content, "STRING"), F.try_variant_get(content, "$", "string")).when(_is(content, "ARRAY"), F.array_join(texts, ""))


def messages(body: Column) -> Column:
    return F.coalesce(_field(body, "messages", "array<variant>"), F.array().cast("array<variant>"))


def last_input(body: Column) -> Column:
    """The text of the last user message, if it is a string or holds parts of text alone; else null."""
    users = F.filter(messages(body), lambda m: F.try_variant_get(m, "$.role", "string") == "user")
    content = F.try_variant_get(F.try_element_at(users, F.lit(-1)), "$.content", "variant")
    parts = F.try_variant_get(content, "$", "array<variant>")
    plain = F.coalesce(F.forall(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.type", "string") == "text", F.lit(False))), F.lit(True))
    return F.when(plain, content_text(content))


def _json_bytes(value: Column) -> Column:
    return F.when(_there(value), F.octet_length(F.to_json(value))).otherwise(0)


def prompt_upper_bound(body: Column) -> Column:
    """Bytes of all texts, of the JSON of tools and tool calls, and a fixed number for each message: a token has a byte at least."""

    def of(m: Column) -> Column:
        get = lambda name: F.try_variant_get(m, f"$.{name}", "variant")
        text = F.coalesce(F.octet_length(content_text(get("content"))), F.lit(0))
        return text + PER_MESSAGE + _json_bytes(get("tool_calls")) + _json_bytes(get("function_call"))

    own = F.aggregate(F.transform(messages(body), of), F.lit(0), lambda acc, n: acc + n)
    return (own + _json_bytes(_field(body, "tools")) + _json_bytes(_field(body, "functions"))).cast("long")


def completion_limit(body: Column) -> Column:
    return F.coalesce(_positive(body, "max_tokens"), _positive(body, "max_completion_tokens"))


def choice_count(body: Column) -> Column:
    return F.coalesce(_positive(body, "n"), F.lit(1))


def completion_upper_bound(body: Column, model_limit: Column) -> Column:
    """The request's limit of tokens, else the model's, else DEFAULT_TOKENS, for each of its choices."""
    most = F.when(model_limit > 0, model_limit)
    return F.coalesce(completion_limit(body), most, F.lit(DEFAULT_TOKENS)).cast("long") * choice_count(body)


def worst_case_cost(body: Column, prompt: Column, completion: Column, request: Column, model_limit: Column) -> Column:
    """Bounds times prices, and the fee of a request."""
    return prompt_upper_bound(body) * prompt + completion_upper_bound(body, model_limit) * completion + request


def reservation_cost(body: Column, prompt: Column, completion: Column, request: Column, model_limit: Column) -> Column:
    """worst_case_cost() of a request with a limit of its own or of its model; null (refused) for one without."""
    bounded = completion_limit(body).isNotNull() | F.coalesce(model_limit > 0, F.lit(False))
    return F.when(bounded, worst_case_cost(body, prompt, completion, request, model_limit))


def nano(usd: Column, up: bool) -> Column:
    """Dollars as whole nano-dollars: up where they are reserved, half to even where they are settled; none below 0."""
    n = F.ceil(usd * 1e9 - 1e-6) if up else F.rint(usd * 1e9)
    return F.greatest(n.cast("long"), F.lit(0))


def is_truncated(body: Column, usage: Column, finish_reason: Column) -> Column:
    """Whether an answer was cut off: by its reason, or as it has more tokens than all its choices may have."""
    n = _positive(usage, "completion_tokens")
    return F.coalesce(finish_reason == "length", F.lit(False)) | F.coalesce(n > completion_limit(body) * choice_count(body), F.lit(False))


def usage_cost(usage: Column, prompt: Column, completion: Column, request: Column) -> Column:
    """What an answer cost: as it says, if that is a number of 0 or more, else by its tokens; null if it says neither."""
    said = _field(usage, "cost", "double")
    number = _is(_field(usage, "cost"), "BIGINT", "DOUBLE", "FLOAT") | F.schema_of_variant(_field(usage, "cost")).startswith("DECIMAL")
    tokens = [F.when(_is(_field(usage, k), "BIGINT"), _field(usage, k, "bigint")) for k in ("prompt_tokens", "completion_tokens")]
    priced = F.coalesce(tokens[0], F.lit(0)) * prompt + F.coalesce(tokens[1], F.lit(0)) * completion + request
    own = F.when(F.coalesce(number, F.lit(False)) & (said >= 0) & (said < float("inf")), said)
    return F.coalesce(own, F.when(tokens[0].isNotNull() | tokens[1].isNotNull(), priced))


def unsupported_feature(body: Column) -> Column:
    """The first field by which a request asks for what a small model has not, or null."""
    out = None
    for name in TOOL_FIELDS:
        v = _field(body, name)
        asked = _there(v) & (F.to_json(v) != "[]")
        out = F.when(asked, name) if out is None else out.when(asked, name)
    n, logprobs = _field(body, "n"), _field(body, "logprobs")
    out = out.when(_there(n) & ~F.coalesce(_field(body, "n", "double") == 1, F.lit(False)), "n")
    wanted = _there(logprobs) & ~F.to_json(logprobs).isin("false", "0", '""', "[]", "{}")
    return out.when(wanted | _there(_field(body, "top_logprobs")), "logprobs")


def completion_problem(request: Column, response: Column) -> Column:
    """Why a pair of JSON texts is no usable call, the first reason in a fixed order, or null. Texts are UTF-8 strings; an
    escape of half a character, which would not be, is a reason."""
    req, res = F.try_parse_json(request), F.try_parse_json(response)
    list_of = lambda v, name: F.when(_is(_field(v, name), "ARRAY"), _field(v, name, "array<variant>"))
    some = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    choices = list_of(res, "choices")

    def failed(c: Column) -> Column:
        return _there(F.try_variant_get(c, "$.error", "variant")) | F.coalesce(F.try_variant_get(c, "$.finish_reason", "string") == "error", F.lit(False))

    return (
        F.when(~_is(req, "OBJECT"), "request is no object").when(~some(list_of(req, "messages")), "no messages").when(~_is(res, "OBJECT"), "response is no object")
        .when(_there(_field(res, "error")), "error").when(~some(choices), "no choices").when(F.exists(choices, lambda c: ~_is(c, "OBJECT")), "a choice is no object")
        .when(F.exists(choices, failed), "error in a choice").when(~utf8_safe(request) | ~utf8_safe(response), "half a character")
    )


def utf8_safe(text: Column) -> Column:
    """Whether a JSON text, once its escapes are read, has whole characters alone: each high surrogate is followed by a low one."""
    pairs = F.regexp_replace(F.regexp_replace(text, r"\\\\", ""), r"(?i)\\ud[89ab][0-9a-f]{2}\\ud[c-f][0-9a-f]{2}", "")
    return F.coalesce(~pairs.rlike(r"(?i)\\ud[89a-f][0-9a-f]{2}"), F.lit(True)) & F.coalesce(F.is_valid_utf8(text), F.lit(True))


def teacher_request(model: Column, prompt: str, text: Column, temperature: float, max_tokens: int, response_format: str | None = None) -> Column:
    """The JSON body that asks a teacher for an answer."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    fields = [
        model.alias("model"), F.array(message("system", F.lit(prompt)), message("user", text)).alias("messages"), F.lit(float(temperature)).alias("temperature"),
        F.lit(max_tokens).alias("max_tokens"),
    ]
    if response_format is not None:
        fields.append(F.from_json(F.lit(response_format), "map<string,string>").alias("response_format"))
    return F.to_json(F.struct(*fields))


def student_messages(prompt: str | Column, text: Column) -> Column:
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), prompt.alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content"))))


def zero_shot_prompt(prompt: str, labels: Sequence[str] | None = None, schema: str | None = None) -> str:
    """A system prompt that says all that is to be known of a task: its labels, or its JSON Schema."""
    if labels:
        listed = "\n".join(labels)
        return f"{prompt.strip()}\n\nLabels:\n{listed}\n\n{LABEL_INSTRUCTION}"
    if not schema:
        raise ValueError("a task without labels needs a schema")
    return f"{prompt.strip()}\n\n{SCHEMA_INSTRUCTION.replace('{schema}', schema)}"


def sse_usage(stream: Column) -> Column:
    """The last `usage` and `provider` of a stream of server-sent events (its whole text), as a struct; null where there is none."""
    lines = F.filter(F.split(stream, r"\r\n|\n|\r"), lambda x: x.startswith("data:") & (F.trim(F.substr(x, F.lit(6))) != "[DONE]"))
    events = F.transform(lines, lambda x: F.try_parse_json(F.substr(x, F.lit(6))))
    last = lambda name: F.try_element_at(F.filter(F.transform(events, lambda e: F.try_variant_get(e, f"$.{name}", "variant")), lambda v: _there(v)), F.lit(-1))
    return F.struct(F.to_json(last("usage")).alias("usage"), F.try_variant_get(last("provider"), "$", "string").alias("provider"))


#: Dollars a token of the prompt, a token of the answer, and a request.
PRICE = ("prompt", "completion", "request")


def load_prices(snapshot: DataFrame, column: str) -> DataFrame:
    """(model, tag, prompt, completion, request, limit, slug) of JSON texts, one per model: {id, canonical_slug, pricing, context_length,
    top_provider, endpoints: [{tag, pricing, ...}]}. The list price has a null tag. Prices that are dynamic (below 0) or no numbers
    are left out; of several endpoints of one tag each field's largest counts."""
    v = F.try_parse_json(F.col(column))
    get = lambda x, path, kind="double": F.try_variant_get(x, path, kind)

    def price(x: Column) -> list[Column]:
        p, c, r = get(x, "$.pricing.prompt"), get(x, "$.pricing.completion"), F.coalesce(get(x, "$.pricing.request"), F.lit(0.0))
        ok = (p >= 0) & (c >= 0) & (r >= 0)
        return [F.when(ok, a) for a in (p, c, r)]

    def limit(*paths: Column) -> Column:
        return F.coalesce(*[F.when(p > 0, p) for p in paths])

    model = snapshot.select(v.alias("v")).filter(_is(F.col("v"), "OBJECT"))
    names = [get(F.col("v"), "$.id", "string").alias("model"), get(F.col("v"), "$.canonical_slug", "string").alias("slug")]
    p, c, r = price(F.col("v"))
    own = limit(get(F.col("v"), "$.top_provider.max_completion_tokens", "bigint"), get(F.col("v"), "$.context_length", "bigint"))
    listed = model.select(*names, F.lit(None).cast("string").alias("tag"), p.alias("prompt"), c.alias("completion"), r.alias("request"), own.alias("limit"))
    e = model.select(*names, F.explode(get(F.col("v"), "$.endpoints", "array<variant>")).alias("e"))
    p, c, r = price(F.col("e"))
    own = limit(get(F.col("e"), "$.max_completion_tokens", "bigint"), get(F.col("e"), "$.context_length", "bigint"))
    ends = e.select("model", "slug", get(F.col("e"), "$.tag", "string").alias("tag"), p.alias("prompt"), c.alias("completion"), r.alias("request"), own.alias("limit"))
    every = listed.unionByName(ends.filter(F.col("tag").isNotNull())).filter(F.col("prompt").isNotNull() | F.col("limit").isNotNull())
    return every.groupBy("model", "tag").agg(*[F.max(x).alias(x) for x in ("prompt", "completion", "request", "limit", "slug")])


def _ranked(wanted: DataFrame, prices: DataFrame, present: str) -> DataFrame:
    """The different (model, tag) of wanted with each price that has `present`, and its rank: 1 the tag itself, 2 in another case, 3 the endpoints of
    a base name, 4 any endpoint, 5 what the model itself says."""
    by_id = prices.filter(F.col(present).isNotNull()).withColumnRenamed("tag", "__tag")
    alias = by_id.filter(F.col("slug") != F.col("model")).withColumn("model", F.col("slug"))
    alias = alias.join(by_id.select("model").distinct(), "model", "left_anti")  # a model's own name comes first
    known = by_id.unionByName(alias)
    asked, tag = F.lower(F.trim("tag")), F.lower("__tag")
    rank = (
        F.when(F.col("__tag") == F.col("tag"), 1).when(tag == asked, 2)
        .when(~F.contains(asked, F.lit("/")) & (F.split_part(tag, F.lit("/"), F.lit(1)) == asked), 3).when(tag.isNotNull(), 4).otherwise(5)
    )
    # Requests name few models, and most of them the same: prices are ranked once for each different pair.
    return wanted.select("model", "tag").distinct().join(known, "model", "left").withColumn("__rank", F.when(F.col(present).isNotNull(), rank))


def price_lookup(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """wanted (id, model, tag) with the price to plan with: prompt, completion, request, and rank as in _ranked(). Of several of a
    rank each field's largest counts. A model may be named by its slug. An unknown model is an error."""
    by = _ranked(wanted, prices, "prompt")
    unknown = F.raise_error(F.concat(F.lit("no price for model "), F.coalesce("model", F.lit("null")))).cast("int")
    best = by.groupBy("model", "tag").agg(
        F.min("__rank").alias("rank"), *[F.max(F.when(F.col("__rank") == r, F.col(k))).alias(f"{k}{r}") for k in PRICE for r in range(1, 6)]
    )
    best = best.withColumn("rank", F.coalesce("rank", unknown))
    of = lambda k: F.element_at(F.array(*[F.col(f"{k}{r}") for r in range(1, 6)]), F.col("rank"))
    return _told(wanted, best.select("model", "tag", "rank", *[of(k).alias(k) for k in PRICE])).select("id", "model", "rank", *PRICE)


def _told(wanted: DataFrame, best: DataFrame) -> DataFrame:
    """wanted with what is known of each model and tag; null tags are alike."""
    a, b = wanted.select("id", "model", "tag").alias("a"), best.alias("b")
    on = F.col("a.model").eqNullSafe(F.col("b.model")) & F.col("a.tag").eqNullSafe(F.col("b.tag"))
    return a.join(b, on, "left").select("a.id", "a.model", *[f"b.{c}" for c in best.columns if c not in ("model", "tag")])


def limit_lookup(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """wanted (id, model, tag) with the most tokens that an answer can have; null where none is known. A named endpoint's
    limit counts; else the largest of all endpoints and the model."""
    by = _ranked(wanted, prices, "limit")
    named = F.max(F.when(F.col("__rank") <= 3, -F.col("__rank")))
    of = lambda r: F.max(F.when(F.col("__rank") == r, F.col("limit")))
    best = by.groupBy("model", "tag").agg(F.when(named.isNotNull(), F.coalesce(of(1), of(2), of(3))).otherwise(F.max("limit")).alias("limit"))
    return _told(wanted, best).select("id", "limit")
