"""Runs and their names, schedules, thresholds, projections of cost, and confidences of extracted fields."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gristmill.functions import text as tx

# Endings of model names that say how a model was packed, and folders that absolute paths begin with.
MODEL_ENDINGS = ("instruct", "4bit", "8bit", "3bit", "6bit", "bf16", "fp16", "mlx")
PATH_ROOTS = ("Users", "home", "tmp", "private", "var", "Volumes", "opt", "root", "mnt")
#: Share of the steps that warm up, their most, and the share of the peak that is left at the end; the most steps of a quick run.
WARMUP, WARMUP_MOST, LAST_RATE, QUICK_STEPS = 0.1, 100, 0.1, 300
#: Dollars from which a projected cost must be confirmed.
CONFIRM_FROM = 0.5


def short_model_name(c: Column) -> Column:
    """The last part of a model's path, in lower case, without what says how it was packed; 'model' if nothing is left."""
    name = F.lower(F.regexp_extract(F.regexp_replace(c, r"[/\\]+$", ""), r"([^/\\]*)$", 1))
    name = F.regexp_replace(name, rf"(?<=.)(?:-(?:{'|'.join(MODEL_ENDINGS)}))+$", "")
    name = F.regexp_replace(F.regexp_replace(name, "[^a-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(name == "", "model").otherwise(name)


def base_size(c: Column) -> Column:
    """Billions of parameters, the last number before a b in a model's short name; null if it has none."""
    return F.try_element_at(F.regexp_extract_all(short_model_name(c), F.lit(r"(\d+(?:\.\d+)?)b"), F.lit(1)), F.lit(-1)).cast("double")


def run_id(base: Column, profile: Column, seed: Column, labels: Column, backend: Column, schedule: Column) -> Column:
    """A run's id: the model's short name, profile and seed, and what is not as usual."""
    parts = [
        short_model_name(base), profile, F.concat(F.lit("s"), seed.cast("string")), F.when(labels == "gold", "gold"), F.when(backend == "torch", "torch"),
        F.when(schedule != "warmup_cosine", schedule),
    ]
    return F.concat_ws("-", *parts)


def scrub_paths(c: Column, work: str, store: str, store_name: str = "$STORE") -> Column:
    """Absolute paths in a text: those below the working folder become relative to it, those below the store begin with its name, and
    of others, if they begin with a usual folder, the last name is left. What only looks like a path stays."""
    before, part = r"(?<![^\s=:'\"(\[,])", r"[^\s'\"()\[\],;/]+"
    end = r"(?=[\s'\"()\[\],;]|$)"
    out = F.regexp_replace(c, rf"{before}{re.escape(work)}/((?:{part}/?)+){end}", "$1")
    out = F.regexp_replace(out, rf"{before}{re.escape(work)}/?{end}", ".")
    out = F.regexp_replace(out, rf"{before}{re.escape(store)}(?=[/\s'\"()\[\],;]|$)", store_name.replace("$", r"\$"))
    return F.regexp_replace(out, rf"{before}/(?:{'|'.join(PATH_ROOTS)})(?:/{part})*?(?:/({part}))/?{end}", "$1")


def seconds(c: Column) -> Column:
    """A duration such as 30m, 24h or 7d in seconds; null for anything else."""
    value = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*[smhd]\s*$", 1)
    unit = F.regexp_extract(c, r"([smhd])\s*$", 1)
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400)
    return F.when(value != "", value.cast("double") * size)


def iterations(epochs: Column, rows: Column, batch: Column, profile: Column) -> Column:
    """Steps of so many epochs, one at least; a quick run has QUICK_STEPS at most, and nothing to train on gives 0."""
    n = F.greatest(F.ceil(F.round(epochs * rows / F.nullif(batch, F.lit(0)), 9)), F.lit(1))
    n = F.when((rows <= 0) | (batch <= 0), 0).when(profile == "quick", F.least(n, F.lit(QUICK_STEPS))).otherwise(n)
    return n.cast("long")


def learning_rate(step: Column, peak: Column, steps: Column, schedule: Column) -> Column:
    """The rate of a step (from 0): it rises for a tenth of the steps and then falls along half a cosine, or is the peak throughout."""
    warm = F.when(steps <= 1, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(WARMUP_MOST), F.rint(steps * WARMUP).cast("int"))))
    last = peak * LAST_RATE
    done = F.least(F.lit(1.0), (step - warm) / F.greatest(F.lit(1), steps - warm))
    fall = last + 0.5 * (peak - last) * (1 + F.cos(F.pi() * done))
    return F.when(schedule == "constant", peak).when(step < warm, peak * (step + 1) / warm).otherwise(fall)


def resolve_threshold(runs: DataFrame, task: DataFrame, own: DataFrame) -> DataFrame:
    """runs (run_id, adapter) with t, source and warning: the task's threshold if it was chosen for the run, else the run's own, else
    the task's with a warning; no threshold (null) is infinity. task: one row or none (run_id, t, adapter); own: a row per run
    that has one (run_id, t, adapter). An adapter that is not the one a threshold was chosen for is warned of. No threshold at all is an
    error."""
    one = task.select(F.struct(F.lit(True).alias("there"), F.col("run_id").alias("owner"), "t", "adapter").alias("task")).limit(1)
    mine = own.select("run_id", F.struct(F.lit(True).alias("there"), F.col("run_id").alias("owner"), "t", "adapter").alias("own"))
    x = runs.join(mine, "run_id", "left").join(F.broadcast(one), F.lit(True), "left")
    is_own = F.coalesce(F.col("task.owner") == F.col("run_id"), F.lit(False))
    pick = F.when(is_own, F.col("task")).otherwise(F.coalesce("own", "task"))
    source = F.when(is_own, "task").when(F.col("own").isNotNull(), "run").when(F.col("task").isNotNull(), "task")
    x = x.withColumns({"pick": pick, "source": F.coalesce(source, F.raise_error(F.concat(F.lit("no threshold for run "), "run_id")).cast("string"))})
    other, stale = ~F.col("pick.owner").eqNullSafe(F.col("run_id")), F.col("pick.adapter") != F.col("adapter")
    warning = F.when(other, "of another run").when(stale, "of another adapter")
    return x.select("run_id", F.coalesce("pick.t", F.lit(float("inf"))).alias("t"), "source", warning.alias("warning"))


def invalidate(results: DataFrame, trained: DataFrame) -> DataFrame:
    """results (run_id, adapter, ...) without those of a run that was trained again: its adapter is another now. trained (run_id,
    adapter): the runs as they are."""
    now = trained.select("run_id", F.col("adapter").alias("__now"))
    return results.join(now, "run_id", "left").filter(F.col("__now").isNull() | (F.col("__now") == F.col("adapter"))).drop("__now")


def candidates(runs: DataFrame, backend: str) -> DataFrame:
    """Runs to choose from: trained to the end (log and adapter) on the teacher's labels, on the backend."""
    return runs.filter(F.col("log").isNotNull() & F.col("adapter").isNotNull() & (F.col("labels") == "teacher") & (F.col("backend") == backend))


def selected_run(runs: DataFrame, given: str | None, chosen: DataFrame) -> DataFrame:
    """One row, run_id: the given run, else the one that was selected (chosen: run_id, at; the last), else the first on the teacher's
    labels; null where there is none, or the run does not exist."""
    last = chosen.agg(F.max_by("run_id", "at").alias("last"))
    first = runs.agg(F.min(F.when(F.col("labels") == "teacher", F.col("run_id"))).alias("first"))
    want = F.coalesce(F.lit(given).cast("string"), "last", "first")
    one = last.crossJoin(first).select(want.alias("want"))  # a row each
    return one.join(runs.select("run_id"), F.col("want") == F.col("run_id"), "left").select("run_id")


def project_cost(sample: DataFrame, calls: Column) -> DataFrame:
    """sample (source, cost): n, live_n, mean and projected of so many calls to come, from the mean of the sample's live calls. Without a
    live one, nothing is known, but nothing is spent if no call is left or the sample is a replay."""
    live = F.col("source") == "live"
    by = sample.agg(F.count("*").alias("n"), F.count_if(live).alias("live_n"), F.avg(F.when(live, F.col("cost"))).alias("mean"), F.bool_and(F.col("source") == "replay").alias("replay"))
    free = (calls == 0) | F.coalesce("replay", F.lit(False))
    return by.select("n", "live_n", "mean", F.when(F.col("mean").isNotNull(), F.col("mean") * calls).when(free, 0.0).alias("projected"))


def must_confirm(projected: Column, threshold: float = CONFIRM_FROM) -> Column:
    return projected.isNull() | (projected > threshold)


def project_bakeoff(sample: DataFrame, plans: DataFrame) -> DataFrame:
    """What a comparison of candidates will cost, in one row: plans (place, calls, prompt, completion, request; prices null if unknown)
    times the mean tokens of the first candidate's sample (source, cost, prompt_tokens, completion_tokens), which itself costs the mean
    of its live calls; and what the sample has cost. Null if a candidate with calls left has no price."""
    live, known = F.col("source") == "live", F.col("prompt_tokens").isNotNull()
    s = sample.agg(
        F.coalesce(F.sum(F.when(live, F.col("cost"))), F.lit(0.0)).alias("spent"), F.avg(F.when(live, F.col("cost"))).alias("mean"),
        F.avg(F.when(known, F.col("prompt_tokens"))).alias("p"), F.avg(F.when(known, F.coalesce("completion_tokens", F.lit(0)))).alias("c"),
    )
    by_tokens = F.col("p") * F.col("prompt") + F.col("c") * F.col("completion") + F.col("request")
    each = F.when((F.col("place") == 0) & F.col("mean").isNotNull(), F.col("mean")).otherwise(by_tokens)
    x = plans.filter("calls > 0").crossJoin(F.broadcast(s)).select("spent", (each * F.col("calls")).alias("cost"))
    left = x.agg(F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unknown"))
    return s.crossJoin(left).select(F.when(F.col("unknown") == 0, F.col("spent") + F.coalesce("cost", F.lit(0.0))).alias("projected"), "spent", F.col("p").alias("mean_prompt"), F.col("c").alias("mean_completion"))


def header_fits(cached: Column, wanted: Column) -> Column:
    """Whether cached rows with a header (a JSON object) serve one that is wanted: all fields are equal, but alternatives may be there
    though they are not wanted."""
    rest = lambda h: F.to_json(F.parse_json(tx.meta_pop(h, F.lit("alternatives"))["props"]))
    has = lambda h: F.coalesce(F.get_json_object(h, "$.alternatives") == "true", F.lit(False))
    return (rest(cached) == rest(wanted)) & (has(cached) | ~has(wanted))


def files_hash(files: DataFrame, by: str, path: str, sha256: str) -> DataFrame:
    """(by, hash): one hash of a folder's files, from their paths and hashes, whatever their order."""
    lines = F.sort_array(F.collect_list(F.concat_ws(" ", F.col(sha256), F.col(path))))
    return files.groupBy(by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))


def sent_under_cap(requests: DataFrame, by: str, order: str, added: str, worst: str, cap: int) -> DataFrame:
    """requests with `sent`: they are sent in order, each if what was spent and the most that it may cost stay within the cap; the first
    that does not ends it. The most is its worst case, or the largest amount a request has added so far."""
    earlier = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(added).over(earlier), F.lit(0))
    most = F.greatest(F.coalesce(F.max(added).over(earlier), F.lit(0)), F.coalesce(F.col(worst), F.lit(0)))
    df = requests.withColumn("__fits", (spent < cap) & (spent + most <= cap))
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("sent", F.bool_and("__fits").over(upto)).drop("__fits")


_SPANS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _spans_of(answer: str) -> list[dict]:
    """Where each value of the first object of an answer stands, by stepping over its members with a decoder."""
    found = tx.first_object(answer)
    at = answer.index("{", max(0, _object_start(answer))) + 1
    read, spans = json.JSONDecoder().raw_decode, {}
    for _ in re.finditer(",|{", "{" + "," * len(answer)):
        at = _blank(answer, at)
        if answer[at] == "}":
            break
        name, at = read(answer, at)
        start = _blank(answer, _blank(answer, at) + 1)
        _, at = read(answer, start)
        spans[name] = (start, at)
        at = _blank(answer, at)
        if answer[at] == "}":
            break
        at += 1
    return [{"name": k, "start": a, "end": b} for k, (a, b) in spans.items() if k in found]


def _blank(text: str, at: int) -> int:
    return re.compile(r"[ \t\r\n]*").match(text, at).end()


def _object_start(answer: str) -> int:
    return next((m.start() for m in tx.FENCED.finditer(answer) if "{" in (m[1] or m[2] or "")), 0)


@F.pandas_udf(_SPANS)
def json_value_spans(s: pd.Series) -> pd.Series:
    """(name, start, end) of each value of the first JSON object in an answer, in characters of it; null if there is none."""

    def one(x: str):
        try:
            return _spans_of(x)
        except (ValueError, IndexError, RecursionError):
            return None

    return s.map(one, na_action="ignore")


def extraction_confidence(spans: Column, tokens: Column, names: list[str], valid: Column) -> Column:
    """The least probability of a field: that of the tokens (s, e, lp) that overlap its value's span; over fields of the schema that are
    there. Without any, that of all tokens; 0 for an answer that is not valid. An empty token belongs to the value it stands in."""
    prob = lambda some: F.exp(F.least(F.aggregate(some, F.lit(0.0), lambda acc, t: acc + t["lp"]), F.lit(0.0)))
    own = F.filter(spans, lambda v: v["name"].isin(*names))

    def of(v: Column) -> Column:
        hit = lambda t: F.when(t["e"] > t["s"], (t["s"] < v["end"]) & (t["e"] > v["start"])).otherwise((t["s"] >= v["start"]) & (t["s"] < v["end"]))
        return prob(F.filter(tokens, hit))

    return F.when(~F.coalesce(valid, F.lit(False)) | spans.isNull(), 0.0).when(F.size(own) > 0, F.array_min(F.transform(own, of))).otherwise(prob(tokens))


def first_seen_keys(df: DataFrame, order: str, json_column: str) -> DataFrame:
    """(key, place): the keys of JSON objects in the order in which they first appear."""
    at = df.select(order, F.posexplode(F.json_object_keys(json_column)).alias("i", "key"))
    first = at.groupBy("key").agg(F.min(F.struct(order, "i")).alias("f"))
    return first.select("key", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("f")).alias("place"))  # one row per key


def best_c(scores: DataFrame) -> DataFrame:
    """The c (c, agreement) of the highest agreement, the smallest at a tie."""
    return scores.agg(F.min(F.struct((-F.col("agreement")).alias("a"), "c")).alias("b")).select("b.c", (-F.col("b.a")).alias("agreement"))


def collected(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(id, key, found, answer) of wanted requests (id, key, context), against held answers (id, key, context, answer).

    'cached': each answer that is held under a wanted key and its context, with its own id; a wanted key and context without one, by
    the smallest id that asks it: 'elsewhere' if the key is held under another context, 'missing' if it isn't held. However often
    a request is asked, it counts once.
    """
    asked = wanted.groupBy("key", "context").agg(F.min("id").alias("id"))
    found = held.join(asked.select("key", "context"), ["key", "context"], "left_semi").select("id", "key", F.lit("cached").alias("found"), "answer")
    missing = asked.join(held.select("key", "context"), ["key", "context"], "left_anti")
    elsewhere = held.select("key").distinct().withColumn("there", F.lit(True))
    told = F.when(F.col("there"), "elsewhere").otherwise("missing")
    missing = missing.join(elsewhere, "key", "left").select("id", "key", told.alias("found"), F.lit(None).cast("string").alias("answer"))
    return found.unionByName(missing)
