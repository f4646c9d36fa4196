"""The stage that scrubs examples: texts and the strings in their answers become placeholders, and answers that no longer
fit their schema are told apart, with the fields and the kinds that broke them."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import pii
from gristmill.functions import text as tx

ROLES = ("input", "teacher", "gold")
_FOUND = T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("role", "path", "kind")), T.StructField("n", T.LongType())]))
_BROKEN = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("field", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]))


def leaves(value, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, string) of every string in a JSON value; keys are none."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")


def _broken_fields(before, after, schema: dict) -> list[tuple[str, list[str]]]:
    """(field, kinds found in it) of the fields that the scrub changed and whose own part of the schema they now fail; '$' and all
    kinds where what fails is no one field's part. Empty if what came out is valid."""
    if not tx.schema_errors(after, schema):
        return []
    own = schema.get("properties", {}) if isinstance(after, dict) else {}
    fields = {k: before[k] for k, part in own.items() if k in after and after[k] != before[k] and tx.schema_errors(after[k], part)}
    return [(k, sorted(pii.scrub_value(v)[1])) for k, v in (fields or {"$": before}).items()]


def scrub_examples(examples: DataFrame, schema: dict | None = None, text: str = "input", teacher: str = "teacher", gold: str = "gold", kinds: tuple[str, ...] = pii.KINDS) -> DataFrame:
    """examples with text (of `text`), and teacher and gold scrubbed, and four columns more: found (role, path, kind, n: what was
    found where), broken (role, field, kinds), rejected (the teacher's answer broke) and cleared (the gold did, and is null).

    schema: a JSON Schema of the answers, which are JSON text; without one answers are labels and stay as they are. An answer that
    the scrub changed is validated again; one that fails rejects its example, a gold that fails becomes null. Answers that are
    no JSON count as broken at '$' if anything is found in them. kinds: which placeholders to use. Null stays null, rows are
    independent of each other, and nothing is shuffled: rows that can hold no personal data don't leave the JVM.
    """
    answers = [teacher, gold] if schema is not None else []
    hold = [F.coalesce(pii.may_hold(c), F.lit(False)) for c in (text, *answers)]
    any_ = hold[0]
    for h in hold[1:]:
        any_ = any_ | h
    rows = examples.withColumn("__holds", any_)
    result = T.StructType([*(T.StructField(n, T.StringType()) for n in ("text", "teacher", "gold")), T.StructField("found", _FOUND), T.StructField("broken", _BROKEN)])

    @F.pandas_udf(result)
    def scrub(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_scrub_one(*r, schema, kinds) for r in frame.itertuples(index=False)], columns=result.names)

    asked = F.struct(F.col(text).alias("i"), F.col(teacher).cast("string").alias("t"), F.col(gold).cast("string").alias("g"))
    rest = [c for c in examples.columns if c not in (teacher, gold, "text", "found", "broken", "rejected", "cleared")]
    changed = rows.filter("__holds").withColumn("__s", scrub(asked))
    changed = changed.select(*rest, "__s.text", F.col("__s.teacher").alias(teacher), F.col("__s.gold").alias(gold), "__s.found", "__s.broken")
    plain = rows.filter("NOT __holds")
    plain = plain.select(
        *rest, F.col(text).alias("text"), F.col(teacher).cast("string").alias(teacher), F.col(gold).cast("string").alias(gold),
        F.array().cast(_FOUND).alias("found"), F.array().cast(_BROKEN).alias("broken"),
    )
    out = changed.unionByName(plain)
    broke = lambda role: F.exists("broken", lambda b: b["role"] == role)
    return out.withColumns({"rejected": broke("teacher"), "cleared": broke("gold")})


def _scrub_one(text: str | None, teacher: str | None, gold: str | None, schema: dict | None, kinds: tuple[str, ...]) -> tuple:
    found, broken, out = [], [], {"input": text, "teacher": teacher, "gold": gold}

    def clean(value: str) -> tuple[str, Counter]:
        new, n = pii.scrub_text(value, kinds=kinds)
        return new, n

    if text is not None:
        out["input"], n = clean(text)
        found += [("input", "$", k, c) for k, c in sorted(n.items())]
    for role, raw in (("teacher", teacher), ("gold", gold)):
        if raw is None or schema is None:
            continue
        try:
            before = json.loads(raw)
        except ValueError:
            new, n = clean(raw)
            found += [(role, "$", k, c) for k, c in sorted(n.items())]
            broken += [(role, "$", sorted(n))] if n else []
            out[role] = None if n and role == "gold" else new
            continue
        hits = [(role, path, k, c) for path, x in leaves(before) for k, c in sorted(clean(x)[1].items())]
        found += hits
        if hits:
            after = _put(before, clean)
            failing = _broken_fields(before, after, schema)
            broken += [(role, f, k) for f, k in failing]
            out[role] = None if failing and role == "gold" else json.dumps(after, separators=(",", ":"), ensure_ascii=False)
    return out["input"], out["teacher"], out["gold"], found, broken


def _put(value, clean):
    if isinstance(value, str):
        return clean(value)[0]
    if isinstance(value, dict):
        return {k: _put(v, clean) for k, v in value.items()}
    return [_put(v, clean) for v in value] if isinstance(value, list) else value


def hits(role: str, kind: str) -> Column:
    """How often a kind was found in a role of a row."""
    fits = F.filter("found", lambda f: (f["role"] == role) & (f["kind"] == kind))
    return F.aggregate(fits, F.lit(0).cast("long"), lambda acc, f: acc + f["n"])


def counters(kinds: tuple[str, ...] = pii.KINDS) -> dict[str, Column]:
    """Aggregates of what scrub_examples() returns: hits by role and kind, examples changed, answers rejected and golds cleared."""
    out = {f"{role}_{kind}": F.sum(hits(role, kind)) for role in ROLES for kind in kinds}
    return out | {"examples_changed": F.count_if(F.size("found") > 0), "rejected": F.count_if("rejected"), "gold_cleared": F.count_if("cleared")}


def blame(scrubbed: DataFrame) -> DataFrame:
    """(field, teacher, gold, kinds): which fields broke answers, how many of each role, and the kinds found in them."""
    rows = scrubbed.select(F.inline("broken"))
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds"))))
    return rows.groupBy("field").agg(F.count_if(F.col("role") == "teacher").alias("teacher"), F.count_if(F.col("role") == "gold").alias("gold"), kinds.alias("kinds"))
