"""A curation run, its counters, what it writes and what it refuses, on records worked out by hand."""

import hashlib
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gristmill.operators import curation, leakage, pii_stage
from gristmill.operators.curation import CurateError, Run, Task, run

SCHEMA = "seq long, h string, input string, output string, gold string, split string, result string"
TASK = Task(labels=("a", "b"))


def records(spark, rows):
    """rows: (input, output, gold, split) or with a result; h is the input itself."""
    full = [(i, r[0], *r, *([] if len(r) == 5 else ["ok"])) for i, r in enumerate(rows)]
    return spark.createDataFrame([(s, re.sub(r"\W", "", h or "") or str(s), t, o, g, p, k) for s, h, t, o, g, p, k in full], SCHEMA)


def decided(spark, rows):
    r = Run(TASK, spark)
    g = r.take(records(spark, rows), "records")
    df = r.keep("vote", curation.decide(curation.merge(g), g, TASK), **curation.decision_counters())
    return {x["h"]: x for x in df.collect()}, r.counters["vote"]


def test_twelve_counters(spark):
    rows = [
        ("won", "a", "a", "train"), ("won", " a ", "b", "train"), ("won", "b", "a", "train"),  # a conflict that is resolved, golds too
        ("tie", "a", None, "train"), ("tie", "b", None, None), ("tietest", "a", None, "train"), ("tietest", "b", "x", "test"),
        ("bad", "x", None, "valid"), ("bad", "y", None, None), ("badtest", "x", "a", "test"), ("badtest", None, "b", "test"),
        ("none", None, "a", None), ("none", None, "zz", None),
    ]
    got, counts = decided(spark, rows)
    assert {k: v["fate"] for k, v in got.items()} == {
        "won": "labelled", "tie": "dropped_no_majority", "tietest": "kept_test_no_majority", "bad": "dropped_all_invalid", "badtest": "kept_test_all_invalid",
        "none": "unlabelled",
    }
    assert (got["won"]["teacher"], got["won"]["votes"], got["won"]["gold"], got["badtest"]["gold"], got["none"]["gold"]) == ("a", 2, "a", None, "a")
    assert {k: counts[k] for k in curation.NORMALISE} == {
        "examples": 6, "outputs": 10, "invalid_outputs": 3, "dropped_all_invalid": 1, "dropped_no_majority": 1, "kept_test_all_invalid": 1, "kept_test_no_majority": 1,
        "conflicts_resolved": 1, "unlabelled": 1, "gold_invalid": 2, "gold_conflicts_resolved": 1, "gold_conflicts_unresolved": 1,
    }


def test_dedupe_of_every_split_with_conflicts(spark):
    long = [f"w{i}" for i in range(40)]
    text = lambda *edit: " ".join(w if i not in edit else f"x{i}" for i, w in enumerate(long))
    rows = [
        (1, text(), "train", "a", 2, "g"), (2, text(39), "train", "b", 1, "h"), (3, text(), "train", "a", 0, None), (4, text(), "valid", "a", 1, None),
        (5, "top up", "train", "a", 1, None), (6, "Top  UP", "train", "b", 1, None), (7, "one two three", "test", None, 0, "g"), (8, "one  two three", "test", None, 0, "h"),
        (9, "alone here now", "test", "b", 1, None),
    ]
    df = spark.createDataFrame(rows, "seq long, text string, split string, teacher string, votes long, gold string")
    got = {r["seq"]: r for r in curation.dedupe(df).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "kept", 2: "near", 3: "exact", 4: "kept", 5: "conflict", 6: "conflict", 7: "kept", 8: "exact", 9: "kept"}
    assert sorted(k for k, r in got.items() if r["gold_conflict"]) == [1, 7] and [k for k, r in got.items() if r["conflict_cluster"]] == [5]
    assert (got[7]["gold"], got[1]["gold"], got[1]["teacher"]) == ("g", "g", "a")
    loose = {r["seq"]: r["verdict"] for r in curation.dedupe(df, exact=False).collect()}
    assert loose[5] == loose[6] == "kept" and loose[3] == "exact"


def filler(n, split, prefix):
    return [(f"{prefix} number {i} is about {prefix}{i * 7} and {prefix}{i * 11}", "ab"[i % 2], None, split) for i in range(n)]


def test_a_run_counts_each_stage_and_writes_what_it_keeps(spark, tmp_path):
    rows = [
        *filler(6, "train", "t"), *filler(3, "valid", "v"), *filler(2, "test", "s"), ("write to jane@example.org about the card", "a", "b", "train"),
        ("T number 0 is  about t0 and t0", "a", None, "valid"), ("please label me, nobody did", None, None, "train"), ("and me, badly", None, None, "train"),
        ("no answer of a test row", None, None, "test"), (" ".join(["long"] + [f"l{i}" for i in range(500)]), "a", None, "valid"), ("dropped", "zzz", None, "train"),
        ("unread", None, None, None, "input_unparsed"),
    ]
    answers = spark.createDataFrame([(13, "b"), (14, "nonsense")], "seq long, answer string")
    r = run(records(spark, rows), TASK, answers)
    assert [(s, r.counters[s]["rows"]) for s in ("load", "extract", "merge", "vote")] == [("load", 19), ("extract", 18), ("merge", 18), ("vote", 18)]
    assert r.counters["vote"]["dropped_all_invalid"] == 1
    assert (r.counters["pii"]["input_email"], r.counters["pii"]["examples_changed"]) == (1, 1)
    assert [r.sizes(s) for s in ("split", "dedupe", "cross_split", "label", "length", "leakage")] == [
        {"train": 9, "valid": 5, "test": 3}, {"train": 9, "valid": 5, "test": 3}, {"train": 8, "valid": 5, "test": 3}, {"train": 7, "valid": 5, "test": 3},
        {"train": 7, "valid": 4, "test": 3}, {"train": 7, "valid": 4, "test": 3},
    ]
    assert (r.counters["label"]["asked"], r.counters["label"]["invalid"], r.counters["cross_split"]["exact"], r.counters["leakage"]["near"]) == (3, 2, 1, 0)
    path = str(tmp_path / "out")
    report = curation.write(r, path, rows_per_file=3)
    got = spark.read.json(path)
    assert {(x["split"], x["count"]) for x in got.groupBy("split").count().collect()} == {("train", 7), ("valid", 4), ("test", 3)}
    assert got.filter("text = 'write to <EMAIL> about the card' AND gold = 'b'").count() == 1 and got.filter("text = 'please label me, nobody did' AND teacher = 'b'").count() == 1
    assert len(report["files"]) > 3 and sum(f["rows"] for f in report["files"]) == 14
    for f in report["files"]:
        raw = next(Path(path).glob(f"split={f['split']}/{f['file']}")).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == f["sha256"] and raw.count(b"\n") == f["rows"]
    assert json.loads(spark.read.text(f"{path}/_report").first()[0])["splits"] == {"train": 7, "valid": 4, "test": 3}
    again = curation.write(r, str(tmp_path / "again"), rows_per_file=3)
    assert sorted(f["sha256"] for f in again["files"]) == sorted(f["sha256"] for f in report["files"])


def test_a_run_is_refused_without_training_rows_or_with_leaks(spark, monkeypatch):
    with pytest.raises(CurateError, match="no usable"):
        run(records(spark, [("x", None, None, None, "empty_input")]), TASK)
    with pytest.raises(CurateError, match="train split is empty after cross_split"):
        run(records(spark, [("the very same text", "a", None, "train"), ("the  very SAME text", "a", None, "test")]), TASK)
    none = curation.similarity.cross_matches
    monkeypatch.setattr(curation.similarity, "cross_matches", lambda *a: none(*a).filter("false"))
    rows = [*filler(3, "train", "t"), ("the very same text", "a", None, "train"), ("the  very SAME text", "a", None, "test")]
    with pytest.raises(CurateError, match=r"leak between splits \(train/test 1\)"):
        run(records(spark, rows), TASK)


SHAPE = {
    "type": "object", "properties": {"mail": {"type": "string", "pattern": "@"}, "host": {"type": "string", "maxLength": 5}, "free": {}}, "additionalProperties": False,
}


def test_scrubbed_answers_are_validated_again_and_fields_blamed(spark):
    say = lambda **v: json.dumps(v)
    rows = [
        (1, "mail a@example.org or b@example.org", say(mail="x@example.org", free="192.0.2.1"), say(free=["555-0142", {"x": "555-0143"}])),
        (2, "nothing", say(mail="@"), say(mail="x@example.org")), (3, None, None, None), (4, "nothing 12", say(free={"k": "4111 1111 1111 1111"}), "no json at 192.0.2.9"),
        (5, "192.0.2.1", say(host="1.2"), say(host="192.0.2.1", mail="y@example.org")),
    ]
    df = spark.createDataFrame(rows, "seq long, input string, teacher string, gold string").withColumn("found", F.lit(1))
    done = pii_stage.scrub_examples(df, SHAPE)
    got = {r["seq"]: r for r in done.collect()}
    assert [got[i]["text"] for i in range(1, 6)] == ["mail <EMAIL> or <EMAIL>", "nothing", None, "nothing 12", "<IPV4>"]
    assert [(got[i]["rejected"], got[i]["cleared"], got[i]["gold"] is None) for i in range(1, 6)] == [
        (True, False, False), (False, True, True), (False, False, True), (False, True, True), (False, True, True)
    ]
    assert json.loads(got[1]["gold"]) == {"free": ["<PHONE>", {"x": "<PHONE>"}]} and json.loads(got[4]["teacher"]) == {"free": {"k": "<CARD>"}}
    assert sorted((f["role"], f["path"], f["kind"], f["n"]) for f in got[1]["found"]) == [
        ("gold", "$.free[0]", "phone", 1), ("gold", "$.free[1].x", "phone", 1), ("input", "$", "email", 2), ("teacher", "$.free", "ipv4", 1), ("teacher", "$.mail", "email", 1),
    ]
    blame = {r["field"]: (r["teacher"], r["gold"], r["kinds"]) for r in pii_stage.blame(done).collect()}
    assert blame == {"mail": (1, 2, ["email"]), "host": (0, 1, ["ipv4"]), "$": (0, 1, ["ipv4"])}
    counts = done.agg(*[v.alias(k) for k, v in pii_stage.counters().items()]).first()
    assert (counts["input_email"], counts["gold_phone"], counts["gold_ipv4"], counts["teacher_card"], counts["input_ssn"]) == (2, 2, 2, 1, 0)
    assert (counts["examples_changed"], counts["rejected"], counts["gold_cleared"]) == (4, 1, 3)
    labels = {r["seq"]: r["teacher"] for r in pii_stage.scrub_examples(df).collect()}
    assert labels[1] == rows[0][2]  # answers of a labelling task are labels
    assert pii_stage.scrub_examples(df, SHAPE, kinds=("phone",)).filter("rejected OR cleared").count() == 0


def test_the_check_of_a_run_is_its_own(spark, monkeypatch):
    """What the run removes duplicates by can break without the check going blind."""
    monkeypatch.setattr(curation.similarity, "candidates", lambda *a, **k: pytest.fail("not here"))
    df = spark.createDataFrame([(1, "train", "a b c d e"), (2, "test", "a b c d e")], "seq long, split string, text string")
    assert leakage.leaks(df, "seq", "text", "split").count() == 1


def test_a_run_leaves_its_session_as_it_was(spark):
    """Spark's ML can't put a session that has observed something into its closures."""
    from pyspark.ml.feature import CountVectorizer

    run(records(spark, filler(3, "train", "t")), TASK)
    df = spark.createDataFrame([(["a", "b"],)], "w array<string>")
    assert CountVectorizer(inputCol="w", outputCol="c").fit(df).transform(df).count() == 1
