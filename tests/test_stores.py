"""Lookups in the stores where two calls ask the same."""

import hashlib

import pytest

from gristmill import registry
from gristmill.operators.bookkeeping import collected

registry.load()


@pytest.fixture(scope="module")
def same(spark, tmp_path_factory):
    """Calls 0 to 12, all with one request for each model: only the id tells them apart."""
    path = tmp_path_factory.mktemp("stores")
    turns = [(i, t, role, "hi") for i in range(13) for t, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_a_call_is_not_cached_because_another_asked_the_same__collect_records(spark, same):
    assert sorted(r["id"] for r in registry.QUERIES["collect_records"](spark, same).collect()) == [0, 2, 4, 6, 8, 10, 12]


def test_a_call_is_not_cached_because_another_asked_the_same__uncached_flags(spark, same):
    assert sorted(r["id"] for r in registry.QUERIES["uncached_flags"](spark, same).collect()) == [1, 3, 5, 7, 9, 11]


def test_a_call_is_not_cached_because_another_asked_the_same__teacher_lookup(spark, same):
    got = {r["id"]: r["found"] for r in registry.QUERIES["teacher_lookup"](spark, same).collect()}
    assert got == {i: "cache" if i % 2 == 0 else "recording" if i % 3 == 0 else None for i in range(13)}


def test_records_are_collected_by_key_and_context__collect_records(spark, tmp_path):
    """Even calls are cached, those with id % 5 = 1 under another context. 3 asks what 6 does, 9 what 15 does, 5 what 11 does (% 3 is the model)."""
    says = {3: "as six", 6: "as six", 9: "as fifteen", 15: "as fifteen", 5: "as eleven", 11: "as eleven"}
    turns = [(i, 0, "user", says.get(i, f"own {i}")) for i in range(17)] + [(i, 1, "assistant", f"said {i}") for i in range(17)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["id"]: r for r in registry.QUERIES["collect_records"](spark, str(tmp_path)).collect()}
    found = {k: sorted(i for i, r in got.items() if r["found"] == k) for k in ("cached", "elsewhere", "missing")}
    assert found == {"cached": [0, 2, 4, 6, 8, 10, 12, 14, 16], "elsewhere": [1, 5], "missing": [7, 9, 13]}
    assert got[4]["answer_sha256"] == hashlib.sha256(b"said 4").hexdigest() and got[0]["answer_sha256"] is None  # 0: no response was kept


def test_a_key_is_collected_once_under_its_own_context(spark):
    frame = lambda rows, more="": spark.createDataFrame(rows, "id long, key string, context string" + more)
    wanted = frame([(5, "a", "x"), (3, "a", "x"), (4, "a", "y"), (1, "b", "x"), (2, "c", "x")])
    held = frame([(7, "a", "x", "A"), (8, "b", "y", "B"), (9, "z", "x", "Z")], ", answer string")
    got = {(r["id"], r["key"], r["found"], r["answer"]) for r in collected(wanted, held).collect()}
    assert got == {(7, "a", "cached", "A"), (4, "a", "elsewhere", None), (1, "b", "elsewhere", None), (2, "c", "missing", None)}
