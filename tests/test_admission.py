"""Admission under caps against folding the entries one by one."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import admission
from gristmill.operators.admission import Cap, admit


def plain(rows, caps):
    """rows: (id, order, need, run, task, closed, charged); caps: (name, limit, index of the group or None)."""
    events = []
    for r in rows:
        events.append((r[1], 1, r[0], r))
        if r[5] is not None and r[5] >= r[1]:
            events.append((r[5], 2 if r[5] == r[1] else 0, r[0], r))
    held, out = {}, {}
    for _, kind, i, r in sorted(events, key=lambda e: e[:3]):
        groups = [(name, None if g is None else r[g]) for name, _, g in caps]
        if kind == 1:
            before = [held.get(g, 0) for g in groups]
            crossed = [name for (name, limit, _), h in zip(caps, before, strict=True) if limit is not None and h + r[2] > limit]
            out[i] = (not crossed, crossed, dict(zip([c[0] for c in caps], before, strict=True)))
        if out[i][0]:
            for g in groups:
                held[g] = held.get(g, 0) + (r[2] if kind == 1 else (r[6] or 0) - r[2])
    return out


SCHEMA = "id long, at long, need long, run string, task string, closed long, charged long"


def check(spark, rows, limits):
    caps = [Cap("global", limits[0]), Cap("task", limits[1], ("task",)), Cap("run", limits[2], ("run", "task"))]
    df = spark.createDataFrame([(*r[:3], *[str(x) if x is not None else None for x in r[3:5]], *r[5:]) for r in rows], SCHEMA)
    got = {r["id"]: (r["accepted"], r["crossed"], r["committed"]) for r in admit(df, caps, order="at", closed="closed", charged="charged").collect()}
    flat = [(*r[:3], (r[3], r[4]), r[4], *r[5:]) for r in rows]
    assert got == plain(flat, [("global", limits[0], None), ("task", limits[1], 4), ("run", limits[2], 3)])
    return got


@pytest.mark.parametrize("fold", [20_000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_admission_is_the_fold(spark, monkeypatch, fold, seed):
    monkeypatch.setattr(admission, "FOLD", fold)
    rng = random.Random(seed)
    rows = []
    for i in range(60 if not fold else 600):
        at = rng.randrange(200)
        closed = rng.choice([None, at, at + rng.randrange(60)])
        rows.append((i, at, rng.choice([0, 1, 5, 20, 60]), rng.choice(["r1", "r2", "r3", None]), rng.choice(["a", "b"]), closed, rng.choice([0, 3, 80, None])))
    got = check(spark, rows, (300, 200, 90) if fold else (150, 100, 60))
    assert {True, False} == {x[0] for x in got.values()} and any(len(x[1]) > 1 for x in got.values())


def test_a_cap_is_met_exactly_and_every_crossed_one_is_named(spark):
    def run(needs, *caps):
        df = spark.createDataFrame([(i, n, "t") for i, n in enumerate(needs)], "id long, need long, task string")
        return [(r["accepted"], r["crossed"]) for r in admit(df, caps).orderBy("id").collect()]

    cents = [10_000_000] * 130
    assert sum(ok for ok, _ in run(cents, Cap("global", 1_000_000_000))) == 100
    assert sum(ok for ok, _ in run(cents, Cap("global", 370_000_000))) == 37
    assert run([100_000_000, 200_000_000, 1, 0], Cap("global", 300_000_000)) == [(True, []), (True, []), (False, ["global"]), (True, [])]
    assert run([900, 200], Cap("global", 1000), Cap("task", 500, ("task",)), Cap("run", F.lit(500), ("id",))) == [(False, ["task", "run"]), (True, [])]
    assert run([900, 200], Cap("global", 1000), Cap("task", F.lit(None), ("task",))) == [(True, []), (False, ["global"])]
    with pytest.raises(ValueError, match="no column"):
        run([1], Cap("run", 1, ("nothing",)))


def test_charges_replace_reservations_and_releases_free_them(spark):
    rows = [(1, 1, 70, "r", "t", 5, 0), (2, 2, 40, "r", "t", None, None), (3, 3, 30, "r", "t", 6, 12), (4, 5, 71, "r", "t", None, None), (5, 7, 88, "r", "t", None, None)]
    got = check(spark, rows, (100, 500, 500))
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == [True, False, True, False, True]


def test_no_rows_and_null_amounts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 5, None)], "id long, need long, accepted string")
    got = admit(df, [Cap("global", 4)])
    assert [(r["id"], r["accepted"]) for r in got.orderBy("id").collect()] == [(1, True), (2, False)]
    assert admit(df.limit(0), [Cap("global", 4)]).collect() == []


def test_rounds_are_few_where_bounds_decide_little(spark, monkeypatch):
    """Amounts come back as fast as they are reserved, so bounds decide a few entries a round; each round folds FOLD besides."""
    monkeypatch.setattr(admission, "FOLD", 25)
    rounds, one = [], admission._round
    monkeypatch.setattr(admission, "_round", lambda *a: rounds.append(1) or one(*a))
    check(spark, [(i, i, 5 + i % 7, "r", "a", i + 3, 0) for i in range(60)], (20, 20, 20))
    assert len(rounds) <= 60 // 25 + 1
