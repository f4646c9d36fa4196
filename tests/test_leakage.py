"""Leakage between splits, planted and counted by hand."""

import itertools
import random

import pytest

from gristmill.operators import leakage, similarity


def words(n, prefix="w"):
    return [f"{prefix}{i}" for i in range(n)]


def edited(ws, *places):
    return [f"{w}x" if i in places else w for i, w in enumerate(ws)]


def frame(spark, splits):
    rows = [(1000 * k + i, s, t) for k, (s, texts) in enumerate(splits.items()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, part string, text string")


def found(df, **more):
    return sorted((r["sa"], r["sb"], r["kind"], r["a"], r["b"], r["pairs"], round(r["jaccard"], 9)) for r in leakage.leaks(df, "id", "text", "part", **more).collect())


def test_each_way_to_leak_alone(spark):
    """One text in train; another split gets it changed in one way."""
    base = words(50, "leaf")
    ways = {
        "as it is": (base, ("exact", 1.0)), "in capitals": ([w.upper() for w in base], ("exact", 1.0)), "with more blanks": ([f" {w}\n" for w in base], ("exact", 1.0)),
        "its last word changed": (edited(base, 49), ("near", 47 / 49)), "cut by three words": (base[:47], ("near", 45 / 48)), "cut by ten words": (base[:40], None),
        "a word changed within": (edited(base, 20), None), "two ends changed": (edited(base, 0, 49), ("near", 46 / 50)), "another text": (words(50, "root"), None),
    }
    for part in ("valid", "test"):
        df = frame(spark, {"train": [" ".join(base)], part: [" ".join(v) for v, _ in ways.values()]})
        want = [(1000 + i, *w) for i, (_, w) in enumerate(ways.values()) if w]
        got = {(b, kind, j) for _, sb, kind, _, b, _, j in found(df) if sb == part}
        exact = [b for b, kind, _ in want if kind == "exact"]
        assert got == {(b, kind, round(j, 9)) for b, kind, j in want if kind == "near"} | {(min(exact), "exact", 1.0)}
        assert {r["kind"]: r["pairs"] for r in leakage.report(leakage.leaks(df, "id", "text", "part")).filter(f"sb = '{part}' AND sa = 'train'").collect()} == {
            "exact": len(exact), "near": len(want) - len(exact)
        }
    clean = frame(spark, {"train": [" ".join(words(9, "p")), "no"], "valid": [" ".join(words(9, "q")), "no?"], "test": [" ".join(words(9, "r"))]})
    assert found(clean) == [] and {r["pairs"] for r in leakage.report(leakage.leaks(clean, "id", "text", "part")).collect()} == {0}


def test_the_threshold_counts_as_reached(spark):
    """20 runs of 22 are 10 / 11."""
    df = frame(spark, {"valid": [" ".join(words(24))], "test": [" ".join(words(22))]})
    assert found(df, threshold=10 / 11) == [("valid", "test", "near", 0, 1000, 1, round(10 / 11, 9))] and found(df, threshold=0.91) == []


def test_copies_are_counted_not_paired(spark, monkeypatch):
    a, b = " ".join(words(30)), " ".join(edited(words(30), 29))
    df = frame(spark, {"train": [a] * 700 + [b] * 3, "valid": [a] * 40, "test": [b] * 500 + ["x"]})
    assert found(df) == [
        ("train", "test", "exact", 700, 2000, 1500, 1.0), ("train", "test", "near", 0, 2000, 350_000, round(27 / 29, 9)),
        ("train", "valid", "exact", 0, 1000, 28_000, 1.0), ("train", "valid", "near", 700, 1000, 120, round(27 / 29, 9)),
        ("valid", "test", "near", 1000, 2000, 20_000, round(27 / 29, 9)),
    ]


@pytest.mark.parametrize("together", [256, 4])
def test_hot_buckets_are_split_without_losing_a_pair(spark, monkeypatch, together):
    monkeypatch.setattr(leakage, "TOGETHER", together)
    rng = random.Random(1)
    texts = [" ".join([*words(59), f"z{rng.randrange(50)}"]) for _ in range(60)] + [" ".join(words(rng.randint(3, 40), f"q{i}")) for i in range(40)]
    parts = [("train", "valid", "test")[rng.randrange(3)] for _ in texts]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(zip(parts, texts, strict=True))], "id long, part string, text string")
    runs = [{" ".join(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    order = {"train": 0, "valid": 1, "test": 2}
    want = {"exact": 0, "near": 0}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if order[parts[i]] != order[parts[j]]:
            if texts[i] == texts[j]:
                want["exact"] += 1
            elif len(runs[i] & runs[j]) >= 0.9 * len(runs[i] | runs[j]):
                want["near"] += 1
    got = {"exact": 0, "near": 0}
    for r in leakage.report(leakage.leaks(df, "id", "text", "part")).collect():
        got[r["kind"]] += r["pairs"]
    assert got == want and want["near"] > 300


def test_it_uses_nothing_of_the_other_path(spark, monkeypatch):
    def fail(*args, **kwargs):
        raise AssertionError("the check must not use what it checks")

    for name in ("sets", "candidates", "verified", "near_pairs", "components", "cross_matches", "lsh_bands"):
        monkeypatch.setattr(similarity, name, fail)
    text = words(40)
    df = frame(spark, {"train": [" ".join(text), "same words here"], "test": [" ".join(edited(text, 39)), "same words  HERE"]})
    assert [x[2] for x in found(df)] == ["exact", "near"]


def test_odd_rows_and_thresholds(spark):
    rows = [(1, "train", None), (2, None, "a b c d"), (3, "other", "a b c d"), (4, "train", "a b c d"), (5, "test", ""), (6, "train", ""), (6, "train", "")]
    df = spark.createDataFrame(rows, "id long, part string, text string")
    assert found(df) == [("train", "test", "exact", 6, 5, 2, 1.0)]
    assert found(df.limit(0)) == []
    bands, size = leakage.band_shape(0.9)
    assert (1 - 0.9**size) ** bands <= 1e-6 < (1 - 0.9 ** (size + 1)) ** (256 // (size + 1))
    for bad in (0, 1.5, 0.01):
        with pytest.raises(ValueError, match="threshold"):
            leakage.band_shape(bad)
