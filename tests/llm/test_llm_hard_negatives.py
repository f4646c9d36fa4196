"""Hard negatives against sorting every row for every anchor."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.llm import hard_negatives
from gristmill.llm.hard_negatives import labelled_vectors, mine
from gristmill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def plain(rows, anchors, positives=5, k=5, share=(80, 100)):
    """rows: (id, label, whole components)."""
    out = []
    for a, label, q in sorted({(i, c, tuple(v)) for i, c, v in rows if anchors(i)}):
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, c) for i, c, v in rows if i != a and len(v) == len(q))
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and share[0] * -s <= 100 * -r[0] <= share[1] * -s][:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fits)]
    return sorted(out)


def whole(x, scale=256):
    return [math.floor(scale * float(c)) for c in x]


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(3)
    middle = [[rng.gauss(0, 20) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(1500):
        m = rng.randrange(5)
        rows.append((i, m if rng.random() < 0.8 else rng.randrange(5), [round(c + rng.gauss(0, 8)) for c in middle[m]]))
    rows += [(1500 + i, i % 3, rows[7][2]) for i in range(700)]  # a third are one vector
    return rows


@pytest.mark.parametrize(("block", "leaf", "cells"), [(4096, 256, None), (128, 16, 16), (10_000, 10_000, 1)])
def test_rows_are_those_of_the_plain_search(spark, monkeypatch, random_rows, block, leaf, cells):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("ANCHORS", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    df = spark.createDataFrame(random_rows, "vec_id long, label int, v array<long>")
    got = sorted(tuple(r) for r in mine(df, F.col("vec_id") % 100 == 0, cells=cells).collect())
    want = plain(random_rows, lambda i: i % 100 == 0)
    assert got == want and len(want) > 300


def test_cells_are_bounded_out_and_leaves_left_unread(random_rows):
    import numpy as np

    x = np.array([v for _, _, v in random_rows[:1500]], float)
    longest = int((x * x).sum(1).max())
    flat = hard_negatives._augmented(x, longest)
    router = hard_negatives.Router.of(flat[:400], 4)
    cell, way = router.route(flat)
    near, far = (np.array([f(way[cell == c], 0) if (cell == c).any() else way[0] for c in range(16)]) for f in (np.min, np.max))
    low, high = hard_negatives.Cells(router.points, router.above(), near, far).scores(x[:50], longest)
    s = x[:50] @ x.T
    for c in range(16):
        if (cell == c).any():
            assert (low[:, c] <= s[:, cell == c].min(1)).all() and (s[:, cell == c].max(1) <= high[:, c]).all()
    assert (high < np.sort(s, 1)[:, [-10]]).mean() > 0.3  # of cells and anchors: cells without one of the ten best
    order, leaves, cells = hard_negatives._local_tree(flat)
    assert sorted(order) == list(range(1500)) and [a for a, _ in leaves] + [1500] == [0] + [b for _, b in leaves]
    low, high = cells.scores(x[:50], longest)
    for i, (a, b) in enumerate(leaves):
        assert (low[:, i] <= s[:, order[a:b]].min(1)).all() and (s[:, order[a:b]].max(1) <= high[:, i]).all()


def test_op13_is_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    known = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], whole(r["embedding"])) for r in rows]
    got = sorted(
        (r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
        for r in QUERIES["op13_hard_negatives"](spark, DATA).collect()
    )
    assert got == plain(known, lambda i: i % 100 == 0) and got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0], "x"), (0, 1, [1.0, 0.0], "y"), (1, 1, [0.9, 0.1], "x"), (1, 1, [0.9, 0.1], "x"), (2, 2, [0.8, 0.0], "x"), (3, 2, [0.8, 0.5], "x"),
        (4, None, [1.0, 0.0], "x"), (5, 2, None, "x"), (6, 2, [None, 1.0], "x"), (7, 2, [nan, 1.0], "x"), (8, 2, [inf, 1.0], "x"), (None, 2, [0.8, 0.0], "x"),
        (9, 2, [], "x"), (10, 2, [0.8, 0.0, 0.0], "x"), (100, 3, [-1.0, 0.0], "x"), (11, 3, [1.0, 0.0], None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, cell string").withColumnRenamed("cell", "windows")
    vectors = labelled_vectors(df)
    sound = [(r["vec_id"], r["label"], list(r["v"])) for r in vectors.collect()]
    assert sorted(i for i, _, _ in sound) == [0, 0, 1, 1, 2, 3, 10, 11, 100]
    got = sorted(tuple(r) for r in mine(vectors, F.col("vec_id") % 100 == 0).collect())
    assert got == plain(sound, lambda i: i % 100 == 0) and got
    assert mine(vectors.filter("vec_id > 1000"), F.col("vec_id") % 100 == 0).collect() == []
    assert mine(vectors, F.col("vec_id") > 1000).collect() == []
    long = spark.createDataFrame([(1, 1, [2**31, 2**31]), (2, 1, [1, 1])], "vec_id long, label int, v array<long>")
    with pytest.raises(ValueError, match="too long"):
        mine(long, F.col("vec_id") == 1)
