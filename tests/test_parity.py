"""The bound by bits: it loses no pair, and leaves few that are far apart."""

import itertools
import random

from gristmill.operators import parity, similarity


def test_no_near_pair_is_lost_and_far_ones_go(spark):
    rng = random.Random(3)
    number = lambda: rng.randrange(-(2**63), 2**63)
    sets, base = {}, [[number() for _ in range(n)] for n in (1, 10, 40, 600)]
    for i in range(80):
        own = base[i % 4]
        gone = rng.randrange(1 + len(own) // 8)
        sets[f"s{i:02}"] = sorted({*own[gone:], *(number() for _ in range(rng.randrange(2)))})
    pairs = list(itertools.combinations(sets, 2))
    jaccard = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a, b in pairs}
    df = spark.createDataFrame([(k, v, len(v)) for k, v in sets.items()], "id string, runs array<bigint>, n int")
    asked = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (0.9, 0.95, 1.0):
        left = {(r["a"], r["b"]) for r in parity.close(asked, df, threshold).collect()}
        near = {p for p in pairs if jaccard[p] >= threshold}
        assert near <= left and near
        far = {p for p in pairs if jaccard[p] < threshold - 0.1 and len(sets[p[0]]) > 9}
        assert far and len(left & far) < len(far) / 20


def test_only_sets_of_near_pairs_are_moved(spark, monkeypatch):
    moved = []
    ids_of = parity.ids_of
    monkeypatch.setattr(parity, "ids_of", lambda pairs: moved.append({r["id"] for r in ids_of(pairs).collect()}) or ids_of(pairs))
    rng = random.Random(5)
    sets = [[rng.randrange(2**62) for _ in range(300)] for _ in range(20)]
    sets.append(sets[0][1:])
    df = spark.createDataFrame([(i, sorted(v), len(v)) for i, v in enumerate(sets)], "id long, runs array<bigint>, n int")
    every = spark.createDataFrame(list(itertools.combinations(range(21), 2)), "a long, b long")
    assert [(r["a"], r["b"]) for r in similarity.verified(every, df, 0.9).collect()] == [(0, 20)]
    assert moved == [set(range(21)), {0, 20}]
