"""Periodic runs against a search of every period from every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from gristmill.llm.periodic import find_runs, runs_of
from gristmill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_runs(words, shortest=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            x = words[s : i + q]
            if len(x) >= max(shortest, times * q) and not any(x[p:] == x[: len(x) - p] for p in range(1, q)):
                out.append((s, len(x), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_texts_are_those_of_the_plain_search():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = []
            for _ in range(rng.randint(0, 8)):
                kinds = rng.choice([1, 2, 3, 50])
                part = [rng.randint(0, kinds) for _ in range(rng.randint(1, 30))]
                words += (part * rng.randint(1, 12))[: rng.randint(0, 120)]
            texts.append(words)
        word, counts = np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts])
        got = list(zip(*(x.tolist() for x in runs_of(word, counts)), strict=True))
        assert got == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_long_texts_of_one_period_are_one_run():
    for period, n in ((1, 50_000), (3, 40_000), (7000, 30_000)):
        got = runs_of(np.arange(n) % period, np.array([n]))
        assert [x.tolist() for x in got] == [[0], [0], [n], [period]]


def test_op11_is_brute_force(spark):
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        words, h = (r["text"] or "").encode().split(), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want[r["doc_id"]] = (
            len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
        )
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 10


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "a " * 30, 3), (1, "a " * 30, 3), (2, "b\t" * 23, 4), (3, "x y\n" * 12 + "x", 5), (4, "  " * 24, 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs int")
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in find_runs(docs).collect())
    assert got == [
        ("1", 0, [], ""), ("1", 30, [(0, 30, 1)], "a"), ("1", 30, [(0, 30, 1)], "a"), ("2", 23, [], " ".join("b" * 23)),
        ("3", 25, [(0, 25, 2)], "x y"), ("4", 24, [(0, 24, 1)], " "), ("None", 0, [], ""),
    ]
    assert find_runs(docs.filter(F.lit(False))).collect() == []
