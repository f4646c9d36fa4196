"""Context-tree weighting against trees that are built and walked node by node."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.llm import context_tree
from gristmill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def small(text):
    return (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def plain_scores(texts, learn, depth):
    """log10 of the probability of each text and its end, by recursion."""
    counts, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    steps = lambda b, i: [((1 << k) | (b[i] >> (8 - k)), (b[i] >> (7 - k)) & 1) for k in range(8)]
    marked = [b"\xff" * depth + t + b"\xff" for t in texts]
    for b, own in zip(marked, learn, strict=True):
        for i in range(depth, len(b) if own else 0):
            for d in range(depth + 1):
                for node, bit in steps(b, i):
                    counts[b[i - d : i], node][bit] += 1
    for context, node in counts:
        if context:
            below[context[1:], node].add(context)
    known = {}

    def weighted(context, node):
        if (context, node) not in known:
            a, b = counts[context, node]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(context) == depth:
                known[context, node] = own, 1.0
            else:
                rest = sum(weighted(c, node)[0] for c in below[context, node])
                most = max(own, rest)
                log = most + math.log(math.exp(own - most) + math.exp(rest - most)) - math.log(2)
                known[context, node] = log, math.exp(own - math.log(2) - log)
        return known[context, node]

    def one(context, node, d=0):
        own = context[len(context) - d :]
        if (own, node) not in counts:
            return 0.5
        a, b = counts[own, node]
        estimate = (b + 0.5) / (a + b + 1)
        if d == depth:
            return estimate
        w = weighted(own, node)[1]
        return w * estimate + (1 - w) * one(context, node, d + 1)

    out = []
    for b in marked:
        p = [(one(b[i - depth : i], node), bit) for i in range(depth, len(b)) for node, bit in steps(b, i)]
        out.append(sum(math.log10(x if bit else 1 - x) for x, bit in p))
    return out


@pytest.mark.parametrize("depth", [3, 5, 6])
def test_scores_are_those_of_the_plain_trees(spark, depth):
    rng = random.Random(2)
    words = ["the", "THE", "cat", "é", "sat on", "a", "mat.", "x" * 9]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.random() < 0.7) for i in range(40)]
    rows += [(None, None, True), (99, "", None), (7, "the cat", True), (7, "the cat", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score boolean").repartition(3)
    got = context_tree.score_texts(docs, F.col("score"), depth).collect()
    want = plain_scores([small(t) for _, t, _ in rows], [bool(x) for _, _, x in rows], depth)
    have = sorted(((str(r["doc_id"]), r["score"], r["n_bytes"]) for r in got))
    wish = sorted(((str(i), s) for (i, _, _), s in zip(rows, want, strict=True)))
    assert [x[0] for x in have] == [x[0] for x in wish]
    # No byte's code length is off by more than half a part.
    assert all(abs(s - w) < (n + 1) / 2 / context_tree.PARTS * math.log10(2) + 1e-9 * -w + 1e-6 for (_, s, n), (_, w) in zip(have, wish, strict=True))


def test_pieces_of_a_long_text_add_up(monkeypatch):
    def strings():
        found = Counter()
        for keys, first, text in context_tree.strings_of([b"abc abd " * 40, b"abd", b""], 6):
            for key, a, b in zip(keys.tolist(), first, [*first[1:], len(text)], strict=True):
                found.update((key, t) for t in text[a:b].tolist())
        return found

    whole = strings()
    monkeypatch.setattr(context_tree, "PIECE", 50)
    assert strings() == whole and whole.total() == 321 + 4 + 1


def test_nothing_to_learn_from_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in context_tree.score_texts(docs, F.lit(False)).collect()}
    assert [(got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["base_score"], got[i]["bits_per_byte"]) for i in (1, 2)] == [
        (3, 0, 0, 0.0, 8.0), (1, 0, 0, 0.0, 8.0)
    ]
    assert context_tree.score_texts(docs.filter("doc_id > 9"), F.lit(True)).collect() == []


def test_op12_base_is_brute_force_and_the_model_codes_held_out_texts_better(spark):
    rows = {r["doc_id"]: small(r["text"]).split() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in rows}
    counts = Counter(w for d, t in rows.items() if not held[d] for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in QUERIES["op12_context_tree"](spark, DATA).collect()}
    assert set(got) == set(rows)
    for d, words in rows.items():
        r, own = got[d], [counts[w] for w in [*words, None]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(own), sum(c > 0 for c in own), n)
        want = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in own)
        assert abs(r["base_score"] - want) < 1e-9 * max(1, -want)
    rest = [r for r in got.values() if r["held_out"]]
    assert sum(r["bits_per_byte"] for r in rest) / len(rest) < 3
