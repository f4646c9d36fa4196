"""Queries that do the whole job, against rows worked out by hand on small tables."""

import numpy as np

from gristmill import registry
from gristmill.operators import baseline, splits

registry.load()


def tables(spark, path, rows):
    """documents and labels of rows (doc_id, text, lang, quality or None), and no conversations, as a folder of tables."""
    d = [(i, text, lang, "web", len(text)) for i, text, lang, _ in rows]
    spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    q = [(i, quality, 0) for i, _, _, quality in rows if quality is not None]
    spark.createDataFrame(q, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_bakeoff_inputs_are_valid_hashes_with_a_majority_gold(spark, tmp_path):
    """doc_id % 6 gives the split: 0 and 4 train, 1 and 3 valid, 2 test, 5 none."""
    rows = [
        (1, "taken  by test", "fr", 1), (2, "taken by test", "de", 1),
        (6, "train too", "fr", 1), (7, "train too", "fr", 0), (9, " train\ttoo ", "de", 1),
        (13, "a tie", "fr", 1), (15, "a tie", "fr", 0),
        (19, "no gold", "fr", None), (21, "  ", "fr", 1), (12, "only train", "fr", 1), (25, "alone", "es", 0), (194, "of a language", "fr", 1), (195, "kept", "fr", 1),
        (29, "no split", "fr", 0), (30, "only train", "fr", 0),
    ]
    got = registry.QUERIES["bakeoff_inputs"](spark, tables(spark, tmp_path, rows)).collect()
    assert sorted((r["id"], r["gold"]) for r in got) == [(6, "1"), (25, "0"), (195, "1")]
    assert len({r["h"] for r in got}) == 3


def test_baseline_takes_every_term_with_sublinear_weights_and_the_whole_grid(spark):
    rows = [("Äpfel a äpfel birne", "1"), ("birne birne birne " + " ".join(f"w{i}" for i in range(5000)), "0"), ("äpfel neu", "1"), ("birne alt", "0")]
    train = spark.createDataFrame(rows, "text string, label string")
    model, c, scores = baseline.tfidf_baseline(train, train)
    words = {"äpfel", "birne", "neu", "alt"} | {f"w{i}" for i in range(5000)}
    pairs = {"äpfel äpfel", "äpfel birne", "birne birne", "birne w0", "äpfel neu", "birne alt"} | {f"w{i} w{i + 1}" for i in range(4999)}
    assert model.numFeatures == len(words) + len(pairs) and model.numClasses == 2
    assert [r["c"] for r in scores.orderBy("c").collect()] == [0.1, 0.3, 1.0, 3.0, 10.0, 30.0]
    got = baseline.features(train)(train).first()["__x"].values
    idf = lambda df: 1 + np.log(5 / (1 + df))
    want = np.array([(1 + np.log(2)) * idf(2), idf(3), idf(1), idf(1)])
    assert np.allclose(sorted(got), sorted(want / np.linalg.norm(want)))


def test_quick_subset_hands_on_what_a_language_lacks(spark, tmp_path):
    sizes = {"a": 3, "b": 90, "c": 30, "d": 25}
    rows = [(i, "x", lang, None) for i, lang in enumerate(k for k, n in sizes.items() for _ in range(n))]
    got = registry.QUERIES["quick_subset"](spark, tables(spark, tmp_path, rows)).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"a": 3, "b": 26, "c": 26, "d": 25}


def test_water_quota(spark):
    def quota(size, **n):
        df = spark.createDataFrame(list(n.items()), "label string, n long")
        return {r["label"]: r["quota"] for r in splits.water_quota(df, "label", "n", size).collect()}

    assert quota(80, a=3, b=90, c=30, d=30) == {"a": 3, "b": 26, "c": 26, "d": 25}
    assert quota(8, a=1, b=5, c=5) == {"a": 1, "b": 4, "c": 3}
    assert quota(9, a=1, b=2) == {"a": 1, "b": 2}


LONG = " ".join(f"l{i}" for i in range(501))


def test_stages_are_chained_and_emptied_splits_found(spark, tmp_path):
    """Ids are those of pairs (not % 3 = 0) unless said; % 6: 1 and 3 valid, 2 test, 4 train."""
    rows = [
        (4, "one two three four", "fr", 1), (10, "ONE two three four", "fr", 1), (16, "a copy across", "fr", 0), (2, "A copy across", "fr", 0),
        (22, "told apart", "fr", 0), (34, "Told apart", "fr", 1), (1, LONG, "fr", 1), (40, "kept of train", "fr", 1),
    ]
    path = tables(spark, tmp_path, rows)
    got = {(r["name"], r["split"]): r["n"] for r in registry.QUERIES["stage_counters"](spark, path).collect()}
    assert [got[s, None] for s in ("load", "extract", "merge", "vote", "pii")] == [8] * 5
    by = {s: tuple(got[s, k] for k in ("train", "valid", "test")) for s in ("split", "dedupe", "cross_split", "label", "length", "leakage")}
    assert by == {"split": (6, 1, 1), "dedupe": (3, 1, 1), "cross_split": (2, 1, 1), "label": (2, 1, 1), "length": (2, 0, 1), "leakage": (2, 0, 1)}
    found = {r["split"]: (r["name"], r["reason"]) for r in registry.QUERIES["emptied_at"](spark, path).collect()}
    assert found == {"train": (None, None), "test": (None, None), "valid": ("length", "every row is longer than 500 tokens")}


def test_baseline_has_the_optimum_as_a_table_of_terms(spark):
    """At the optimum a coefficient is C times the sum, over the rows, of how far they are off times their weight of the term."""
    texts = ["red apple pie", "green apple", "red wine and red meat", "green tea and apple pie", "tea", "wine and meat", "..."]
    for said in ("1011010", "0120120"):
        rows = [(t, k) for t, k in zip(texts, said, strict=True)]
        train = spark.createDataFrame(rows, "text string, label string")
        model, c, _ = baseline.tfidf_baseline(train, train)
        got = {r["term"]: r["w"].toArray() for r in model.coefficients.collect()}
        assert len(got) == model.numFeatures and model.numClasses == len(set(said))
        terms = {t: [w for w in t.replace(".", "").split()] for t in texts}
        counts = [[*ws, *map(" ".join, zip(ws, ws[1:], strict=False))] for ws in terms.values()]
        df = {t: sum(t in x for x in counts) for t in got}
        x = np.array([[(1 + np.log(r.count(t))) * (1 + np.log(8 / (1 + df[t]))) if t in r else 0.0 for t in got] for r in counts])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        w, classes = np.array(list(got.values())), model.labels[1:] if len(model.labels) == 2 else model.labels
        y = np.array([[float(k == s) for s in classes] for k in said])
        b = baseline._step(x @ w, np.zeros_like(y), y, c, np.zeros(y.shape[1]), 0.0, 1.0)[1]
        assert np.abs(w - c * x.T @ (y - baseline._chances(x @ w + b)[0])).max() < 1e-3


def test_baseline_passes_read_no_terms_of_one_row_and_no_other_rows(spark, monkeypatch):
    """Terms of one training row are a number of that row; rows that aren't trained on come in at the end, with what they share."""
    train = [("red apple red", "1"), ("green apple", "0"), ("red wine", "1"), ("blue", "0"), ("green green tea", None)]
    valid = [("apple tea", "0"), ("wine unheard", "1"), ("unheard", "1"), ("red blue red", "1"), ("green", "0")]
    texts, said = zip(*train, *valid, strict=True)
    ours = np.arange(len(texts)) < len(train)
    words = [t.split() for t in texts]
    counts = [[*w, *map(" ".join, zip(w, w[1:], strict=False))] for w in words]
    terms = sorted({t for r in counts[: len(train)] for t in r})
    tf = np.array([[r.count(t) for t in terms] for r in counts])
    df = (tf[ours] > 0).sum(0)
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (1 + np.log(6 / (1 + df)))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    y = np.array([[float(s == "1")] for s in said])
    fitted = ours & np.array([s is not None for s in said])
    want = {}
    for c, (w, _, b) in zip(baseline.GRID, baseline.fit(lambda a: x @ (x.T @ a), y, fitted, baseline.GRID), strict=True):
        want[c] = float((((x @ (x.T @ w) + b)[~ours, 0] > 0) == (y[~ours, 0] > 0)).mean())
    read = []
    monkeypatch.setattr(baseline, "_blocks", lambda *a, make=baseline._blocks: read.append(make(*a)) or read[0])
    frame = lambda rows: spark.createDataFrame(rows, "text string, label string")
    model, _, scores = baseline.tfidf_baseline(frame(train), frame(valid))
    assert {r["c"]: r["agreement"] for r in scores.collect()} == want and model.numFeatures == len(terms)
    several = (df > 1) | ((df == 1) & (tf[~ours] > 0).any(0))
    block = read[0].selectExpr("sum(length(x)) div 8 x", "sum(length(v_x)) div 8 v", "sum(length(lone_x)) div 8 lone").first()
    assert tuple(block) == ((tf[ours][:, several] > 0).sum(), (tf[~ours][:, several] > 0).sum(), (~several).sum())
    a = np.where(ours, np.arange(1.0, len(texts) + 1), 0)[:, None]
    apart = x[:, several] @ (x[:, several].T @ a)
    rows = [r["text"] for r in baseline.numbered(frame(train).unionByName(frame(valid))).orderBy("__row").collect()]
    assert rows == list(texts)
    norm = np.sqrt(baseline._squares(read[0], len(texts))[:, :1])
    norm[norm == 0] = 1
    assert np.allclose(baseline._gram(read[0], a / norm)[ours] / norm[ours], apart[ours])
    assert np.allclose(baseline._others(read[0], a / norm)[~ours] / norm[~ours], apart[~ours])
