"""Stages that compare the same texts share their sets: what was hashed once is not read again."""

from gristmill.operators import similarity


def test_pairs_and_matches_come_from_sets_without_texts(spark):
    long = [f"w{i}" for i in range(40)]
    texts = [" ".join(long), " ".join(long).upper(), " ".join([*long[:39], "x"]), "of two", "Of  two", "alone in this"]
    rows = [(10 * k + i, t, s) for k, s in enumerate(("train", "valid")) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (99, None, "test")], "id long, text string, split string")
    known = similarity.hashed(df, "id", "text", "split")
    bare = df.drop("text")
    for want, got in (
        (similarity.near_pairs(df, "id", "text", within="split"), similarity.near_pairs(bare, "id", "text", within="split", known=known)),
        (similarity.cross_matches(df, "id", "text", "split"), similarity.cross_matches(bare, "id", "text", "split", known=known)),
    ):
        rows = sorted(map(tuple, want.collect()))
        assert rows == sorted(map(tuple, got.collect())) and {r[2] for r in rows} == {"exact", "near"} or {r[2] for r in rows} == {"exact"}
