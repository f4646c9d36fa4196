"""Leakage between splits: a check of its own, by banded MinHash, of what the removal of duplicates should have left.

It shares the definitions of a text's key and of Jaccard similarity with `similarity`, and nothing of how pairs are found there.
Texts of one key are one node with a count for each split, so copies, however many, are never paired one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import parity
from gristmill.sources.shared import materialize

SPLITS = ("train", "valid", "test")
#: Values of a sketch; how likely a pair at the threshold may be missed; nodes of a bucket that meet in one task; runs
#: hashed at once.
VALUES, MISS, TOGETHER, RUNS_AT_ONCE = 256, 1e-6, 256, 4096
_RANDOM = np.random.default_rng(20240229)
_FACTOR = _RANDOM.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSET = _RANDOM.integers(0, 2**63, VALUES, dtype=np.uint64)


def band_shape(threshold: float) -> tuple[int, int]:
    """(bands, values in a band): the longest bands that miss a pair at the threshold with a probability of MISS at most."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and not above 1")
    for size in range(VALUES // 2, 0, -1):
        bands = VALUES // size
        if (1 - threshold**size) ** bands <= MISS:
            return bands, size
    raise ValueError("the threshold is too low for so few values")


def sketch(runs: np.ndarray) -> np.ndarray:
    """The least of VALUES hashes over a set of 64-bit numbers."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(runs), RUNS_AT_ONCE):
        x = runs[at : at + RUNS_AT_ONCE].astype(np.uint64)[:, None] * _FACTOR + _OFFSET
        least = np.minimum(least, ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).min(0))
    return least


def _nodes(df: DataFrame, id_: str, text: str, split: str) -> DataFrame:
    """(node, runs, n, held): a row for each key; held: its splits with their rows and the smallest id there."""
    df = df.filter(F.col(text).isNotNull() & F.col(split).isNotNull()).select(tx.dedupe_key(text).alias("key"), F.col(split).alias("split"), F.col(id_).alias("id"))
    held = df.groupBy("key", "split").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    held = held.groupBy("key").agg(F.collect_list(F.struct("split", "rows", "first")).alias("held"))
    held = held.withColumn("words", tx.words(F.col("key"))).withColumn("runs", tx.shingles(F.col("words")))
    return materialize(held.select(F.monotonically_increasing_id().alias("node"), "runs", F.size("runs").alias("n"), "held"), "leak-nodes")


def _buckets(nodes: DataFrame, bands: int, size: int) -> DataFrame:
    """(bucket, node, n, only) of each band of each node; only: its one split, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            offsets, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            out = np.empty((batch.num_rows, bands), np.uint64)
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                x = place.copy()
                for column in sketch(values[a:b].view(np.uint64))[: bands * size].reshape(bands, size).T:
                    x = (x ^ column) * np.uint64(0xD6E8FEB86659FD93)
                    x ^= x >> np.uint64(32)
                out[i] = x
            repeat = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), bands) for c in (0, 2, 3)]
            arrays = [pa.array(out.reshape(-1).view(np.int64)), pa.array(repeat[0]), pa.array(repeat[1]), pa.array(repeat[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "node", "n", "only"])

    only = F.when(F.size("held") == 1, F.get("held", F.lit(0))["split"])
    rows = nodes.filter("n > 0").select("node", F.transform("runs", lambda r: F.xxhash64(r)).alias("h"), "n", only.alias("only"))
    return rows.mapInArrow(run, "bucket long, node long, n int, only string")


def _candidates(buckets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes (a, b) of one bucket that may lie in different splits. A bucket of more than TOGETHER nodes is cut into parts,
    and each two parts meet in a group of their own."""
    buckets = materialize(buckets, "leak-bands")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    rows = buckets.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("size") / TOGETHER).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("size")
    other = lambda first, last: F.explode(F.sequence(first, last))
    left = rows.select("bucket", "node", "n", "only", F.col("part").alias("x"), other(F.col("part"), F.col("parts") - 1).alias("y"))
    right = rows.select("bucket", "node", "n", "only", other(F.lit(0), F.col("part")).alias("x"), F.col("part").alias("y"))
    a, b = left.alias("a"), right.alias("b")
    near = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9
    apart = F.coalesce(F.col("a.only") != F.col("b.only"), F.lit(True))
    meet = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    once = (F.col("a.x") < F.col("a.y")) | (F.col("a.node") < F.col("b.node"))
    found = a.join(b, meet & near & apart & once)
    return found.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def leaks(df: DataFrame, id_: str, text: str, split: str, threshold: float = 0.9, order: Sequence[str] = SPLITS) -> DataFrame:
    """What lies in two splits: a row (sa, sb, kind, a, b, pairs, jaccard) for each two splits and each two keys, or each one key
    ('exact'), that do. sa comes before sb in `order`; a and b are the smallest ids of them there; pairs: how many pairs of
    rows that is.

    'exact': one key; 'near': different keys whose sets of word runs reach the threshold, each pair compared exactly. Texts too
    short for a run match exactly only. Rows with a null text or split, or a split not in `order`, take no part. A pair at the
    threshold is missed with a probability of MISS at most. Other columns are ignored.
    """
    bands, size = band_shape(threshold)
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    nodes = _nodes(df.filter(F.col(split).isin(*order)), id_, text, split)
    found = _candidates(_buckets(nodes, bands, size), threshold)
    hashed = nodes.select(F.col("node").alias("id"), F.transform("runs", lambda r: F.xxhash64(r)).alias("runs"), "n")
    found = parity.close(materialize(found, "candidates"), hashed, threshold)
    sets = nodes.withColumnRenamed("node", "id").join(parity.ids_of(found), "id", "left_semi")
    one = sets.select(F.col("id").alias("a"), F.col("runs").alias("ra"), F.col("held").alias("ha"))
    two = sets.select(F.col("id").alias("b"), F.col("runs").alias("rb"), F.col("held").alias("hb"))
    jaccard = F.size(F.array_intersect("ra", "rb")) / F.size(F.array_union("ra", "rb"))
    near = found.join(one, "a").join(two, "b").withColumn("jaccard", jaccard).filter(F.col("jaccard") >= threshold - 1e-12)
    near = near.select("ha", "hb", F.lit("near").alias("kind"), "jaccard")
    exact = nodes.filter(F.size("held") > 1).select(F.col("held").alias("ha"), F.col("held").alias("hb"), F.lit("exact").alias("kind"), F.lit(1.0).alias("jaccard"))
    both = near.unionByName(exact).withColumn("x", F.explode("ha")).withColumn("y", F.explode("hb"))
    before = rank[F.col("x.split")] < rank[F.col("y.split")]
    first, last = (F.when(before, F.col(p)).otherwise(F.col(q)) for p, q in (("x", "y"), ("y", "x")))
    both = both.filter(before | ((F.col("kind") == "near") & (F.col("x.split") != F.col("y.split"))))
    both = both.select(first.alias("p"), last.alias("q"), "kind", "jaccard")
    return both.select(
        F.col("p.split").alias("sa"), F.col("q.split").alias("sb"), "kind", F.col("p.first").alias("a"), F.col("q.first").alias("b"),
        (F.col("p.rows") * F.col("q.rows")).alias("pairs"), "jaccard",
    )


def report(found: DataFrame, order: Sequence[str] = SPLITS) -> DataFrame:
    """(sa, sb, kind, pairs) for every two splits and both kinds, 0 where nothing leaks."""
    every = [(a, b, k) for i, a in enumerate(order) for b in order[i + 1 :] for k in ("exact", "near")]
    every = found.sparkSession.createDataFrame(every, "sa string, sb string, kind string")
    counts = found.groupBy("sa", "sb", "kind").agg(F.sum("pairs").alias("pairs"))
    return every.join(counts, ["sa", "sb", "kind"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
