"""Exact set-similarity joins over word runs, connected components, and matches between splits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gristmill.functions import text as tx
from gristmill.operators import parity
from gristmill.sources.shared import materialize

THRESHOLD = 0.9
#: Sets that meet on one run before it is moved back; how many runs a round moves back; rows that are broadcast; sets handled at once.
OFTEN, HOT, BROADCAST, AT_ONCE = 64, 1 << 16, 1_000_000, 1024


def sets(df: DataFrame, id_: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(id, key, runs, n, kept columns): the folded text and its set of runs of three words."""
    df = df.select(F.col(id_).alias("id"), tx.dedupe_key(text).alias("key"), *(keep or []))
    df = df.withColumn("__words", tx.words(F.col("key")))
    df = df.withColumn("runs", tx.shingles(F.col("__words"))).drop("__words")
    return df.withColumn("n", F.size("runs"))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends of the lists among them, from 0) of lists of longs."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _mixed(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every three neighbours of hashes of words."""
    w = words.view(np.uint64)
    x = w[:-2].copy()
    for y in (w[1:-1], w[2:]):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + y
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, hashes of words, as sorted hashes of runs of three of them, each once."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            words, ends = _lists(part.column(part.num_columns - 1))
            of = _mixed(words) if len(words) > 2 else np.zeros(0, np.int64)
            sets_ = [np.unique(of[a : max(a, b - 2)]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets_)]), pa.int32()), pa.array(np.concatenate(sets_)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "runs"])


def hashed(df: DataFrame, id_: str, text: str, *keep: str) -> DataFrame:
    """(id, kept columns, key, runs, n), as a table: the key's hash, and the sorted 64-bit hashes of the runs. Texts go no further,
    and runs are never strings: they are hashed from the hashes of their words."""
    s = df.filter(F.col(text).isNotNull()).select(F.col(id_).alias("id"), *keep, tx.dedupe_key(text).alias("key"))
    s = s.select("id", *keep, F.sha2("key", 256).alias("key"), F.transform(tx.words(F.col("key")), lambda w: F.xxhash64(w)).alias("words"))
    schema = T.StructType([*s.schema.fields[:-1], T.StructField("runs", T.ArrayType(T.LongType()))])
    return materialize(s.mapInArrow(_runs, schema).withColumn("n", F.size("runs")), "sets")


def _prefixes(s: DataFrame, keep: list[str], threshold: float, hot: list[int]) -> DataFrame:
    """(kept columns, at, run): the first runs of each set, in the order of their hashes, but those in hot last."""
    first = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")
    rows = s.filter("n > 0")
    if not hot:
        return rows.select(*keep, F.posexplode(F.slice("runs", F.lit(1), first)).alias("at", "run"))
    late = np.sort(np.array(hot, np.int64))
    low = (1 << 20) - 1
    may = np.zeros(low + 1, bool)
    may[late & low] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                runs, ends = _lists(part.column(part.num_columns - 2))
                take = part.column(part.num_columns - 1).to_numpy()
                of = np.repeat(np.arange(part.num_rows), np.diff(ends))
                back = may[runs & low]
                asked = np.flatnonzero(back)
                back[asked] = late[np.minimum(np.searchsorted(late, runs[asked]), len(late) - 1)] == runs[asked]
                before = np.append(0, np.cumsum(back))  # of those that come last, before each run
                own = before[:-1] - before[ends[:-1]][of]
                place = np.arange(len(runs)) - ends[:-1][of]
                place = np.where(back, (np.diff(ends) - np.diff(before[ends]))[of] + own, place - own)
                stay = np.flatnonzero(place < take[of])
                kept = [c.take(pa.array(of[stay])) for c in part.columns[:-2]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(place[stay].astype(np.int32)), pa.array(runs[stay])], names=[*keep, "at", "run"])

    schema = T.StructType([*(s.schema[c] for c in keep), T.StructField("at", T.IntegerType()), T.StructField("run", T.LongType())])
    return rows.select(*keep, "runs", first.alias("first")).mapInArrow(run, schema)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its size, which is counted, allows it. It is best a table."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def candidates(s: DataFrame, threshold: float, condition=None) -> DataFrame:
    """Pairs of ids (a, b) of sets (id, runs: sorted numbers, n, any more) that can reach the threshold: in any one order of all runs,
    at least one of the first n - ceil(threshold * n) + 1 of each must be shared, and sizes must be near. Nothing that reaches it is lost.

    Runs are ordered by their hash, so that no run has to be counted and a tenth of them is shuffled; those that more than OFTEN
    sets would meet on come last in the order of every set, the HOT most frequent of them in each of two rounds. Equal sets have a pair
    each; group them by key first.
    """
    keep = [c for c in s.columns if c not in ("key", "runs")]
    hot: list[int] = []
    for last in (False, False, True):
        df = materialize(_prefixes(s, keep, threshold, hot), "prefixes")
        if last:
            break
        often = df.groupBy("run").count().filter(F.col("count") > OFTEN).orderBy(F.desc("count"), "run").limit(HOT)
        have = set(hot)
        more = [r["run"] for r in often.collect() if r["run"] not in have]  # HOT numbers at most
        if not more:
            break
        hot += more
    a, b = df.alias("a"), df.alias("b")
    near = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9
    # Of two sets that reach it, the first run they share leaves enough behind it in both.
    share = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    near &= F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= share
    on = (F.col("a.run") == F.col("b.run")) & near & (condition if condition is not None else F.col("a.id") < F.col("b.id"))
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def verified(pairs: DataFrame, s: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach the threshold. Only sets of pairs that a bound by bits leaves are shuffled."""
    pairs = parity.close(materialize(pairs, "candidates"), s, threshold)
    s = s.select("id", "runs").join(parity.ids_of(pairs), "id", "left_semi")
    x = s.select(F.col("id").alias("a"), F.col("runs").alias("ra"))
    y = s.select(F.col("id").alias("b"), F.col("runs").alias("rb"))
    j = tx.jaccard(F.col("ra"), F.col("rb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", j.alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-12)


def near_pairs(df: DataFrame, id_: str, text: str, threshold: float = THRESHOLD, within: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """(a, b, kind, jaccard): texts of one key are linked to its smallest id ('exact', 1.0), and the smallest ids of
    different keys to each other where their sets reach the threshold ('near'). within: only rows with the same value of it.
    Keys are told apart by SHA-256, runs by 64 bits. known: what hashed() made of the rows, with `within`, so that no text is read."""
    own = [within] if within else []
    s = hashed(df, id_, text, *own) if known is None else known
    first = F.min("id").over(Window.partitionBy("key", *own))
    copies = materialize(s.select("id", "key", *own).withColumn("first", first).filter(F.col("id") > F.col("first")).select("id", "first"), "copies")
    exact = copies.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit("exact").alias("kind"), F.lit(1.0).alias("jaccard"))
    reps = s.join(small(copies.select("id")), "id", "left_anti")
    same = (F.col(f"a.{within}") == F.col(f"b.{within}")) & (F.col("a.id") < F.col("b.id")) if within else None
    found = verified(candidates(reps.drop("key"), threshold, same), reps, threshold)
    return exact.unionByName(found.select("a", "b", F.lit("near").alias("kind"), "jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for the nodes of edges (a, b): the smallest id connected to each. Labels fall to the neighbours'
    least and to their labels' labels until none changes."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id")
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        now = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = now.select(F.col("id").alias("root"), F.col("root").alias("upper"))
        now = materialize(now.join(up, "root", "left").select("id", "old", F.least("root", F.coalesce("upper", "root")).alias("root")), "labels")
        labels = now.select("id", "root")
        if now.filter("old <> root").isEmpty():
            return labels


def cross_matches(df: DataFrame, id_: str, text: str, split: str, threshold: float = THRESHOLD, known: DataFrame | None = None) -> DataFrame:
    """(a, b, kind, jaccard): for each row that a row of a more protected split (train, valid, test) matches, the best of those:
    of the same key ('exact') before others ('near'), then of the highest similarity, then of the smallest id.

    Texts of one key are one set, with the smallest id of each split, so copies, however many, are neither compared nor paired:
    what is found for a key and split holds for all its rows. known: what hashed() made of the rows, with `split`, so that no text
    is read.
    """
    rank = F.expr(f"array_position(array('train', 'valid', 'test'), `{split}`)")
    named = (df if known is None else known).filter(F.col(split).isNotNull()).withColumn("rank", rank)
    sets_ = hashed(named, id_, text, "rank") if known is None else named.drop(split)
    rows = sets_.select("id", "rank", F.col("key").alias("h"))
    first = rows.groupBy("h", "rank").agg(F.min("id").alias("first"))
    held = F.sort_array(F.collect_list(F.struct("rank", "first")))
    keys = first.groupBy("h").agg(held.alias("held"), F.min("first").alias("id"))
    keys = materialize(keys.withColumns({"low": F.array_min("held.rank"), "high": F.array_max("held.rank")}), "split-keys")
    # A key's set is that of its smallest id; the other rows are its copies.
    copies = small(materialize(rows.join(keys.select("id"), "id", "left_anti").select("id"), "copies"))
    alone = sets_.select("id", "runs", "n", F.col("key").alias("h")).join(copies, "id", "left_anti")
    spans = keys.select("id", "low", "high")
    apart = (F.col("a.low") < F.col("b.high")) | (F.col("b.low") < F.col("a.high"))
    pairs = candidates(alone.select("id", "runs", "n"), threshold)
    a, b = spans.select(F.col("id").alias("a"), "low", "high").alias("a"), spans.select(F.col("id").alias("b"), "low", "high").alias("b")
    pairs = pairs.join(a, "a").join(b, "b").filter(apart).select("a", "b")
    near = verified(pairs, alone, threshold)
    one = keys.select(F.col("id").alias("a"), F.col("h").alias("h"), F.col("held").alias("own"))
    two = keys.select(F.col("id").alias("b"), F.col("held").alias("others"))
    near = near.union(near.select("b", "a", "jaccard")).join(one, "a").join(two, "b")
    near = near.select("h", "own", "others", F.lit("near").alias("kind"), "jaccard")
    exact = keys.filter("low < high").select("h", F.col("held").alias("own"), F.col("held").alias("others"), F.lit("exact").alias("kind"), F.lit(1.0).alias("jaccard"))
    found = near.unionByName(exact).select("*", F.explode("own.rank").alias("rank"))
    later = F.filter("others", lambda o: o["rank"] > F.col("rank"))
    found = found.withColumn("b", F.array_min(F.transform(later, lambda o: o["first"]))).filter("b IS NOT NULL")
    best = F.min(F.struct(F.when(F.col("kind") == "exact", 0).otherwise(1).alias("k"), (-F.col("jaccard")).alias("j"), "b", "kind"))
    found = found.groupBy("h", "rank").agg(best.alias("m"))
    return rows.join(found, ["h", "rank"]).select(F.col("id").alias("a"), F.col("m.b").alias("b"), F.col("m.kind").alias("kind"), (-F.col("m.j")).alias("jaccard"))


def lsh_bands(threshold: float, permutations: int, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most rows in a band for which a pair at the threshold is missed with a probability of no
    more than `miss`. ValueError if even one row is too many."""
    for rows in range(permutations, 0, -1):
        bands = permutations // rows
        p = threshold**rows
        if p >= 1.0 or bands * math.log1p(-p) <= math.log(miss):
            return bands, rows
    raise ValueError("the threshold is too low for so few permutations")
