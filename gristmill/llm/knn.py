"""Exact top-k search by inner product, as a join over Voronoi cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gristmill.llm._common import materialize

#: Cells, at least and at most; queries in a group; vectors in a block of a group. Bounds of what a task or the driver holds.
CELLS, MOST_CELLS, QUERIES, VECTORS = 128, 4096, 1024, 8192
#: The pairs of group and cell are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_PAIRS = 50_000


def whole_vectors(df: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of each component as a double. Rows with a null id, a null
    or empty vector, or one that holds null, NaN or an infinity take no part; ids that are no integers count as null."""
    x = F.col(embedding)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    df = df.filter(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound)
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return df.select(F.col(vec_id).try_cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL")


def cells_for(n: int) -> int:
    """How many cells n vectors are split into: as many as each has vectors, within bounds."""
    return min(MOST_CELLS, max(CELLS, int(n**0.5)))


def _stack(column: pd.Series, dim: int, kind: type = np.float64) -> np.ndarray:
    return np.array(column.tolist(), kind).reshape(len(column), dim)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row and the distance to its pivot, rounded up a little."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    cell = square.argmin(1)
    far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
    return cell, far * (1 + 1e-9) + 1e-6


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k highest scores in each row of finite ones, ties to the smaller id."""
    rows, columns = [], []
    for i, row in enumerate(scores):
        at = np.arange(len(row))
        if len(row) > k:
            at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
        at = at[row[at] > (np.iinfo(np.int64).min if row.dtype == np.int64 else -np.inf)]
        at = at[np.lexsort((ids[at], -row[at]))][:k]
        rows.append(np.full(len(at), i))
        columns.append(at)
    if not rows:
        return (np.empty(0, int),) * 3
    r, c = np.concatenate(rows), np.concatenate(columns)
    return r, c, scores[r, c].astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, cells: int | None = None) -> DataFrame:
    """The k highest inner products of each query with all vectors of its dimension but those of its own id.

    vectors: (vec_id, v), see whole_vectors(). is_query: a condition on vec_id. Returns query_id, rank (from
    1), vec_id, score; fewer than k rows for a query that has fewer candidates; ties go to the smaller
    vec_id. Repeated ids: a query is asked once per different vector, a candidate row counts once per row.
    No vectors or no queries: no rows. Scores are exact; ValueError if the product of two vectors' lengths reaches 2 ** 63,
    as a score may then not fit a long. There is a plan for each length of vector that a query has.

    Pivots (a bounded sample by hash) split the vectors into cells, and a summary of each cell keeps its
    pivot, its radius and its longest vector. A query's k-th best score over the pivots is a lower bound; a
    cell can only matter to it if pivot score + length * radius (or the product of lengths) reaches that.
    Queries are grouped by cell, a cell's vectors go to the groups that need it, in blocks of bounded
    size, each block is solved by itself, and the blocks' best are merged.
    """
    vectors = vectors.withColumn("__dim", F.size("v"))
    found = vectors.groupBy("__dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries")).filter("queries > 0")
    parts = [
        _one_dimension(vectors.filter(F.col("__dim") == r["__dim"]).drop("__dim"), r["__dim"], is_query, k, cells or cells_for(r["n"]))
        for r in found.orderBy("__dim").collect()
    ]
    schema = "query_id long, rank int, vec_id long, score long"
    out = vectors.sparkSession.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def _one_dimension(vectors: DataFrame, dim: int, is_query: Column, k: int, cells: int) -> DataFrame:
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(cells).collect()
    ids = np.array([r["vec_id"] for r in sample])
    every = np.array([r["v"] for r in sample], np.float64)
    pivots = np.unique(every, axis=0)  # of equal vectors one is enough

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _stack(b["v"], dim)
            cell, far = _nearest(x, pivots)
            yield b.assign(cell=cell.astype(np.int32), far=far, norm=np.sqrt((x * x).sum(1)) * (1 + 1e-9))

    kind = T.StructType(
        [*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()),
         T.StructField("norm", T.DoubleType())]
    )
    data = materialize(vectors.mapInPandas(assign, kind), "voronoi")
    summary = data.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm"),
        F.count(F.when(is_query, 1)).alias("queries"),
    ).collect()
    count, queries = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    far, norm = np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in summary:
        count[r["cell"]], far[r["cell"]], norm[r["cell"]], queries[r["cell"]] = r["n"], r["far"], r["norm"], r["queries"]
    longest = max(norm, default=0.0) ** 2
    if longest >= 2.0**63:
        raise ValueError("vectors are too long: their scores may not fit a long")
    whole = np.float64 if longest < 2.0**53 else np.int64  # numbers whose sums are exact

    # Cells of few queries share a group, those of many have several.
    first, parts, group, load = [], [], -1, QUERIES
    for n in queries:
        if load + n > QUERIES:
            group, load = group + 1, 0
        first.append(group)
        parts.append(max(1, -(-int(n) // QUERIES)))
        if parts[-1] > 1:
            group, load = group + parts[-1] - 1, QUERIES
        load += int(n)
    cell = F.col("cell") + 1
    own = F.element_at(F.array(*map(F.lit, first)), cell) + F.pmod(
        F.xxhash64("vec_id", "v"), F.element_at(F.array(*map(F.lit, parts)), cell)
    )
    asked = data.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), own.cast("long").alias("group"))
    asked = asked.distinct()

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = set()
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                q = _stack(part["q"], dim)
                sure = q @ every.T
                sure[part["query_id"].to_numpy()[:, None] == ids[None]] = -np.inf
                least = np.partition(sure, -k, 1)[:, -k] if sure.shape[1] >= k else np.full(len(q), -np.inf)
                size = np.sqrt((q * q).sum(1))[:, None] * (1 + 1e-9)
                most = np.minimum(q @ pivots.T + size * far[None], size * norm[None])
                where = (most + 1 + 1e-9 * size * max(norm) >= least[:, None]) & (count > 0)[None]
                g = part["group"].to_numpy()
                for one in np.unique(g):
                    pairs.update((int(one), int(c)) for c in np.flatnonzero(where[g == one].any(0)))
        if pairs:
            yield pd.DataFrame(sorted(pairs), columns=["group", "cell"])

    pairs = asked.mapInPandas(needed, "group long, cell int").distinct()
    sizes = data.sparkSession.createDataFrame(
        [(i, int(n)) for i, n in enumerate(count)], "cell int, n long"
    )
    pairs = pairs.join(F.broadcast(sizes), "cell")
    blocks = F.ceil(F.sum("n").over(Window.partitionBy("group")) / VECTORS).cast("int")
    pairs = materialize(pairs.withColumn("blocks", blocks).drop("n"), "voronoi-pairs")
    small = pairs.count() <= BROADCAST_PAIRS
    sent = data.select("vec_id", "v", "cell").join(F.broadcast(pairs) if small else pairs, "cell")
    sent = sent.select("group", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v")
    per = pairs.groupBy("group").agg(F.max("blocks").alias("blocks"))
    asked = asked.join(F.broadcast(per) if small else per, "group").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            vec_ids, vectors = x["vec_id"].to_numpy(), _stack(x["v"], dim, whole)
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                query_ids = part["query_id"].to_numpy()
                scores = _stack(part["q"], dim, whole) @ vectors.T
                scores[query_ids[:, None] == vec_ids[None]] = np.iinfo(np.int64).min if whole is np.int64 else -np.inf
                r, c, s = _best(scores, vec_ids, k)
                # Queries of one id and different vectors are told apart by `which`.
                out.append(pd.DataFrame({"query_id": query_ids[r], "which": part["which"].to_numpy()[r], "vec_id": vec_ids[c], "score": s}))
        return pd.concat(out) if out else pd.DataFrame({n: pd.Series(dtype="int64") for n in ("query_id", "which", "vec_id", "score")})

    asked = asked.withColumn("which", F.xxhash64("q"))
    found = (
        asked.groupBy("group", "block")
        .cogroup(sent.groupBy("group", "block"))
        .applyInPandas(solve, "query_id long, which long, vec_id long, score long")
    )
    w = Window.partitionBy("query_id", "which").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
