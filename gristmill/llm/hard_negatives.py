"""Hard negatives: rows of another label whose score lies in a window below a positive's, by vantage-point trees.

With one component more, which makes all rows equally long, the highest inner products are the nearest rows, and a window
of scores is an annulus of distances. A tree over a bounded sample deals all rows out to cells and keeps what distances to
its vantage points each cell has; so it is known which cells an annulus can meet. The rows of a cell have a tree of
their own, whose leaves are read nearest first until as many rows as wanted are nearer than all that is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gristmill.llm._common import materialize

#: Rows of a cell's block and cells at most; rows of the sample for each cell; rows of a leaf; anchors that meet a block at once.
BLOCK, CELLS, SAMPLE, LEAF, ANCHORS = 4096, 1024, 64, 256, 512
_LOW, _HIGH = -(2**63), 2**63 - 1


def _matrix(column: pd.Series, dim: int, kind: type = np.float64) -> np.ndarray:
    return np.array(column.tolist(), kind).reshape(len(column), dim)


def _augmented(x: np.ndarray, longest: int) -> np.ndarray:
    """The rows with one component more; all are as long as the longest."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))])


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(points)))
    for i, p in enumerate(points):  # by differences, which lose no digits where rows are close
        out[:, i] = np.sqrt(((x - p) ** 2).sum(1))
    return out


@dataclass
class Cells:
    """Cells, each with distances to the vantage points above it. points: augmented; above: for each cell the numbers of
    the points; near and far: least and greatest distance of the cell's rows to each."""

    points: np.ndarray
    above: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def scores(self, q: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and cell a lower and an upper bound of the scores of the cell's rows."""
        flat = np.column_stack([q, np.zeros(len(q))])
        d = _distances(flat, self.points)[:, self.above]
        least = np.maximum(np.maximum(d - self.far, self.near - d), 0.0).max(2, initial=0.0)
        most = (d + self.far).min(2, initial=np.inf)
        whole = ((q * q).sum(1) + longest)[:, None]
        slack = 1e-9 * (np.sqrt(whole) + 1)
        low, high = (whole - (most + slack) ** 2) / 2 - 1, (whole - np.maximum(least - slack, 0.0) ** 2) / 2 + 1
        return np.maximum(low, _LOW), np.minimum(high, float(_HIGH))


@dataclass
class Router:
    """The vantage-point tree over the sample: node i has the children 2 i + 1 (nearer than its radius) and 2 i + 2."""

    points: np.ndarray
    radius: np.ndarray
    depth: int

    @staticmethod
    def of(sample: np.ndarray, depth: int) -> Router:
        inner = (1 << depth) - 1
        points, radius = np.zeros((inner, sample.shape[1])), np.full(inner, np.inf)
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            own = members.pop(node, np.empty(0, np.int64))
            points[node] = sample[own[0]] if len(own) else points[max(node - 1, 0) // 2]
            d = np.sqrt(((sample[own] - points[node]) ** 2).sum(1))
            if len(own):
                radius[node] = np.median(d)
            members[2 * node + 1], members[2 * node + 2] = own[d <= radius[node]], own[d > radius[node]]
        return Router(points, radius, depth)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell of each row, its distances to the points on the way)."""
        node, way = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for k in range(self.depth):
            way[:, k] = np.sqrt(((x - self.points[node]) ** 2).sum(1))
            node = 2 * node + 1 + (way[:, k] > self.radius[node])
        return node - ((1 << self.depth) - 1), way

    def above(self) -> np.ndarray:
        node = np.arange(1 << self.depth) + (1 << self.depth) - 1
        out = np.zeros((len(node), self.depth), np.int64)
        for k in range(self.depth - 1, -1, -1):
            node = (node - 1) // 2
            out[:, k] = node
        return out


def _local_tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], Cells]:
    """(order of the rows, leaves as ranges of it, their bounds) of a tree with halves of equal size."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
    order, parts, points, ways = np.arange(len(x)), [(0, len(x))], [], [[]]
    for _ in range(depth):
        split, new_ways = [], []
        for (a, b), way in zip(parts, ways, strict=True):
            own = order[a:b]
            points.append(x[own[0]])
            d = np.sqrt(((x[own] - points[-1]) ** 2).sum(1))
            order[a:b] = own[np.argsort(d, kind="stable")]
            middle = (a + b + 1) // 2
            for part in ((a, middle), (middle, b)):
                split.append(part)
                new_ways.append([*way, len(points) - 1])
        parts, ways = split, new_ways
    points = np.array(points).reshape(-1, x.shape[1])
    above = np.array(ways, np.int64).reshape(len(parts), depth)
    near, far = np.zeros(above.shape), np.zeros(above.shape)
    for leaf, (a, b) in enumerate(parts):
        d = _distances(x[order[a:b]], points[above[leaf]])
        near[leaf], far[leaf] = d.min(0), d.max(0)
    return order, parts, Cells(points, above, near, far)


def _nearest_first(
    q: np.ndarray, own_id: int, own_label: int, same: bool, windows: list[tuple[int, int, int]], low: np.ndarray, high: np.ndarray,
    leaves: list[tuple[int, int]], x: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, ids, scores) for each window (place, least, greatest score): its k highest rows. x, ids and labels are in the
    order of the leaves; low and high: bounds of the leaves' scores."""
    order, read = np.argsort(-high, kind="stable"), {}
    for place, least, greatest in windows:
        found_ids, found = np.empty(0, np.int64), np.empty(0, np.int64)
        for leaf in order:
            if high[leaf] < least or len(found) >= k and high[leaf] < found[k - 1]:
                break
            if low[leaf] > greatest:
                continue
            if leaf not in read:
                a, b = leaves[leaf]
                fits = ((labels[a:b] == own_label) == same) & (ids[a:b] != own_id)
                read[leaf] = ids[a:b][fits], (x[a:b][fits] @ q).astype(np.int64)
            i, s = read[leaf]
            inside = (s >= least) & (s <= greatest)
            if inside.any():
                found_ids, found = np.append(found_ids, i[inside]), np.append(found, s[inside])
                best = np.lexsort((found_ids, -found))[:k]
                found_ids, found = found_ids[best], found[best]
        if len(found):
            yield place, found_ids, found


_FOUND = "anchor_id long, which long, place int, vec_id long, score long"


def _search(data: DataFrame, asked: DataFrame, count: list[int], dim: int, longest: int, same: bool, k: int) -> DataFrame:
    """data (vec_id, label, v, cell); asked (anchor_id, which, label, q, cell, windows): for each window the k highest rows of
    each block of the cell."""
    whole = np.float64 if longest < 2**53 else np.int64  # numbers whose sums are exact
    asks = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    number = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    blocks = [-(-n // BLOCK) if c in asks else 0 for c, n in enumerate(count)]
    parts = [-(-asks.get(c, 0) // ANCHORS) for c in range(len(count))]
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sent = data.filter(number(parts) > 0).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), number(blocks)).cast("int"))
    sent = sent.withColumn("part", each(number(parts))).select("cell", "block", "part", "vec_id", "label", "v")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("anchor_id", "which"), number(parts)).cast("int"))
    asked = asked.withColumn("block", each(number(blocks)))

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("vec_id", kind="stable")
            flat = _matrix(b["v"], dim)
            order, leaves, cells = _local_tree(_augmented(flat, longest))
            codes = pd.factorize(np.concatenate([b["label"].to_numpy(), a["label"].to_numpy()]))[0]
            labels, own_labels = codes[: len(b)][order], codes[len(b) :]
            ids, x = b["vec_id"].to_numpy()[order], (flat if whole is np.float64 else _matrix(b["v"], dim, whole))[order]
            low, high = cells.scores(_matrix(a["q"], dim), longest)
            asks = _matrix(a["q"], dim, whole)
            for i, (anchor, which, windows) in enumerate(zip(a["anchor_id"], a["which"], a["windows"], strict=True)):
                windows = [(w["place"], w["least"], w["greatest"]) for w in windows]
                found = _nearest_first(asks[i], anchor, own_labels[i], same, windows, low[i], high[i], leaves, x, ids, labels, k)
                for place, found_ids, s in found:
                    out += [(anchor, which, place, *x) for x in zip(found_ids.tolist(), s.tolist(), strict=True)]
        kinds = {"anchor_id": "int64", "which": "int64", "place": "int32", "vec_id": "int64", "score": "int64"}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    by = ("cell", "block", "part")
    return asked.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(solve, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "which", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _dealt(anchors: DataFrame, dim: int, choose: Callable[[np.ndarray, list], list[tuple[int, list]]]) -> DataFrame:
    """anchors (anchor_id, which, label, q, windows), a row for each cell that `choose` wants: (cell, its windows)."""
    schema = T.StructType([*anchors.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                rows, cells, windows = [], [], []
                for i, wanted in enumerate(choose(_matrix(part["q"], dim), [list(w) for w in part["windows"]])):
                    for cell, own in wanted:
                        rows.append(i)
                        cells.append(cell)
                        windows.append(own)
                if rows:
                    out = part.iloc[rows].drop(columns="windows")
                    yield out.assign(windows=windows, cell=np.array(cells, np.int32))[[f.name for f in schema]]

    return anchors.mapInPandas(run, schema)


def _meeting(low: np.ndarray, high: np.ndarray, w: dict) -> np.ndarray:
    """The cells that may hold scores of a window, best first."""
    order = np.argsort(-high, kind="stable")
    return order[(high[order] >= w["least"]) & (low[order] <= w["greatest"])]


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 5, least: int = 80, greatest: int = 100, cells: int | None = None
) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first k rows of another label whose
    score is `least` to `greatest` per cent of the positive's.

    vectors: (vec_id long, label, v array<bigint>), see labelled_vectors(); is_anchor: a condition on vec_id. Score: inner
    product with the anchor; rows come by falling score, ties by smaller vec_id. Returns anchor_id, positive_id, rank (from
    1), negative_id, positive_score, negative_score; fewer rows where there are fewer, none for a window that is empty, as
    of a negative score. An anchor's own id is neither its positive nor its negative. Repeated rows: an anchor is asked once
    per different vector and label, every other row counts as often as it stands there. Only vectors of one length
    meet; each length that an anchor has is a plan of its own. No rows or no anchors: no rows. Scores are exact;
    ValueError where one may not fit a long.

    Each search goes in two steps: first the most promising cell alone, whose k-th score bounds the other cells out that
    can't reach it. The driver gets SAMPLE rows for each of at most CELLS cells, and sums by cell.
    """
    vectors = vectors.withColumn("__dim", F.size("v"))
    found = vectors.groupBy("__dim").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors")).filter("anchors > 0")
    out = vectors.sparkSession.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    for r in found.orderBy("__dim").collect():
        wanted = cells or min(CELLS, -(-r["n"] // BLOCK) * 2)
        part = vectors.filter(F.col("__dim") == r["__dim"]).select("vec_id", "label", "v")
        out = out.unionByName(_mine(part, r["__dim"], is_anchor, positives, k, (least, greatest), max(0, (wanted - 1).bit_length())))
    return out


def _mine(vectors: DataFrame, dim: int, is_anchor: Column, positives: int, k: int, share: tuple[int, int], depth: int) -> DataFrame:
    square = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    if vectors.agg(F.max(square)).first()[0] >= 2.0**62:
        raise ValueError("vectors are too long: their scores may not fit a long")
    longest = vectors.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda acc, c: acc + c * c))).first()[0]
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE << depth).select("v").collect()
    router = Router.of(_augmented(np.array([r["v"] for r in sample], np.float64), longest), depth)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                cell, way = router.route(_augmented(_matrix(part["v"], dim), longest))
                yield part.assign(cell=cell.astype(np.int32), way=list(way))

    kind = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("way", T.ArrayType(T.DoubleType()))])
    data = materialize(vectors.mapInPandas(assign, kind), "vantage-cells")
    ends = [f(F.get("way", F.lit(i))).alias(f"{n}{i}") for i in range(depth) for n, f in (("near", F.min), ("far", F.max))]
    count, near, far = [0] * (1 << depth), np.zeros((1 << depth, depth)), np.zeros((1 << depth, depth))
    for r in data.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect():
        count[r["cell"]] = r["n"]
        near[r["cell"]], far[r["cell"]] = ([r[f"{n}{i}"] for i in range(depth)] for n in ("near", "far"))
    bounds, full = Cells(router.points, router.above(), near, far), np.array(count) > 0

    def scores(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = bounds.scores(q, longest)
        return np.where(full, low, np.inf), np.where(full, high, -np.inf)

    def first_cell(q: np.ndarray, windows: list) -> list:
        out = []
        for low, high, own in zip(*scores(q), windows, strict=True):
            wanted = {}
            for w in own:
                if len(cells := _meeting(low, high, w)):
                    wanted.setdefault(int(cells[0]), []).append(w)
            out.append(list(wanted.items()))
        return out

    def other_cells(q: np.ndarray, windows: list) -> list:
        """The windows come with what the first cell gave: reached, the k-th score."""
        out = []
        for low, high, own in zip(*scores(q), windows, strict=True):
            wanted = {}
            for w in own:
                first = _meeting(low, high, w)[:1]
                narrow = {**w, "least": max(w["least"], w["reached"])}
                for c in _meeting(low, high, narrow):
                    if c not in first:
                        wanted.setdefault(int(c), []).append(narrow)
            out.append(list(wanted.items()))
        return out

    rows = data.select("vec_id", "label", "v", "cell")

    def search(asked: DataFrame, same: bool, most: int, name: str) -> DataFrame:
        """asked (anchor_id, which, label, q, windows): the first `most` rows of each window."""
        near = materialize(_search(rows, materialize(_dealt(asked, dim, first_cell), name), count, dim, longest, same, most), name)
        reached = near.groupBy("anchor_id", "which", "place").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
        reached = reached.groupBy("anchor_id", "which").agg(F.map_from_entries(F.collect_list(F.struct("place", F.get("s", F.lit(most - 1))))).alias("r"))
        again = asked.join(reached, ["anchor_id", "which"], "left").withColumn(
            "windows", F.transform("windows", lambda w: w.withField("reached", F.coalesce(F.try_element_at("r", w["place"]), F.lit(_LOW))))
        )
        again = materialize(_dealt(again.drop("r"), dim, other_cells), name)
        return _best(near.unionByName(_search(rows, again, count, dim, longest, same, most)), most)

    anchors = data.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("v", "label").alias("which"), "label", F.col("v").alias("q")).distinct()
    window = lambda place, low, high: F.struct(
        place.cast("int").alias("place"), low.cast("long").alias("least"), high.cast("long").alias("greatest"), F.lit(_LOW).alias("reached")
    )
    all_scores = F.array(window(F.lit(0), F.lit(_LOW), F.lit(_HIGH)))
    positive = search(anchors.withColumn("windows", all_scores), True, positives, "positives").select(
        "anchor_id", "which", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    positive = materialize(positive, "positives")
    # least * p <= 100 * s <= greatest * p, in whole numbers that don't overflow.
    p = F.col("positive_score").cast("decimal(19,0)")
    low, high = F.ceil(p * share[0] / 100), F.floor(p * share[1] / 100)
    windows = positive.withColumns({"low": low, "high": high}).filter("low <= high").groupBy("anchor_id", "which")
    windows = windows.agg(F.collect_list(window(F.col("place"), F.col("low"), F.col("high"))).alias("windows"))
    negative = search(anchors.join(windows, ["anchor_id", "which"]), False, k, "negatives")
    negative = negative.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return negative.join(positive, ["anchor_id", "which", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def labelled_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v array<bigint>) of rows (vec_id, label, embedding): floor(scale * x) of each component as a double. Rows
    with a null id or label, a null or empty vector, or one that holds null, NaN or an infinity take no part; ids
    that are no integers count as null. Other columns are ignored."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    df = df.filter(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound)
    return df.select(F.col("vec_id").try_cast("long").alias("vec_id"), "label", v.alias("v")).filter("vec_id IS NOT NULL")
