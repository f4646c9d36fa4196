"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

Candidates come from banded MinHash, are pruned by comparing MinHash values step by step until a pair's posterior
probability of reaching the threshold is negligible, and what is left is verified exactly. Documents of
one set are one node; nothing of the size of all pairs is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._common import materialize, text_key

WORDS, THRESHOLD = 5, 0.8
#: Bands and rows of MinHash. A pair at the threshold shares no band with probability (1 - 0.8^5)^36 < 1e-6.
BANDS, ROWS = 36, 5
#: Values compared in a step, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 20, 1e-7
#: Members of a group that meet in one task: larger groups are split into blocks, and pairs of blocks meet.
BLOCK = 512
#: Bytes of text hashed at once, unless one text alone has more; pairs looked at at once.
BYTES_AT_ONCE, PAIRS_AT_ONCE = 1_000_000, 500_000
#: Labels that changed are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROOTS = 50_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(4)
def _factors(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


@lru_cache(1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(7, 7 + 2 * BANDS * ROWS, dtype=_U) * _U(0xD6E8FEB86659FD93)).astype(np.uint32)
    return x[: BANDS * ROWS], x[BANDS * ROWS :] | np.uint32(1)


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted different 64-bit keys of each text's runs of `words` words: lower case, split at blanks, tabs
    and the ASCII line and page breaks. A text of fewer words has one run, all of it; one of none has none."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    ink = (data != 32) & ((data < 9) | (data > 13))
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    at = np.flatnonzero(begin)
    if not len(at):
        return [np.empty(0, _U) for _ in texts]
    index = np.maximum(np.arange(len(data)) - at[np.maximum(np.cumsum(begin) - 1, 0)], 0)
    top = 1 << int(index[ink].max() + 1).bit_length()
    key = np.add.reduceat(np.where(ink, (data.astype(_U) + _U(1)) * _factors(top)[np.minimum(index, top - 1)], _U(0)), at)
    key = _mix(key)
    own = np.searchsorted(at, np.append(0, np.cumsum(sizes)))  # the words of each text
    run = np.zeros(max(0, len(key) - words + 1), _U)
    for j, f in enumerate(_factors(words + 1)[1:].tolist()):
        run += key[j : j + len(run)] * _U(f)
    run = _mix(run)
    out = []
    for lo, hi in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(run[lo : hi - words + 1]))
        elif hi > lo:
            few = _U(hi - lo)
            with np.errstate(over="ignore"):
                for j in range(lo, hi):
                    few = few * _U(0x9E3779B97F4A7C15) + key[j]
            out.append(_mix(np.array([few], _U)))
        else:
            out.append(np.empty(0, _U))
    return out


def _portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lists of up to BYTES_AT_ONCE, or of one."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > BYTES_AT_ONCE:
            yield texts[at:i]
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield texts[at:]


def minhash(keys: np.ndarray) -> np.ndarray:
    """BANDS * ROWS values, uint32, of a set that is not empty."""
    flip, odd = _seeds()
    x = (keys ^ (keys >> _U(32))).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        out = np.minimum(out, ((x[lo : lo + 2048, None] ^ flip) * odd).min(0))
    return out


@lru_cache(1)
def _band_factors() -> np.ndarray:
    return _factors(4096)[100 : 100 + BANDS * ROWS].reshape(BANDS, ROWS)


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, th, sid, n, bands, sig) of each row: th names the text, sid (16 bytes) the set of n runs, bands
    are the keys of its bands, sig holds a byte of each MinHash value. No words: null sid, bands and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for b in batches for small in _slices(b)):
            at = 0
            for texts in _portions(batch.column(2).to_pylist()):
                sid, n, bands, sig = [], [], [], []
                for keys in shingles(texts, words):
                    n.append(len(keys))
                    if not len(keys):
                        sid.append(None), bands.append(None), sig.append(None)
                        continue
                    sums = [_mix(keys).sum(dtype=_U), _mix(keys ^ _U(0xA5A5A5A55A5A5A5A)).sum(dtype=_U) ^ _U(len(keys))]
                    sid.append(np.array(sums, _U).tobytes())
                    values = minhash(keys)
                    bands.append((_mix((values.reshape(BANDS, ROWS).astype(_U) + _U(1)) * _band_factors()).sum(1, dtype=_U)).view(np.int64))
                    sig.append((values & np.uint32(255)).astype(np.uint8).tobytes())
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sid, pa.binary()), pa.array(n, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["doc_id", "th", "sid", "n", "bands", "sig"],
                )
                at += len(texts)

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("th", T.LongType()),
            T.StructField("sid", T.BinaryType()), T.StructField("n", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()),
        ]
    )
    return docs.select("doc_id", text_key().alias("th"), "text").mapInArrow(run, schema)


@lru_cache(4)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches to go on): with fewer, the probability that the similarity reaches
    the threshold is below the tolerance. Prior: uniform. Bytes match by chance once in 256."""
    grid = (np.arange(20000) + 0.5) / 20000
    p = grid + (1 - grid) / 256
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[grid >= threshold].sum() / w.sum() >= tolerance:
                out.append((n, m))
                break
    return tuple(out)


def _groups_of_pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, a bounded number at once. Rows of a group are consecutive; a group of two
    blocks (side 0 and 1) has the pairs between them, one of a single block (side 2) all."""
    n = len(group)
    last = np.searchsorted(group, group, "right")
    count = last - np.arange(n) - 1
    upto, lo = np.cumsum(count), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        c = count[lo:hi]
        a = np.repeat(np.arange(lo, hi), c)
        if len(a):
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
            keep = (side[a] == 2) | (side[a] != side[b])
            yield a[keep], b[keep]
        lo = hi


def probable(a: np.ndarray, b: np.ndarray, sig: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the posterior does not rule out, by comparing ever more values."""
    matches, at = np.zeros(len(a), np.int32), 0
    for n, least in least_matches(threshold):
        if not len(a):
            break
        matches += (sig[a, at:n] == sig[b, at:n]).sum(1, dtype=np.int32)
        keep = matches >= least
        a, b, matches, at = a[keep], b[keep], matches[keep], n
    return a, b


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        label = label[label]
        if (label == old).all():
            return label


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows sorted by (g1, bi, bj), cut anew so that no group is in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(batch.schema.get_field_index(c)) for c in ("g1", "bi", "bj")]
        same = np.ones(batch.num_rows, bool)
        for c in ids:
            v = c.to_pylist()
            same &= np.array([x == v[-1] for x in v])
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if first:
            held.append(batch.slice(0, first))
            yield pa.Table.from_batches(held)
            held = []
        elif held:
            before = [held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() for c in ("g1", "bi", "bj")]
            if before != [c[0].as_py() for c in ids]:
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _group_numbers(t: pa.Table) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    for c in ("g1", "bi", "bj"):
        v = t[c].to_pylist()
        new[1:] |= np.array([x != y for x, y in zip(v[1:], v[:-1], strict=True)], bool)
    return np.cumsum(new)


def _side(t: pa.Table) -> np.ndarray:
    bi, bj, own = (t[c].to_numpy() for c in ("bi", "bj", "own"))
    return np.where(bi == bj, 2, np.where(own == bi, 0, 1))


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(t.num_rows, BANDS * ROWS)


def in_blocks(df: DataFrame, group: str, size: str, member: str) -> DataFrame:
    """Deals rows out to groups (g1, bi, bj): of a group of up to BLOCK rows to one, of a larger one to one for each
    pair of its blocks, so that any two of its rows meet once and no more than two blocks meet at once."""
    parts = F.ceil(F.col(size) / BLOCK).cast("int")
    df = df.withColumn("own", F.pmod(F.xxhash64(member, F.lit("block")), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    df = df.withColumn("__o", other).withColumns({"bi": F.least("own", "__o"), "bj": F.greatest("own", "__o")})
    df = df.withColumn("g1", F.col(group)).drop("__o")
    # Rows of one group that tells apart no block come once.
    return df.repartition("g1", "bi", "bj").sortWithinPartitions("g1", "bi", "bj", "own", member)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b): the smallest node connected to it.

    Labels fall to the smallest of the neighbours' and then to their labels' labels, until none changes;
    each round is written to the shared folder. Many nodes may share a label, so a label's own label is looked up once
    for each different label, and only those that changed are joined.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, f"{name}-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        now = labels.join(near.withColumnRenamed("a", "node"), "node", "left")
        now = now.select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        now = materialize(now, f"{name}-labels")
        if now.filter(F.col("old") != F.col("root")).isEmpty():
            return labels
        labels = now.select("node", "root")
        roots = labels.select("root").distinct()
        up = labels.filter(F.col("node") != F.col("root")).select(F.col("node").alias("root"), F.col("root").alias("upper")).join(roots, "root")
        up = materialize(up, f"{name}-upper")
        if n := up.count():
            up = F.broadcast(up) if n <= BROADCAST_ROOTS else up
            labels = labels.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
            labels = materialize(labels, f"{name}-labels")


def candidate_links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets that may be linked: of each band's bucket a spanning forest of the
    probable pairs. sets: (sid, bands, sig), a row per set."""
    entries = sets.select("sid", F.posexplode("bands").alias("band", "key"))
    entries = entries.select("sid", F.xxhash64("band", "key").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).filter(F.col("members") > 1)
    entries = entries.join(shared, "bucket").join(sets.select("sid", "sig"), "sid")
    rows = in_blocks(entries, "bucket", "members", "sid").select("g1", "bi", "bj", "own", "sid", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            group, side, sig = _group_numbers(t), _side(t), _signatures(t)
            pairs = [probable(a, b, sig) for a, b in _groups_of_pairs(group, side)]
            if not pairs:
                continue
            a, b = (np.concatenate(x) for x in zip(*pairs))
            label = _stars(t.num_rows, a, b)
            at = np.flatnonzero(label != np.arange(t.num_rows))
            sid = t["sid"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [_binary(sid.take(pa.array(at))), _binary(sid.take(pa.array(label[at])))], names=["a", "b"]
            )

    return rows.mapInArrow(run, "a binary, b binary").distinct()


def _binary(x) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def exact_links(members: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """members (comp, comp_size, sid, sig, copies, text): (sid, links, other) with links, the documents in other sets whose
    similarity reaches the threshold, and an edge to `other` for a spanning forest, a row or more per set."""
    rows = in_blocks(members, "comp", "comp_size", "sid").select("g1", "bi", "bj", "own", "sid", "sig", "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(small for batch in batches for small in _slices(batch)):
            group, side, sig = _group_numbers(t), _side(t), _signatures(t)
            copies, sets = t["copies"].to_numpy(), [s for part in _portions(t["text"].to_pylist()) for s in shingles(part, words)]
            n = np.array([len(s) for s in sets], np.int64)
            _, ids = np.unique(np.concatenate(sets), return_inverse=True)
            first = np.cumsum(n) - n
            flag = np.zeros(len(ids) + 1, bool)
            links, ra, rb = np.zeros(len(n), np.int64), [], []
            for a, b in _groups_of_pairs(group, side):
                # The smaller set can't have less than the threshold's share of the larger.
                near = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
                a, b = probable(a[near], b[near], sig, threshold)
                if not len(a):
                    continue
                starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                for lo, hi in zip(starts, [*starts[1:], len(a)], strict=True):
                    mine, others = a[lo], b[lo:hi]
                    own = ids[first[mine] : first[mine] + n[mine]]
                    flag[own] = True
                    c = n[others]
                    at = np.arange(c.sum()) + np.repeat(first[others] - (np.cumsum(c) - c), c)
                    both = np.add.reduceat(flag[ids[at]].astype(np.int64), np.cumsum(c) - c)
                    flag[own] = False
                    linked = others[both >= threshold * (n[mine] + c - both) - 1e-9]
                    links[mine] += copies[linked].sum()
                    links[linked] += copies[mine]
                    ra.append(np.full(len(linked), mine))
                    rb.append(linked)
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ra, rb))
            label = _stars(t.num_rows, a, b)
            sid = _binary(t["sid"])
            yield pa.RecordBatch.from_arrays(
                [sid, pa.array(links), _binary(sid.take(pa.array(label)))], names=["sid", "links", "other"]
            )

    return rows.mapInArrow(run, "sid binary, links long, other binary")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, 1000):
        yield batch.slice(at, 1000)


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, th (a key of the text), class_id (the smallest doc_id
    of all documents it is connected to by links, its own if there is none), n_links (other documents whose
    similarity is at least the threshold, copies included).

    The similarity of two documents is that of their sets of runs of words, see shingles(); documents without words
    have none and no links. Null doc_ids take part; a class of them alone has a null class_id. Repeated rows
    are documents of their own, linked as copies. Other columns are ignored. A candidate pair at the threshold
    is missed with a probability below 1e-6, one well above it with less; what is returned is exact. Memory of a task: about 80
    times BYTES_AT_ONCE or the longest text, and the texts of a group of two blocks of BLOCK documents.
    """
    rows = materialize(sketch(docs, words), "sketch")
    own = F.struct("doc_id", "th")
    sets = rows.filter(F.col("sid").isNotNull()).groupBy("sid").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(own).alias("rep"),
        F.min_by("bands", own).alias("bands"), F.min_by("sig", own).alias("sig"),
    )
    sets = materialize(sets, "sets")
    comps = components(candidate_links(sets), "candidates")
    sizes = comps.groupBy("root").agg(F.count("*").alias("comp_size"))
    members = comps.join(sizes, "root").withColumnRenamed("node", "sid")
    members = members.join(sets.select("sid", "sig", "copies", "rep"), "sid")
    members = members.withColumns({"__doc": F.col("rep.doc_id"), "__th": F.col("rep.th")}).drop("rep")
    texts = docs.select("doc_id", text_key().alias("th"), "text")
    on = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th"))
    members = texts.join(members, on).dropDuplicates(["sid"]) if _repeats(rows) else texts.join(members, on)
    found = exact_links(members.withColumnRenamed("root", "comp"), threshold, words)
    found = materialize(found, "links")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = components(found.filter(F.col("sid") != F.col("other")).select(F.col("sid").alias("a"), F.col("other").alias("b")), "classes")
    info = sets.select("sid", "copies", "least").join(links, "sid", "left").join(classes.withColumnRenamed("node", "sid"), "sid", "left")
    info = info.withColumn("root", F.coalesce("root", "sid"))
    least = info.groupBy("root").agg(F.min("least").alias("class_id"))
    info = info.join(least, "root").select("sid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "th", "sid").join(info, "sid", "left")
    alone = F.col("sid").isNull()
    return out.select(
        "doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _repeats(rows: DataFrame) -> bool:
    """Whether a document (doc_id and text) comes more than once."""
    return not rows.groupBy("doc_id", "th").count().filter(F.col("count") > 1).isEmpty()
