"""Suffix-array dedup: bytes that repeat an earlier string of LENGTH bytes are removed.

Windows of LENGTH bytes are dealt out by content: a window belongs to the smallest of the hashes of its
short strings, so equal windows meet. Consecutive windows of one such hash form a chunk of text. A chunk that
shares none of its longer strings with a different chunk of its hash can't hold a repeated window; chunks equal as a
whole count as one. What is left goes, as text, to shards that are sorted by external induced sorting, whose intervals of a
common prefix of LENGTH bytes are the windows that are equal. Hashes of very many different chunks don't go to a
shard: their windows meet one by one, in a grouping that is summed up before it is dealt out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._common import materialize, shared_dir, text_key
from gristmill.llm.induced_sort import suffix_blocks

#: Bytes of a string that must not repeat; of the short strings whose hashes deal windows out.
LENGTH, SHORT = 100, 32
#: Windows of a chunk at most: no more than LENGTH + 1, so that its first and its last window, which make its key, hold
#: all its bytes (a hash is at one place for LENGTH - SHORT + 1 windows, or recurs); bytes of text hashed at once; bytes of text per shard of chunks, and of chunk text per shard that is sorted; different chunks of one hash that go
#: to a shard.
WINDOWS, BYTES_AT_ONCE, SHARD, SORTED, HOT = LENGTH + 1, 1_000_000, 32 << 20, 5 << 20, 20_000
#: A window holds its short string and, of those around it, at least one of NEAR bytes: the string with so many of the
#: other bytes to its left as the name's number says in steps of (LENGTH - SHORT) / 4, and the rest of three steps to its right.
NEAR, _AROUND = SHORT + (LENGTH - SHORT) * 3 // 4, ("k0", "k1", "k2", "k3")
_U = np.uint64
_NULL = -(2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_ODD = _mix(np.arange(1000, 1128, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _doubled(h: np.ndarray, n: int) -> np.ndarray:
    return h[:-n] * _ODD[n] + h[n:]


def _sliding(x: np.ndarray, n: int, of) -> np.ndarray:
    """The least (or greatest) of n values from each on."""
    k, out = 1, x
    while 2 * k <= n:
        out = of(out[:-k], out[k:])
        k *= 2
    return of(out[: len(x) - n + 1], out[n - k : len(x) - k + 1]) if n > k else out


def chunks(raw: list[bytes]) -> dict[str, np.ndarray]:
    """The chunks of texts: doc (index), a (start), n (windows), h (the hash they share), c (a key of the
    content), double: whether the hash occurs twice in it, so that windows inside may be equal, and k0 to k3: keys of
    the strings of NEAR bytes around the place of the hash, at least one of which two equal windows share (0: no
    window of the chunk holds that string)."""
    kinds = {"doc": int, "a": int, "n": int, "h": _U, "c": _U, "double": bool, **dict.fromkeys(_AROUND, np.uint16)}
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    total = len(data) - LENGTH + 1
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)[: max(total, 0)]
    valid = np.arange(len(doc)) + LENGTH <= (begin + sizes)[doc]
    if not valid.any():
        return {k: np.empty(0, t) for k, t in kinds.items()}
    h1 = _BYTES[data]
    h2 = _doubled(h1, 1)
    h4 = _doubled(h2, 2)
    h16 = _doubled(_doubled(h4, 4), 8)
    h32 = _doubled(h16, 16)
    h64 = _doubled(h32, 32)
    short = _mix(h32)
    span = LENGTH - SHORT + 1
    least = _sliding(short, span, np.minimum)
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    run = np.flatnonzero(new)
    length = np.add.reduceat(valid.astype(np.int32), run).astype(np.int64)
    parts = -(-length // WINDOWS)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    a = np.repeat(run, parts) + WINDOWS * step
    n = np.minimum(WINDOWS, np.repeat(length, parts) - WINDOWS * step)
    h = least[a]

    def whole(i: np.ndarray) -> np.ndarray:
        return (h64[i] * _ODD[1] + h32[i + 64]) * _ODD[3] + h4[i + 96]

    c = _mix(whole(a) * _ODD[5] + _mix(whole(a + n - 1)) * _ODD[7] + n.astype(_U))
    # Places where a window's least hash stands; two of one hash close to each other may make equal windows.
    pad = np.zeros(span - 1, _U)
    most = _sliding(np.concatenate([pad, np.where(valid, least, _U(0)), pad]), span, np.maximum)
    at = np.flatnonzero(most == short)
    twice = at[:-1][(short[at[:-1]] == short[at[1:]]) & (np.diff(at) < span)]
    double = np.zeros(len(a), bool)
    near = np.searchsorted(a, twice, "right") - 1
    for k in range(-4, 5):
        i = np.clip(near + k, 0, len(a) - 1)
        double[i[h[i] == short[twice]]] = True
    # The place of the hash, which all windows of the chunk hold, and the strings around it.
    i = np.searchsorted(at, a + n - 1)
    while len(wrong := np.flatnonzero(short[at[i]] != h)):
        i[wrong] += 1
    p = at[i]
    out = {"doc": doc[a], "a": a - begin[doc[a]], "n": n, "h": h, "c": c, "double": double}
    step = (LENGTH - SHORT) // len(_AROUND)
    for j, name in enumerate(_AROUND):
        held = (p - a >= step * j) & (p - (a + n - 1) <= step * (j + 1))
        start = np.where(held, p - step * j, a)
        key = _mix((h64[start] * _ODD[9] + h16[start + 64]) * _ODD[11] + h2[start + 80] * _ODD[13] + h1[start + 82])
        out[name] = np.where(held, (key >> _U(48)).astype(np.uint16) | np.uint16(1), np.uint16(0))
    return out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, as maximal ones, by doc and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    big = int(end.max()) + 2
    reach = np.maximum.accumulate(end + doc * big)
    new = np.append(True, start[1:] + doc[1:] * big > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _settle(r: dict[str, np.ndarray], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are a first copy of their chunk, rows that repeat an earlier one). rank orders documents.

    Rows of one document and place, as repeated rows have them, are no copies of each other."""
    order = np.lexsort((r["a"], rank, r["n"], r["c"], r["h"]))
    h, c, n = (r[k][order] for k in ("h", "c", "n"))
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1]))[: len(order)]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = (rank[order] != rank[head]) | (r["a"][order] != r["a"][head])
    return order[new], order[later]


def _ranks(d: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The rank of (d, th) among those given; equal pairs have one."""
    order = np.lexsort((th, d))
    new = np.append(False, (d[order][1:] != d[order][:-1]) | (th[order][1:] != th[order][:-1]))[: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


_KINDS = (("h", np.uint64), ("c", np.uint64), ("doc", np.int32), ("a", np.int32), ("n", np.uint8), ("double", np.uint8), *((k, np.uint16) for k in _AROUND))


def _pack(r: dict[str, np.ndarray], rows: np.ndarray, d: np.ndarray, th: np.ndarray) -> bytes:
    docs, index = np.unique(r["doc"][rows], return_inverse=True)
    parts = [np.array([len(rows), len(docs)], np.int64), d[docs], th[docs]]
    parts += [(index if k == "doc" else r[k][rows]).astype(t) for k, t in _KINDS]
    return b"".join(p.tobytes() for p in parts)


def _unpack(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    out, ds, ths, docs = {k: [] for k, _ in _KINDS}, [], [], 0
    for b in blobs:
        n, m = np.frombuffer(b, np.int64, 2)
        ds.append(np.frombuffer(b, np.int64, m, 16))
        ths.append(np.frombuffer(b, np.int64, m, 16 + 8 * m))
        at = 16 + 16 * m
        for k, t in _KINDS:
            v = np.frombuffer(b, t, n, at)
            at += n * v.itemsize
            out[k].append(v + docs if k == "doc" else v)
        docs += m
    r = {k: np.concatenate(v) for k, v in out.items()}
    return {k: v.astype(np.int64) if k in ("doc", "a", "n") else v for k, v in r.items()}, np.concatenate(ds), np.concatenate(ths)


_DEALT = "shard int, d long, th long, start long, end long, blob binary"
_SETTLED = "kind int, d long, th long, start long, end long, h long"
_SPAN, _LOOK, _HOT = 0, 1, 2


def _batch(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    n = max((len(v) for v in columns.values()), default=0)
    arrays = [pa.array(columns[k], kinds[t]) if k in columns else pa.nulls(n, kinds[t]) for k, t in names]
    return pa.RecordBatch.from_arrays(arrays, names=[k for k, _ in names])


def _pieces(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """The texts in batches of about BYTES_AT_ONCE: (pieces, their texts' numbers, their places there). Longer texts are
    in several pieces; each window is in one of them."""
    pieces, docs, starts, size = [], [], [], 0
    for i in range(len(texts)):
        raw = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
        for start in range(0, max(1, len(raw) - LENGTH + 1), BYTES_AT_ONCE):
            pieces.append(raw[start : start + BYTES_AT_ONCE + LENGTH - 1] if len(raw) > BYTES_AT_ONCE else raw)
            docs.append(i)
            starts.append(start)
            size += len(pieces[-1])
            if len(raw) <= BYTES_AT_ONCE:
                break
            if size >= BYTES_AT_ONCE:
                yield pieces, np.array(docs), np.array(starts)
                pieces, docs, starts, size = [], [], [], 0
        if size >= BYTES_AT_ONCE:
            yield pieces, np.array(docs), np.array(starts)
            pieces, docs, starts, size = [], [], [], 0
    if pieces:
        yield pieces, np.array(docs), np.array(starts)


def _alike(r: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Of the different chunks `at`, in the order of h: which may hold a window that another one of them, or the same one,
    holds too."""
    h = r["h"][at]
    look = r["double"][at] != 0
    for name in _AROUND:
        key = r[name][at]
        held = np.flatnonzero(key)
        order = held[np.lexsort((key[held], h[held]))]
        same = np.append(False, (h[order][1:] == h[order][:-1]) & (key[order][1:] == key[order][:-1]))[: len(order)]
        look[order[same | np.append(same[1:], False)[: len(order)]]] = True
    # A hash that recurs within a chunk's windows has no one place: all chunks of that hash are looked at.
    look[np.isin(h, np.unique(h[r["double"][at] != 0]))] = True
    return look


def _deal(docs: DataFrame, shards: int) -> DataFrame:
    """docs (d, th, text): chunks in blobs by shard of their hash, and spans that repeat something earlier in the
    same batch already, so that many copies of one text are not all sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th = (batch.column(i).to_numpy() for i in (0, 1))
            for pieces, piece_doc, piece_start in _pieces(batch.column(2)):
                r = chunks(pieces)
                if not len(r["a"]):
                    continue
                docs, index = np.unique(piece_doc, return_inverse=True)
                own_d, own_th = d[docs], th[docs]
                r["a"] = r["a"] + piece_start[r["doc"]]
                r["doc"] = index[r["doc"]]
                first, later = _settle(r, _ranks(own_d, own_th)[r["doc"]])
                doc, start, end = merged(r["doc"][later], r["a"][later], r["a"][later] + r["n"][later] + LENGTH - 1)
                if len(doc):
                    to = (own_th[doc] % shards).astype(np.int32)
                    yield _batch(_DEALT, shard=to, d=own_d[doc], th=own_th[doc], start=start, end=end)
                to = (r["h"][first] % _U(shards)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order])) + 1
                groups = np.split(order, cuts)
                yield _batch(
                    _DEALT,
                    shard=np.array([to[g[0]] for g in groups], np.int32),
                    blob=[_pack(r, first[g], own_d, own_th) for g in groups],
                )

    return docs.mapInArrow(run, _DEALT)


def _settle_shards(dealt: DataFrame, shards: int) -> DataFrame:
    """Spans that repeat an earlier chunk; and the chunks whose text must be looked at: h, their windows' place start to
    end. Those of a hash with more than HOT different chunks are of another kind."""

    def one(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        r, d, th = _unpack(blobs)
        rank = _ranks(d, th)[r["doc"]]
        first, later = _settle(r, rank)
        doc, start, end = merged(r["doc"][later], r["a"][later], r["a"][later] + r["n"][later] + LENGTH - 1)
        yield _batch(_SETTLED, kind=np.full(len(doc), _SPAN, np.int32), d=d[doc], th=th[doc], start=start, end=end)
        at = first[_alike(r, first)]
        _, group, size = np.unique(r["h"][at], return_inverse=True, return_counts=True)
        doc, kind = r["doc"][at], np.where(size[group] > HOT, _HOT, _LOOK).astype(np.int32)
        start = r["a"][at]
        yield _batch(_SETTLED, kind=kind, d=d[doc], th=th[doc], start=start, end=start + r["n"][at], h=r["h"][at].view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blobs = None, []
        for batch in batches:
            plain = batch.filter(pa.compute.is_null(batch.column(5)))
            if plain.num_rows:
                kind = pa.array(np.full(plain.num_rows, _SPAN, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [kind, *plain.columns[1:5], pa.nulls(plain.num_rows, pa.int64())], names=["kind", "d", "th", "start", "end", "h"]
                )
            for s, b in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if b is None:
                    continue
                if s != shard and blobs:
                    yield from one(blobs)
                    blobs = []
                shard = s
                blobs.append(b)
        if blobs:
            yield from one(blobs)

    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, _SETTLED)


def _cut(wanted: DataFrame) -> DataFrame:
    """wanted (d, th, text, places array<struct<h, start, end>>): (h, d, th, start, end, bytes) of each place."""
    schema = "h long, d long, th long, start long, end long, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = {n: [] for n in ("h", "d", "th", "start", "end", "bytes")}
                part = batch.slice(k, 500)
                for d, th, text, places in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    for p in places:
                        for n, v in (("h", p["h"]), ("d", d), ("th", th), ("start", p["start"]), ("end", p["end"])):
                            rows[n].append(v)
                        rows["bytes"].append(raw[p["start"] : p["end"] + LENGTH - 1])
                yield _batch(schema, **rows)

    return wanted.select("d", "th", "text", "places").mapInArrow(run, schema)


def _sort_shards(cut: DataFrame, shards: int, folder: str) -> DataFrame:
    """(d, th, start, end) of what repeats an earlier window in the chunks of a shard."""
    schema = "d long, th long, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        d, th, start, end = (t[c].to_numpy() for c in ("d", "th", "start", "end"))
        rank = _ranks(d, th)
        raw = t["bytes"].to_pylist()
        size = np.array([len(b) for b in raw], np.int64) + 1
        del t, tables
        # Bytes are numbered from 1; a 0 ends each chunk, so that no common prefix of a whole window has one.
        text = np.zeros(size.sum(), np.uint16)
        first = np.cumsum(size) - size
        inside = np.ones(len(text), bool)
        inside[first + size - 1] = False
        text[inside] = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint16) + 1
        del raw, inside
        found = []
        for position, lcp in suffix_blocks(text, LENGTH, folder):
            joins = np.append(lcp[1:] >= LENGTH, False)
            member = joins | (lcp >= LENGTH)
            position, head = position[member], (lcp < LENGTH)[member]
            if not len(position):
                continue
            chunk = np.searchsorted(first, position, "right") - 1
            offset = position - first[chunk]
            whole = offset < (end - start)[chunk]
            place = (rank[chunk] << 40) + start[chunk] + offset
            place = np.where(whole, place, np.iinfo(np.int64).max)
            group = np.cumsum(head) - 1
            least = np.minimum.reduceat(place, np.flatnonzero(head))
            later = whole & (place > least[group])
            found.append(place[later])
        place = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        doc, s, e = merged(place >> 40, place & ((1 << 40) - 1), (place & ((1 << 40) - 1)) + LENGTH)
        by_rank = np.empty(rank.max() + 1, np.int64)
        by_rank[rank] = np.arange(len(rank))
        yield _batch(schema, d=d[by_rank[doc]], th=th[by_rank[doc]], start=s, end=e)

    return cut.repartition(shards, "h").mapInArrow(run, schema)


def _windows(wanted: DataFrame) -> DataFrame:
    """wanted as in _cut(): (w1, w2, d, th, at) of each window of the places; w1 and w2 are 128 bits of it."""
    schema = "w1 long, w2 long, d long, th long, at long"
    second = _mix(_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, th, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                for p in places:
                    part, n = raw[p["start"] : p["end"] + LENGTH - 1], p["end"] - p["start"]
                    out = []
                    for table in (_BYTES, second):
                        h = [table[part]]
                        for k in (1, 2, 4, 8, 16, 32):
                            h.append(_doubled(h[-1], k))
                        out.append(_mix((h[6][:n] * _ODD[1] + h[5][64 : 64 + n]) * _ODD[3] + h[2][96 : 96 + n]).view(np.int64))
                    at = np.arange(p["start"], p["end"])
                    yield _batch(schema, w1=out[0], w2=out[1], d=np.full(n, d), th=np.full(n, th), at=at)

    return wanted.select("d", "th", "text", "places").mapInArrow(run, schema)


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """(d, th, start, end) of the windows that also start earlier. Only the first place of a window is gathered."""
    windows = materialize(windows, "windows")
    place = F.struct("d", "th", "at")
    earliest = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    later = windows.join(earliest.drop("last"), ["w1", "w2"]).filter(place > F.col("first"))
    return later.select("d", "th", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, th, start, end) of bytes to remove from docs (doc_id, text): d is doc_id (null, or no integer: the smallest
    long), th a key of the text. Spans of a document may overlap. Two passes over the texts; everything between is in shards
    whose number grows with the input."""
    spark = docs.sparkSession
    own = docs.select(document().alias("d"), text_key().alias("th"), "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, total // SHARD)
    settled = materialize(_settle_shards(_deal(own, shards), shards), "settled")
    size = settled.groupBy("kind").agg(F.sum(F.col("end") - F.col("start") + LENGTH)).collect()
    size = {r[0]: r[1] for r in size}
    found = settled.filter(F.col("kind") == _SPAN).select("d", "th", "start", "end")
    for kind in (_LOOK, _HOT):
        if kind not in size:
            continue
        places = settled.filter(F.col("kind") == kind).groupBy("d", "th")
        wanted = own.join(places.agg(F.collect_list(F.struct("h", "start", "end")).alias("places")), ["d", "th"])
        if kind == _HOT:
            more = _repeated_windows(_windows(wanted))
        else:
            folder = f"{shared_dir(spark)}/queues-{uuid.uuid4().hex}"
            more = materialize(_sort_shards(_cut(wanted), max(8, size[kind] // SORTED), folder), "sorted")
        found = found.unionByName(more)
    return found


def document() -> Column:
    """doc_id as a long that can be joined on and comes in order: the smallest for null and for what is no integer."""
    return F.coalesce(F.col("doc_id").try_cast("long"), F.lit(_NULL))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_bytes, spans (array<struct<start, end>> of the maximal
    removed runs, in order) and kept (the other bytes).

    A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a document of
    smaller doc_id, or earlier in the same one; overlaps count, and no string crosses documents. Null text
    counts as empty. Null doc_ids, and those that are no integers, come first and count as equal. Rows equal in doc_id and
    text are one document; documents of one doc_id and different texts are in the order of their texts' hashes. Other
    columns are ignored. Chunks count as equal by 128 bits of hashes and their length, and so do windows of a hash with more
    than HOT chunks; all else is compared byte by byte. A task needs about 8 times the longest text as memory, and hashes a text in pieces.
    """
    spans = repeated_spans(docs).groupBy("d", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = docs.select("doc_id", document().alias("d"), text_key().alias("th"), "text").join(spans, ["d", "th"], "left")
    rows = rows.select("doc_id", "text", "spans")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", kind), T.StructField("kept", T.BinaryType())]
    )
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sizes, spans, kept = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    sizes.append(len(raw))
                    s = np.array([f["start"] for f in found or ()], np.int64)
                    e = np.array([f["end"] for f in found or ()], np.int64)
                    _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
                    kept.append(b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, arrow), pa.array(kept, pa.binary())],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
