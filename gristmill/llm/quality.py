"""Quality classifier: attention-based multiple-instance learning. A document is a bag of passages; labels
are of documents. Every passage is encoded, gated attention weighs the codes, and their sum is scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a passage; documents that a model is fitted on at most (chosen by hash of the id).
PASSAGE, MAX_LABELLED = 512, 6000
#: Bytes whose features are computed at once, unless one text alone has more.
BYTES_AT_ONCE = 1_000_000


def _byte_classes() -> tuple[np.ndarray, int]:
    """A class for each byte: letters by themselves whatever their case, marks by themselves, kinds of others."""
    out, n = np.zeros(256, np.int64), 0
    for b in range(256):
        c = chr(b)
        if b < 128 and c.isalpha():
            continue
        if 32 < b < 127 and not c.isdigit():
            out[b], n = n, n + 1
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = n + k
    n += 26
    out[48:58] = n
    out[32], out[10] = n + 1, n + 2
    out[[b for b in range(32) if b != 10] + [127]] = n + 3
    for k in range(4):
        out[128 + 16 * k : 144 + 16 * k] = n + 4 + k
    out[192:224], out[224:] = n + 8, n + 9
    return out, n + 10


_CLASS, _CLASSES = _byte_classes()
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Features of a passage: shares of byte classes, and eight of its words.
FEATURES = _CLASSES + 8


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, float32; passages of each text, at least one). Whole texts, in passages of
    PASSAGE bytes; a word belongs to the passage it starts in. An empty text is one passage of zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    total = int(counts.sum())
    out = np.zeros((total, FEATURES), np.float32)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return out, counts
    start = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    place = np.arange(len(data)) - np.repeat(start, sizes)
    passage = np.repeat(first, sizes) + place // PASSAGE
    shares = np.bincount(passage * _CLASSES + _CLASS[data], minlength=total * _CLASSES).reshape(total, _CLASSES)
    length = np.maximum(1, shares.sum(1))
    out[:, :_CLASSES] = shares / length[:, None]
    ink = ~_BLANK[data]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | (place[1:] == 0)
    at = np.flatnonzero(begin)
    if not len(at):
        return out, counts
    of = passage[at]
    end = np.append(at[1:], len(data))
    letters = np.add.reduceat((_LETTER[data]).astype(np.int32), at)
    upper = np.add.reduceat((_UPPER[data]).astype(np.int32), at)
    marks = np.add.reduceat((ink & ~_LETTER[data]).astype(np.int32), at)
    # Words as sums of their bytes' products with odd numbers: equal words, equal keys.
    index = np.clip(np.arange(len(data)) - at[np.maximum(np.cumsum(begin) - 1, 0)], 0, 63)
    key = np.add.reduceat(np.where(ink, data.astype(np.uint64) + np.uint64(1), np.uint64(0)) * _ODD[index], at)
    words = np.maximum(1, np.bincount(of, minlength=total))
    mean = lambda v: np.bincount(of, v, total) / words
    again = np.zeros(len(at))
    again[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    mixed = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) ^ of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    pairs, where = np.unique(mixed, return_index=True)
    different = np.bincount(of[where], minlength=total)
    out[:, _CLASSES:] = np.stack(
        [
            mean(letters) / 10, mean(upper > 0), mean((upper == letters) & (letters > 1)), mean(marks > 1),
            mean(letters == 0), mean(again), different / words, np.log1p(length) / 6,
        ],
        1,
    )
    return out, counts


_ODD = np.random.default_rng(3).integers(0, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """code = tanh(x W + b); weight = softmax over the bag of g . (tanh(code V) * sigmoid(code U)); score =
    sigmoid(c . sum of weight * code + d)."""

    def __init__(self, codes: int = 32, gates: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, a**-0.5, (a, b)).astype(np.float32)
        self.mean = np.zeros(FEATURES, np.float32)
        self.scale = np.ones(FEATURES, np.float32)
        self.p = {
            "W": init(FEATURES, codes), "b": np.zeros(codes, np.float32), "V": init(codes, gates), "U": init(codes, gates),
            "g": init(gates, 1)[:, 0], "c": init(codes, 1)[:, 0], "d": np.zeros(1, np.float32),
        }

    def _forward(self, x: np.ndarray, counts: np.ndarray):
        p = self.p
        starts = np.cumsum(counts) - counts
        code = np.tanh((x - self.mean) * self.scale @ p["W"] + p["b"])
        t, s = np.tanh(code @ p["V"]), _sigmoid(code @ p["U"])
        e = (t * s) @ p["g"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * code, starts, axis=0)
        return code, t, s, a, z, _sigmoid(z @ p["c"] + p["d"])

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self._forward(x, counts)[5].astype(np.float64)

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 3e-3, batch: int = 64, decay: float = 1e-4) -> Model:
        """Adam on the cross entropy of the bags' labels, in an order that depends on the seed alone."""
        self.mean = x.mean(0)
        self.scale = (1 / np.maximum(x.std(0), 1e-3)).astype(np.float32)
        rng, n = np.random.default_rng(5), len(counts)
        starts = np.cumsum(counts) - counts
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(n)
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for at in range(0, n, batch):
                bags = order[at : at + batch]
                c = counts[bags]
                rows = np.arange(c.sum()) + np.repeat(starts[bags] - (np.cumsum(c) - c), c)
                grads = self._gradients(x[rows], c, y[bags])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        starts = np.cumsum(counts) - counts
        code, t, s, a, z, out = self._forward(x, counts)
        dy = (out - y) / len(y)
        dz = dy[:, None] * p["c"]
        spread = np.repeat(dz, counts, 0)
        da = (spread * code).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), counts))
        dcode = a[:, None] * spread
        dt = de[:, None] * p["g"] * s * (1 - t * t)
        ds = de[:, None] * p["g"] * t * s * (1 - s)
        dcode = dcode + dt @ p["V"].T + ds @ p["U"].T
        dx = dcode * (1 - code * code)
        return {
            "W": ((x - self.mean) * self.scale).T @ dx, "b": dx.sum(0), "V": code.T @ dt, "U": code.T @ ds,
            "g": (t * s).T @ de, "c": z.T @ dy, "d": np.array([dy.sum()]),
        }


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) <= BYTES_AT_ONCE):
            size += len(raw[stop])
            stop += 1
        yield at, raw[at:stop]
        at = stop


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; a null id is as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> Model:
    """A model of `label` from documents (doc_id, text) that are not held out.

    At most `most` labelled ids are used, those of the smallest hashes, so that what the driver gathers is
    bounded; their texts are used whole. An id labelled twice counts by its largest label; null labels and
    ids are left out. Without any labelled document the model says 0.5 for all. The fit is a fixed
    sequence of steps from a fixed seed.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            for at, texts in _parts(b.column(1).to_pylist()):
                x, counts = passage_features(texts)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(texts)), b.column(2).slice(at, len(texts)).cast(pa.int32()),
                        pa.array([x[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "y", "x"],
                )

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())]
    )
    got = rows.select("doc_id", "text", "__y").mapInArrow(encode, schema).toArrow()
    model = Model()
    if not got.num_rows:
        model.p = {k: np.zeros_like(v) for k, v in model.p.items()}
        return model
    order = sorted(range(got.num_rows), key=lambda i, ids=got["doc_id"].to_pylist(), x=got["x"].to_pylist(): (ids[i], x[i]))
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["x"].take(pa.array(order)).to_pylist()]
    y = np.array(got["y"].to_pylist(), np.float32)[order]
    return model.fit(np.concatenate(bags), np.array([len(b) for b in bags]), y)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from `threshold` on) from the whole text alone. Null and empty
    texts have the score of a bag of one passage of zeros. Columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    df = docs.select(*kept)
    at_text = kept.index("text")
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = [model.scores(*passage_features(texts)) for _, texts in _parts(b.column(at_text).to_pylist())]
            values = pa.array(np.concatenate(found) if found else np.empty(0))
            yield pa.RecordBatch.from_arrays([*b.columns, values], names=schema.names)

    return df.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
