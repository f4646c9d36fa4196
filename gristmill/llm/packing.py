"""Best-fit packing: documents become token pieces, a plan is made over the histogram of their lengths, and
pieces take its slots by their rank within their length."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._common import running_sum

#: Sequences hold so many tokens.
CAPACITY = 2048
#: Pieces and runs meet by blocks of so many ranks.
BLOCK = 4096
#: Characters tokenized at once, unless one text alone has more; words kept by a worker; rows taken from a batch at once.
CHARS_AT_ONCE, WORDS_KEPT, ROWS_AT_ONCE = 500_000, 500_000, 1000

_LETTER, _NUMBER, _SPACE, _OTHER, _UNSURE = range(5)
#: Unicode's White_Space.
_WHITE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point of the BMP. _UNSURE: not assigned or of another category in Unicode 3.2,
    so that libraries of different age could disagree."""
    out = np.full(0x10001, _UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    for cp in range(0x10000):
        kind = unicodedata.category(chr(cp))
        if kind == old(chr(cp)) and kind not in ("Cn", "Cs"):
            out[cp] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
    out[list(_WHITE)] = _SPACE
    return out


@lru_cache(1)
def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder:
    """The ids of a byte-level BPE file, as `tokenizers` gives them, with every different word encoded once.

    Texts are cut into words by array operations, words are looked up by 64-bit keys, and the tokenizer's
    model encodes those not met before. A text with characters on whose class Unicode versions differ, or
    with a special token's string, goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        rng = np.random.default_rng(7)
        self.factors = rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without any added ones."""
        out: list[np.ndarray | None] = [None] * len(texts)
        table, easy, points = _classes(), [], []
        for i, text in enumerate(texts):
            cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if any(s in text for s in self.special) or (table[np.minimum(cps, 0x10000)] == _UNSURE).any():
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            elif not len(cps):
                out[i] = np.empty(0, np.uint32)
            else:
                easy.append(i)
                points.append(cps)
        if easy:
            for i, ids in zip(easy, self._words(points, [texts[i] for i in easy]), strict=True):
                out[i] = ids
        return out

    def _words(self, points: list[np.ndarray], texts: list[str]) -> list[np.ndarray]:
        cps = np.concatenate(points)
        ends = np.cumsum([len(p) for p in points])
        n = len(cps)
        kind = _classes()[cps]
        first = np.zeros(n + 1, bool)  # of a text
        first[0] = True
        first[ends] = True
        start = first.copy()  # of a word
        start[1:n] |= kind[1:] != kind[:-1]
        # White space before something else: the last of a run stands alone or, if it is a blank, joins what follows.
        after = np.zeros(n, bool)
        after[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]
        start[:n] |= after
        joins = np.flatnonzero(after & (cps == 32)) + 1
        start[joins] = False
        # Contractions: an apostrophe that starts a word and is followed by letters.
        at = np.flatnonzero((cps == 39) & start[:n])
        at = at[(at + 1 < n)]
        at = at[(kind[np.minimum(at + 1, n - 1)] == _LETTER) & ~first[at + 1]]
        if len(at):
            one = cps[at + 1]
            far = at + 2 < n
            two = np.where(far, cps[np.minimum(at + 2, n - 1)], 0)
            two[far] = np.where(first[at[far] + 2], 0, two[far])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[at[short | long] + 1] = False
            start[at[short] + 2] = True
            start[at[long] + 3] = True
        begin = np.flatnonzero(start[:n])
        size = np.diff(np.append(begin, n))
        index = np.arange(n) - np.repeat(begin, size)
        if int(size.max()) > len(self.factors):  # never for words; keys must not repeat factors
            rng = np.random.default_rng(int(size.max()))
            more = rng.integers(0, 2**63, int(size.max()), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            factors = np.append(self.factors, more)
        else:
            factors = self.factors
        key = np.add.reduceat((cps.astype(np.uint64) + np.uint64(1)) * factors[index], begin)
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
        unique, where, back = np.unique(key, return_index=True, return_inverse=True)
        self._learn(unique, begin[where], size[where], cps)
        slot = np.searchsorted(self.keys, unique)[back]
        sizes, starts = self.sizes[slot], self.starts[slot]
        total = np.cumsum(sizes)
        ids = self.pool[np.arange(total[-1]) - np.repeat(total - sizes - starts, sizes)]
        last = total[np.searchsorted(begin, ends, "left") - 1]
        return np.split(ids, last[:-1])

    def _learn(self, unique: np.ndarray, begin: np.ndarray, size: np.ndarray, cps: np.ndarray) -> None:
        if len(self.keys) > WORDS_KEPT:
            self._empty()
        new = np.flatnonzero(~np.isin(unique, self.keys, assume_unique=True)) if len(self.keys) else np.arange(len(unique))
        if not len(new):
            return
        tokenize, chars = self.model.tokenize, _byte_chars()
        text = cps.tobytes()
        ids, counts = [], []
        for b, s in zip((begin[new] * 4).tolist(), (size[new] * 4).tolist(), strict=True):
            word = text[b : b + s].decode("utf-32-le")
            got = [t.id for t in tokenize("".join([chars[x] for x in word.encode()]))]
            ids += got
            counts.append(len(got))
        counts = np.array(counts, np.int64)
        starts = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.append(self.pool, np.array(ids, np.uint32))
        keys = np.append(self.keys, unique[new])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.starts = np.append(self.starts, starts)[order]
        self.sizes = np.append(self.sizes, counts)[order]


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text) as token pieces: doc_id, piece (from 0), start (ids of the document before the
    piece), length, tokens (unsigned 32-bit ids, little-endian).

    A document's ids are those of its text and `end_id`. At most `capacity`: one piece. Longer: pieces of
    `capacity`, of which the first may be shorter. Null text counts as empty: one piece, [end_id]. Null
    doc_id and repeated rows are documents like any other; no rows give none; other columns are ignored.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([end_id], np.uint32)
        for batch in (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE)):
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= CHARS_AT_ONCE):
                    chars += len(texts[stop])
                    stop += 1
                row, piece, start, length, tokens = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(texts[at:stop])):
                    ids = np.concatenate([ids.astype("<u4", copy=False), end])
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                    for k in range(len(cuts) - 1):
                        row.append(at + i)
                        piece.append(k)
                        start.append(cuts[k])
                        length.append(cuts[k + 1] - cuts[k])
                        tokens.append(ids[cuts[k] : cuts[k + 1]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(tokens, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "tokens"],
                )
                at = stop

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("tokens", T.BinaryType()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths.

    Returns runs (length, first rank, count, per, first sequence, offset): of the pieces of that length,
    rank first + i goes to sequence first sequence + i div per, at offset + (i mod per) * length.
    Sequences with the same room are alike, so only ranges of them are kept for each room.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0
    sizes = np.zeros(capacity + 1, bool)  # rooms that have sequences

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            rooms.setdefault(room, []).append((first, count))
            sizes[room] = True

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if length < 1 or length > capacity:
            raise ValueError(f"a piece of {length} tokens can't be placed in {capacity}")
        while left:
            fits = np.flatnonzero(sizes[length:])
            if len(fits):
                room = length + int(fits[0])
                first, count = rooms[room].pop()
                if not rooms[room]:
                    sizes[room] = False
            else:  # a sequence takes `per` pieces of this length before another is opened
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            per = room // length
            full = min(count, left // per)
            if full:
                runs.append((length, rank, full * per, per, first, capacity - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < count:
                if left and left < per:
                    runs.append((length, rank, left, left, first + full, capacity - room))
                    put(room - left * length, first + full, 1)
                    left, full = 0, full + 1
                put(room, first + full, count - full)
    return runs


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, any more columns), in place of columns of these names.

    pieces is read twice: give a table, not a costly plan. `order` names columns that tell rows apart (rows
    equal in all of them are interchangeable). The histogram has at most `capacity` rows and is what the
    driver sees. Ranks within a length are running counts over buckets by hash, so any share of the pieces
    may have one length. Rows without a length, or with one that can't be placed, are an error.
    """
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if None in hist:
        raise ValueError("a piece has no length")
    runs = plan(hist, capacity)
    names = ["length", "__first", "__count", "__per", "__sequence", "__offset"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])
    slots = spark.createDataFrame(runs, schema).withColumn(
        "__block",
        F.explode(
            F.sequence(
                F.floor(F.col("__first") / BLOCK), F.floor((F.col("__first") + F.col("__count") - 1) / BLOCK)
            )
        ),
    )
    counts = spark.createDataFrame(
        [(k, max(1, round(n**0.5))) for k, n in hist.items()],
        T.StructType([T.StructField("length", T.LongType()), T.StructField("__buckets", T.LongType())]),
    )
    df = pieces.withColumn("length", F.col("length").cast("long")).join(F.broadcast(counts), "length")
    bucket = F.pmod(F.xxhash64(*order), F.col("__buckets"))
    df = running_sum(df, ["length"], [F.col(c) for c in order], F.lit(1), "__rank", bucket)
    df = df.withColumn("__block", F.floor(F.col("__rank") / BLOCK)).join(slots, ["length", "__block"])
    i = F.col("__rank") - F.col("__first")
    df = df.filter((i >= 0) & (i < F.col("__count")))
    sequence = (F.col("__sequence") + F.floor(i / F.col("__per"))).cast("long")
    offset = (F.col("__offset") + (i % F.col("__per")) * F.col("length")).cast("long")
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return df.select(*kept, sequence.alias("sequence_id"), offset.alias("offset"))
