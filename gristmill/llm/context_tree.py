"""LM scoring: context-tree weighting over binary-decomposed bytes, and a count of words as the base.

A byte is eight binary choices; each of the 255 nodes of that decomposition has a context tree over the bytes
before. A node of a tree has Krichevsky-Trofimov counts, and mixes its own estimate with those of the longer contexts below it
by the weights that the learning documents give. A text's probability is the product over its bytes and an end mark.

What is shuffled are not places but different strings: documents are put into blocks, and a block asks for
each different string of depth + 1 bytes once. Strings go to buckets by the last three bytes of their context, where
all longer contexts are at hand; the levels above are summed up over the buckets. Words go the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._common import materialize
from gristmill.llm._words import split_words

#: Bytes of context; of text in a block and in a piece of it that is sorted at once; of text for each bucket; buckets at least;
#: buckets that the strings of one context of two bytes go to at most.
DEPTH, BLOCK, PIECE, BUCKET, BUCKETS, SPREAD = 6, 8 << 20, 1 << 20, 8 << 20, 24, 16
#: No byte of UTF-8: stands after each text, and before it as often as the context is long.
END = b"\xff"
#: Sums of logarithms are of whole numbers of this size, so that they don't depend on their order; code lengths of strings are
#: in so many parts of a bit.
_UNIT, PARTS = 2.0**-24, 4096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_U = np.uint64

_N = np.arange(1, 4096, dtype=np.float64)
_LOG_ONE = np.append(0.0, np.cumsum(np.log(_N)))
_LOG_HALF = np.append(0.0, np.cumsum(np.log(_N - 0.5))) + np.log(np.pi) / 2


def _log_gamma(n: np.ndarray, plus: float, small: np.ndarray) -> np.ndarray:
    """The logarithm of Gamma(n + plus) for whole n from 0 on."""
    out = small[np.minimum(n, len(small) - 1)]
    if (large := n >= len(small)).any():
        x = n[large] + plus
        out[large] = (x - 0.5) * np.log(x) - x + np.log(2 * np.pi) / 2 + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros, 0.5, _LOG_HALF) + _log_gamma(ones, 0.5, _LOG_HALF) - _log_gamma(zeros + ones, 1.0, _LOG_ONE) - np.log(np.pi)


def _weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the weighted probability, weight of the own estimate, own estimate of a one) of inner nodes, given the sum of
    the logs of their children."""
    own = log_kt(zeros, ones)
    log = np.logaddexp(own, below) - np.log(2)
    return log, np.exp(own - np.log(2) - log), (ones + 0.5) / (zeros + ones + 1.0)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else x[:0]


class Tree:
    """The nodes of contexts of 3 to `depth` bytes, by level and bit: code, weight, estimate and the code of the parent. A code
    is a context, last byte first, and behind it the bits of the byte that are known. top: by bit (code, zeros, ones,
    sum of logs) of contexts of 2 bytes, as far as these strings go."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int) -> None:
        """keys: different strings in order (the context's last byte first, then the byte); counts: above 0."""
        self.level, self.top = {d: [] for d in range(3, depth + 1)}, []
        for t in range(8):
            code = keys >> _U(8 - t)
            first = _starts(code)
            total, ones = _sum(counts, first), _sum(counts * ((keys >> _U(7 - t)) & _U(1)).astype(np.int64), first)
            code, zeros = code[first], total - ones
            log, weight, p = log_kt(zeros, ones), np.ones(len(code)), (ones + 0.5) / (total + 1.0)
            for d in range(depth, 2, -1):
                parent = (code >> _U(8 + t)) << _U(t) | code & _U((1 << t) - 1)
                self.level[d].append((code, weight, p, parent))
                order = np.argsort(parent, kind="stable")
                first = _starts(parent[order])
                code = parent[order][first]
                zeros, ones, below = (_sum(x[order], first) for x in (zeros, ones, np.rint(log / _UNIT).astype(np.int64)))
                if d > 3:
                    log, weight, p = _weighted(zeros, ones, below * _UNIT)
            self.top.append((code, zeros, ones, below))


def _find(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted one in the sorted codes, whether it is there)."""
    if not len(codes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return at, codes[at] == wanted


def log2_of(keys: np.ndarray, tree: Tree, depth: int, above: np.ndarray, second: list[tuple]) -> np.ndarray:
    """The binary logarithm of the probability of each string's last byte. above: 256 x 256, the probability of a one by
    last byte and node where nothing longer is known; second: by bit (code, share settled, share left) of contexts of 2
    bytes."""
    out = np.zeros(len(keys))
    for t in range(8):
        node = (_U(1) << _U(t)) | (keys & _U(255)) >> _U(8 - t)
        p = above[(keys >> _U(8 * depth)).astype(np.int64), node.astype(np.int64)]
        code, settled, left = second[t]
        for d in range(2, depth + 1):
            if d > 2:
                code, weight, q, parent = tree.level[d][t]
                at, _ = _find(second_code, parent)
                settled, left = settled[at] + left[at] * weight * q, left[at] * (1 - weight)
            wanted = (keys >> _U(8 * (depth + 1 - d))) << _U(t) | (keys & _U(255)) >> _U(8 - t)
            at, there = _find(code, wanted)
            p[there] = (settled + left / 2)[at[there]]
            second_code = code
        one = (keys >> _U(7 - t)) & _U(1) == 1
        out += np.log2(np.maximum(np.where(one, p, 1 - p), 2.0**-60))
    return out


def strings_of(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(different strings in order, where the places of each begin, text of each place) of pieces of the texts."""
    room = 8 * (8 - depth - 1)

    def sort(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.frombuffer(b"".join(parts), np.uint8).astype(_U)
        n = len(a) - depth
        keys = a[depth:].copy()
        for k in range(1, depth + 1):
            keys |= a[depth - k : depth - k + n] << _U(8 * (depth + 1 - k))
        size = np.array([len(p) for p in parts])
        inside = np.ones(n, bool)  # but for the bytes at the start of a part, which are only context
        inside[(np.cumsum(size)[:-1, None] - depth + np.arange(depth)).ravel()] = False
        x = np.sort(keys[inside] << _U(room) | np.repeat(np.arange(len(parts), dtype=_U), size - depth))
        keys = x >> _U(room)
        first = _starts(keys)
        return keys[first], first, np.array(owners)[(x & _U((1 << room) - 1)).astype(np.int64)].astype(np.int32)

    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        whole = END * depth + t + END
        for at in range(0, len(whole) - depth, PIECE):
            parts.append(whole[at : at + PIECE + depth])
            owners.append(i)
            size += len(parts[-1])
            if size >= PIECE or len(parts) == 1 << room:
                yield sort(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield sort(parts, owners)


def _bucket(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """By the last three bytes of the context; those of the same last two go to SPREAD buckets at most."""
    two, third = keys >> _U(8 * (depth - 1)), (keys >> _U(8 * (depth - 2))) & _U(255)
    return ((two * _U(40503) + third * _U(157) % _U(SPREAD)) % _U(buckets)).astype(np.int32)


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = _starts(bucket[order])
    return [(int(bucket[g[0]]), g) for g in np.split(order, cuts[1:])] if len(order) else []


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, as most are small."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _release(raw: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(raw[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[4:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def _ascending(x: np.ndarray) -> bytes:
    return _squeeze(np.diff(x, prepend=_U(0)))


def _ask(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """docs (doc_id, text binary, learn): rows of blocks (ids, learn, sizes, texts) and of what they ask for: different
    strings or words by bucket, and how often each is in the documents to learn from."""
    id_type = docs.schema["doc_id"].dataType
    fields = [
        ("kind", T.IntegerType()), ("block", T.LongType()), ("bucket", T.IntegerType()), ("ids", T.ArrayType(id_type)),
        ("learn", T.ArrayType(T.BooleanType())), ("sizes", T.ArrayType(T.LongType())), ("texts", T.BinaryType()), ("strings", T.BinaryType()),
        ("words", T.ArrayType(T.BinaryType())), ("counts", T.BinaryType()),
    ]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def batch_of(arrow: pa.Schema, n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def words_asked(block: int, learn: np.ndarray, texts: list[bytes], arrow: pa.Schema) -> pa.RecordBatch:
        words, word, size = split_words(texts)
        often = np.bincount(word, np.repeat(learn, size), len(words)).astype(np.int64)
        groups = _by_bucket(_word_bucket(words, buckets))
        n, order = len(groups), np.concatenate([np.empty(0, np.int64), *(g for _, g in groups)])
        cuts = pa.array(np.cumsum([0, *(len(g) for _, g in groups)]), pa.int32())
        return batch_of(
            arrow, n, kind=pa.array([2] * n), block=pa.array([block] * n), bucket=pa.array([b for b, _ in groups], pa.int32()),
            words=pa.ListArray.from_arrays(cuts, words.take(pa.array(order))), counts=pa.array([_squeeze(often[g]) for _, g in groups], pa.binary()),
        )

    def strings_asked(block: int, learn: np.ndarray, texts: list[bytes], arrow: pa.Schema) -> pa.RecordBatch:
        keys, counts = [], []
        for own, first, text in strings_of(texts, depth):
            keys.append(own)
            counts.append(_sum(learn[text].astype(np.int32), first))
        keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = _starts(keys)
        keys, counts = keys[first], _sum(counts, first)
        groups = _by_bucket(_bucket(keys, depth, buckets))
        n = len(groups)
        return batch_of(
            arrow, n, kind=pa.array([1] * n), block=pa.array([block] * n), bucket=pa.array([b for b, _ in groups], pa.int32()),
            strings=pa.array([_ascending(keys[g]) for _, g in groups], pa.binary()), counts=pa.array([_squeeze(counts[g]) for _, g in groups], pa.binary()),
        )

    def emit(block: int, ids: list, learn: list[bool], texts: list[bytes], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        whole = b"".join(texts)
        packed = len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)
        row = {"kind": 0, "block": block, "ids": ids, "learn": learn, "sizes": [len(t) for t in texts], "texts": packed}
        del whole
        yield pa.RecordBatch.from_pylist([row], arrow)
        yield words_asked(block, np.array(learn), texts, arrow)
        yield strings_asked(block, np.array(learn), texts, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        task, number = TaskContext.get().partitionId(), 0
        ids, learn, texts, size = [], [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                i, text, own = (c[k].as_py() for c in batch.columns)
                ids.append(i)
                texts.append((text or b"").translate(_LOWER))
                learn.append(bool(own))
                size += len(texts[-1])
                if size >= BLOCK:
                    yield from emit((task << 32) + number, ids, learn, texts, arrow)
                    number += 1
                    ids, learn, texts, size = [], [], [], 0
        if ids:
            yield from emit((task << 32) + number, ids, learn, texts, arrow)

    return docs.mapInArrow(run, schema)


def _word_bucket(words: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % buckets for w in words.to_pylist()), np.int32, len(words))


def _known_strings(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The different strings of the rows in order, and how often they are learnt from."""
    keys = np.concatenate([np.cumsum(_release(x, _U), dtype=_U) for x in rows["strings"].to_pylist()])
    counts = np.concatenate([_release(x, np.int64) for x in rows["counts"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    first = _starts(keys[order])
    return keys[order][first], _sum(counts[order], first)


def _tree_of(rows: pa.Table, depth: int) -> tuple[np.ndarray, Tree]:
    keys, counts = _known_strings(rows)
    return keys, Tree(keys[counts > 0], counts[counts > 0], depth)


def _upper_levels(asked: DataFrame, depth: int) -> tuple[DataFrame, np.ndarray]:
    """(node, settled, left) of contexts of 2 bytes; and for those of one or none, the table `above` of log2_of(). To
    the driver come the nodes of contexts of one byte: 65,280 at most."""
    schema = "node int, zeros long, ones long, below long"

    def two_bytes(rows: pa.Table) -> pa.Table:
        _, tree = _tree_of(rows, depth)
        out = [
            (((code >> _U(t)) << _U(8)) | _U(1 << t) | (code & _U((1 << t) - 1)), zeros, ones, below)
            for t, (code, zeros, ones, below) in enumerate(tree.top)
        ]
        node, *sums = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([pa.array(node.astype(np.int32)), *map(pa.array, sums)], names=["node", "zeros", "ones", "below"])

    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "below")]
    second = asked.groupBy("bucket").applyInArrow(two_bytes, schema).groupBy("node").agg(*sums)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zeros, ones, below = (b.column(c).to_numpy() for c in ("zeros", "ones", "below"))
            log, weight, p = _weighted(zeros, ones, below * _UNIT)
            arrays = [b.column("node"), b.column("zeros"), b.column("ones"), pa.array(np.rint(log / _UNIT).astype(np.int64)), pa.array(weight), pa.array(p)]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "zeros", "ones", "below", "weight", "p"])

    second = materialize(second.mapInArrow(weigh, schema + ", weight double, p double"), "contexts-of-two")
    # node: 8 bits of the last byte, 8 of the one before, 8 of the node of the decomposition.
    one = F.shiftright("node", 16) * 256 + F.col("node").bitwiseAND(255)
    first = second.groupBy(one.alias("node")).agg(*sums).toPandas().sort_values("node")
    node = first["node"].to_numpy()
    last, choice = node >> 8, node & 255
    zeros, ones, below = (first[c].to_numpy() for c in ("zeros", "ones", "below"))
    log, weight, p = _weighted(zeros, ones, below * _UNIT)
    root = [np.bincount(choice, x, 256).astype(np.int64) for x in (zeros, ones)]
    _, root_weight, root_p = _weighted(*root, np.bincount(choice, np.rint(log / _UNIT), 256) * _UNIT)
    known = np.bincount(choice, minlength=256) > 0
    settled0, left0 = np.where(known, root_weight * root_p, 0.5), np.where(known, 1 - root_weight, 0.0)
    settled, left = np.zeros((256, 256)), np.zeros((256, 256))
    settled[last, choice] = settled0[choice] + left0[choice] * weight * p
    left[last, choice] = left0[choice] * (1 - weight)
    above = np.tile(settled0 + left0 / 2, (256, 1))
    above[last, choice] = (settled + left / 2)[last, choice]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            at = node >> 16, node & 255
            w, p = b.column("weight").to_numpy(), b.column("p").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), pa.array(settled[at] + left[at] * w * p), pa.array(left[at] * (1 - w))], names=["node", "settled", "left"]
            )

    return second.select("node", "weight", "p").mapInArrow(shares, "node int, settled double, left double"), above


_ANSWER = "block long, kind int, bucket int, answer binary"


def _answer_strings(asked: DataFrame, depth: int, buckets: int) -> DataFrame:
    """For each block and bucket the code lengths of its strings, in their order."""
    second, above = _upper_levels(asked, depth)
    two = F.shiftright("node", 8).cast("long")
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda s: ((two * 40503 + s) % buckets).cast("int")))
    second = second.select(F.explode(places).alias("bucket"), "node", "settled", "left")

    def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.nulls(0, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary())], names=["block", "kind", "bucket", "answer"])
        keys, tree = _tree_of(rows, depth)
        node, settled, left = (upper[c].to_numpy() for c in ("node", "settled", "left"))
        order = np.argsort(node)
        node, settled, left = node[order], settled[order], left[order]
        by_bit = []
        for t in range(8):
            own = ((node & 255) >> t) == 1
            code = ((node[own] >> 8).astype(_U) << _U(t)) | (node[own].astype(_U) & _U((1 << t) - 1))
            by_bit.append((code, settled[own], left[own]))
        parts = np.rint(-PARTS * log2_of(keys, tree, depth, above, by_bit)).astype(np.uint32)
        answer = []
        for x in rows["strings"].to_pylist():
            answer.append(_squeeze(parts[np.searchsorted(keys, np.cumsum(_release(x, _U), dtype=_U))]))
        n = rows.num_rows
        return pa.table(
            [rows["block"], pa.array(np.full(n, 1, np.int32)), rows["bucket"], pa.array(answer, pa.binary())], names=["block", "kind", "bucket", "answer"]
        )

    return asked.groupBy("bucket").cogroup(second.groupBy("bucket")).applyInArrow(run, _ANSWER)


def _answer_words(asked: DataFrame) -> DataFrame:
    """For each block and bucket how often its words are learnt from, in their order; and for each bucket a row with
    block -1: all words learnt, and how many different ones."""

    def run(rows: pa.Table) -> pa.Table:
        words = rows["words"].combine_chunks()
        counts = np.concatenate([_release(x, np.int64) for x in rows["counts"].to_pylist()])
        coded = words.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        often = np.bincount(number, counts, len(coded.dictionary)).astype(np.int64)
        cuts = np.cumsum(words.value_lengths().to_numpy())[:-1]
        answer = [_squeeze(x) for x in np.split(often[number], cuts)]
        answer.append(np.array([often.sum(), (often > 0).sum()], np.int64).tobytes())
        block = np.append(rows["block"].to_numpy(), -1)
        bucket = np.full(len(block), rows["bucket"][0].as_py(), np.int32)
        return pa.table(
            [pa.array(block), pa.array(np.full(len(block), 2, np.int32)), pa.array(bucket), pa.array(answer, pa.binary())],
            names=["block", "kind", "bucket", "answer"],
        )

    return asked.groupBy("bucket").applyInArrow(run, _ANSWER)


def score_texts(docs: DataFrame, learn: Column, depth: int = DEPTH) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, learnt, n_bytes, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte.

    learn: a condition on docs' columns, of the rows to learn from (null: not learnt from). Letters A-Z count as small ones.
    score: log10 of the probability of the text and its end by the model of contexts of up to `depth` (3 to 6) bytes that the
    learnt texts make, all of them, each byte's code length rounded to a 4096th of a bit; bits_per_byte: the code length of the text and its end by bytes and one. base_score: the
    sum over the words and one end of log10((c + 0.5) / (N + 0.5 * (V + 1))), c, N and V from the learnt texts; n_tokens
    counts the end, n_known those with c > 0, train_tokens is N. Null text counts as empty. Rows count one by one, whatever
    their ids (null, repeated or of any type); other columns are ignored. Nothing to learn from: eight bits a byte, a base
    of 0. No rows: none. The same rows give the same scores, however they are dealt out.

    Memory of a task: about 15 times BLOCK and 4 times the longest text, which is not split. To the driver come sums over
    the buckets of words and the nodes of contexts of one byte.
    """
    if not 3 <= depth <= 6:
        raise ValueError("contexts have 3 to 6 bytes")
    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size, ends = own.agg(F.sum(F.octet_length("text")), F.count_if("learn")).first()
    buckets = max(BUCKETS, (size or 0) // BUCKET)
    asked = materialize(_ask(own, depth, buckets), "context-blocks")
    strings = asked.filter("kind = 1").select("block", "bucket", "strings", "counts")
    words = asked.filter("kind = 2").select("block", "bucket", "words", "counts")
    words = materialize(_answer_words(words), "context-words")
    sums = [np.frombuffer(r[0], np.int64) for r in words.filter("block = -1").select("answer").toLocalIterator()]
    all_words, different = (sum(int(x[i]) for x in sums) for i in (0, 1))
    tokens, kinds = all_words + ends, different + (ends > 0)
    # A row of a block is large, and so few of them go to a task.
    blocks = asked.filter("kind = 0").select("block", "ids", "learn", "sizes", "texts")
    tasks = max(1, blocks.count() // 2)
    answers = words.filter("block >= 0").unionByName(_answer_strings(strings, depth, buckets)).repartition(tasks, "block")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "answer")).alias("answers"))
    blocks = blocks.repartition(tasks, "block").join(answers, "block")
    names = ("n_bytes", "n_tokens", "n_known", "train_tokens")
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("learnt", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in names),
         *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "bits_per_byte"))]
    )

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, ids, learnt, sizes, packed, told = (c[k] for c in batch.columns)
                packed, sizes = packed.as_py(), np.array(sizes.as_py(), np.int64)
                whole = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
                cuts = np.append(0, np.cumsum(sizes))
                texts = [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                told = {(t["kind"], t["bucket"]): t["answer"] for t in told.as_py()}
                pieces = list(strings_of(texts, depth))
                keys = np.sort(np.concatenate([p[0] for p in pieces]))
                keys = keys[_starts(keys)]
                long, bits = np.zeros(len(keys), np.uint32), np.zeros(len(texts))
                for b, g in _by_bucket(_bucket(keys, depth, buckets)):
                    long[g] = _release(told[1, b], np.uint32)
                while pieces:
                    own, first, text = pieces.pop()
                    often = np.diff(np.append(first, len(text)))
                    bits += np.bincount(text, np.repeat(long[np.searchsorted(keys, own)], often), len(texts))
                bits /= PARTS
                words, word, n = split_words(texts)
                count = np.zeros(len(words), np.int64)
                for b, g in _by_bucket(_word_bucket(words, buckets)):
                    count[g] = _release(told[2, b], np.int64)
                owner = np.repeat(np.arange(len(texts)), n)
                scores = np.bincount(owner, base(count)[word], len(texts)) + base(np.array([ends]))
                known = np.bincount(owner, (count > 0)[word], len(texts)).astype(np.int64) + (ends > 0)
                columns = (sizes, n + 1, known, np.full(len(n), tokens), scores, -bits * np.log10(2), bits / (sizes + 1))
                types = [pa.int64()] * 4 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays(
                    [ids.values, learnt.values, *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=schema.names
                )

    return blocks.mapInArrow(run, schema)
