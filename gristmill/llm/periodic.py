"""Periodic runs: stretches of words that repeat themselves with a period, found by Karp-Miller-Rosenberg names.

Blocks of 2 ** k words get names, equal ones the same: a name of level k + 1 stands for two of level k. How far two places
agree is then a walk down the levels. A run of period q agrees with itself q words on for so long that it covers a whole
block that starts at a multiple of max(q, SHORTEST / 3); such blocks are the only candidates, and those that have
the same name q words on are extended to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._words import split_words

#: Words of a run at least, and periods of it at least. Bytes of text that are named at once, unless one text alone has more.
SHORTEST, TIMES, BYTES_AT_ONCE = 24, 3, 2 << 20


def _named(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each of n places and one more the number of its code; -1 where it has none, or no other place has it too."""
    out = np.full(n + 1, -1, np.int32)
    if len(codes):
        order = np.argsort(codes)
        sort = codes[order]
        group = np.cumsum(np.append(True, sort[1:] != sort[:-1])) - 1
        several = np.bincount(group) > 1
        out[at[order]] = np.where(several, np.cumsum(several) - 1, -1)[group]
    return out


class Names:
    """Names of all blocks of 2 ** k words that occur twice in a text, by level. word: numbers of the words of all
    texts, one after the other; begin and end: of each text. No two texts share a name."""

    def __init__(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        n = len(word)
        self.text = np.repeat(np.arange(len(begin), dtype=np.int64), end - begin)
        self.begin, self.end = begin, end
        self.level = [_named(self.text * (int(word.max(initial=0)) + 1) + word, np.arange(n), n)]
        last = end[self.text] if n else np.empty(0, np.int64)
        while True:
            names, half = self.level[-1], 1 << (len(self.level) - 1)
            at = np.flatnonzero(names[:n] >= 0)
            at = at[at + 2 * half <= last[at]]
            at = at[names[at + half] >= 0]
            if not len(at):
                break
            names = _named(names[at].astype(np.int64) * (int(names.max()) + 1) + names[at + half], at, n)
            if names.max() < 0:
                break
            self.level.append(names)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on are those from j on, within a text."""
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            names = self.level[k]
            a = names[i + far]
            far += np.where((a >= 0) & (a == names[j + far]), 1 << k, 0)
        return far

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i are those before j."""
        far = np.zeros(len(i), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            names = self.level[k]
            a, b = i - far - (1 << k), j - far - (1 << k)
            a = names[np.where(a < 0, -1, a)]  # the last entry is no name
            far += np.where((a >= 0) & (a == names[np.where(b < 0, -1, b)]), 1 << k, 0)
        return far


@lru_cache(maxsize=1 << 16)
def _primes(q: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return (*out, q) if q > 1 else tuple(out)


def _candidates(names: Names, shortest: int, times: int) -> Iterator[tuple[np.ndarray, int]]:
    """(places i, period q) where the block at i is the one at i + q; every run has at least one."""
    size = names.end - names.begin
    # What agrees with itself q words on is at least (times - 1) * step long, so it holds a block from a multiple of step.
    base = max(1, shortest // times)
    for k in range(base.bit_length() - 1, len(names.level)):
        level = names.level[k]
        named = np.flatnonzero(level[:-1] >= 0)
        if not len(named):
            return
        own = names.text[named]
        texts = np.unique(own)
        inside = named - names.begin[own]
        low, high = (1, 1 << (k + 1)) if k == base.bit_length() - 1 else (1 << k, 1 << (k + 1))
        for q in range(low, high):
            texts = texts[size[texts] >= max(shortest, times * q)]
            if not len(texts):
                break
            step = max(base, q)
            number = -(-size[texts] // step)
            if number.sum() < len(named):
                m = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                i = np.repeat(names.begin[texts], number) + step * m
            else:
                i = named[inside % step == 0]
            j = i + q
            ok = j < len(level)
            a = level[i]
            ok &= a >= 0
            ok[ok] = a[ok] == level[j[ok]]
            if ok.any():
                yield i[ok], q


def runs_of(word: np.ndarray, counts: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period. word: the words of all texts as numbers;
    counts: of each text. times is 3 or more."""
    if times < 3 or shortest < 1:
        raise ValueError("a run has three periods at least")
    end = np.cumsum(counts).astype(np.int64)
    names = Names(word.astype(np.int64), end - counts, end)
    found = []
    # Of the last run found at a place: its period and its end. A multiple of the period gives nothing new within it.
    inside, until = np.ones(len(word), np.int32), np.zeros(len(word), np.int64)
    for i, q in _candidates(names, shortest, times):
        i = i[(q % inside[i] != 0) | (i + q >= until[i])]
        if not len(i):
            continue
        before, after = names.behind(i, i + q), names.ahead(i, i + q)
        long = before + after + q >= max(shortest, times * q)
        s, one = np.unique(i[long] - before[long], return_index=True)
        if not len(s):
            continue
        length = (before + after)[long][one] + q
        found.append(np.stack([s, length, np.full(len(s), q)], 1))
        for a, n in zip(s.tolist(), length.tolist(), strict=True):
            inside[a : a + n], until[a : a + n] = q, a + n
    if not found:
        return (np.empty(0, np.int64),) * 4
    start, length, period = np.concatenate(found).T
    # A run whose period is not its smallest has one that divides it by a prime.
    row, part = [], []
    for r, q in enumerate(period.tolist()):
        for f in _primes(q):
            row.append(r)
            part.append(q // f)
    row, part = np.array(row, np.int64), np.array(part, np.int64)
    smaller = names.ahead(start[row], start[row] + part) >= length[row] - part
    keep = np.ones(len(start), bool)
    keep[row[smaller]] = False
    start, length, period = start[keep], length[keep], period[keep]
    text = names.text[start]
    order = np.lexsort((period, start, text))
    return text[order], (start - names.begin[text])[order], length[order], period[order]


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of about BYTES_AT_ONCE; null counts as empty."""
    part, first, size = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t.as_py() or b"")
        size += len(part[-1])
        if size >= BYTES_AT_ONCE:
            yield first, part
            part, first, size = [], i + 1, 0
    if part:
        yield first, part


def find_runs(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_words, runs (array<struct<start, length, period>>, in words from 0, by
    start and period) and collapsed: the words joined by one space, of each run only the first period.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least `shortest` words
    and `times` * q long, that no neighbouring word extends keeping the period. A word goes if any run contains it after
    that run's first q words. Null text counts as empty: no words, no runs, an empty text. Rows are independent of each
    other, whatever their ids (null, repeated or of any type); other columns are ignored. Nothing is shuffled. Memory of
    a task: 4 bytes for each word and level at which something repeats (log2 of the longest repetition), for texts of
    BYTES_AT_ONCE together or the longest one; a text is not split.
    """
    spans = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", spans), T.StructField("collapsed", T.BinaryType())]
    )
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _batches(batch.column(1)):
                _, word, counts = split_words(texts)
                text, start, length, period = runs_of(word, counts, shortest, times)
                offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kind))
                kept = [b" ".join(t.split()) for t in texts]
                for i in np.unique(text):
                    words, gone = texts[i].split(), np.zeros(counts[i] + 1, np.int64)
                    for r in range(offsets[i], offsets[i + 1]):
                        gone[start[r] + period[r]] += 1
                        gone[start[r] + length[r]] -= 1
                    kept[i] = b" ".join(w for w, g in zip(words, np.cumsum(gone), strict=False) if not g)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(kept, pa.binary())],
                    names=schema.names,
                )

    out = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
