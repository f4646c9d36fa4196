"""A bound on how far two sets differ, from a few bits of each, so that a set is only moved for pairs that may be near."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.sources.shared import materialize

#: Bits of a set; sets whose bits are counted at once; ids that are broadcast.
BITS, AT_ONCE, BROADCAST = 2048, 256, 1_000_000


def _bits(sets: DataFrame) -> DataFrame:
    """(id, n, bits) of sets (id, runs: array of longs, n): whether an odd number of the runs falls on a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                runs = part.column(1)
                ends = runs.offsets.to_numpy()
                place = np.repeat(np.arange(len(runs)) * BITS, np.diff(ends)) + (runs.values.to_numpy()[ends[0] : ends[-1]] & (BITS - 1))
                odd = (np.bincount(place, minlength=len(runs) * BITS) & 1).astype(np.uint8)
                words = np.packbits(odd, bitorder="little").view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(runs) + 1, dtype=np.int32) * (BITS // 64)), pa.array(words))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["id", "n", "bits"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "runs", F.col("n").cast("int").alias("n")).mapInArrow(run, f"id {kind}, n int, bits array<bigint>")


def ids_of(pairs: DataFrame) -> DataFrame:
    """(id) of all that are in a pair (a, b), to be broadcast if their number, which is counted, allows it."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def close(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), best a table, as one, whose sets may reach the similarity. Each run in one set only turns one bit at most, so sets
    differ in no fewer runs than bits, and those that reach it differ in a share of (1 - threshold) / (1 + threshold) at most."""
    bits = materialize(_bits(sets.join(ids_of(pairs), "id", "left_semi")), "bits")
    x = bits.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = bits.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    turned = F.aggregate(F.zip_with("xa", "xb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, k: acc + k)
    most = (F.col("na") + F.col("nb")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-6
    return materialize(pairs.join(x, "a").join(y, "b").filter(turned <= most).select("a", "b"), "close")
