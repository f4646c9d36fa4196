"""Bootstrap intervals of additive statistics. Draws come from one seeded generator, in order, and are shared by
all statistics and systems, so differences are paired."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiplicities(n: int, resamples: int, seed: int) -> list[dict[int, int]]:
    """How often each of n rows is drawn in each resample: default_rng(seed).integers(0, n, n), one after another."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(resamples):
        v, c = np.unique(rng.integers(0, n, n), return_counts=True)
        out.append(dict(zip(v.tolist(), c.tolist(), strict=True)))
    return out


def sums(units: DataFrame, values: list[str], n: int, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """units (unit: 0 to n - 1, numeric values): (resample, the values' sums over the rows drawn).

    A unit is a row, or a group whose values are summed (the cluster bootstrap), so a unit's row is small. Every
    task draws the same numbers again and keeps a running sum per resample of its own units; only those partial
    sums are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches), ignore_index=True)
        if not len(own):
            return
        rng, rows, unit = np.random.default_rng(seed), own[values].to_numpy(float), own["unit"].to_numpy()
        out = np.empty((resamples, len(values)))
        for b in range(resamples):
            out[b] = np.bincount(rng.integers(0, n, n), minlength=n)[unit] @ rows
        yield pd.DataFrame(out, columns=values).assign(resample=np.arange(resamples))

    schema = ", ".join([*(f"{v} double" for v in values), "resample int"])
    part = units.select("unit", *values).mapInPandas(run, schema)
    return part.groupBy("resample").agg(*[F.sum(v).alias(v) for v in values])


def interval(stats: DataFrame, columns: list[str]) -> DataFrame:
    """(statistic, low, high, undefined) from the 2.5 and 97.5 percentiles of each column over the resamples in which it
    is defined."""
    rows = F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("v")) for c in columns])
    long = stats.select(F.inline(rows))
    return long.groupBy("statistic").agg(
        F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"),
        F.count_if(F.col("v").isNull()).alias("undefined"),
    )
