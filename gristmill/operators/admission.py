"""Admission under caps: entries reserve an amount in order, and one that would cross a cap is refused and takes nothing.

That is a fold in which every decision depends on those before it, under several caps at once, one of them over all entries. Here it
is decided in rounds of running sums, each in parallel: counting all undecided entries as accepted gives an upper
bound of what is committed before an entry, counting none a lower one. Where the upper bound still fits, the entry is
accepted; where the lower one crosses, it is refused. The first undecided entry is always decided, and the less is left under a
cap, the more are refused at once. After each round the first FOLD undecided entries are folded one by one, so that n entries
take n / FOLD rounds at most, however they are mixed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.running import by_ranges
from gristmill.sources.shared import materialize

#: Undecided entries that one task may fold; rows of sums of ranges that are broadcast.
FOLD, BROADCAST = 200_000, 200_000


@dataclass(frozen=True)
class Cap:
    """What entries alike in `by` may have committed together (by none: all entries). limit: a number, or a column of each
    entry's own limit; null: no limit."""

    name: str
    limit: int | Column
    by: tuple[str, ...] = ()


def admit(entries: DataFrame, caps: Sequence[Cap], id_: str = "id", order: str = "id", need: str = "need", closed: str | None = None, charged: str | None = None) -> DataFrame:
    """entries with accepted, crossed (names of all caps that the entry would have crossed, in the order of caps) and
    committed (a map from a cap's name to what was committed before the entry).

    order: when an entry reserves, ties by id_, which must be unique. closed: when it is closed (null: it stays open), which
    changes what it has committed to `charged`, at the latest just before an entry reserves at that time. Amounts are whole
    numbers and not negative; an entry that needs more than a limit is refused, one that meets it exactly is accepted. Null
    amounts count as 0. Null in a column of `by` is a group of its own. Columns accepted, crossed and committed are replaced;
    those whose names begin with two underscores must not be there. Work per round is in proportion to the entries.
    """
    for c in caps:
        if c.by and not set(c.by) <= set(entries.columns):
            raise ValueError(f"cap {c.name}: no column {c.by}")
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    rows = entries.drop("accepted", "crossed", "committed")
    plain = rows.select(
        F.col(id_).alias("__id"), F.col(order).alias("__at"), whole(need).alias("__need"),
        (F.col(closed) if closed else F.lit(None).cast("long")).alias("__closed"), (whole(charged) if charged else F.lit(0).cast("long")).alias("__charged"),
        *[_key(c).alias(f"__g{i}") for i, c in enumerate(caps)],
        *[(F.lit(c.limit) if isinstance(c.limit, int) else c.limit).cast("long").alias(f"__limit{i}") for i, c in enumerate(caps)],
    )
    # Two events of an entry: it reserves (kind 1), and it is closed (kind 0, so before what reserves at that time; an entry closed
    # as it reserves has its closing after it). Each knows its range of the order; after that an entry is one row again.
    kind = F.when(F.col("__closed") > F.col("__at"), 0).when(F.col("__closed") == F.col("__at"), 2)
    events = plain.select("__id", F.inline(F.array(F.struct(F.col("__at").alias("__when"), F.lit(1).alias("__kind")), F.struct(F.col("__closed").alias("__when"), kind.alias("__kind"))))).filter("__kind IS NOT NULL")
    events = by_ranges(events, "__when", "__kind", "__id")
    place = events.groupBy("__id").agg(*[F.max(F.when(F.col("__kind") == 1 if k else F.col("__kind") != 1, F.col("__range"))).alias(f"__range{k}") for k in (0, 1)])
    state = plain.join(place, "__id").withColumn("__accepted", F.lit(None).cast("boolean"))
    state = materialize(state, "admission")
    while True:
        state = materialize(_round(state, caps), "admission")
        left = _undecided(state).count()
        if left and FOLD:
            # The first of them are folded even where many are left, so that rounds are few whatever the entries are like.
            told = F.broadcast(materialize(_fold(state, caps, _first(state, left)), "verdicts"))
            state = state.join(told, "__id", "left").withColumn("__accepted", F.coalesce("__accepted", "__verdict")).drop("__verdict")
            if left > FOLD:
                state = materialize(state, "admission")
        if left <= FOLD:
            break
    state = _sums(state, caps, __low=F.coalesce("__accepted", F.lit(False)))
    needed = [_crosses(i, "__low") for i in range(len(caps))]
    crossed = F.filter(F.array(*[F.when(x, F.lit(c.name)) for x, c in zip(needed, caps, strict=True)]), lambda x: x.isNotNull())
    committed = F.create_map(*[x for i, c in enumerate(caps) for x in (F.lit(c.name), F.col(f"__low{i}"))])
    told = state.select("__id", F.col("__accepted").alias("accepted"), crossed.alias("crossed"), committed.alias("committed"))
    return rows.join(told, rows[id_] == told["__id"]).drop("__id")


def _key(cap: Cap) -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cap.by])) if cap.by else F.lit("")


def _events(state: DataFrame) -> DataFrame:
    """The events of the entries, in their ranges: both have all columns of their entry."""
    kind = F.when(F.col("__closed") > F.col("__at"), 0).otherwise(2)
    made = F.struct(F.col("__range1").alias("__range"), F.col("__at").alias("__when"), F.lit(1).alias("__kind"), F.col("__need").alias("__change"))
    change = F.col("__charged") - F.col("__need")
    closed = F.struct(F.col("__range0").alias("__range"), F.col("__closed").alias("__when"), kind.alias("__kind"), change.alias("__change"))
    return state.select("*", F.inline(F.array(made, closed))).filter("__range IS NOT NULL")


def _sums(state: DataFrame, caps: Sequence[Cap], **counts: Column) -> DataFrame:
    """The entries with what those for which a condition holds have committed before each, for each cap i, as the condition's name + i.

    Events are shuffled once, by their range, in which every cap's sums are taken; the sums of whole ranges, one row for a range and a
    group of a cap, are taken from the events as they are, so that no sum waits for another.
    """
    order = [F.col(c) for c in ("__when", "__kind", "__id")]
    events = _events(state).withColumns({f"__v{name}": F.when(c, F.col("__change")).otherwise(0) for name, c in counts.items()})
    rows = events.repartition("__range")
    for i in range(len(caps)):
        group = f"__g{i}"
        w = Window.partitionBy("__range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({f"{name}{i}": F.coalesce(F.sum(f"__v{name}").over(w), F.lit(0)) for name in counts})
    rows = rows.filter("__kind = 1")
    groups = F.inline(F.array(*[F.struct(F.lit(i).alias("__cap"), F.col(f"__g{i}").alias("__g")) for i in range(len(caps))]))
    of = events.select("__range", *[f"__v{name}" for name in counts], groups).groupBy("__cap", "__g", "__range").agg(*[F.sum(f"__v{name}").alias(f"__s{name}") for name in counts])
    before = Window.partitionBy("__cap", "__g").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    of = materialize(of.select("__cap", "__g", "__range", *[F.coalesce(F.sum(f"__s{name}").over(before), F.lit(0)).alias(f"__o{name}") for name in counts]), "range-sums")
    few = of.count() <= BROADCAST
    for i in range(len(caps)):
        own = of.filter(F.col("__cap") == i).withColumnRenamed("__g", f"__g{i}").drop("__cap")
        rows = rows.join(F.broadcast(own) if few else own, ["__range", f"__g{i}"])
        rows = rows.withColumns({f"{name}{i}": F.col(f"{name}{i}") + F.col(f"__o{name}") for name in counts}).drop(*[f"__o{name}" for name in counts])
    return rows.drop("__range", "__when", "__kind", "__change", *[f"__v{name}" for name in counts])


def _crosses(i: int, name: str) -> Column:
    return F.coalesce(F.col(f"{name}{i}") + F.col("__need") > F.col(f"__limit{i}"), F.lit(False))


def _round(state: DataFrame, caps: Sequence[Cap]) -> DataFrame:
    """Decides what the bounds decide."""
    bounds = _sums(state, caps, __high=F.coalesce("__accepted", F.lit(True)), __low=F.coalesce("__accepted", F.lit(False)))
    any_of = lambda name: reduce(lambda a, b: a | b, [_crosses(i, name) for i in range(len(caps))], F.lit(False))
    verdict = F.when(~any_of("__high"), True).when(any_of("__low"), False)
    return bounds.withColumn("__accepted", F.coalesce("__accepted", verdict)).select(*state.columns)


def _undecided(state: DataFrame) -> DataFrame:
    return state.filter("__accepted IS NULL")


def _first(state: DataFrame, left: int) -> DataFrame:
    """(__id) of the first FOLD undecided entries, of `left`."""
    open_ = _undecided(state).select("__id", "__at", "__range1")
    if left <= FOLD:
        return open_.select("__id")
    # Whole ranges up to the one in which the last of them lies: a count for each range, as many as there are partitions.
    last, n = None, 0
    for r in open_.groupBy("__range1").count().orderBy("__range1").collect():
        last, n = r["__range1"], n + r["count"]
        if n >= FOLD:
            break
    return open_.filter(F.col("__range1") <= last).orderBy("__at", "__id").limit(FOLD).select("__id")


def _fold(state: DataFrame, caps: Sequence[Cap], chosen: DataFrame) -> DataFrame:
    """(__id, __verdict) of the chosen entries, one after the other: the first FOLD undecided ones at most, with two events each. All
    that come before one of them are decided or chosen, too."""
    n = len(caps)
    known = _sums(state, caps, __low=F.coalesce("__accepted", F.lit(False))).join(F.broadcast(materialize(chosen, "chosen")), "__id")
    known = _events(known).withColumnRenamed("__when", "__time")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = [{} for _ in range(n)]
        accepted: dict = {}
        for b in batches:
            out = []
            groups, low = ([b[f"__{k}{i}"].tolist() for i in range(n)] for k in ("g", "low"))
            limits = [[None if pd.isna(x) else int(x) for x in b[f"__limit{i}"].astype(object)] for i in range(n)]
            for r, (own, kind, need, change) in enumerate(zip(b["__id"], b["__kind"], b["__need"].tolist(), b["__change"].tolist(), strict=True)):
                if kind == 1:
                    ok = all(limits[i][r] is None or low[i][r] + held[i].get(groups[i][r], 0) + need <= limits[i][r] for i in range(n))
                    accepted[own] = ok
                    out.append((own, ok))
                if accepted.get(own):
                    for i in range(n):
                        held[i][groups[i][r]] = held[i].get(groups[i][r], 0) + change
            yield pd.DataFrame({"__id": [o for o, _ in out], "__verdict": np.array([v for _, v in out], bool)})

    kind = state.schema["__id"].dataType.simpleString()
    one = known.repartition(1).sortWithinPartitions("__time", "__kind", "__id")
    return one.mapInPandas(run, f"__id {kind}, __verdict boolean")
