"""Mixing sources to target weights, by Efraimidis-Spirakis sampling in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm._common import materialize, running_sum

#: What counts as a word here: a run of anything but a blank, a tab or one of the line and page breaks.
WORD = r"[^\x20\x09-\x0D]+"
#: The table of sources is broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), most: float = 3.0, share: float = 1.0
) -> DataFrame:
    """The words each source should give.

    sizes: (source, source_size), a row per source. Sources in code point order, null last, weigh as
    `cycle` says, over and over, and share `share` of all words by weight. A target stops at `most` times
    its source's size; what is over goes to the others by weight until none is above. That is a water
    level: target = min(most * size, level * weight). Sorted by most * size / weight, the sources that
    stop form a prefix, so running sums over the (few) sources give the level.

    Adds source_index, weight and target. No sources: no rows. All sources empty: targets of 0.
    """
    w = Window.partitionBy(F.lit(0))
    df = sizes.withColumn("source_index", F.row_number().over(w.orderBy(F.col("source").asc_nulls_last())) - 1)
    df = df.withColumn("__i", F.col("source_index"))
    df = df.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("__i") % len(cycle) + 1).cast("int")))
    df = df.withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    df = df.withColumn("__r", F.col("__cap") / F.col("weight"))
    before = w.orderBy("__r", "__i").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "__caps": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
            "__left": F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "__all": F.sum("source_size").over(w) * F.lit(float(share)),
        }
    )
    df = df.withColumn("__level", (F.col("__all") - F.col("__caps")) / F.col("__left"))
    df = df.withColumn("__free", F.col("__level") <= F.col("__r"))
    # The first source in that order that does not stop sets the level for itself and all after it.
    level = F.min(F.when(F.col("__free"), F.struct("__r", "__i", "__level"))).over(w)
    df = df.withColumn("__at", level)
    free = F.col("__at").isNotNull() & (F.struct("__r", "__i") >= F.struct(F.col("__at.__r"), F.col("__at.__i")))
    target = F.when(free, F.least(F.col("weight") * F.col("__at.__level"), F.col("__cap"))).otherwise(F.col("__cap"))
    return df.withColumn("target", target).drop(*[c for c in df.columns if c.startswith("__")])


def mix(
    docs: DataFrame,
    size: Column | None = None,
    quality: Column | None = None,
    cycle: tuple[int, ...] = (5, 2, 1),
    most: float = 3.0,
    share: float = 1.0,
    seed: str = "",
) -> DataFrame:
    """docs (doc_id, source, text unless size is given, any more) with how often the mix takes each document.

    Adds size (words), source_size, target and copies. A source gives floor(target / size) whole epochs;
    for the rest its documents are put in order of the exponential keys -ln(u) / quality, u from a hash of
    the document's id and `seed`, and taken while at least half of the document still fits the rest: so
    each source ends within half a document of its target, and documents of higher quality come first.
    Nothing is drawn anew, so reruns agree.

    size: the words per row, where they are counted already. quality: a positive weight per row (null: 1). Running sums are in two levels over buckets of the keys,
    with about as many buckets as rows in each, so that a source may hold any share of the rows.

    Null or empty text: size 0, never taken in the fractional part. Null doc_id: a document like any
    other. Rows that repeat a doc_id and size are ordered among themselves at will: they get what the
    several rows get, in any order. Empty input: no rows. Further columns pass through; names beginning
    with __ or equal to the added ones are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    df = docs.drop(*[c for c in docs.columns if c in added or c.startswith("__")])
    df = df.withColumn("size", word_count(F.col("text")) if size is None else size)
    sizes = df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    # A row per source, counted before it is sent to all machines.
    t = materialize(source_targets(sizes, cycle, most, share), "mix-targets")
    t = t.select(
        F.col("source").alias("__source"), F.col("source_index").alias("__i"), "source_size", "target",
        F.col("rows").alias("__n"),
    )
    t = F.broadcast(t) if t.count() <= BROADCAST_SOURCES else t
    df = df.join(t, F.col("source").eqNullSafe(F.col("__source")), "inner").drop("__source")
    ident = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.md5(ident), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    weight = F.lit(1.0) if quality is None else F.coalesce(quality.cast("double"), F.lit(1.0))
    df = df.withColumn("__key", -F.log(u) / weight)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    df = df.withColumn("__epochs", F.least(epochs, F.lit(int(most))).cast("long"))
    df = df.withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))
    # 1 - exp(-key) spreads the keys of weight 1 evenly over (0, 1), in order.
    bucket = F.floor((1 - F.exp(-F.col("__key"))) * F.ceil(F.sqrt("__n")))
    df = running_sum(
        df, ["__i"], [F.col("__key"), F.col("doc_id"), F.col("size")], F.col("size"), "__before", bucket
    )
    extra = (F.col("size") > 0) & (F.col("__before") + F.col("size") / 2 <= F.col("__rest"))
    df = df.withColumn("copies", F.col("__epochs") + extra.cast("long"))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as its `copies` says."""
    return (
        mixed.filter(F.col("copies") > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .drop("__copy")
    )
