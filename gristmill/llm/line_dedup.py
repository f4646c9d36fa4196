"""Line dedup: later copies of repeated runs of lines are deleted. A suffix array over line ids is built by
prefix doubling, in DataFrame operations, as deep as runs must be long; its common-prefix intervals are
the repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm._common import materialize, running_sum, text_key
from gristmill.llm.mixing import word_count

#: Words that a run must have at least.
MIN_WORDS = 5
ADDED = ("n_lines", "n_removed", "n_left")
_INK = r"[^\x20\x09-\x0D]"


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _numbered(keys: DataFrame, order: list[str], bucket: Column, out: str) -> DataFrame:
    """keys (distinct) with their rank in that order, from 0."""
    return running_sum(keys, [], [F.col(c) for c in order], F.lit(1), out, bucket)


def _known(doc_id: str) -> Column:
    """The id as a long, the smallest one for null and for what is no integer, so that ids can be joined on and come in
    order."""
    return F.coalesce(F.col(doc_id).try_cast("long"), F.lit(-(2**63)))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, i, words, h1, h2): the lines with at least one word, numbered from 0 among themselves. th
    and doc_id name a document; h1 and h2 are 128 bits of the line."""
    inked = F.filter(_lines(), lambda x: x.rlike(_INK))
    df = docs.select(_known("doc_id").alias("doc_id"), text_key().alias("th"), F.posexplode(inked).alias("i", "line"))
    return df.select(
        "doc_id", "th", "i", word_count(F.col("line")).alias("words"), F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit("second"), "line").alias("h2"),
    )


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, i) of the lines to delete: those in a run of consecutive lines of at least `min_words` words
    that also starts earlier (smaller doc_id, null first; then smaller th; then earlier line).

    A maximal repeated run of that many words is the union of its shortest runs of that many words that
    begin, or end, at one of its lines: those have at most `min_words` lines. So suffixes need order only
    as deep as that. Lines that occur once end every run and are dropped at first. Round k gives suffixes
    the rank of their first 2^k lines from the ranks of two halves; suffixes whose prefix is unique leave.
    Two overlapping ranks then name a run of any number of lines, and the suffixes of one name form an
    interval of the suffix array with a common prefix of that length: all but its first are later copies.
    """
    lines = materialize(line_table(docs), "lines")
    # Numbers are dealt out by buckets, so many that a bucket has a million lines at most, if each line is another.
    bits = min(24, max(12, (lines.count() >> 20).bit_length()))
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    ids = materialize(_numbered(ids, ["h1", "h2"], F.shiftright("h1", 64 - bits), "r0"), "line-ids")
    rows = lines.join(ids, ["h1", "h2"]).select("doc_id", "th", "i", "words", "r0").dropDuplicates(["doc_id", "th", "i"])
    doc = Window.partitionBy("doc_id", "th").orderBy("i")
    rows = rows.withColumn("seg", F.col("i") - F.row_number().over(doc))
    seg = Window.partitionBy("doc_id", "th", "seg")
    rows = rows.withColumn("upto", F.sum("words").over(seg.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("words"))
    # The last line before which fewer than min_words words have come since this one, and the same backwards.
    last = F.max(F.struct("i", "upto")).over(seg.orderBy("before").rangeBetween(0, min_words - 1))
    first = F.min(F.struct("i", "before")).over(seg.orderBy("upto").rangeBetween(1 - min_words, 0))
    rows = rows.withColumns({"__last": last, "__first": first})
    rows = rows.withColumn(
        "ahead", F.when(F.col("__last.upto") - F.col("before") >= min_words, F.col("__last.i") - F.col("i") + 1)
    )
    rows = rows.withColumn(
        "behind", F.when(F.col("upto") - F.col("__first.before") >= min_words, F.col("i") - F.col("__first.i") + 1)
    )
    rows = materialize(rows.select("doc_id", "th", "seg", "i", "ahead", "behind", "r0"), "suffixes")
    most = rows.agg(F.max(F.greatest(F.coalesce("ahead", F.lit(0)), F.coalesce("behind", F.lit(0))))).first()[0] or 0
    runs, k = [], 0
    order = seg.orderBy("i")
    while most >= 1 << k:
        size, rank = 1 << k, F.col(f"r{k}")
        both = F.explode(
            F.array_distinct(
                F.array(
                    F.struct(F.col("i").alias("start"), F.col("ahead").alias("m")),
                    F.struct((F.col("i") - F.col("behind") + 1).alias("start"), F.col("behind").alias("m")),
                )
            )
        )
        wanted = rows.select("doc_id", "th", both.alias("w")).select("doc_id", "th", "w.*").distinct()
        wanted = wanted.filter((F.col("m") >= size) & (F.col("m") < 2 * size))
        ranks = rows.filter(rank.isNotNull()).select("doc_id", "th", F.col("i"), rank.alias("r"))
        named = (
            wanted.join(_at(ranks, "start", "a"), ["doc_id", "th", "start"])
            .withColumn("second", F.col("start") + F.col("m") - size)
            .join(_at(ranks, "second", "b"), ["doc_id", "th", "second"])
        )
        runs.append(named.select("doc_id", "th", "start", "m", "a", "b"))
        if most < 2 * size:
            break
        # The lead is the rank 2^k lines on, if the segment reaches so far.
        rows = rows.withColumn("b", F.when(F.lead("i", size).over(order).isNotNull(), F.lead(rank, size).over(order)))
        pairs = rows.filter(rank.isNotNull() & F.col("b").isNotNull()).groupBy(rank.alias("a"), "b").agg(F.count("*").alias("n"))
        pairs = pairs.filter(F.col("n") > 1).drop("n")
        # A line that many different ones follow is one rank a: ranges of both ranks are the buckets, and are written, so that they
        # are the same wherever they are used.
        pairs = pairs.repartitionByRange("a", "b").withColumn("__range", F.spark_partition_id())
        pairs = _numbered(materialize(pairs, "line-ranges"), ["a", "b"], F.col("__range"), f"r{k + 1}").drop("__range")
        pairs = materialize(pairs, "line-pairs")
        rows = rows.withColumn("a", rank).join(pairs, ["a", "b"], "left").drop("a", "b")
        rows = materialize(rows, "suffixes")
        k += 1
    if not runs:
        return docs.select(_known("doc_id").alias("doc_id"), F.lit(0).cast("long").alias("th"), F.lit(0).alias("i")).limit(0)
    found = runs[0]
    for more in runs[1:]:
        found = found.unionByName(more)
    found = materialize(found, "line-runs")
    place = F.struct("doc_id", "th", "start")
    earliest = found.groupBy("m", "a", "b").agg(F.min(place).alias("earliest"), F.count("*").alias("n"))
    # A run may have copies in a third of all documents. Sums go before the shuffle, and as its result is written, what is
    # joined with it is dealt out for the join alone, where large parts are split.
    earliest = materialize(earliest.filter(F.col("n") > 1).drop("n"), "first-runs")
    copies = found.join(earliest, ["m", "a", "b"]).filter(place > F.col("earliest"))
    lines = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1))
    return copies.select("doc_id", "th", lines.alias("i")).distinct()


def _at(ranks: DataFrame, place: str, name: str) -> DataFrame:
    return ranks.select("doc_id", "th", F.col("i").alias(place), F.col("r").alias(name))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text, any more) without later copies of repeated runs of lines: text is what is left;
    n_lines (all lines, blank ones too), n_removed and n_left (lines with words that are left) are added.

    Lines end at line feeds; blank lines (without any word) belong to no run and stay. A null text stays
    null and has no lines; an empty one has one, blank. Rows equal in doc_id and text are one document and
    share their result; documents of one doc_id but different texts are told apart by their text's hash.
    Null doc_ids, and those that are no integers, come first. Columns of the added names, or beginning with __, are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c in ADDED or c.startswith("__")])
    gone = later_copies(docs, min_words).groupBy(F.col("doc_id").alias("__doc"), F.col("th").alias("__key")).agg(
        F.collect_set("i").alias("__gone")
    )
    # Lines are split, and those with words found, before the join: what is behind it is computed once, and not again for
    # each element of an array that a later expression runs over.
    marked = F.filter(F.transform(_lines(), lambda x, j: F.struct(j.alias("j"), x.rlike(_INK).alias("ink"))), lambda s: s["ink"])
    df = docs.select(
        *[c for c in docs.columns if c != "text"], text_key().alias("__th"), _lines().alias("__lines"),
        F.transform(marked, lambda s: s["j"]).alias("__inked"),
    )
    df = df.join(gone, (_known("doc_id") == F.col("__doc")) & (F.col("__th") == F.col("__key")), "left")
    whole = F.array_join("__lines", "\n")
    places = F.transform("__gone", lambda o: F.get(F.col("__inked"), o))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), places)
    text = F.array_join(F.transform(left, lambda j: F.get(F.col("__lines"), j)), "\n")
    removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    return df.select(
        *[F.when(F.col("__gone").isNull(), whole).otherwise(text).alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        removed.alias("n_removed"),
        (F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__inked")).cast("long") - removed).alias("n_left"),
    )
