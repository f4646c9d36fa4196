"""A corpus from raw documents: classified, without repeated lines, without near duplicates, mixed and packed.

STAGES are functions (spark, docs, sf_dir) -> DataFrame. Each works on all rows it gets, which are written as a table
between stages. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import line_dedup, mixing, ngram_join, packing, quality
from gristmill.llm._common import materialize, table, text_key
from gristmill.llm.queries import label_weights

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def columns_kept(*needed: str) -> Callable[[Stage], Stage]:
    """Of a stage: all columns but `needed` have names of their own within it, so that they can be named like any of its own."""

    def decorate(stage: Stage) -> Stage:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            own = {c: f"kept column {i}" for i, c in enumerate(docs.columns) if c not in needed}
            out = stage(spark, docs.withColumnsRenamed(own), sf_dir)
            return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)

        return run

    return decorate


@columns_kept("doc_id", "text")
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for quality is 0.3 or more. The model learns from labelled rows of docs; without any,
    all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


@columns_kept("doc_id", "text", "n_chars")
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a document of which no word is left goes with them. n_chars
    is that of the text that is left."""
    df = line_dedup.dedup_lines(docs)
    df = df.filter((F.col("n_removed") == 0) | (F.col("n_left") > 0))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        df = df.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return df.select(*docs.columns)


@columns_kept("doc_id", "text")
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the smallest doc_id. Documents without
    words have no duplicates. A row that repeats doc_id and text is the same document."""
    found = ngram_join.similar_documents(docs)
    smallest = F.coalesce(F.col("doc_id").try_cast("long"), F.lit(-(2**63)))
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = gone.select(smallest.alias("__d"), F.col("th").alias("__t")).distinct()
    rows = docs.withColumns({"__d": smallest, "__t": text_key()}).dropDuplicates(["__d", "__t"])
    return rows.join(gone, ["__d", "__t"], "left_anti").select(*docs.columns)


@columns_kept("doc_id", "text", "source")
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those marked good go first into a fraction."""
    rows = docs.withColumn("__words", mixing.word_count(F.col("text")))
    weights = label_weights(table(spark, sf_dir, "labels")).withColumnRenamed("weight", "quality_weight")
    rows = rows.withColumnRenamed("__words", "mix_words").join(weights, "doc_id", "left")
    mixed = mixing.mix(rows, size=F.col("mix_words"), quality=F.col("quality_weight"))
    return mixing.repeat(mixed).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, with their ids (tokens: little-endian, 32 bits each) and their place in a sequence of 2048. The places
    are found without the ids, which join them at the end; a document that the mix repeats has pieces for each time."""
    pieces = packing.tokenize(docs).select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "tokens")
    pieces = materialize(pieces.withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    places = packing.pack(pieces.drop("tokens"), ["__piece", "doc_id", "piece", "start", "ids_crc32"])
    return places.join(pieces.select("__piece", "tokens"), "__piece").drop("__piece")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The first stage is a trained model and the last a tokenizer: tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
