"""A curation run: logged and imported records become examples, in splits without duplicates or leaks, and are written.

Each stage writes a table in the shared folder and counts what it does as it writes (observed metrics of that write, whose
tasks count once), so no counter takes a pass of its own. A run that leaves no training example, or in which texts leak
between splits, is refused, and nothing is written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import pii
from gristmill.functions import text as tx
from gristmill.operators import leakage, pii_stage, similarity, splits, votes
from gristmill.sources.shared import materialize, materialize_at, shared_dir

SPLITS = ("train", "valid", "test")
STAGES = ("load", "extract", "merge", "vote", "pii", "split", "dedupe", "cross_split", "label", "length", "leakage")
# Names of what can become of an example as its answers are made one, and of the counters of that stage.
FATES = ("labelled", "unlabelled", "dropped_all_invalid", "dropped_no_majority", "kept_test_all_invalid", "kept_test_no_majority")
NORMALISE = (
    "examples", "outputs", "invalid_outputs", "dropped_all_invalid", "dropped_no_majority", "kept_test_all_invalid", "kept_test_no_majority",
    "conflicts_resolved", "unlabelled", "gold_invalid", "gold_conflicts_resolved", "gold_conflicts_unresolved",
)


class CurateError(ValueError):
    """A run that must not be written."""


@dataclass(frozen=True)
class Task:
    """labels: the answers of a labelling task; or schema: of an extraction task, whose answers are JSON. near: the similarity at which
    texts are duplicates; exact: whether texts too short for a word run are removed as copies; longest: in words."""

    labels: tuple[str, ...] = ()
    schema: dict | None = None
    kinds: tuple[str, ...] = pii.KINDS
    near: float = 0.9
    exact: bool = True
    longest: int = 500
    seed: str = "13"
    test: float = 0.2
    valid: float = 0.1


def own_session(spark: SparkSession) -> SparkSession:
    """A session beside this one with its settings. A session that has observed anything can no longer be part of a closure, as it is
    of those of Spark's ML, so a run observes in one of its own."""
    out = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if out.conf.get(k, None) != v and (spark.conf.isModifiable(k) or k == "spark.checkpoint.dir"):
            out.conf.set(k, v)
    return out


@dataclass
class Run:
    """What a run knows of itself: counters by stage, in order, and its tables, which are those of a session of its own."""

    task: Task
    spark: SparkSession
    counters: dict[str, dict[str, int]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        shared_dir(self.spark)  # both sessions write there
        self.spark = own_session(self.spark)

    def take(self, df: DataFrame, name: str) -> DataFrame:
        """A table of another session as one of the run's."""
        _, path = materialize_at(df, f"curate-{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, stage: str, df: DataFrame, **counts: Column) -> DataFrame:
        """Writes a stage's rows, and what they add up to."""
        seen = Observation(f"{stage}-{id(self)}")
        total = {"rows": F.count(F.lit(1))} | counts
        out = materialize(df.observe(seen, *[v.alias(k) for k, v in total.items()]), f"curate-{stage}")
        self.counters[stage] = {k: int(v or 0) for k, v in seen.get.items()}
        self.tables[stage] = out
        return out

    def sizes(self, stage: str) -> dict[str, int]:
        return {s: self.counters[stage][s] for s in SPLITS}


def _by_split(kept: Column | None = None) -> dict[str, Column]:
    ok = kept if kept is not None else F.lit(True)
    return {s: F.count_if(ok & (F.col("split") == s)) for s in SPLITS}


def normalised(task: Task, answer: str) -> Column:
    """An answer as it counts: the label it is, or canonical JSON of the schema's fields if it is valid; null if not."""
    if task.schema is None:
        x = F.trim(F.col(answer))
        return F.when(x.isin(*task.labels), x)
    value = tx.parse_output(F.col(answer))
    return F.when(F.size(tx.validate(task.schema)(value)) == 0, tx.canonical_json(tx.in_schema_order(task.schema)(value)))


def merge(records: DataFrame) -> DataFrame:
    """records (seq, h, input, output, gold, split): an example for each h: seq (the first), given (the most protected split it was
    given, or null), split_conflict, observations."""
    rank = F.max(F.coalesce(F.expr(votes.RANK), F.lit(0)))
    out = records.groupBy("h").agg(F.min("seq").alias("seq"), rank.alias("rank"), (F.count_distinct("split") > 1).alias("split_conflict"), F.count("*").alias("observations"))
    name = F.element_at(F.array(*map(F.lit, SPLITS)), F.col("rank").cast("int"))
    return out.withColumn("given", F.when(F.col("rank") > 0, name)).drop("rank")


def decide(examples: DataFrame, records: DataFrame, task: Task) -> DataFrame:
    """examples with teacher, votes, gold, fate and what was counted on the way.

    Answers vote by their normalised value, and more than half of the valid ones decide. An example of which all answers are invalid,
    or none has a majority, is dropped; if it was given to test it stays, without a teacher. Golds vote likewise; without a
    majority there is none. Votes are counted by value before they meet, so no example, however often seen, is one task.
    """
    one = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).isNotNull().alias("there"), normalised(task, c).alias("value"))
    long = records.select("h", "seq", F.inline(F.array(one("teacher", "output"), one("gold", "gold")))).filter("there")
    counts = long.groupBy("h", "role", "value").agg(F.count("*").alias("v"), F.min("seq").alias("s"))
    valid = F.col("value").isNotNull()
    top = F.max(F.when(valid, F.struct(F.col("v").alias("v"), (-F.col("s")).alias("s"), F.col("value").alias("value"))))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("v"))), F.lit(0))
    per = counts.groupBy("h", "role").agg(top.alias("top"), total(valid).alias("valid"), total(~valid).alias("invalid"), F.count("value").alias("different"))
    pick = lambda role: F.max(F.when(F.col("role") == role, F.struct("valid", "invalid", "different", "top")))
    wide = per.groupBy("h").agg(pick("teacher").alias("t"), pick("gold").alias("g"))
    x = examples.join(wide, "h", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    won = lambda r: F.coalesce(F.col(f"{r}.top.v") * 2 > F.col(f"{r}.valid"), F.lit(False))
    outputs = number("t.valid") + number("t.invalid")
    none = F.when(number("t.valid") == 0, "all_invalid").otherwise("no_majority")
    lost = F.when(F.coalesce(F.col("given") == "test", F.lit(False)), F.concat(F.lit("kept_test_"), none)).otherwise(F.concat(F.lit("dropped_"), none))
    fate = F.when(outputs == 0, "unlabelled").when(won("t"), "labelled").otherwise(lost)
    return x.select(
        *examples.columns, fate.alias("fate"), F.when(won("t"), F.col("t.top.value")).alias("teacher"), F.when(won("t"), F.col("t.top.v")).otherwise(0).alias("votes"),
        F.when(won("g"), F.col("g.top.value")).alias("gold"), outputs.alias("outputs"), number("t.invalid").alias("invalid_outputs"),
        (won("t") & (number("t.different") > 1)).alias("conflict"), number("g.invalid").alias("gold_invalid"),
        F.when(number("g.different") > 1, F.when(won("g"), "resolved").otherwise("unresolved")).alias("gold_conflict"),
    )


def decision_counters() -> dict[str, Column]:
    out = {"examples": F.count(F.lit(1)), "outputs": F.sum("outputs"), "invalid_outputs": F.sum("invalid_outputs"), "conflicts_resolved": F.count_if("conflict")}
    out |= {f: F.count_if(F.col("fate") == f) for f in FATES}
    out["gold_invalid"] = F.sum("gold_invalid")
    return out | {f"gold_conflicts_{k}": F.count_if(F.coalesce(F.col("gold_conflict") == k, F.lit(False))) for k in ("resolved", "unresolved")}


def dedupe(examples: DataFrame, near: float = 0.9, exact: bool = True, known: DataFrame | None = None) -> DataFrame:
    """examples (seq, text, split, teacher, votes, gold) with cluster, verdict and the survivor's teacher and gold.

    Within each split, texts of one key or whose word runs reach the similarity are clusters. verdict: 'kept' (alone, or the
    survivor), 'exact' or 'near' (removed, of the survivor's key or not), 'conflict' (the cluster's teachers have no
    majority: all go). exact False: texts of fewer than three words are left alone. gold_conflict: on the first row of a cluster
    whose golds differ. known: similarity.hashed() of the examples, with their split.
    """
    known = similarity.hashed(examples, "seq", "text", "split") if known is None else known
    # A text of three words has a run.
    pairs = similarity.near_pairs(examples, "seq", "text", near, within="split", known=known if exact else known.filter("n > 0"))
    clusters = similarity.components(pairs)
    clusters = materialize(clusters.select(F.col("id").alias("seq"), F.col("root").alias("cluster")), "curate-clusters")
    own = examples.join(clusters, "seq").select(F.col("seq").alias("id"), "cluster", "teacher", F.when(F.col("teacher").isNotNull(), F.greatest("votes", F.lit(1))).alias("votes"), "gold")
    won = votes.resolve_clusters(own).select("cluster", F.col("survivor"), F.col("teacher").alias("won_teacher"), F.col("gold").alias("won_gold"))
    differ = own.filter("gold IS NOT NULL").groupBy("cluster").agg((F.min("gold") != F.max("gold")).alias("gold_conflict"))
    won = won.join(differ, "cluster", "left")
    # Texts are not joined: rows of a cluster are, with the hashes of their keys, and what comes of it is broadcast where it can be.
    keys = known.join(similarity.small(clusters), F.col("id") == F.col("seq"), "left_semi").select(F.col("id").alias("seq"), F.col("key").alias("own_key"))
    keys = materialize(keys, "curate-keys")
    of = clusters.join(keys, "seq").join(won, "cluster", "left").join(keys.select(F.col("seq").alias("survivor"), F.col("own_key").alias("won_key")), "survivor", "left")
    of = of.withColumn("same", F.col("own_key") == F.col("won_key")).drop("own_key", "won_key")
    x = examples.join(similarity.small(materialize(of, "curate-resolved")), "seq", "left")
    conflict = F.col("cluster").isNotNull() & F.col("survivor").isNull()
    copy = F.when(F.col("same"), "exact").otherwise("near")
    verdict = F.when(F.col("cluster").isNull() | (F.col("seq") == F.col("survivor")), "kept").when(conflict, "conflict").otherwise(copy)
    survivor = F.col("seq") == F.col("survivor")
    first = F.col("seq") == F.col("cluster")  # a cluster is named by its smallest seq
    return x.select(
        *[c for c in examples.columns if c not in ("teacher", "gold")], F.when(survivor, F.col("won_teacher")).otherwise(F.col("teacher")).alias("teacher"),
        F.when(survivor, F.col("won_gold")).otherwise(F.col("gold")).alias("gold"), "cluster", verdict.alias("verdict"), (conflict & first).alias("conflict_cluster"),
        (~conflict & first & F.coalesce("gold_conflict", F.lit(False))).alias("gold_conflict"),
    )


def run(records: DataFrame, task: Task, answers: DataFrame | None = None) -> Run:
    """The stages over records (seq: a unique order, h: hash of the input, input, output, gold, split: as given or null, result: 'ok' or
    why a record is no example). answers (seq, answer): of a teacher to examples without one. See the stages' functions.

    Raises CurateError when there is no record to work on, when train is empty, or when texts leak between splits.
    """
    r = Run(task, records.sparkSession)
    records = r.take(records, "load")
    r.counters["load"], r.tables["load"] = {"rows": records.count()}, records
    answers = None if answers is None else r.take(answers.select("seq", "answer"), "answers")
    good = records.filter("result = 'ok'")  # as cheap to read from the loaded table as from one of its own
    r.counters["extract"], r.tables["extract"] = {"rows": good.count()}, good
    if not r.counters["extract"]["rows"]:
        raise CurateError("no usable records")
    examples = r.keep("merge", merge(good), split_conflicts=F.count_if("split_conflict"), observations=F.sum("observations"))
    decided = r.keep("vote", decide(examples, good, task), **decision_counters())
    kept = decided.filter(~F.col("fate").startswith("dropped")).select("seq", "h", "given", "fate", "teacher", "votes", "gold")
    texts = good.select("seq", "input").join(kept, "seq")
    scrubbed = r.keep("pii", pii_stage.scrub_examples(texts, task.schema, kinds=task.kinds).drop("input"), **pii_stage.counters(task.kinds))
    scrubbed = scrubbed.filter("NOT rejected").drop("found", "broken", "rejected", "cleared")
    free = splits.random_split(scrubbed.filter("given IS NULL").select("h", "seq"), "h", task.seed, task.test, task.valid)
    free = similarity.small(materialize(free.select("seq", "split"), "curate-free"))
    assigned = scrubbed.join(free, "seq", "left").withColumn("split", F.coalesce("given", "split")).drop("given")
    assigned = r.keep("split", assigned, **_by_split())
    sets = similarity.hashed(assigned, "seq", "text", "split")  # for both stages that compare
    stays = F.col("verdict") == "kept"
    deduped = r.keep(
        "dedupe", dedupe(assigned, task.near, task.exact, sets), **_by_split(stays), removed_exact=F.count_if(F.col("verdict") == "exact"),
        removed_near=F.count_if(F.col("verdict") == "near"), conflict_examples=F.count_if(F.col("verdict") == "conflict"),
        conflict_clusters=F.count_if("conflict_cluster"), gold_conflicts=F.count_if("gold_conflict"),
    ).filter("verdict = 'kept'").drop("cluster", "verdict", "conflict_cluster", "gold_conflict")
    gone = similarity.small(materialize(r.tables["dedupe"].filter("verdict <> 'kept'").select(F.col("seq").alias("id")), "curate-gone"))
    matched = similarity.cross_matches(deduped, "seq", "text", "split", task.near, sets.join(gone, "id", "left_anti"))
    matched = similarity.small(materialize(matched.select(F.col("a").alias("seq"), "kind"), "curate-matched"))
    crossed = deduped.join(matched, "seq", "left")
    apart = F.col("kind").isNull()
    crossed = r.keep("cross_split", crossed, **_by_split(apart), exact=F.count_if(F.col("kind") == "exact"), near=F.count_if(F.col("kind") == "near"))
    crossed = crossed.filter("kind IS NULL").drop("kind")
    _require_train(r, "cross_split")
    label = crossed
    if answers is not None:
        label = label.join(similarity.small(answers.select("seq", "answer")), "seq", "left").withColumn("__said", normalised(task, "answer"))
        asked = F.col("fate") == "unlabelled"
        label = label.withColumns({"teacher": F.coalesce("teacher", F.when(asked, F.col("__said"))), "bad_answer": asked & F.col("__said").isNull()}).drop("answer", "__said")
    else:
        label = label.withColumn("bad_answer", F.col("fate") == "unlabelled")
    stays = ~F.col("bad_answer") | (F.col("split") == "test")
    # The last two stages are one write: what is too long is told from what is left of the first.
    label = label.withColumn("words", F.regexp_count("text", F.lit(r"[^\s]+")))
    fits = stays & (F.col("words") <= task.longest)
    long = {f"length {k}": v for k, v in ({"rows": F.count_if(stays)} | _by_split(fits)).items()}
    label = r.keep("label", label, **_by_split(stays), asked=F.count_if(F.col("fate") == "unlabelled"), invalid=F.count_if("bad_answer"), **long)
    r.counters["length"] = {k: r.counters["label"].pop(f"length {k}") for k in ("rows", *SPLITS)}
    r.tables["length"] = label.filter(stays).drop("bad_answer")
    final = label.filter(fits).drop("bad_answer", "words")
    found = leakage.report(leakage.leaks(final, "seq", "text", "split", task.near)).collect()
    r.counters["leakage"] = r.sizes("length") | {k: sum(x["pairs"] for x in found if x["kind"] == k) for k in ("exact", "near")}
    r.tables["leakage"] = final
    leaks = [f"{x['sa']}/{x['sb']} {x['pairs']}" for x in found if x["pairs"]]
    if leaks:
        raise CurateError(f"texts leak between splits ({', '.join(sorted(leaks))}); nothing was written")
    _require_train(r, "length")
    return r


def _require_train(r: Run, stage: str) -> None:
    if not r.counters[stage]["train"]:
        raise CurateError(f"the train split is empty after {stage}; nothing was written")


def stage_sizes(r: Run) -> list[tuple[int, str, str | None, int]]:
    """(stage, name, split, rows kept) of the stages the run came to; before there are splits, split is null."""
    out: list[tuple[int, str, str | None, int]] = []
    for i, name in enumerate(STAGES, start=1):
        c = r.counters.get(name)
        if c is None:
            break
        if i > 5:
            out += [(i, name, s, c[s]) for s in SPLITS]
        else:
            gone = sum(c.get(k, 0) for k in ("dropped_all_invalid", "dropped_no_majority", "rejected"))
            out.append((i, name, None, c["rows"] - gone))
    return out


def write(r: Run, path: str, messages: Callable[[DataFrame], DataFrame] | None = None, rows_per_file: int = 200_000) -> dict:
    """Writes what a run kept, as JSON lines in a folder for each split (by h, so that the files are the same each time), and a report
    beside them, which is returned: counters, sizes, and for each file its split, rows and a checksum of its lines.

    The checksum of a file is the SHA-256 of its lines' bytes, taken line by line, so that a file of any size is read as a stream.
    messages: what a row is written as; by default input_hash, text, teacher, gold. The report comes last: a folder
    without it is not a whole run.
    """
    spark = r.tables["leakage"].sparkSession
    rows = r.tables["leakage"]
    rows = messages(rows) if messages else rows.select("split", F.col("h").alias("input_hash"), "text", "teacher", "gold")
    parts = max(1, -(-max(r.sizes("length").values()) // rows_per_file))
    own = rows.withColumn("__part", F.pmod(F.xxhash64("input_hash"), parts))
    own = own.repartition(3 * parts, "split", "__part").sortWithinPartitions("split", "__part", "input_hash").drop("__part")
    own.write.mode("error").partitionBy("split").json(path)

    files = [f.asDict() for f in checksums(spark, f"{path}/split=*").orderBy("file").collect()]
    report = {"counters": r.counters, "splits": r.sizes("length"), "files": files}
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{path}/_report")
    return report


def checksums(spark, path: str) -> DataFrame:
    """(file, split, rows, sha256) of text files: of each line with its line feed, in the order of the file. A file is one task, as a hash
    goes on from line to line; its lines are streamed."""
    import hashlib

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, n, h = None, 0, None
        out = []
        for f in frames:
            for name, line in zip(f["file"], f["value"], strict=True):
                if name != file:
                    if file is not None:
                        out.append((file, n, h.hexdigest()))
                    file, n, h = name, 0, hashlib.sha256()
                h.update(line.encode() + b"\n")
                n += 1
        if file is not None:
            out.append((file, n, h.hexdigest()))
        yield pd.DataFrame(out, columns=["file", "rows", "sha256"])

    sums = lines.repartition("file").sortWithinPartitions("file", "block", "at").select("file", "value").mapInPandas(digest, "file string, rows long, sha256 string")
    return sums.select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), F.regexp_extract("file", "split=([^/]*)/", 1).alias("split"), "rows", "sha256")
