"""Chat formatting: conversations are rebuilt from event logs, then rendered with a template that can be undone."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Marks of the template. A turn is OPEN, its role, a line break, its text, CLOSE and a line break.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Inside roles and texts "<|" is written with this sign between, which itself is doubled; in roles it precedes line breaks.
ESCAPE = "\\"
_ROLE = re.compile(r"(?:[^\\\n]|\\.)*", re.S)  # up to the first line break that is not behind the sign

#: Kinds of events. start: a turn is opened (with any text there is). delta: text is added to a turn. end: a turn is
#: complete. message: a whole turn. edit: the text is replaced. regenerate: the text is emptied (or replaced) and later turns
#: go. delete: the turn goes.
KINDS = ("start", "delta", "end", "message", "edit", "regenerate", "delete")
#: Code points of a delta of conversations_as_events().
DELTA = 1024


def escape(text: str) -> str:
    """No "<|" is left; unescape(escape(x)) == x for any x."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_column(c: Column) -> Column:
    """escape() in Spark's own functions."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    """escape_column(), and no line break that is not behind the sign."""
    return F.replace(escape_column(c), F.lit("\n"), F.lit("\\\n"))


def conversations_as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of a streamed conversation: each row starts a turn, adds its text in deltas
    of DELTA code points (64 at most), and ends it. Turns are in the order of `turn` (null first); rows that repeat a turn are turns of their
    own, ordered by role and text, and a row that comes twice is there twice. A null role is empty, a null text too."""
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    rows = rows.select("conv_id", "role", "text", F.row_number().over(order).alias("n"))
    size = F.greatest(F.lit(DELTA), F.ceil(F.length("text") / 64)).cast("int")  # long texts in 64, as each is sought from the start
    parts = F.ceil(F.length("text") / size).cast("int")
    kind = "struct<kind:string,role:string,text:string>"
    deltas = F.transform(
        F.when(parts > 0, F.sequence(F.lit(1), parts)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("delta"), F.lit(None).cast("string"), F.substring("text", (i - 1) * size + 1, size)).cast(kind),
    )
    start = F.array(F.struct(F.lit("start"), F.col("role"), F.lit(None).cast("string")).cast(kind))
    end = F.array(F.struct(F.lit("end"), F.lit(None).cast("string"), F.lit(None).cast("string")).cast(kind))
    events = rows.select("conv_id", "n", F.posexplode(F.concat(start, deltas, end)).alias("part", "e"))
    return events.select(
        "conv_id", F.struct("n", "part").alias("seq"), F.col("e.kind").alias("kind"), F.lit(None).cast("long").alias("turn"),
        F.col("e.role").alias("role"), F.col("e.text").alias("text"),
    )


def fold(events: Iterable[tuple]) -> list[tuple[str, str]]:
    """The messages that a conversation's events, in order, leave: (role, text), by turn.

    An event: (kind, turn, role, text). Without a turn, a start or message opens the next free turn; a delta goes on with the
    open turn, or opens the next one where none is open; an end, edit, regenerate or delete is of the last turn. A start or
    message of a turn that exists replaces it, a delta adds to it, or opens it where it does not exist. Other events of a turn
    that does not exist change nothing. A null kind is a message. ValueError for a kind that is not known.
    """
    turns: dict[int, list] = {}
    last, is_open = -1, False
    for kind, turn, role, text in events:
        kind, role, text = kind or "message", role or "", text or ""
        if kind in ("start", "message") or (kind == "delta" and not (is_open if turn is None else turn in turns)):
            turn = last + 1 if turn is None else turn
            turns[turn] = [role, [text]]
            last, is_open = max(last, turn), kind != "message"
            continue
        turn = last if turn is None else turn
        if kind == "end":
            is_open = is_open and turn != last
        elif kind not in KINDS:
            raise ValueError(f"unknown kind of event: {kind}")
        elif turn not in turns:
            continue
        elif kind == "delta":
            turns[turn][1].append(text)
        elif kind == "edit":
            turns[turn][1] = [text]
        elif kind == "regenerate":
            for later in [t for t in turns if t > turn]:
                del turns[later]
            turns[turn][1] = [text]
            last, is_open = turn, True
        else:
            del turns[turn]
            last, is_open = max(turns, default=-1), False
    return [(role, "".join(parts)) for _, (role, parts) in sorted(turns.items())]


def rebuild(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, kind, turn, role, text) as conv_id, messages array<struct<role, text>>, by fold().

    Events of one conversation are gathered and sorted by seq (any type that sorts; null first), then folded;
    a conversation is one row of the result, so it must fit a task, and no more than that is asked. Events
    equal in all columns are kept. Ties of seq are ordered by the other columns. A null conv_id is a
    conversation. A conversation of which no message is left has an empty array.
    """
    rows = F.sort_array(F.collect_list(F.struct("seq", "kind", F.col("turn").cast("long").alias("turn"), "role", "text")))
    gathered = events.groupBy("conv_id").agg(rows.alias("events"))
    slim = F.transform("events", lambda e: F.struct(e["kind"].alias("k"), e["turn"].alias("n"), e["role"].alias("r"), e["text"].alias("t")))
    kind = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    schema = T.StructType([events.schema["conv_id"], T.StructField("messages", kind)])
    arrow = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                logs = part.column(1)
                flat = logs.flatten()
                columns = [flat.field(i).to_pylist() for i in range(4)]
                ends = np.cumsum(pa.compute.list_value_length(logs).to_numpy())
                found = [fold(zip(*(c[i:j] for c in columns), strict=True)) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
                messages = pa.array([[{"role": r, "text": t} for r, t in m] for m in found], arrow)
                yield pa.RecordBatch.from_arrays([part.column(0), messages], names=["conv_id", "messages"])

    return gathered.select("conv_id", slim.alias("events")).mapInArrow(run, schema)


def render(messages: DataFrame, role: str = "assistant") -> DataFrame:
    """Adds formatted (the whole chat) and loss_spans array<struct<start, end>>, in code points of it: the
    escaped texts of the turns of `role`, without marks. No messages: an empty string."""
    turn = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit("\n")).alias("head"),
            escape_column(m["text"]).alias("body"),
            (m["role"] == role).alias("loss"),
        ),
    )
    df = messages.withColumn("__turns", turn)
    tail = CLOSE + "\n"
    df = df.withColumn(
        "formatted",
        F.array_join(F.transform("__turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), ""),
    )
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(tail)).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return df.withColumn("loss_spans", F.aggregate("__turns", zero, step, lambda acc: acc["spans"])).drop("__turns")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered chat."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        end = formatted.index(CLOSE + "\n", at)
        turn = formatted[at + len(OPEN) : end]
        head = _ROLE.match(turn)[0]
        out.append((unescape(head), unescape(turn[len(head) + 1 :])))
        at = end + len(CLOSE) + 1
    return out
