"""The queries opN against their SQL, and each stage of the pipeline on its own input."""

import html
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gristmill.llm import media, packing, quality
from gristmill.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted([show(dict(zip(names, row))[c]) for c in sorted(names)] for row in r.fetchall())
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted([show(row[c]) for c in sorted(names)] for row in df.collect()) == want


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 1 + len(QUERIES)))


def rows_of(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DATA).collect()]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def first_fit(lengths, room=2048):
    """How many sequences the longest pieces first, each in the first sequence with room, take."""
    free = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, f in enumerate(free) if f >= n), None)
        if at is None:
            free.append(room)
            at = len(free) - 1
        free[at] -= n
    return len(free)


def test_op3_is_brute_force(spark, texts):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    got, room = rows_of(spark, "op3_best_fit_packing"), {}
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids[d]) and all(r["length"] == 2048 for r in own[1:]) and (len(own) == 1 or len(ids[d]) > 2048)
    for slots in room.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = [r["length"] for r in got]
    assert -(-sum(lengths) // 2048) <= len(room) <= first_fit(lengths)


def test_op4_is_brute_force(spark, texts):
    got = rows_of(spark, "op4_webp_media")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    same = {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:]) and r["media_bytes"] > 0 and r["feature"]
        assert same.setdefault(texts[r["doc_id"]], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert sum(r["media_bytes"] for r in got) < 0.6 * sum(r["payload_bytes"] for r in got)


def test_op4_rows_take_the_decoders_path(texts):
    """The stored rows have prefix codes of several lengths, back-references and palettes."""
    seen = set()
    for stored in media.encode_all([media.payload(t) for t in texts.values()]):
        for f in media.files(stored):
            bits, width, height, _, steps = media._read_head(f)
            codes = media._read_codes(bits, width, height, True)[0][0]
            lengths = set((codes[0].array & 15).tolist())
            seen |= {x[0] for x in steps} | {"lengths"} if len(lengths) > 3 else {x[0] for x in steps}
            seen |= {"copies"} if (codes[0].array >> 4).max() > 255 and codes[4].only is None else set()
    assert seen == {media._GREEN, media._PALETTE, "lengths", "copies"}


def test_op6_learns_from_the_rest_and_scores_what_is_held_out(spark):
    data = DATA.replace("0.001", "0.01")  # 70 held-out rows are labelled
    docs = {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, data).collect()}
    assert set(got) == docs
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for d, r in got.items())
    pairs = [(got[d]["score"], q) for d, q in labels.items() if got[d]["held_out"]]
    good, bad = ([s for s, q in pairs if q == k] for k in (1, 0))
    assert len(pairs) >= 60 and good and bad
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) > 0.9 * len(good) * len(bad)


def test_op7_is_the_marked_article(spark):
    got = {r["page_id"]: r for r in rows_of(spark, "op7_main_text")}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div|ul|li)[^>]*>", inside)]
        want = "\n\n".join(x for x in blocks if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_op8_is_brute_force(spark, texts):
    seen, got = set(), {r["doc_id"]: r for r in rows_of(spark, "op8_suffix_dedup")}
    assert set(got) == set(texts)
    for d in sorted(texts):
        raw, gone = texts[d].encode(), bytearray(len(texts[d].encode()))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        r, kept = got[d], bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert r["kept_sha256"] == sha256(kept).hexdigest()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, DATA).cache()
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.score(docs, model).collect() if r["score"] >= 0.3}
    assert sum(labels.get(r["doc_id"]) == 0 for r in kept.collect()) < sum(q == 0 for q in labels.values()) / 2
    lined = stages["line dedup"](spark, kept, DATA).cache()
    assert lined.columns == docs.columns and {r["n_chars"] == len(r["text"]) for r in lined.collect()} == {True}
    alone = stages["n-gram jaccard join"](spark, lined, DATA).cache()
    assert not alone.exceptAll(lined).count()
    words = lambda t: [*t.lower().encode().split()]
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in lined.collect() if (w := words(r["text"]))}
    ids = sorted(r["doc_id"] for r in alone.collect())
    assert all(len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b and a in sets and b in sets)
    gone = set(sets) - set(ids)
    assert all(any(len(sets[g] & sets[b]) >= 0.8 * len(sets[g] | sets[b]) for b in sets if b != g) for g in gone)
    mixed = stages["source mixing"](spark, alone, DATA).cache()
    assert mixed.columns == docs.columns and not mixed.distinct().exceptAll(alone).count()
    packed = stages["best-fit packing"](spark, mixed, DATA).collect()
    encoder = packing.Encoder(packing.tokenizer_path())
    want = sum(len(x) + 1 for x in encoder.encode([r["text"] for r in mixed.collect()]))
    assert sum(r["length"] for r in packed) == want
    assert all(len(r["tokens"]) == 4 * r["length"] and zlib.crc32(r["tokens"]) == r["ids_crc32"] for r in packed)
    room = {}
    for r in packed:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in room.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_stages_keep_columns_of_any_name(spark):
    """Columns that a stage has of its own, too, come out as they went in."""
    names = ("score", "predicted", "held_out", "n_lines", "n_removed", "n_left", "size", "source_size", "target", "copies", "quality_weight", "mix_words", "weight",
             "th", "sid", "class_id", "n_links", "sequence_id", "offset", "length", "root")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 60")
    more = docs.select("*", *[F.concat_ws("-", F.lit(n), "doc_id").alias(n) for n in names]).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, named = stage(spark, docs, DATA), stage(spark, more, DATA)
        assert named.columns == more.columns
        rows = named.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in plain.collect()), name
        assert rows and all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names)
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, more, DATA).count() == packed(spark, docs, DATA).count()
