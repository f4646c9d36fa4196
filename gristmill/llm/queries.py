"""The queries opN_<name>, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import chat, context_tree, hard_negatives, html_extract, knn, line_dedup, media, mixing, ngram_join, packing, periodic, quality, suffix_dedup
from gristmill.llm._common import materialize, table


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for documents marked good, 0.5 for bad ones; the others count 1."""
    good = F.max("quality")
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.when(good == 1, 2.0).when(good == 0, 0.5).otherwise(1.0).alias("weight")
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.similar_documents(docs).select("doc_id", "class_id", "n_links")


OP1_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), b AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE shared * 10 >= 8 * (na.n + nb.n - shared)
), r(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a
), c AS (
    SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id
)
SELECT c.doc_id, class_id, (SELECT count(*) FROM e WHERE e.a = c.doc_id) AS n_links FROM c
"""


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Words are counted before the join, so that no text is shuffled.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    docs = docs.join(label_weights(table(spark, sf_dir, "labels")), "doc_id", "left")
    mixed = mixing.mix(docs, size=F.col("words"), quality=F.col("weight"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


OP2_SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
    FROM d GROUP BY source
), c AS (
    SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3.0::DOUBLE * source_size AS cap,
           3.0::DOUBLE * source_size / (CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) AS r
    FROM s
), l AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0.0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM c WINDOW before AS (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_free AS (
    SELECT r AS fr, i AS fi, level AS fl FROM l WHERE level <= r ORDER BY r, i LIMIT 1
), t AS (
    SELECT source, source_size,
           CASE WHEN fr IS NOT NULL AND (r > fr OR (r = fr AND i >= fi)) THEN least(weight * fl, cap) ELSE cap END AS target
    FROM l LEFT JOIN first_free ON true
), w AS (
    SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS weight
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), k AS (
    SELECT d.*, t.source_size, t.target,
           CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs,
           -ln((CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5)
               / 4503599627370496.0) / coalesce(w.weight, 1.0) AS key
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN w ON d.doc_id = w.doc_id
), p AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
    FROM k
)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN size > 0 AND before + size / 2.0 <= target - epochs * source_size
                                  THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"))
    return packing.pack(materialize(pieces, "pieces"), ["doc_id", "piece", "start", "ids_crc32"])


def op4_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.read_media(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256")
    )


OP5_SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j
    FROM documents
), n AS (
    SELECT doc_id, line, j, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
           row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i
    FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), d AS (
    SELECT doc_id, list(line ORDER BY i) AS lines, list(words ORDER BY i) AS words FROM n GROUP BY doc_id
), w AS (
    SELECT n.doc_id, n.i, m, array_to_string(lines[n.i : n.i + m - 1], chr(10)) AS run
    FROM n JOIN d USING (doc_id), range(1, 6) r(m)
    WHERE n.i + m - 1 <= len(lines) AND list_sum(d.words[n.i : n.i + m - 1]) >= 5
), c AS (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM w
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS i FROM c WHERE nth > 1
), k AS (
    SELECT l.doc_id, l.j, l.line, g.i IS NOT NULL AS removed
    FROM l LEFT JOIN n ON l.doc_id = n.doc_id AND l.j = n.j LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i
), t AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT removed), '') AS text
    FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CAST(length(coalesce(t.text, d.text)) AS BIGINT) AS n_chars, sha256(coalesce(t.text, d.text)) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return docs.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.whole_vectors(table(spark, sf_dir, "embeddings"))
    return knn.top_k(vectors, F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
    FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM s
)
SELECT * FROM r WHERE rank <= 10
"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    chats = chat.render(chat.rebuild(chat.conversations_as_events(rows.unionByName(more))))
    return chat_digest(chats)


def chat_digest(chats: DataFrame) -> DataFrame:
    """What can be read back from `formatted` and `loss_spans` alone."""
    schema = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string"

    @F.pandas_udf(schema)
    def digest(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, ranges in zip(formatted, spans, strict=True):
            turns = chat.parse(text)
            loss = "".join(chat.unescape(text[s["start"] : s["end"]]) for s in ranges)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
            rows.append((len(turns), sha256(whole).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    return chats.select(
        "conv_id", digest("formatted", "loss_spans").alias("d"), F.length("formatted").cast("long").alias("formatted_chars")
    ).select("conv_id", "d.*", "formatted_chars")


OP10_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)))
                + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), of which about a tenth (h % 10 = 0, h the crc32 of the id as text) repeat a part of themselves
    from word g % n on, g = h / 10. A null id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n, a, p = F.size("w"), F.col("g") % F.size("w"), F.col("p")
    rows = rows.withColumn("p", F.when(n > 0, 1 + F.floor((n - a) / (3 + F.col("g") % 8))))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i)))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.find_runs(docs)
    # Of the greatest length / period, then the smallest start and period; a / b > c / d as a * d > c * b.
    first = F.get("runs", F.lit(0))
    better = lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], x).otherwise(y)
    best = F.reduce("runs", first, lambda acc, r: better(r, acc))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", "runs", best.alias("best"), lines.alias("lines"), "collapsed")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    found = context_tree.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), rest != 1)
    return found.select(
        "doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.labelled_vectors(rows), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score
    FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v x ON a.vec_id <> x.vec_id AND len(a.v) = len(x.v)
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_source_mix": op2_source_mix,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_webp_media": op4_webp_media,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_main_text": op7_main_text,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_top_k": op9_top_k,
    "op10_chat_format": op10_chat_format,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_context_tree": op12_context_tree,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": OP1_SQL, "op2_source_mix": OP2_SQL, "op5_line_dedup": OP5_SQL, "op9_top_k": OP9_SQL, "op10_chat_format": OP10_SQL,
    "op13_hard_negatives": OP13_SQL,
}
