"""Curation queries: text and JSON scalars, merging, voting, splits, near duplicates, leakage and personal data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions import pii
from gristmill.functions import text as tx
from gristmill.operators import curation, leakage, metrics, running, similarity, splits, votes
from gristmill.operators import pii_stage as stage
from gristmill.registry import query
from gristmill.sources.shared import shared_dir
from gristmill.sources.views import CAPTURES, IMPORTS, PREDS, captures, imports, preds, table

R = lambda c, n=9: F.round(c, n)
NORM = r"trim(regexp_replace(X, '[\s]+', ' ', 'g'))"
KEY = "replace(lower(" + NORM + "), 'ß', 'ss')"
NORM_TEXT, KEY_TEXT = NORM.replace("X", "text"), KEY.replace("X", "text")


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("normalise_text", f"SELECT doc_id, {NORM_TEXT} AS norm FROM documents")
def normalise_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.normalise("text").alias("norm"))


@query("input_hash", f"SELECT doc_id, sha256({NORM_TEXT}) AS input_hash FROM documents")
def input_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(tx.normalise("text"), 256).alias("input_hash"))


@query("dedupe_key", f"SELECT doc_id, {KEY_TEXT} AS key FROM documents")
def dedupe_key(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.dedupe_key("text").alias("key"))


RUNS = f"""w AS (SELECT doc_id, {KEY_TEXT} AS key, regexp_extract_all({KEY_TEXT}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS w FROM documents), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), n AS (SELECT w.doc_id, any_value(key) AS key, count(run) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id)"""


@query("words", f"WITH {RUNS} SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words FROM w")
def words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(tx.words(tx.dedupe_key("text"))).alias("n_words"))


@query("shingles", f"WITH {RUNS} SELECT doc_id, CAST(n AS INTEGER) AS n FROM n")
def shingles(spark, sf_dir):
    return similarity.sets(docs(spark, sf_dir), "doc_id", "text").select(F.col("id").alias("doc_id"), "n")


@query("jaccard", f"""WITH {RUNS}, p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON b.doc_id = a.doc_id + 1)
SELECT p.a, p.b, round(coalesce(c * 1.0::DOUBLE / nullif(na.n + nb.n - c, 0), 0.0), 9) AS jaccard FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
JOIN (SELECT p.a, count(y.run) AS c FROM p LEFT JOIN s x ON x.doc_id = p.a LEFT JOIN s y ON y.doc_id = p.b AND y.run = x.run GROUP BY p.a) o ON o.a = p.a""")
def jaccard(spark, sf_dir):
    s = similarity.sets(docs(spark, sf_dir), "doc_id", "text")
    nxt = s.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("runs").alias("rb"))
    return s.join(nxt, "id").select(F.col("id").alias("a"), "b", R(tx.jaccard(F.col("runs"), F.col("rb"))).alias("jaccard"))


OVERLAP = f"""{RUNS}, first AS (SELECT key, min(doc_id) AS rep FROM n GROUP BY key), r AS (SELECT n.* FROM n JOIN first ON n.doc_id = first.rep),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.run = y.run AND x.doc_id < y.doc_id
      WHERE x.doc_id IN (SELECT rep FROM first) AND y.doc_id IN (SELECT rep FROM first) GROUP BY ALL),
pairs AS (SELECT rep AS a, doc_id AS b, 'exact' AS kind, 1.0::DOUBLE AS jaccard FROM n JOIN first USING (key) WHERE doc_id > rep
    UNION ALL SELECT a, b, 'near', c * 1.0::DOUBLE / (x.n + y.n - c) FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 10 >= 9 * (x.n + y.n - c))"""


@query("near_dup_selfjoin", f"WITH {OVERLAP} SELECT a, b, kind, round(jaccard, 9) AS jaccard FROM pairs")
def near_dup_selfjoin(spark, sf_dir):
    return similarity.near_pairs(docs(spark, sf_dir), "doc_id", "text").select("a", "b", "kind", R("jaccard").alias("jaccard"))


COMPONENTS = f"""WITH RECURSIVE {OVERLAP}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(id, root) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON r.root = e.a), c AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


@query("connected_components", COMPONENTS + " SELECT id, root FROM c")
def connected_components(spark, sf_dir):
    return similarity.components(similarity.near_pairs(docs(spark, sf_dir), "doc_id", "text"))


MEMBERS = COMPONENTS + f""", lab AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS teacher, quality AS gold FROM labels),
m AS (SELECT c.root AS cluster, c.id, CAST(teacher AS VARCHAR) AS teacher, CASE WHEN teacher IS NULL THEN 0 ELSE 1 + c.id % 2 END AS votes, CAST(gold AS VARCHAR) AS gold
      FROM c LEFT JOIN lab ON c.id = lab.id)"""
RESOLVED = MEMBERS + """, v AS (SELECT cluster, teacher, sum(votes) AS v, min(id) AS first FROM m WHERE teacher IS NOT NULL AND votes >= 1 GROUP BY ALL),
t AS (SELECT cluster, sum(v) AS total, max(v) AS top, arg_max(teacher, v) AS win FROM v GROUP BY cluster),
gv AS (SELECT cluster, gold, count(*) AS v FROM m WHERE gold IS NOT NULL GROUP BY ALL), g AS (SELECT cluster, sum(v) AS total, max(v) AS top, arg_max(gold, v) AS win FROM gv GROUP BY cluster),
pick AS (SELECT m.cluster, min(m.id) FILTER (total IS NULL OR (top * 2 > total AND m.teacher = t.win)) AS survivor, any_value(CASE WHEN t.top * 2 > t.total THEN t.win END) AS teacher
      FROM m LEFT JOIN t ON m.cluster = t.cluster GROUP BY m.cluster),
resolved AS (SELECT r.cluster, r.survivor, r.teacher, coalesce(CASE WHEN g.top * 2 > g.total THEN g.win END, own.gold) AS gold
      FROM pick r LEFT JOIN g ON g.cluster = r.cluster LEFT JOIN m own ON own.id = r.survivor)"""


def _members(spark, sf_dir):
    c = similarity.components(similarity.near_pairs(docs(spark, sf_dir), "doc_id", "text"))
    q, id_ = F.col("quality"), F.col("id")
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    teacher = F.when(id_ % 7 == 0, 1 - q).otherwise(q).cast("string")
    return c.join(lab, "id", "left").select(
        F.col("root").alias("cluster"), "id", teacher.alias("teacher"), F.when(teacher.isNull(), 0).otherwise(1 + id_ % 2).alias("votes"), q.cast("string").alias("gold")
    )


@query("resolve_cluster", RESOLVED + " SELECT * FROM resolved")
def resolve_cluster(spark, sf_dir):
    return votes.resolve_clusters(_members(spark, sf_dir)).select("cluster", "survivor", "teacher", "gold")


@query("dedupe_split", RESOLVED + """, k AS (SELECT n.doc_id AS id, n.key FROM n)
SELECT count(*) FILTER (survivor IS NULL) AS conflict_examples, count(*) FILTER (m.id <> survivor AND a.key = b.key) AS removed_exact, count(*) FILTER (m.id <> survivor AND a.key <> b.key) AS removed_near
FROM m JOIN resolved USING (cluster) JOIN k a ON a.id = m.id LEFT JOIN k b ON b.id = survivor""")
def dedupe_split(spark, sf_dir):
    m = _members(spark, sf_dir)
    r = votes.resolve_clusters(m).select("cluster", "survivor")
    k = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha2(tx.dedupe_key("text"), 256).alias("key"))
    x = m.select("cluster", "id").join(r, "cluster").join(k, "id").join(k.select(F.col("id").alias("survivor"), F.col("key").alias("sk")), "survivor", "left")
    gone = F.col("id") != F.col("survivor")
    return x.agg(
        F.count_if(F.col("survivor").isNull()).alias("conflict_examples"), F.count_if(gone & (F.col("key") == F.col("sk"))).alias("removed_exact"),
        F.count_if(gone & (F.col("key") != F.col("sk"))).alias("removed_near"),
    )


@query("lsh_bands", """SELECT CAST(t AS DOUBLE) AS threshold, p AS permutations, CAST(arg_max(p // r, r) AS INTEGER) AS bands, CAST(max(r) AS INTEGER) AS rows
FROM (VALUES (0.9, 128), (0.9, 256), (0.8, 256)) v(t, p), range(1, 257) w(r) WHERE r <= p AND pow(1 - pow(CAST(t AS DOUBLE), r), p // r) <= 1e-6 GROUP BY t, p""")
def lsh_bands(spark, sf_dir):
    rows = [(t, p, *similarity.lsh_bands(t, p)) for t, p in ((0.9, 128), (0.9, 256), (0.8, 256))]
    return spark.createDataFrame(rows, "threshold double, permutations int, bands int, rows int")


SPLIT = "CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'valid' ELSE 'test' END"
CROSS = f"""{RUNS}, sp AS (SELECT doc_id, {SPLIT} AS split, CASE WHEN doc_id % 10 < 6 THEN 1 WHEN doc_id % 10 < 8 THEN 2 ELSE 3 END AS rank, key, n FROM n),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.run = y.run GROUP BY ALL),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, x.split AS sa, y.split AS sb, 'exact' AS kind, 1.0::DOUBLE AS jaccard FROM sp x JOIN sp y ON x.key = y.key AND x.rank < y.rank
    UNION ALL SELECT a, b, x.split, y.split, 'near', c * 1.0::DOUBLE / (x.n + y.n - c) FROM o JOIN sp x ON x.doc_id = a JOIN sp y ON y.doc_id = b
    WHERE x.rank < y.rank AND x.key <> y.key AND c * 10 >= 9 * (x.n + y.n - c)),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY kind, jaccard DESC, b) AS r FROM pairs)"""


def _split(df, id_="doc_id"):
    k = F.col(id_) % 10
    return df.withColumn("split", F.when(k < 6, "train").when(k < 8, "valid").otherwise("test"))


def _cross(spark, sf_dir):
    return similarity.cross_matches(_split(docs(spark, sf_dir)), "doc_id", "text", "split")


@query("cross_split_match", f"WITH {CROSS} SELECT a, b, kind, round(jaccard, 9) AS jaccard FROM best WHERE r = 1")
def cross_split_match(spark, sf_dir):
    return _cross(spark, sf_dir).select("a", "b", "kind", R("jaccard").alias("jaccard"))


@query("cross_split_anti", f"WITH {CROSS} SELECT doc_id, split FROM sp WHERE doc_id NOT IN (SELECT a FROM pairs)")
def cross_split_anti(spark, sf_dir):
    gone = _cross(spark, sf_dir).select(F.col("a").alias("doc_id"))
    return _split(docs(spark, sf_dir)).select("doc_id", "split").join(gone, "doc_id", "left_anti")


@query("leakage_check", f"""WITH {CROSS} SELECT v.sa, v.sb, k.kind, count(a) AS pairs FROM (VALUES ('train','valid'),('train','test'),('valid','test')) v(sa, sb) CROSS JOIN (VALUES ('exact'),('near')) k(kind)
LEFT JOIN pairs p ON p.sa = v.sa AND p.sb = v.sb AND p.kind = k.kind GROUP BY ALL""")
def leakage_check(spark, sf_dir):
    """By a banded MinHash join that shares nothing with what the other queries find duplicates by."""
    return leakage.report(leakage.leaks(_split(docs(spark, sf_dir)), "doc_id", "text", "split"))


# Captured calls.
LOADED = f"""{CAPTURES}, d AS (SELECT *, CASE WHEN NOT captured THEN 'not_captured' WHEN status <> 200 THEN 'status' WHEN response <> 'body' THEN 'empty_response' ELSE 'usable' END AS disposition FROM captures)"""


def _loaded(spark, sf_dir):
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(~F.col("captured"), "not_captured").when(F.col("status") != 200, "status").when(empty("request_body"), "empty_request")
        .when(empty("response_body"), "empty_response").otherwise("usable")
    )
    return captures(spark, sf_dir).withColumn("disposition", reason)


@query("load_sources", f"WITH {LOADED} SELECT disposition, source, upstream_model, count(*) AS n, round(sum(cost_usd), 9) AS cost, min(ts) AS first, max(ts) AS last FROM d GROUP BY ALL")
def load_sources(spark, sf_dir):
    return _loaded(spark, sf_dir).groupBy("disposition", "source", "upstream_model").agg(
        F.count("*").alias("n"), R(F.sum("cost_usd")).alias("cost"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


MESSAGES = "struct<model:string,messages:array<struct<role:string,content:string>>>"


def _asked(spark, sf_dir):
    return _loaded(spark, sf_dir).withColumn("req", F.from_json("request_body", MESSAGES))


def _last_user(messages):
    return F.element_at(F.filter(messages, lambda m: m["role"] == "user"), -1)["content"]


@query("request_teacher", f"WITH {LOADED} SELECT id, upstream_model AS model, sha256(list_filter(messages, lambda m: m.role IN ('system', 'developer'))[1].content) AS prompt_hash FROM d")
def request_teacher(spark, sf_dir):
    first = F.get(F.filter("req.messages", lambda m: m["role"].isin("system", "developer")), F.lit(0))["content"]
    return _asked(spark, sf_dir).select("id", F.col("req.model").alias("model"), F.sha2(first, 256).alias("prompt_hash"))


LAST = "list_filter(messages, lambda m: m.role = 'user')[-1].content"



@query("extract_input_regex", f"WITH {LOADED} SELECT id, CASE WHEN regexp_matches({LAST}, '(?s)^[^ ]+ .*') THEN regexp_extract({LAST}, '(?s)^[^ ]+ (.*)', 1) END AS input FROM d")
def extract_input_regex(spark, sf_dir):
    users = F.filter("req.messages", lambda m: m["role"] == "user")
    said = F.when(F.size(users) > 0, _last_user("req.messages"))
    return _asked(spark, sf_dir).select("id", F.when(said.rlike("(?s)^[^ ]+ .*"), F.regexp_extract(said, "(?s)^[^ ]+ (?<input>.*)", 1)).alias("input"))


@query("response_output", f"WITH {LOADED} SELECT id, CASE WHEN response = 'body' THEN answer END AS output FROM d")
def response_output(spark, sf_dir):
    return _loaded(spark, sf_dir).select("id", F.get_json_object("response_body", "$.choices[0].message.content").alias("output"))


RECORDS = f"""{LOADED}, {IMPORTS}, rec AS (
    SELECT 'capture' AS origin, id, {LAST} AS input, CASE WHEN response = 'body' THEN answer END AS output, NULL AS gold, NULL AS split, disposition FROM d
    UNION ALL SELECT 'import', id, input, CASE WHEN format = 'pairs' THEN output END, gold, split, 'usable' FROM imports
), records AS (SELECT *, CASE WHEN disposition <> 'usable' THEN disposition WHEN input IS NULL THEN 'input_unparsed' WHEN {NORM.replace('X', 'input')} = '' THEN 'empty_input'
    WHEN origin = 'capture' AND output IS NULL THEN 'missing_output' ELSE 'ok' END AS result FROM rec)"""


def _records(spark, sf_dir):
    """Captured and imported rows in one form: origin, id, input, output, gold, split, result."""
    a = _asked(spark, sf_dir)
    users = F.filter("req.messages", lambda m: m["role"] == "user")
    said = F.when(F.size(users) > 0, _last_user("req.messages"))
    a = a.select(F.lit("capture").alias("origin"), "id", said.alias("input"), F.get_json_object("response_body", "$.choices[0].message.content").alias("output"), "disposition")
    b = imports(spark, sf_dir)
    b = b.select(F.lit("import").alias("origin"), "id", "input", F.when(F.col("format") == "pairs", F.col("output")).alias("output"), "gold", "split", "grp", F.lit("usable").alias("disposition"))
    u = b.unionByName(a, allowMissingColumns=True)
    result = (
        F.when(F.col("disposition") != "usable", F.col("disposition")).when(F.col("input").isNull(), "input_unparsed")
        .when(~F.col("input").rlike("[!-~]") & (tx.normalise("input") == ""), "empty_input").when((F.col("origin") == "capture") & F.col("output").isNull(), "missing_output").otherwise("ok")
    )
    return u.withColumn("result", result)


@query("union_sources", f"WITH {RECORDS} SELECT origin, count(*) AS n, count(output) AS outputs, count(gold) AS golds FROM records GROUP BY origin")
def union_sources(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("n"), F.count("output").alias("outputs"), F.count("gold").alias("golds"))


@query("extract_records", f"WITH {RECORDS} SELECT origin, result, count(*) AS n FROM records GROUP BY ALL")
def extract_records(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("origin", "result").agg(F.count("*").alias("n"))


CANON = "CASE lower(trim(split)) WHEN 'validation' THEN 'valid' WHEN 'dev' THEN 'valid' WHEN 'train' THEN 'train' WHEN 'test' THEN 'test' END"


@query("canonical_split", f"WITH {IMPORTS} SELECT id, {CANON} AS split FROM imports")
def canonical_split(spark, sf_dir):
    return imports(spark, sf_dir).select("id", votes.canonical_split("split").alias("split"))


GOOD = f"""{RECORDS}, g AS (SELECT origin, id, CASE WHEN origin = 'import' THEN id ELSE 1000000000 + id END AS seq, sha256({NORM.replace('X', 'input')}) AS h, input, output, gold, {CANON} AS split FROM records WHERE result = 'ok')"""


def _good(spark, sf_dir):
    r = _records(spark, sf_dir).filter("result = 'ok'")
    seq = F.when(F.col("origin") == "import", F.col("id")).otherwise(F.col("id") + 1000000000)
    return r.select("origin", "id", seq.alias("seq"), F.sha2(tx.normalise("input"), 256).alias("h"), "input", "output", "gold", "grp", votes.canonical_split("split").alias("split"))


@query("merge_by_hash", f"""WITH {GOOD} SELECT h, count(*) AS n, count(output) AS outputs, count(gold) AS golds, arg_min(id, seq) AS first, count(DISTINCT origin) AS origins FROM g GROUP BY h""")
def merge_by_hash(spark, sf_dir):
    return _good(spark, sf_dir).groupBy("h").agg(
        F.count("*").alias("n"), F.count("output").alias("outputs"), F.count("gold").alias("golds"), F.min_by("id", "seq").alias("first"), F.count_distinct("origin").alias("origins")
    )


@query("raw_inputs_by_hash", f"WITH {GOOD} SELECT h, arg_min(input, seq) AS input FROM g GROUP BY h")
def raw_inputs_by_hash(spark, sf_dir):
    return _good(spark, sf_dir).groupBy("h").agg(F.min_by("input", "seq").alias("input"))


@query("order_by_hash", f"WITH {GOOD} SELECT DISTINCT h FROM g ORDER BY h")
def order_by_hash(spark, sf_dir):
    return _good(spark, sf_dir).select("h").distinct().orderBy("h")


MAJ = """, v AS (SELECT h, VALUE AS value, count(*) AS v FROM g WHERE VALUE IS NOT NULL GROUP BY ALL), m AS (SELECT h, sum(v) AS total, max(v) AS top, arg_max(value, v) AS win FROM v GROUP BY h)
SELECT k.h, CASE WHEN top * 2 > total THEN win END AS VALUE, CASE WHEN top * 2 > total THEN top END AS votes, CAST(coalesce(total, 0) AS BIGINT) AS total FROM (SELECT DISTINCT h FROM g) k LEFT JOIN m USING (h)"""


@query("majority_vote", f"WITH {GOOD}{MAJ.replace('VALUE', 'output')}")
def majority_vote(spark, sf_dir):
    return votes.majority(_good(spark, sf_dir), "h", "output", "seq")


@query("weighted_majority", f"""WITH {PREDS}, v AS (SELECT grp, pred, sum(id % 4) AS v FROM preds WHERE id % 4 >= 1 GROUP BY ALL), m AS (SELECT grp, sum(v) AS total, max(v) AS top, arg_max(pred, v) AS win FROM v GROUP BY grp)
SELECT grp, CASE WHEN top * 2 > total THEN win END AS pred, CAST(CASE WHEN top * 2 > total THEN top END AS BIGINT) AS votes, CAST(total AS BIGINT) AS total FROM m WHERE grp IS NOT NULL""")
def weighted_majority(spark, sf_dir):
    return votes.majority(preds(spark, sf_dir).filter("grp IS NOT NULL"), "grp", "pred", "id", F.col("id") % 4)


@query("merge_meta_first_wins", f"""WITH {GOOD}, kv AS (SELECT h, seq, 'gold' AS key, gold AS value FROM g UNION ALL SELECT h, seq, 'split', split FROM g)
SELECT h, key, arg_min(value, seq) AS value, min(value) <> max(value) AS conflict FROM kv WHERE value IS NOT NULL GROUP BY ALL""")
def merge_meta_first_wins(spark, sf_dir):
    g = _good(spark, sf_dir).withColumn("meta", F.create_map(F.lit("gold"), F.col("gold"), F.lit("split"), F.col("split")))
    return votes.first_wins(g, "h", "meta", "seq")


@query("split_rank_max", f"""WITH {GOOD} SELECT h, max(CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 WHEN 'test' THEN 3 END) AS rank, count(DISTINCT split) > 1 AS disagree FROM g GROUP BY h""")
def split_rank_max(spark, sf_dir):
    rank = F.max(F.expr(votes.RANK)).cast("int")
    return _good(spark, sf_dir).groupBy("h").agg(F.when(rank > 0, rank).alias("rank"), (F.count_distinct("split") > 1).alias("disagree"))


@query("repeats", f"""WITH {GOOD}, o AS (SELECT h, origin, split, count(*) - 1 AS r FROM g GROUP BY ALL), p AS (SELECT h, origin, sum(r) AS r FROM o GROUP BY ALL) SELECT h, CAST(max(r) AS BIGINT) AS repeats FROM p GROUP BY h""")
def repeats(spark, sf_dir):
    return votes.repeats(_good(spark, sf_dir), "h")


@query("normalise_examples", f"""WITH {GOOD}, o AS (SELECT h, output AS value, count(*) AS v FROM g WHERE output IS NOT NULL GROUP BY ALL), gg AS (SELECT h, gold AS value, count(*) AS v FROM g WHERE gold IS NOT NULL GROUP BY ALL),
t AS (SELECT h, sum(v) AS outputs, coalesce(sum(v) FILTER (value NOT IN ('0', '1')), 0) AS invalid, coalesce(sum(v) FILTER (value IN ('0', '1')), 0) AS valid, max(v) FILTER (value IN ('0', '1')) AS top, count(*) FILTER (value IN ('0', '1')) AS different FROM o GROUP BY h),
gt AS (SELECT h, coalesce(sum(v) FILTER (value NOT IN ('0', '1')), 0) AS invalid, coalesce(sum(v) FILTER (value IN ('0', '1')), 0) AS valid, max(v) FILTER (value IN ('0', '1')) AS top, count(*) FILTER (value IN ('0', '1')) AS different FROM gg GROUP BY h),
e AS (SELECT g.h, coalesce(bool_or(split = 'test'), false) AS test FROM g GROUP BY g.h),
x AS (SELECT e.h, test, coalesce(t.outputs, 0) AS outputs, coalesce(t.invalid, 0) AS invalid, coalesce(t.valid, 0) AS valid, coalesce(t.top * 2 > t.valid, false) AS won, coalesce(t.different, 0) AS different,
    coalesce(gt.invalid, 0) AS gold_invalid, coalesce(gt.top * 2 > gt.valid, false) AS gold_won, coalesce(gt.different, 0) AS golds FROM e LEFT JOIN t USING (h) LEFT JOIN gt USING (h)),
c AS (SELECT count(*) AS examples, sum(outputs) AS outputs, sum(invalid) AS invalid_outputs, count(*) FILTER (outputs > 0 AND valid = 0 AND NOT test) AS dropped_all_invalid,
    count(*) FILTER (valid > 0 AND NOT won AND NOT test) AS dropped_no_majority, count(*) FILTER (outputs > 0 AND valid = 0 AND test) AS kept_test_all_invalid,
    count(*) FILTER (valid > 0 AND NOT won AND test) AS kept_test_no_majority, count(*) FILTER (won AND different > 1) AS conflicts_resolved, count(*) FILTER (outputs = 0) AS unlabelled,
    sum(gold_invalid) AS gold_invalid, count(*) FILTER (golds > 1 AND gold_won) AS gold_conflicts_resolved, count(*) FILTER (golds > 1 AND NOT gold_won) AS gold_conflicts_unresolved FROM x)
SELECT unnest([{', '.join(f"'{n}'" for n in curation.NORMALISE)}]) AS counter, unnest([{', '.join(f'CAST({n} AS BIGINT)' for n in curation.NORMALISE)}]) AS n FROM c""")
def normalise_examples(spark, sf_dir):
    """The twelve counters of the stage, observed as its rows are written."""
    r = curation.Run(TASK, spark)
    g = r.take(_good(spark, sf_dir), "good")
    r.keep("normalise", curation.decide(curation.merge(g), g, TASK), **curation.decision_counters())
    return spark.createDataFrame([(n, r.counters["normalise"][n]) for n in curation.NORMALISE], "counter string, n long")


@query("label_distribution", f"WITH {PREDS} SELECT split, l AS label, count(id) AS n FROM (VALUES ('0'), ('1'), ('2')) v(l), (SELECT DISTINCT split FROM preds) s LEFT JOIN preds USING (split) WHERE true GROUP BY ALL HAVING false UNION ALL SELECT s.split, l, count(p.id) FROM (VALUES ('0'), ('1'), ('2')) v(l) CROSS JOIN (SELECT DISTINCT split FROM preds) s LEFT JOIN preds p ON p.split = s.split AND p.gold = l GROUP BY s.split, l")
def label_distribution(spark, sf_dir):
    c = metrics.label_counts(preds(spark, sf_dir), "pred", "gold", ["0", "1", "2"], ["split"])
    return c.select("split", "label", F.col("n_gold").alias("n"))


@query("topk_counts", """WITH c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY source)
SELECT CASE WHEN r <= 8 THEN source ELSE 'others' END AS source, CAST(sum(n) AS BIGINT) AS n, count(*) AS k FROM c GROUP BY 1""")
def topk_counts(spark, sf_dir):
    c = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    c = c.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "source")))
    return c.groupBy(F.when(F.col("r") <= 8, F.col("source")).otherwise("others").alias("source")).agg(F.sum("n").alias("n"), F.count("*").alias("k"))


# Splits.
ORDER = "substr(sha256('13' || chr(0) || 'KIND' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 16)"
Q = "CAST(floor(n * 0.2::DOUBLE + 0.5) AS BIGINT)"
CUT = f"CASE WHEN r <= {Q} THEN 'test' WHEN r <= {Q} + CAST(floor(n * 0.1::DOUBLE + 0.5) AS BIGINT) THEN 'valid' ELSE 'train' END AS split"


@query("seeded_order", f"SELECT doc_id, {ORDER.replace('KIND', 'random')} AS rank FROM documents")
def seeded_order(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", splits.seeded_rank("13", "random", F.col("doc_id")).alias("rank"))


@query("split_random", f"SELECT doc_id, {CUT} FROM (SELECT doc_id, row_number() OVER (ORDER BY {ORDER.replace('KIND', 'random')}, doc_id) AS r, count(*) OVER () AS n FROM documents)")
def split_random(spark, sf_dir):
    return splits.random_split(docs(spark, sf_dir).select("doc_id"), "doc_id", "13", 0.2, 0.1).select("doc_id", "split")


STRATA = f"""WITH i AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ORDER.replace('KIND', 'stratum')}, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m, count(*) OVER () AS n FROM documents),
p AS (SELECT doc_id, n, row_number() OVER (ORDER BY (i + CAST(CAST('0x' || substr(sha256('13' || chr(0) || 'offset' || chr(0) || lang), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0) / m, lang, i) AS r FROM i)"""


@query("split_stratified", STRATA + f" SELECT doc_id, {CUT} FROM p")
def split_stratified(spark, sf_dir):
    return splits.stratified_split(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", "lang", "13", 0.2, 0.1).select("doc_id", "split")


GROUP_OF = "CASE WHEN source IS NOT NULL THEN 'group' || chr(0) || source ELSE 'row' || chr(0) || CAST(doc_id AS VARCHAR) END"


@query("split_grouped", f"""WITH RECURSIVE g AS (SELECT {GROUP_OF} AS g, count(*) AS n FROM documents GROUP BY 1),
o AS (SELECT g, n, row_number() OVER (ORDER BY {ORDER.replace('KIND', 'group').replace('CAST(doc_id AS VARCHAR)', 'g')}, g) AS r FROM g),
t AS (SELECT sum(n) AS n, floor(sum(n) * 0.2::DOUBLE + 0.5) AS test, floor(sum(n) * 0.1::DOUBLE + 0.5) AS valid, count(*) AS k FROM g),
ft(r, taken, hit) AS (SELECT 0::BIGINT, 0::HUGEINT, false UNION ALL
    SELECT o.r, taken + CASE WHEN 2 * taken + n < 2 * (SELECT test FROM t) THEN n ELSE 0 END, 2 * taken + n < 2 * (SELECT test FROM t) FROM ft JOIN o ON o.r = ft.r + 1),
ht AS (SELECT o.g, row_number() OVER (ORDER BY r) AS i FROM ft JOIN o USING (r) WHERE hit),
pt AS (SELECT g FROM ht WHERE i <= (SELECT k - (n > test + valid)::INT FROM t) UNION ALL
    (SELECT g FROM o WHERE (SELECT count(*) FROM ht) = 0 AND (SELECT test > 0 AND k > (n > test + valid)::INT FROM t) ORDER BY n, r LIMIT 1)),
q AS (SELECT g, n, row_number() OVER (ORDER BY r) AS r FROM o WHERE g NOT IN (SELECT g FROM pt)), u AS (SELECT count(*) AS k FROM q),
fv(r, taken, hit) AS (SELECT 0::BIGINT, 0::HUGEINT, false UNION ALL
    SELECT q.r, taken + CASE WHEN 2 * taken + n < 2 * (SELECT valid FROM t) THEN n ELSE 0 END, 2 * taken + n < 2 * (SELECT valid FROM t) FROM fv JOIN q ON q.r = fv.r + 1),
hv AS (SELECT q.g, row_number() OVER (ORDER BY r) AS i FROM fv JOIN q USING (r) WHERE hit),
pv AS (SELECT g FROM hv WHERE i <= (SELECT u.k - (t.n > t.test + t.valid)::INT FROM t, u) UNION ALL
    (SELECT g FROM q WHERE (SELECT count(*) FROM hv) = 0 AND (SELECT t.valid > 0 AND u.k > (t.n > t.test + t.valid)::INT FROM t, u) ORDER BY n, r LIMIT 1))
SELECT source, CASE WHEN {GROUP_OF} IN (SELECT g FROM pt) THEN 'test' WHEN {GROUP_OF} IN (SELECT g FROM pv) THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY ALL""")
def split_grouped(spark, sf_dir):
    return splits.grouped_split(docs(spark, sf_dir), "doc_id", "source", "13", 0.2, 0.1).groupBy("source", "split").agg(F.count("*").alias("n"))


@query("assign_splits", f"""WITH {IMPORTS}, r AS (SELECT doc_id, {CUT} FROM (SELECT doc_id, row_number() OVER (ORDER BY {ORDER.replace('KIND', 'random')}, doc_id) AS r, count(*) OVER () AS n
    FROM documents WHERE doc_id % 6 = 5)) SELECT id AS doc_id, coalesce({CANON.replace('split', 'i.split')}, r.split) AS split FROM imports i LEFT JOIN r ON r.doc_id = i.id""")
def assign_splits(spark, sf_dir):
    df = imports(spark, sf_dir).select(F.col("id").alias("doc_id"), votes.canonical_split("split").alias("given"))
    free = splits.random_split(df.filter("given IS NULL").select("doc_id"), "doc_id", "13", 0.2, 0.1)
    return df.join(free, "doc_id", "left").select("doc_id", F.coalesce("given", "split").alias("split"))


@query("smoke_spread", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r % greatest(n // 10, 1) = 0 ORDER BY doc_id LIMIT 10")
def smoke_spread(spark, sf_dir):
    df = running.by_ranges(docs(spark, sf_dir).select("doc_id"), "doc_id")
    df = running.with_totals(running.running_sums(df, "__range", [F.col("doc_id")], {"r": F.lit(1)}, before=True), n=F.count(F.lit(1)))
    return df.filter(F.col("r") % F.greatest(F.floor(F.col("n") / 10), F.lit(1)) == 0).orderBy("doc_id").limit(10).select("doc_id")


@query("seeded_shuffle_sample", f"SELECT doc_id FROM documents ORDER BY {ORDER.replace('KIND', 'sample')}, doc_id LIMIT 50")
def seeded_shuffle_sample(spark, sf_dir):
    return docs(spark, sf_dir).orderBy(splits.seeded_rank("13", "sample", F.col("doc_id")), "doc_id").limit(50).select("doc_id")


@query("quick_subset", f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), k AS (SELECT count(*) AS k FROM c),
l AS (SELECT lang, n, (20 * k - coalesce(sum(n) OVER (ORDER BY n, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) // (k - row_number() OVER (ORDER BY n, lang) + 1) AS level FROM c, k),
q AS (SELECT lang, n, least(n, (SELECT max(level) FROM l WHERE n > level)) AS quota FROM l),
e AS (SELECT lang, quota + CASE WHEN n > quota AND row_number() OVER (ORDER BY n DESC, lang) <= (SELECT 20 * k FROM k) - sum(quota) OVER () THEN 1 ELSE 0 END AS quota FROM q)
SELECT doc_id, d.lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ORDER.replace('KIND', 'quick')}, doc_id) AS r FROM documents) d
JOIN e ON d.lang IS NOT DISTINCT FROM e.lang WHERE r <= quota""")
def quick_subset(spark, sf_dir):
    """20 rows a language on average: what a language lacks goes to those that have more."""
    d = docs(spark, sf_dir).select("doc_id", "lang")
    counts = d.groupBy("lang").agg(F.count("*").alias("n"))
    quotas = splits.water_quota(counts, "lang", "n", 20 * counts.count()).select(F.col("lang").alias("of"), "quota")
    most = quotas.agg(F.max("quota")).first()[0] or 0
    w = Window.partitionBy("lang").orderBy(splits.seeded_rank("13", "quick", F.col("doc_id")), "doc_id")
    first = d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)  # a limit that is known keeps rows from the shuffle
    return first.join(F.broadcast(quotas), F.col("lang").eqNullSafe(F.col("of"))).filter("r <= quota").select("doc_id", "lang")


# Labels, JSON and schemas. Orders' priorities stand for labels, in the forms in which a model answers.
SAID = ["{}", "**Label:** {}", '"{}".', "intent: `{}`", "  {}  ", "CATEGORY：{}..", "“{}”", "{}?"]


def _said(spark, sf_dir) -> DataFrame:
    """(id, priority, raw): each order's priority in one of these forms."""
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, SAID)), (k % len(SAID) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("priority"), F.replace(form, F.lit("{}"), F.col("o_orderpriority")).alias("raw"))


KEYS = "SELECT o_orderkey AS id, regexp_replace(lower(o_orderpriority), '[ -]+', '_', 'g') || CASE o_orderkey % 8 WHEN 5 THEN '.' WHEN 7 THEN '?' ELSE '' END AS key FROM orders"


@query("label_key", KEYS)
def label_key(spark, sf_dir):
    return _said(spark, sf_dir).select("id", tx.label_key("raw").alias("key"))


LABEL_SET = ["1 Urgent?", "2-high", "3_MEDIUM!", "3-medium.", "4 not specified", "4-NOT-SPECIFIED", "5-LOW."]


@query("normalise_label", f"""WITH k AS ({KEYS}) SELECT id, CASE WHEN key IN ('1_urgent', '1_urgent.', '1_urgent?') THEN '1 Urgent?' WHEN key LIKE '2_high%' THEN '2-high'
    WHEN key LIKE '5_low%' THEN '5-LOW.' WHEN key = '3_medium' THEN '3-medium.' END AS label FROM k""")
def normalise_label(spark, sf_dir):
    """Keys '3_medium' (its label ends in a full stop, which goes) and '3_medium!' differ, but not without punctuation; two labels
    have the key '4_not_specified'."""
    labels = spark.createDataFrame([(x,) for x in LABEL_SET], "label string")
    return tx.match_labels(_said(spark, sf_dir), "raw", labels, "label").select("id", F.col("matched").alias("label"))


ANSWERS = ["Here it is:\n```json\n{}\n```\nDone.", "{}", "Sure: {} and {{not this}}", '{{"broken": ', "none", '{{"a": NaN}}']


@query("parse_json_output", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 < 3 THEN '{"key":' || CAST(o_orderkey AS VARCHAR) || ',"tags":[{"p":"' || o_orderpriority || '"}]}' END AS value FROM orders""")
def parse_json_output(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.to_json(F.struct(k.alias("key"), F.array(F.struct(F.col("o_orderpriority").alias("p"))).alias("tags")))
    said = F.element_at(F.array(*[F.concat(*(F.lit(x.replace("{{", "{").replace("}}", "}")) if x else value for x in _around(a))) for a in ANSWERS]), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), tx.parse_output(said).alias("value"))


def _around(answer: str) -> list[str]:
    """The text before and after '{}', with an empty string in its place."""
    before, mark, after = answer.partition("{}")
    return [x for x in ((before or " "), "" if mark else None, (after or " ")) if x is not None]


ORDER_SCHEMA = {
    "type": "object", "required": ["status", "total"], "additionalProperties": False,
    "properties": {"status": {"enum": ["F", "O"]}, "total": {"type": "number", "maximum": 200000}, "date": {"type": "string", "format": "date"}},
}


@query("validate_schema", "SELECT o_orderkey AS id, CAST((o_orderstatus NOT IN ('F', 'O'))::INT + (o_totalprice > 200000)::INT AS INTEGER) AS errors FROM orders")
def validate_schema(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    doc = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")))
    return o.select(F.col("o_orderkey").alias("id"), F.size(tx.validate(ORDER_SCHEMA)(doc)).alias("errors"))


LINE_SCHEMA = {
    "type": "object", "properties": {
        "status": {"type": "string"}, "customer": {"type": "object", "properties": {"key": {"type": "number"}, "name": {"type": ["string", "null"]}}},
        "lines": {"type": "array", "items": {"type": "object", "properties": {"part": {"type": "number"}, "tax": {"type": "number"}}}},
    },
}


@query("canonical_output", """SELECT o_orderkey AS id, '{"status":"' || o_orderstatus || '","customer":{"key":' || CAST(o_custkey AS VARCHAR) || ',"name":null},"lines":[{"part":1,"tax":0.5},{"tax":2}]}' AS out FROM orders""")
def canonical_output(spark, sf_dir):
    """Objects at any depth in the order of the schema; what it does not know goes, what is missing stays missing."""
    o = table(spark, sf_dir, "orders")
    given = F.concat(
        F.lit('{"lines": [{"tax": 0.5, "x": 1, "part": 1}, {"tax": 2}], "unknown": {"a": 1}, "customer": {"name": null, "key": '), F.col("o_custkey").cast("string"),
        F.lit('}, "status": "'), "o_orderstatus", F.lit('"}'),
    )
    return o.select(F.col("o_orderkey").alias("id"), tx.in_schema_order(LINE_SCHEMA)(given).alias("out"))


@query("normalise_output", f"""WITH k AS ({KEYS}) SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN key LIKE '2_high%' THEN '2-high' END WHEN o_orderstatus IN ('F', 'O') AND o_totalprice <= 200000
    THEN '{{"status":"' || o_orderstatus || '"}}' END AS out FROM orders JOIN k ON k.id = o_orderkey""")
def normalise_output(spark, sf_dir):
    """Answers of a labelling task as labels, those of an extraction task as JSON in their schema's order; null if not valid."""
    labels = spark.createDataFrame([("2-high",)], "label string")
    o = table(spark, sf_dir, "orders")
    doc = F.to_json(F.struct(F.lit("2024-01-01").alias("date"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")))
    value = tx.parse_output(F.concat(F.lit("```\n"), doc, F.lit("\n```")))
    valid = F.size(tx.validate(ORDER_SCHEMA)(value)) == 0
    short = tx.in_schema_order({"type": "object", "properties": {"status": {}}})(value)
    x = o.select(F.col("o_orderkey").alias("id"), F.when(valid, short).alias("object"))
    x = tx.match_labels(_said(spark, sf_dir), "raw", labels, "label").select("id", "matched").join(x, "id")
    return x.select("id", F.when(F.col("id") % 2 == 0, F.col("matched")).otherwise(F.col("object")).alias("out"))


@query("canonical_json", """SELECT o_orderkey AS id, '{"a":' || CAST(o_orderkey AS VARCHAR) || ',"z":"' || o_orderstatus || '"}' AS json FROM orders""")
def canonical_json(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    given = F.to_json(F.struct(F.col("o_orderstatus").alias("z"), F.col("o_orderkey").cast("double").alias("a")))
    return o.select(F.col("o_orderkey").alias("id"), tx.canonical_json(given).alias("json"))


BODY = """b AS (SELECT id, upstream_model, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END AS max_tokens, id % 2 = 0 AS streams, id % 4 AS effort FROM captures)"""


def _bodies(spark, sf_dir) -> DataFrame:
    """(id, body): requests with fields of the key, of the context, and of neither."""
    k = F.col("id")
    body = F.struct(
        F.when(k % 4 > 0, (k % 4).cast("string")).alias("reasoning"), F.when(k % 3 != 0, (k % 5).cast("double")).alias("max_tokens"), (k % 2 == 0).alias("stream"),
        F.col("upstream_model").alias("model"), F.array(F.struct(F.lit("hi").alias("content"), F.lit("user").alias("role"))).alias("messages"),
        F.lit(0.0).alias("temperature"), F.lit(0.5).alias("top_p"), F.lit("END").alias("stop"), F.lit("me").alias("user"),
    )
    return captures(spark, sf_dir).select("id", F.to_json(body).alias("body"))


@query("request_key", f"""WITH {LOADED}, {BODY} SELECT id, sha256('{{"max_tokens":' || coalesce(CAST(max_tokens AS VARCHAR), 'null') || ',"messages":[{{"content":"hi","role":"user"}}],"model":"' || upstream_model
    || '","response_format":null,"seed":null,"stop":"END","temperature":0,"top_p":0.5}}') AS key FROM b""")
def request_key(spark, sf_dir):
    return _bodies(spark, sf_dir).select("id", tx.request_key("body").alias("key"))


@query("request_context", f"""WITH {LOADED}, {BODY} SELECT id, sha256(CASE WHEN max_tokens IS NULL THEN '{{"body":' ELSE '' END || CASE WHEN effort > 0 THEN '{{"reasoning":"' || CAST(effort AS VARCHAR) || '"}}' ELSE '{{}}' END
    || CASE WHEN max_tokens IS NULL THEN ',"max_tokens_default":4096}}' ELSE '' END) AS context FROM b""")
def request_context(spark, sf_dir):
    default = F.when(F.get_json_object("body", "$.max_tokens").isNull(), 4096)
    return _bodies(spark, sf_dir).select("id", tx.request_context(F.col("body"), default).alias("context"))


@query("meta_get", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.a.b') AS none FROM events""")
def meta_get(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.a.b").alias("none"))


PROPS = "json_extract_string(props, '$.k')"


@query("meta_keys", "SELECT event_id, 'k' AS keys FROM events")
def meta_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("keys"))


@query("meta_set", f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{{"a":{{"b":"' || event_type || '"}},"k":' || {PROPS} || '}}' ELSE '{{"k":{{"b":"' || event_type || '"}}}}' END AS props FROM events""")
def meta_set(spark, sf_dir):
    """A value at a dotted path; what stands in the way and is no object is replaced."""
    e = table(spark, sf_dir, "events")
    path = F.when(F.col("event_id") % 2 == 0, "a.b").otherwise("k.b")
    return e.select("event_id", tx.meta_set(F.col("props"), path, F.to_json(F.struct(F.col("event_type").alias("v")))).alias("props"))


@query("meta_pop", f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{{}}' ELSE '{{"k":' || {PROPS} || '}}' END AS props, CASE WHEN event_id % 3 = 0 THEN {PROPS} END AS value FROM events""")
def meta_pop(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.when(F.col("event_id") % 3 == 0, "k").when(F.col("event_id") % 3 == 1, "a.b").otherwise("k.b")
    return e.select("event_id", tx.meta_pop(F.col("props"), path).alias("p")).select("event_id", "p.props", "p.value")


# Personal data.
# Orders as examples with planted data: the teacher's contact must hold an '@' and the gold's note is short, so that some placeholders break them.
PII_SCHEMA = {
    "type": "object", "required": ["status"], "additionalProperties": False,
    "properties": {
        "status": {"enum": ["F", "O", "P"]}, "contact": {"type": ["string", "null"], "pattern": "@|none"}, "notes": {"type": "array", "items": {"type": "string"}},
        "host": {"type": "string", "pattern": "^[0-9.]+$"},
    },
}


def _orders_as_examples(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    plain = lambda n, s: F.when(k % n == 0, s)
    said = F.concat_ws(
        " ", F.lit("Order"), k.cast("string"), plain(5, F.concat(F.lit("by user"), (k % 9).cast("string"), F.lit("@example.org"))), plain(7, F.lit("call +44 20 7946 0958")),
        plain(11, F.lit("paid with 4111 1111 1111 1111")), plain(13, F.lit("from 192.0.2.7 and 192.0.2.8")), plain(17, F.lit("GB82 WEST 1234 5698 7654 32")), plain(19, F.lit("ssn 123-45-6789")),
    )
    contact = F.when(k % 10 == 0, "jane@example.org").when(k % 10 == 1, "none")
    teacher = F.struct(F.col("o_orderstatus").alias("status"), contact.alias("contact"), F.array(F.coalesce(plain(4, F.lit("tel 555-0142, 555-0143")), F.lit("ok"))).alias("notes"))
    gold = F.struct(F.col("o_orderstatus").alias("status"), F.coalesce(plain(6, F.lit("203.0.113.9")), F.lit("1.2")).alias("host"), F.array(F.coalesce(plain(9, F.lit("123-45-6789")), F.lit("-"))).alias("notes"))
    x = table(spark, sf_dir, "orders").select(k.alias("id"), said.alias("input"), F.to_json(teacher).alias("teacher"), F.when(k % 3 == 0, F.to_json(gold)).alias("gold"))
    return x


_PLANTED = {
    "input": {"email": ("k % 5", 1), "phone": ("k % 7", 1), "card": ("k % 11", 1), "ipv4": ("k % 13", 2), "iban": ("k % 17", 1), "ssn": ("k % 19", 1)},
    "teacher": {"email": ("k % 10", 1), "phone": ("k % 4", 2)}, "gold": {"ipv4": ("k % 6", 1), "ssn": ("k % 9", 1)},
}
PII_SQL = f"""WITH o AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT {', '.join(
    f"{n} * count(*) FILTER ({c} = 0) AS {role}_{kind}" for role, kinds in _PLANTED.items() for kind, (c, n) in kinds.items()
)}, count(*) FILTER ({' OR '.join(f'{c} = 0' for kinds in _PLANTED.values() for c, _ in kinds.values())}) AS examples_changed, count(*) FILTER (k % 10 = 0) AS rejected, count(*) FILTER (k % 6 = 0) AS gold_cleared FROM o),
u AS (UNPIVOT (SELECT COLUMNS(*)::BIGINT FROM c) ON COLUMNS(*) INTO NAME counter VALUE n)
SELECT counter, n FROM u UNION ALL SELECT role || '_' || kind, 0 FROM (VALUES ('input'), ('teacher'), ('gold')) r(role), (VALUES {', '.join(f"('{k}')" for k in pii.KINDS)}) q(kind) WHERE role || '_' || kind NOT IN (SELECT counter FROM u)
UNION ALL SELECT 'broken teacher contact: email', count(*) FILTER (k % 10 = 0) FROM o UNION ALL SELECT 'broken gold host: ipv4', count(*) FILTER (k % 6 = 0) FROM o"""


@query("pii_stage", PII_SQL)
def pii_stage(spark, sf_dir):
    """Hits by role and kind, examples changed, answers that no longer fit their schema, and the fields and kinds to blame."""
    r = curation.Run(curation.Task(schema=PII_SCHEMA), spark)
    examples = r.take(_orders_as_examples(spark, sf_dir), "orders")
    done = r.keep("pii", stage.scrub_examples(examples, PII_SCHEMA), **stage.counters())
    counts = spark.createDataFrame([(k, n) for k, n in r.counters["pii"].items() if k != "rows"], "counter string, n long")
    b = stage.blame(done)
    why = F.concat(F.lit("broken "), F.col("role"), F.lit(" "), F.col("field"), F.lit(": "), F.array_join("kinds", ", "))
    b = b.select("field", "kinds", F.inline(F.array(*[F.struct(F.lit(x).alias("role"), F.col(x).alias("n")) for x in ("teacher", "gold")]))).filter("n > 0")
    blamed = [tuple(x) for x in b.select(why.alias("counter"), "n").collect()]  # as many as the schema has fields, twice
    return counts.union(spark.createDataFrame(blamed, "counter string, n long"))


@query("pii_documents")
def pii_documents(spark, sf_dir):
    """Hits by kind in the documents, and how many documents have any."""
    d = docs(spark, sf_dir).select("text").filter(pii.may_hold("text"))
    s = d.select(pii.scrub("text").alias("s"))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s.{k}").alias("n")) for k in pii.KINDS])
    every = spark.createDataFrame([(k,) for k in pii.KINDS], "kind string")
    got = s.select(F.inline(rows)).groupBy("kind").agg(F.sum("n").alias("hits"), F.count_if(F.col("n") > 0).alias("docs"))
    return every.join(got, "kind", "left").select("kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "docs")])


for _kind in pii.KINDS:

    @query(f"pii_{_kind}")
    def _pii(spark, sf_dir, kind=_kind):
        s = docs(spark, sf_dir).filter(pii.may_hold("text")).select("doc_id", pii.scrub("text").alias("s"))
        return s.select("doc_id", F.col(f"s.{kind}").alias("n")).filter("n > 0")


@query("pii_scrub_value")
def pii_scrub_value(spark, sf_dir):
    s = docs(spark, sf_dir).select("doc_id", F.to_json(F.struct("text", F.array("source").alias("tags"))).alias("j"))
    return s.select("doc_id", F.sha2(pii.scrub_json("j"), 256).alias("scrubbed"))


# Lengths and the stages together.
TOKENS = r"CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT)"


@query("length_filter", f"SELECT doc_id FROM documents WHERE {TOKENS} <= 500")
def length_filter(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.regexp_count("text", F.lit(r"[^\s]+")) <= 500).select("doc_id")


@query("length_stats", f"SELECT {SPLIT} AS split, round(quantile_cont(t::DOUBLE, 0.5), 1) AS p50, round(quantile_cont(t::DOUBLE, 0.95), 1) AS p95, max(t) AS longest FROM (SELECT doc_id, {TOKENS} AS t FROM documents) GROUP BY 1")
def length_stats(spark, sf_dir):
    d = _split(docs(spark, sf_dir)).withColumn("t", F.regexp_count("text", F.lit(r"[^\s]+")).cast("long"))
    p = d.groupBy("split").agg(*metrics.percentiles("t", 0.5, 0.95), F.max("t").alias("longest"))
    return p.select("split", R("p50", 1).alias("p50"), R("p95", 1).alias("p95"), "longest")


def _run_records(spark, sf_dir) -> DataFrame:
    """Captured and imported rows as a run takes them: seq orders imports before captures."""
    r = _records(spark, sf_dir).withColumns({"split": votes.canonical_split("split"), "h": F.sha2(tx.normalise("input"), 256)})
    seq = F.when(F.col("origin") == "import", F.col("id")).otherwise(F.col("id") + 1000000000)
    return r.select(seq.alias("seq"), "h", "input", "output", "gold", "split", "result")


TASK = curation.Task(labels=("0", "1"))


def _run(spark, sf_dir) -> curation.Run:
    recorded = table(spark, sf_dir, "labels").filter("doc_id % 6 <> 0 AND doc_id % 13 <> 0")  # as in label_examples
    recorded = recorded.select(F.col("doc_id").alias("seq"), F.col("quality").cast("string").alias("answer"))
    return curation.run(_run_records(spark, sf_dir), TASK, recorded)


def _size_rows(spark, r: curation.Run) -> DataFrame:
    return spark.createDataFrame(curation.stage_sizes(r), "stage int, name string, split string, n long")


HEAD = f"""{GOOD}, e AS (SELECT h, min(seq) AS seq, count(output) = 0 AS pending, max(CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 WHEN 'test' THEN 3 ELSE 0 END) AS rank FROM g GROUP BY h),
tv AS (SELECT h, output, count(*) AS v FROM g WHERE output IN ('0', '1') GROUP BY ALL), tm AS (SELECT h, max(v) * 2 > sum(v) AS won FROM tv GROUP BY h),
voted AS (SELECT e.*, e.rank = 3 AS test FROM e LEFT JOIN tm USING (h) WHERE pending OR coalesce(won, false) OR rank = 3),
free AS (SELECT h, {CUT} FROM (SELECT h, row_number() OVER (ORDER BY {ORDER.replace('KIND', 'random').replace('CAST(doc_id AS VARCHAR)', 'h')}, h) AS r, count(*) OVER () AS n FROM voted WHERE rank = 0)),
assigned AS (SELECT coalesce(['train', 'valid', 'test'][rank], free.split) AS split FROM voted LEFT JOIN free USING (h))"""


@query("stage_counters_to_split", f"""WITH {HEAD} SELECT 1 AS stage, 'load' AS name, NULL AS split, count(*) AS n FROM records UNION ALL SELECT 2, 'extract', NULL, count(*) FROM records WHERE result = 'ok'
UNION ALL SELECT 3, 'merge', NULL, count(*) FROM e UNION ALL SELECT 4, 'vote', NULL, count(*) FROM voted UNION ALL SELECT 5, 'pii', NULL, count(*) FROM voted
UNION ALL SELECT 6, 'split', s, count(a.split) FROM (VALUES ('train'), ('valid'), ('test')) v(s) LEFT JOIN assigned a ON a.split = s GROUP BY s""")
def stage_counters_to_split(spark, sf_dir):
    """The stages up to the split, whose rows SQL can state; the later ones work on scrubbed texts."""
    return _size_rows(spark, _run(spark, sf_dir)).filter("stage <= 6")


@query("stage_counters")
def stage_counters(spark, sf_dir):
    """Rows after each stage of a curation run and in each split, counted as the stages are written."""
    return _size_rows(spark, _run(spark, sf_dir))


@query("run_counters")
def run_counters(spark, sf_dir):
    """Every counter of a curation run: (stage, counter, n)."""
    rows = [(s, k, n) for s, c in _run(spark, sf_dir).counters.items() for k, n in c.items()]
    return spark.createDataFrame(rows, "stage string, counter string, n long")


@query("curate_run")
def curate_run(spark, sf_dir):
    """A run that writes: what is read back from its files, whose rows and checksums are those of its report."""
    path = f"{shared_dir(spark)}/curated-{uuid.uuid4().hex}"
    report = curation.write(_run(spark, sf_dir), path)
    told = spark.createDataFrame([(f["split"], f["rows"]) for f in report["files"]], "split string, n long").groupBy("split").agg(F.sum("n").alias("reported"))
    rows = spark.read.schema("input_hash string, text string, teacher string, gold string, split string").json(path)
    rows = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("input_hash").alias("hashes"), F.count("teacher").alias("teachers"), F.count("gold").alias("golds"))
    return rows.join(told, "split")


EMPTIED_BY = {
    "split": "no row was assigned to it", "dedupe": "dedupe within splits removed every row",
    "cross_split": "every row duplicates a row of a more protected split", "label": "every row's teacher answer was missing or invalid",
    "length": "every row is longer than 500 tokens",
}


def _emptied(sizes: DataFrame) -> DataFrame:
    reason = F.create_map(*[F.lit(x) for kv in EMPTIED_BY.items() for x in kv])
    of = sizes.filter(F.col("name").isin(*EMPTIED_BY)).groupBy("split").agg(F.min(F.when(F.col("n") == 0, F.struct("stage", "name"))).alias("f"))
    return of.select("split", F.col("f.stage").alias("stage"), F.col("f.name").alias("name"), F.element_at(reason, F.col("f.name")).alias("reason"))


@query("emptied_at")
def emptied_at(spark, sf_dir):
    """The first stage after which a split is empty, and why; nulls for a split with rows at the end."""
    return _emptied(_size_rows(spark, _run(spark, sf_dir)))
