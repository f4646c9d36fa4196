"""Streaming queries, each run to the end of its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.registry import query
from gristmill.streaming import served as st


@query("served_stream", "SELECT event_id, event_type FROM events")
def served_stream(spark, sf_dir):
    return st.run_to_end(st.deduplicated(st.events(spark, sf_dir), "event_id", "ts").select("event_id", "event_type"))


@query("served_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def served_windows(spark, sf_dir):
    return st.run_to_end(st.windowed_counts(st.events(spark, sf_dir), "event_type", "ts"), "complete")


@query("stateful_budget", """WITH RECURSIVE o AS (SELECT event_id AS id, user_id, event_id % 50 + 1 AS need, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f(user_id, r, id, taken, accepted) AS (SELECT user_id, 1::BIGINT, id, CASE WHEN need <= 100 THEN need ELSE 0 END, need <= 100 FROM o WHERE r = 1
    UNION ALL SELECT o.user_id, o.r, o.id, f.taken + CASE WHEN f.taken + need <= 100 THEN need ELSE 0 END, f.taken + need <= 100 FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id AS key, id AS entry, accepted FROM f""")
def stateful_budget(spark, sf_dir):
    s = st.events(spark, sf_dir).withColumn("need", F.col("event_id") % 50 + 1)
    return st.run_to_end(st.admitted(s, "user_id", "event_id", "need", 100))
