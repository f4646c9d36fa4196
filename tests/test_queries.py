"""Every query with SQL gives its SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from gristmill import registry

registry.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Kept short: those that touch each module.
NAMES = (
    "threshold_curve", "choose_threshold", "macro_f1_curve", "macro_f1", "per_trait_breakdown", "extraction_scores", "reliability_bins", "auroc",
    "wilson_interval", "isotonic_fit", "isotonic_apply", "isotonic_per_reference", "select_run", "near_dup_selfjoin", "connected_components", "resolve_cluster", "cross_split_match", "leakage_check",
    "extract_records", "majority_vote", "merge_meta_first_wins", "repeats", "normalise_examples", "split_random", "split_stratified", "assign_splits",
    "normalise_label", "validate_schema", "canonical_json", "completion_problem", "ledger_summary", "ledger_reserve", "price_lookup", "teacher_lookup",
    "served_report", "drift_check", "prom_counters", "cost_latency", "break_even", "bakeoff_select", "compare_reports", "stateful_budget",
)


def value(v):
    if isinstance(v, float):
        return "inf" if v == float("inf") else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return str([value(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    r = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted([value(row[c]) for c in sorted(names)] for row in df.collect())
    want = sorted([value(dict(zip(names, row))[c]) for c in sorted(names)] for row in r.fetchall())
    assert got == want


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert os.path.isdir(DATA)
