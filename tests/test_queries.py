"""A query of each section against its SQL on the smallest tables; the driver compares all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHOSEN = ("flagship", "w2_resolve_facts", "w13_rank_reviews", "a7_distribution", "a19_check_summary", "a23_fingerprint", "j2_resolve_entities", "j7_near_join", "j8_knn_join", "j10_pip_join", "j16_fuzzy_join", "g5_shortest_path", "g7_closure", "g9_canonicalize", "g13_evidence_closed", "p1_encode_value", "p20_quantities", "c1_four_state", "c15_membership", "u4_merge_candidates", "o2_relative_topk", "t1_lexical_search", "t3_phrase_recall", "r7_policy_score", "r9_recall_candidates", "r9_recall_channels", "q3_quarantine", "s8_read_geojson", "st1_event_log", "st2_merge_deltas")


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name, tmp_path):
    out = str(tmp_path / "out")
    entry.queries()[name](spark, SF).write.parquet(out)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    con.execute(f"CREATE TABLE a AS SELECT * FROM '{out}/*.parquet'")
    con.execute(f"CREATE TABLE b AS {entry.oracle_sql()[name]}")
    columns = [r[0] for r in con.execute("DESCRIBE a").fetchall()]
    assert sorted(columns) == sorted(r[0] for r in con.execute("DESCRIBE b").fetchall())
    cols = ", ".join(f'"{c}"' for c in columns)
    for x, y in ("ab", "ba"):
        assert con.execute(f"SELECT {cols} FROM {x} EXCEPT ALL SELECT {cols} FROM {y}").fetchall() == []


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
