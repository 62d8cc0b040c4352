"""Registered queries against their SQL twins on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import TABLES, rows_of  # noqa: E402

SAMPLE = [
    "r01_hybrid_search", "r04_bm25_lines", "r05_keyword_only", "a07_withheld_counts", "r14_disclosure_apply", "r16_admissibility",
    "r18_record_rendering", "r20_action_check", "s03_doc_upsert", "q02_index_currency", "g02_promotion_gate", "g05_near_duplicate_groups",
    "h03_retrieve", "h06_name_resolution", "q01_open_claims", "w10_best_window", "x01_stream_corpus", "x04_stream_staleness",
    "g05_leader_clusters", "z04_merge_candidates", "w12_request_limiter", "r24_batch_embedding", "sql_note_functions", "sql_chunk_notes", "g03_promote",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
