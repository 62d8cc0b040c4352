import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from folioscope.llm import registered
from folioscope.llm.common import stored

from .helpers import DOCS, awkward


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = awkward(spark).withColumns({c: F.lit("x") for c in ("spot", "doc", "fp", "row", "words", "score", "values")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = stored(out, "test")
    kept = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    assert kept == [1, 6, 7, 9]


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_pipeline_keeps_what_it_should(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"] for r in rows}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    leaking = {r[0] for r in con.execute(registered.ORACLES["op6_decontamination"]).fetchall()}
    copies = {r[0] for r in con.execute("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1").fetchall()}
    clean = {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()} - leaking - copies
    assert leaking and copies and not kept & (leaking | copies)
    assert len(clean - kept) <= 0.02 * len(clean)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(max(o + n for o, n in parts) == sum(n for _, n in parts) <= 2048 for parts in by_sequence.values())


def test_sql_twins(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in registered.ORACLES.items():
        df = registered.QUERIES[name](spark, sf)
        cur = con.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(columns)
        assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, cur.fetchall())), name
