"""The SQL functions give what the column functions give."""

import itertools

import pytest
from pyspark.sql import functions as F

from folioscope.functions import dating as d
from folioscope.functions import sqlfunctions
from folioscope.functions import text as t
from folioscope.functions.disclosure import disclosure_class
from folioscope.operators import chunking as ch

PATHS = ["a/b.md", "a\\LAIR.md", "LAIR.md", "", "x/_archive/2024-05-06-y.md", "abstraction_z.md", "p/Abstraction-q.md", "abstraction-q.md", "it's.md.md", "/", None]
TEXTS = [
    "", None, "**Last Updated**: 2024-01-02\n| ⚠ PENDING | x", "as of 2023-03-04, As Of 2024-03-04\n**Status**: Active", "---\ndate: '2022-02-02'\n---\n** BLOCKED ** by it",
    "volatile: no\n**Status**: blocked", "verify_by: 2020-01-01\nfine", "verify_by: 2020-13-01\n❌ overdue", "> ⚠ PENDING\n\"x\": ⚠ TBD\n// ⚠ WIP", "| in  progress |\r\nplain",
]


@pytest.fixture(scope="module")
def registered(spark):
    sqlfunctions.register(spark)
    sqlfunctions.register(spark)  # a second time replaces them
    return spark


def test_paths_and_classes(registered):
    rows = [(p, k, c, s) for p in PATHS for k in ("abstraction ", "note", None) for c in (" Private\n", "secret", None) for s in ("draft", "promoted", "", None)]
    df = registered.createDataFrame(rows, "path string, kind string, declared string, state string")
    both = registered.sql("""SELECT *, basename_slug(path) AS s1, canonical_slug(path) AS s2, is_abstraction_note(kind, path) AS s3,
        disclosure_class(declared, state, 'artifact', kind, path) AS s4 FROM {df}""", df=df).select(
        "s1", "s2", "s3", "s4", t.basename_slug("path").alias("c1"), t.canonical_slug("path").alias("c2"), t.is_abstraction("kind", "path").alias("c3"),
        disclosure_class("declared", "state", F.lit("artifact"), "kind", "path").alias("c4"))
    got = both.collect()
    assert len(got) == len(rows) and all((r.s1, r.s2, r.s3, r.s4) == (r.c1, r.c2, r.c3, r.c4) for r in got)
    assert {r.s4 for r in got} == {"private", "artifact", "proposal"}


def test_dates_and_markers(registered):
    rows = list(itertools.product(TEXTS, PATHS, ("note", "abstraction"), ("2021-05-05", "soon", None)))
    df = registered.createDataFrame(rows, "text string, path string, kind string, declared string")
    got = registered.sql("""SELECT *, claim_date(text, path, '2019-09-09', declared) AS s1,
        stale_marker(text, path, kind, declared, DATE'2024-06-01') AS s2 FROM {df}""", df=df).select(
        "s1", "s2", d.claim_date("text", "path", F.lit("2019-09-09"), "declared").alias("c1"),
        d.stale_marker("text", F.lit(""), "path", "kind", F.lit(0.0), "declared", "2024-06-01").alias("c2")).collect()
    assert len(got) == len(rows) and [r for r in got if (r.s1, r.s2) != (r.c1, r.c2)] == []
    assert {"verified", "as-of", "dated", "file-dated"} <= {r.s1.label for r in got if r.s1} and len({r.s2 for r in got}) > 5


def test_functions_stay_in_the_jvm(registered):
    df = registered.createDataFrame([("a", "b")], "text string, path string")
    plan = registered.sql("SELECT claim_date(text, path, '', '') AS c, stale_marker(text, path, '', '', DATE'2024-01-01') AS m FROM {df}", df=df)
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown.replace("ArrowEvalPython", "Python") and "claim_date(" not in shown


def test_chunks_of_a_table_function(registered):
    body = "# One\n" + "word and word\n" * 90 + "## Two\n| a | b |\n|---|---|\n" + "".join(f"| {i} | x |\n" for i in range(80))
    df = registered.createDataFrame([("n.md", body, ""), ("e.md", "", "")], "rel_path string, body string, context string")
    cols = ["rel_path", "chunk_idx", "text", "token_count", "heading_path"]
    want = ch.chunk_documents(df).select(*cols).collect()
    got = registered.sql("SELECT n.rel_path, c.* FROM {n} n, LATERAL chunk_note(n.body, 512, 64) c", n=df).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 2
    assert registered.sql("SELECT * FROM chunk_note(CAST(NULL AS STRING), 512, 64)").count() == 0
