"""What a query computes once, sorts once, or holds at once."""

import numpy as np
import pandas as pd
import pytest

from folioscope.functions import admission as adm
from folioscope.functions import dating as d
from folioscope.functions import records as r
from folioscope.functions import serving as fs
from folioscope.operators import cluster as cl
from folioscope.operators import serving as sv
from folioscope.plans import q_serve, q_state

OPEN = "| tax | \u26a0\ufe0f **DELINQUENT** |"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_is_cut_into_lines_once(spark):
    """every rule used to cut the page again, for itself and for each trim of its fence."""
    pages = spark.createDataFrame([("```\n# A\n**Status**: ACTIVE\n**Priority**: LOW\n**Last Updated**: 2001-01-01\n## Current State\n## Related Lairs\n```\n",), ("",), (None,)], "text string")
    got = pages.select(r.structure_violations("text").alias("codes"))
    assert plan(got).count("split(") == 1
    assert [x.codes for x in got.collect()] == [
        [], ["no-title", "bad-status", "bad-priority", "bad-updated", "no-current-state", "no-related"], ["no-title"]]


def files(spark):
    rows = [(f"a/n{i}.md", f"{OPEN}\nas of 2001-0{1 + i % 7}-01\n**BLOCKED**  by\ttax" if i % 3 else "nothing", 9.0e8) for i in range(60)]
    return spark.createDataFrame(rows, "rel_path string, text string, mtime double")


def test_the_list_of_all_open_claims_finds_them_once(spark):
    """F8: a whole order samples its input first, which ran the audit twice."""
    out = q_state.stale_list(q_state.audit(files(spark), "2001-08-02")[1])
    assert "split(" not in plan(out) and "RLIKE" not in plan(out).upper()
    got = [tuple(x) for x in out.collect()]
    assert len(got) == 40 and got == sorted(got, key=lambda x: (-x[1], x[0]))
    assert {x[2] for x in got} == {f"{OPEN} / **BLOCKED** by tax"}


def test_an_audit_finds_only_what_its_result_needs(spark):
    """lines were cut for the shown claims again, and dates sought in texts without open claims."""
    decidable, ranked, blind = map(plan, q_state.audit(files(spark), "2001-08-02"))
    assert "verify_by" in decidable and "verify_by" not in ranked + blind
    assert "DELINQUENT" not in decidable + blind
    assert ranked.count("filter(") == 1
    assert ranked.index("Last Updated") < ranked.index("volatility#")  # above the filter, so after it


@pytest.mark.parametrize("text, lines", [
    ("**PENDING**\r\n> **PENDING**\r| a | WIP |\x0bx **LAPSED**", ["**PENDING**", "| a | WIP |", "x **LAPSED**"]),
    ("a\u2028**TBD**\x85 \u231b **WIP** ", ["**TBD**", "\u231b **WIP**"]), ("~**WIP**}", ["~**WIP**}"]),
    ("the pending question\n* TBD", []), ("", []), (None, None),
])
def test_open_lines_at_every_break(spark, text, lines):
    assert spark.createDataFrame([(text,)], "p string").select(d.open_claim_lines("p").alias("x")).first().x == lines


def test_blocks_are_compared_in_slabs():
    """a pair of blocks was held as whole matrices of doubles, twice."""
    draw = np.random.default_rng(1)
    a = pd.DataFrame({"embedding": list(draw.normal(size=(1200, 8)))})
    parts = list(cl._slabs(a, a))
    assert max(c.shape[0] for _, c in parts) <= cl.SLAB < 1200
    u = np.stack(a["embedding"]) / np.linalg.norm(np.stack(a["embedding"]), axis=1, keepdims=True)
    assert np.allclose(np.vstack([c for _, c in parts]), u @ u.T, atol=2e-9)


# ---- F2 to F6: the records served to every customer ---------------------------


def orders(spark, folder):
    """Order 3 comes under two customers of one segment and so under one path; customer 9 has no segment."""
    from datetime import datetime

    rows = [(k, c, "OPF"[k % 3], 10.0 * k, datetime(2000, 1, 1 + k % 28), "1-URGENT" if k % 5 == 0 else "3-MEDIUM")
            for k, c in [(1, 1), (2, 1), (3, 1), (3, 2), (4, 2), (5, 9), (6, 9), (30, 1), (38, 2), (35, 9)]]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, "BUILDING"), (2, "BUILDING"), (9, None)], "c_custkey long, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_hits_are_ranked_before_their_texts_are_made(spark, tmp_path, monkeypatch):
    """The texts went through five shuffles and a join of the notes with themselves."""
    folder = orders(spark, tmp_path)
    monkeypatch.setattr(q_serve, "written", lambda df, _: df)
    hits = q_serve.customer_hits(spark, folder)
    shown = plan(hits)
    assert shown.index("invoice recorded") < shown.index("Window")
    assert sorted((x.query_id, x.rank, x.slug) for x in hits.collect()) == [
        (1, 1, "order-1"), (1, 2, "order-2"), (1, 3, "order-3"), (1, 4, "order-3"), (1, 5, "order-30"),
        (2, 1, "order-3"), (2, 2, "order-3"), (2, 3, "order-4"), (2, 4, "order-38")]


def test_a_record_is_dated_once(spark):
    """Every kind of date was looked for at each place that named it."""
    where = ("text", "head", "path", "kind", "mtime", "declared")
    rows = [("as of 2001-01-02 **PENDING**, AS OF 2001-02-03", "", "a/b.md", "", 0.0, ""), ("**Last Updated**: 2001-01-01\n**Status**: blocked", None, "a", None, 9e8, "2000-01-01"),
            ("**PENDING**\nverify_by: 2001-01-01", "h", "_archive/a", "", 0.0, ""), ("**PENDING**\nverify_by: 2001-01-01", "h", "x-2001-01-01.md", "", 0.0, ""),
            ("x **TBD**", "---\ndate: 2000-05-05", "a", "abstraction", 86400.0, ""), ("x **TBD**", "---\ndate: 2000-05-05", "a", "", 86400.0, ""), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, head string, path string, kind string, mtime double, declared string")
    got = df.select(d.record_date(*where).alias("when"), d.stale_marker(*where, "2001-08-02").alias("marker"))
    assert plan(got).count("Last Updated") == 4 and plan(got).count("verify_by") == 1  # a guard and a search, in two results
    assert [(*x.when, x.marker) for x in got.collect()] == [
        ("as-of", "2001-02-03", "unverified 180d"), ("verified", "2001-01-01", "unverified 213d"), ("", "", ""), ("dated", "2001-01-01", "EXPIRED 2001-01-01"),
        ("generated", "1970-01-02", "unverified (no claim date)"), ("dated", "2000-05-05", "unverified 454d"), ("", "", "")]


def test_a_question_is_read_once_for_its_records(spark, monkeypatch):
    """Its terms were made and tried in the windows of every record, also those that the record does not hold."""
    import pyarrow as pa

    read, once = [], adm._question
    monkeypatch.setattr(adm, "_question", lambda *q: (read.append(q), once(*q))[1])
    asked, texts = ["How many units did the order-7 invoice record?", None], ["The order-7 invoice recorded 3 units.\x01Paid.", "Nothing.", None]
    rows = [(q, x, "" if q else None) for q in asked for x in texts]
    got = adm._matched(*(pa.array(c, pa.string()) for c in zip(*rows))).to_pylist()
    assert len(read) == 1
    assert [(x["n_spec"], x["cov"], round(x["over"], 3), x["anchor"], x["useful"]) for x in got] == [
        (1, 1.0, 0.75, True, [0, 1]), (1, 0.0, 0.0, True, []), (1, 0.0, 0.0, True, None), *[(None, 1.0, 0.0, None, [])] * 2, (None, 1.0, 0.0, None, None)]


@pytest.mark.parametrize("question, record, expected", [
    ("When is the Größe_B review due?", "The grosse b review is due 2001-05-05; more", ("INADMISSIBLE_NEAR", 1.0, 0.75, ["2001-05-05", "2001-05-05"])),
    ("How many sea-side huts?", "Sea side: 4 huts.\n5 huts sea-side\x01 6 huts", ("ADMISSIBLE", 1.0, 1.0, ["4", "5", "6"])),
    ("How many huts?", "4 huts", ("INADMISSIBLE_NEAR", 1.0, 1.0, [])), ("", "4 huts", ("INADMISSIBLE_NEAR", 1.0, 0.0, [])), (None, None, ("INADMISSIBLE_NEAR", 1.0, 0.0, None)), (None, "4 huts", ("INADMISSIBLE_NEAR", 1.0, 0.0, [])),
])
def test_verdicts_of_odd_questions(spark, question, record, expected):
    x = adm.judge(spark.createDataFrame([(question, record)], "question string, record string")).first()["verdict"]
    assert (x["verdict"], x["specific_coverage"], x["generic_overlap"], x["bound"]) == expected


def test_safe_texts_are_left_alone_and_others_made_safe(spark):
    texts = ["plain text", " a  b ", "tab\there", "x\u2028y", "a\rb", "a\x0eb", "\u27eanote\u27eb", "caf\u00e9 \u00b7 \u2605", "", None, "long " * 40]
    df = spark.createDataFrame([(x,) for x in texts], "p string")
    got = df.select(fs.sanitize_field("p", 30).alias("f"), fs.fence_block("p").alias("b")).collect()
    assert [x.f for x in got] == ["plain text", "a b", "tab here", "x y", "a b", "ab", "\u27e8note\u27e9", "caf\u00e9 - *", "", None, "long long long long long long\u2026"]
    inner = [x.b and x.b[len("\u27eanote\u27eb\n"):-len("\n\u27ea/note\u27eb")] for x in got]
    assert inner == ["\u2502 plain text", "\u2502  a  b ", "\u2502 tab\there", "\u2502 x\n\u2502 y", "\u2502 a\n\u2502 b", "\u2502 ab", "\u2502 \u27e8note\u27e9", "\u2502 caf\u00e9 \u00b7 \u2605", "\u2502 ", None, "\u2502 " + "long " * 40]
