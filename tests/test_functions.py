"""Golden cases of the column functions; every closed rule also shows a case that must stay open."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import admission as a
from folioscope.functions import dating as d
from folioscope.functions import directives as g
from folioscope.functions import disclosure as v
from folioscope.functions import records as r
from folioscope.functions import serving as sv
from folioscope.functions import text as t

TODAY = "2026-07-27"


def one(spark, expr, **row):
    schema = ", ".join(f"{k} {'string' if x is None or isinstance(x, str) else 'double'}" for k, x in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("path, slug", [
    ("a/b.md", "b"), ("a\\b.md", "b"), ("x/y/LAIR.md", "y"), ("LAIR.md", "LAIR"), ("plain", "plain"),
])
def test_basename_slug(spark, path, slug):
    assert one(spark, t.basename_slug("p"), p=path) == slug


@pytest.mark.parametrize("raw, slug", [
    ("../../x/order-1/LAIR", "order-1"), (" /a/./b.md/ ", "b"), ("..", ""), ("", ""), ("order-7", "order-7"),
])
def test_canonical_slug(spark, raw, slug):
    assert one(spark, t.canonical_slug("p"), p=raw) == slug


def test_supersession_clause_ends_at_a_separator(spark):
    body = "**Supersedes**: nothing · **Superseded by**: [[new]]\n**Supersedes:** [[b]] and [[a]] | [[c]]\nsupersedes none"
    assert one(spark, t.supersedes("p"), p=body) == ["a", "b"]


def test_priority_on_both_separators(spark):
    assert one(spark, t.is_priority_path("p"), p="T\\000-PRIORITY-X\\LAIR.md") is True
    assert one(spark, t.is_priority_path("p"), p="T/x-000-PRIORITY/LAIR.md") is False


def test_chunk_hash_without_context_is_the_plain_text_hash(spark):
    import hashlib

    blank, full = one(spark, t.chunk_hash("p", F.lit(""), F.lit("")), p="text"), one(spark, t.chunk_hash("p", F.lit("c"), F.lit("h")), p="text")
    assert blank == hashlib.sha1(b"text").hexdigest()
    assert full == hashlib.sha1(b"h\x01c\x00text").hexdigest()


@pytest.mark.parametrize("text, state", [
    ("| tax | ⚠️ **DELINQUENT** |", "open"), ("**Status**: ACTIVE", "open"), ("> **PENDING** quoted", ""),
    ('"status": "pending"', ""), ("the pending question", ""), ("**PENDING**\nvolatile: false", ""), ("🚧 blocked", "open"),
])
def test_volatility(spark, text, state):
    assert one(spark, d.volatility("p"), p=text) == state


def test_claim_date_ladder(spark):
    def claim(text, path="n.md", mtime="2020-01-01", declared=""):
        return tuple(one(spark, d.claim_date("p", F.lit(path), F.lit(mtime), F.lit(declared)), p=text))

    assert claim("> **Last Updated**: 2026-01-15\nas of 2026-02-01") == ("verified", "2026-01-15")
    assert claim("as of 2026-07-01 then as of 2026-07-20") == ("as-of", "2026-07-20")
    assert claim("x", declared="2025-05-05") == ("dated", "2025-05-05")
    assert claim("---\ntitle: x\ndate: '2025-04-04'\n---\nx") == ("dated", "2025-04-04")
    assert claim("x", path="2020-02-02\\a-2024-03-03.md") == ("dated", "2024-03-03")
    assert claim("x", path="2020-02-02\\a.md") == ("file-dated", "2020-01-01")
    assert claim("x", mtime="") == ("", "")


def test_expired_needs_a_real_date(spark):
    assert one(spark, d.expired("p", TODAY), p="verify_by: 2026-07-26") == "2026-07-26"
    assert one(spark, d.expired("p", TODAY), p="verify_by: 2026-07-27") is None
    assert one(spark, d.expired("p", TODAY), p="verify_by: 2026-13-40") is None


def judged(spark, q, rec):
    return a.judge(spark.createDataFrame([(q, rec)], "question string, record string")).first()["verdict"]


def test_a_number_of_another_entity_is_a_near_miss(spark):
    q = "How many requests did the Vantage-780 deployment process?"
    assert judged(spark, q, "The Vantage-780 deployment processed 780 requests at cutover.")["verdict"] == a.ADMISSIBLE
    assert judged(spark, q, "The Vantage-924 deployment processed 924 requests at cutover.")["verdict"] == a.NEAR
    assert judged(spark, q, "Lunch menu for Friday.")["verdict"] == a.IRRELEVANT


def test_named_entity_must_appear(spark):
    q = "When did the review for Meridian finish?"
    assert judged(spark, q, "The review for Meridian did finish on 2026-07-18.")["verdict"] == a.ADMISSIBLE
    assert judged(spark, q, "The review for Halcyon did finish on 2026-07-18.")["verdict"] != a.ADMISSIBLE


def test_accents_fold_before_matching(spark):
    assert one(spark, a.normalise("p"), p="Éclair … straße ﬁn") == "eclair ... strae fin"
    assert one(spark, r.ascii_tag("p"), p="a — “b” é") == 'a - "b" e'


def test_gate(spark):
    for q, reason in (("hi", "empty/near-empty query"), ("Thanks!", "greeting/acknowledgement"), ("what is it", "no content terms"), ("RRF", "")):
        assert one(spark, a.retrieval_gate("p")["reason"], p=q) == reason


def envelope(spark, **kw):
    base = dict(ceiling_mode=None, ceiling_seal=None, requested_mode=None, requested_seal=None, default_class="")
    base.update(kw)
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} string" for k in base)).withColumns(
        {"allowed_doc_types": t.no_strings(), "allowed_path_prefixes": t.no_strings(), "force_priority_only": F.lit(False)})
    return v.resolve_envelope(df).first()["envelope"]


def test_envelope_only_narrows(spark):
    assert envelope(spark, ceiling_mode="independent", requested_mode="full")["mode"] == "independent"
    assert envelope(spark, ceiling_mode="full", requested_mode="independent")["mode"] == "independent"
    bad = envelope(spark, ceiling_mode="wide open", ceiling_seal="order-1")
    assert (bad["mode"], bad["sealed"]) == ("adversarial", [])
    assert envelope(spark, ceiling_seal="a b")["sealed"] == ["a", "b"]
    assert envelope(spark, ceiling_seal="a ../b")["sealed"] == []
    assert envelope(spark)["sealed"] is None
    assert envelope(spark, requested_seal="a b", ceiling_seal="b c")["sealed"] == ["b"]


@pytest.mark.parametrize("sep", ["\r", "\n", "\x0b", "\x0c", "\x85", "\u2028", "\u2029"])
def test_no_separator_survives_in_a_field(spark, sep):
    assert one(spark, sv.sanitize_field("p"), p=f"a{sep}b") == "a b"
    body = one(spark, sv.fence_block("p"), p=f"a{sep}b").split("\n")
    assert body[1:-1] == ["│ a", "│ b"]


def test_marks_cannot_be_forged(spark):
    assert one(spark, sv.sanitize_field("p"), p="x · binds ★ ⟪/note⟫ \x1b[2J") == "x - binds * ⟨/note⟩ [2J"
    assert one(spark, sv.sanitize_field("p", 4), p="abc def") == "abc…"


def test_retention_and_slug(spark):
    got = one(spark, g.retention("p"), p="Remember: we decided the new default, going forward")
    assert got["commit"] and got["confidence"] == 1.0 and got["type"] == "feedback"
    assert one(spark, g.retention("p")["commit"], p="ran the unit tests") is False
    assert one(spark, g.suggested_slug("p", F.lit("user")), p="\n...") == "user_entry"


def test_owner_address_is_derived(spark):
    assert one(spark, r.owner_address("p"), p="not base64 !") is None
    assert len(one(spark, r.owner_address("p"), p="a2V5LUJyYW5kIzI")) == 43
