"""Column functions over the derived notes and the given texts."""

from pyspark.sql import functions as F

from ..functions import admission as a
from ..functions import dating as d
from ..functions import directives as g
from ..functions import disclosure as v
from ..functions import grading
from ..functions import records as r
from ..functions import serving
from ..functions import text as t
from ..sources import notes as src
from .catalog import fan_out, query, table
from .oracle_views import (
    ISO, sql_archived, sql_canonical, sql_claim, sql_days, sql_expired, sql_is_abstraction, sql_iso, sql_norm,
    sql_open_lines, sql_record_date, sql_slug, sql_stale_marker, sql_terms_of, sql_volatility, with_views,
)

WIKI = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"


def _q(name, views, sql, fn):
    query(name, with_views(views, sql))(fn)


def _notes(*cols):
    return lambda s, p: src.notes(s, p).select("rel_path", *[c() if callable(c) else c for c in cols])


def joined(c):
    return F.array_join(c, "|")


_q("f01_basename_slug", ["notes"], f"SELECT rel_path, {sql_slug('rel_path')} AS slug FROM notes",
   _notes(lambda: t.basename_slug("rel_path").alias("slug")))

_q("f02_canonical_slug", ["links"], f"SELECT DISTINCT tgt_raw, {sql_canonical('tgt_raw')} AS slug FROM links",
   lambda s, p: src.links(src.notes(s, p)).select("tgt_raw", t.canonical_slug("tgt_raw").alias("slug")).distinct())

_q("f03_link_slug", ["links"],
   f"SELECT DISTINCT 'see [[' || tgt_raw || '|label]]' AS raw, {sql_canonical('tgt_raw')} AS slug FROM links",
   lambda s, p: src.links(src.notes(s, p))
   .select(F.concat(F.lit("see [["), "tgt_raw", F.lit("|label]]")).alias("raw")).distinct()
   .withColumn("slug", t.link_slug("raw")))

_q("f04_name_slug", ["notes"],
   f"SELECT rel_path, CASE WHEN k % 2 = 0 THEN 'named-' || k ELSE {sql_slug('rel_path')} END AS slug FROM notes",
   _notes(lambda: t.name_slug(F.when(F.col("k") % 2 == 0, F.concat(F.lit("named-"), F.col("k").cast("string"))).otherwise(F.lit("")), "rel_path").alias("slug")))

_q("f05_wikilinks", ["notes"],
   f"SELECT rel_path, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, '{WIKI}', 1), lambda x: trim(x)))), '|') AS links FROM notes",
   _notes(lambda: joined(F.array_sort(t.wikilinks("body"))).alias("links")))

_q("f06_supersedes", ["notes"],
   "SELECT rel_path, CASE WHEN k % 8 = 0 AND k >= 8 THEN 'order-' || (k - 8) ELSE '' END AS targets FROM notes",
   _notes(lambda: joined(t.supersedes("body")).alias("targets")))

_q("f07_title", ["notes"], "SELECT rel_path, 'Order ' || k AS title FROM notes",
   _notes(lambda: t.title(F.lit(""), "body", "rel_path").alias("title")))

_q("f08_is_priority", ["notes"],
   "SELECT rel_path, starts_with(rel_path, '000-PRIORITY') OR contains(rel_path, '/000-PRIORITY') AS is_priority FROM notes",
   _notes(lambda: t.is_priority_path("rel_path").alias("is_priority")))

_q("f09_declared_fields", ["docs"], "SELECT rel_path, doc_type, disclosure, evidence, claim_date FROM docs",
   lambda s, p: src.docs(s, p).select("rel_path", "doc_type", "disclosure", "evidence", "claim_date"))

_q("f10_doc_hash", ["notes"], "SELECT rel_path, sha1(body) AS doc_hash FROM notes",
   _notes(lambda: t.doc_hash("body").alias("doc_hash")))


def _context():
    return F.when(F.col("k") % 2 == 0, F.concat(F.lit("Order "), F.col("k").cast("string"))).otherwise(F.lit(""))


def _heading():
    return F.when(F.col("k") % 3 == 0, F.lit("Ledger")).otherwise(F.lit(""))


_SQL_CTX = "CASE WHEN k % 2 = 0 THEN 'Order ' || k ELSE '' END"
_SQL_HEAD = "CASE WHEN k % 3 = 0 THEN 'Ledger' ELSE '' END"

_q("f11_chunk_hash", ["notes"],
   "SELECT rel_path, sha1((CASE WHEN k % 3 = 0 THEN 'Ledger'::BLOB || '\\x01'::BLOB ELSE ''::BLOB END) || "
   "(CASE WHEN k % 2 = 0 THEN encode('Order ' || k) || '\\x00'::BLOB ELSE ''::BLOB END) || encode(body)) AS chunk_hash FROM notes",
   _notes(lambda: t.chunk_hash("body", _context(), _heading()).alias("chunk_hash")))

_q("f12_macro_context", ["notes"],
   "SELECT rel_path, 'Order ' || k || (CASE WHEN k % 2 = 0 THEN ' — ' || trim(doc_type || ' note') ELSE '' END) AS context FROM notes",
   _notes(lambda: t.macro_context(F.concat(F.lit(" Order "), F.col("k").cast("string")), F.when(
       F.col("k") % 2 == 0, F.concat("doc_type", F.lit(" note "))).otherwise(F.lit("  "))).alias("context")))

_q("f15_token_count", [], r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS tokens FROM documents",
   lambda s, p: table(s, p, "documents").select("doc_id", t.token_count("text").alias("tokens")))

_q("f18_normalize_claim_date", ["notes"],
   "SELECT rel_path, CASE WHEN k % 4 = 3 THEN '' ELSE iso END AS claim_date FROM notes",
   _notes(lambda: d.normalize_claim_date(
       F.when(F.col("k") % 4 == 0, F.col("day").cast("string"))
       .when(F.col("k") % 4 == 1, F.concat(F.lit(" '"), F.col("day").cast("string"), F.lit("' ")))
       .when(F.col("k") % 4 == 2, F.concat(F.col("day").cast("string"), F.lit("T10:00:00")))
       .otherwise(F.lit("soon"))).alias("claim_date")))


def _claim(**kw):
    def build():
        return d.claim_date("body", "rel_path", d.epoch_to_iso("mtime"), **kw)
    return build


_L, _D = sql_claim("body", "rel_path", sql_iso("mtime"), "claim_date")
_q("f19_claim_date", ["notes"], f"SELECT rel_path, {_L} AS label, {_D} AS claimed FROM notes",
   _notes(lambda: _claim(declared="claim_date")()["label"].alias("label"),
          lambda: _claim(declared="claim_date")()["date"].alias("claimed")))

_L, _D = sql_record_date("body", "rel_path", "doc_type", sql_slug("rel_path"), "mtime", "claim_date")
_q("f20_record_date", ["notes"], f"SELECT rel_path, {_L} AS label, {_D} AS dated FROM notes",
   lambda s, p: src.notes(s, p).select(
       "rel_path", d.record_date("body", F.lit(""), "rel_path", "doc_type", "mtime", "claim_date").alias("r"))
   .select("rel_path", "r.label", F.col("r.date").alias("dated")))

_q("f21_volatility", ["notes"], f"SELECT rel_path, {sql_volatility('body')} AS volatility FROM notes",
   _notes(lambda: d.volatility("body").alias("volatility")))

_q("f22_expired", ["notes"], f"SELECT rel_path, {sql_expired('body')} AS expired FROM notes",
   _notes(lambda: d.expired("body", src.TODAY).alias("expired")))

_q("f23_days_since", ["notes"], f"SELECT rel_path, {sql_days('claim_date')} AS days FROM notes",
   _notes(lambda: d.days_since("claim_date", src.TODAY).alias("days")))

_M = sql_stale_marker("body", "rel_path", "doc_type", sql_slug("rel_path"), "mtime", "claim_date")
_q("f24_stale_marker", ["notes"], f"SELECT rel_path, {_M} AS marker FROM notes",
   _notes(lambda: d.stale_marker("body", F.lit(""), "rel_path", "doc_type", "mtime", "claim_date", src.TODAY).alias("marker")))

_q("f25_normalise", [], f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents",
   lambda s, p: table(s, p, "documents").select("doc_id", a.normalise("text").alias("norm")))

_q("f26_terms", [], f"SELECT doc_id, array_to_string({sql_terms_of(sql_norm('text'))}, ' ') AS terms FROM documents",
   lambda s, p: table(s, p, "documents").select("doc_id", F.array_join(a.terms("text"), " ").alias("terms")))

_q("f27_specificity", [],
   f"SELECT doc_id, len(list_filter({sql_terms_of(sql_norm('text'))}, lambda w: regexp_matches(w, '[0-9]') OR contains(w, '-') OR contains(w, '/') "
   "OR length(w) >= 8)) AS specific FROM documents",
   lambda s, p: table(s, p, "documents").select("doc_id", F.size(F.filter(a.terms("text"), a.is_specific)).alias("specific")))


def _questions(s, p):
    """One question per order, in the three shapes the rules tell apart."""
    k = F.col("k").cast("string")
    return src.notes(s, p).select("k", F.when(F.col("k") % 4 == 0, F.concat(F.lit("How many units did the order-"), k, F.lit(" invoice record?")))
                                  .when(F.col("k") % 4 == 1, F.concat(F.lit("When was order-"), k, F.lit(" counted")))
                                  .when(F.col("k") % 4 == 2, F.concat(F.lit("latest status of order-"), k))
                                  .otherwise(F.lit("thank you!")).alias("question"))


_SQL_QUESTIONS = """questions AS (SELECT k, CASE k % 4 WHEN 0 THEN 'How many units did the order-' || k || ' invoice record?'
 WHEN 1 THEN 'When was order-' || k || ' counted' WHEN 2 THEN 'latest status of order-' || k ELSE 'thank you!' END AS question FROM notes)"""

_q("f28_question_kind", ["notes"], "SELECT k, CASE k % 4 WHEN 0 THEN 'quantity' WHEN 1 THEN 'date' ELSE 'identity' END AS kind FROM notes",
   lambda s, p: _questions(s, p).select("k", a.question_kind("question").alias("kind")))

query("f29_typed_candidates", with_views(["notes"], r"""
SELECT rel_path, array_to_string(regexp_extract_all(body, '\d{4}-\d{2}-\d{2}|[0-9][0-9.]*'), ' ') AS numbers,
  array_to_string(list_concat(regexp_extract_all(body, '\b\d{4}-\d{2}-\d{2}\b'), regexp_extract_all(body, '\d{4}-\d{2}-\d{2}|[0-9][0-9.]*')), ' ') AS dates
FROM notes"""))(
    lambda s, p: src.notes(s, p).select(
        "rel_path", F.array_join(a.candidates(F.col("body"), F.lit("quantity")), " ").alias("numbers"),
        F.array_join(a.candidates(F.col("body"), F.lit("date")), " ").alias("dates")))

_q("f30_clean_candidates", ["notes"], r"""
SELECT rel_path, array_to_string(list_distinct_keep, ' ') AS clean FROM (
  SELECT rel_path, list_filter(vals, lambda x, i: list_position(vals, x) = i) AS list_distinct_keep
  FROM (SELECT rel_path, list_filter(regexp_extract_all(body, '[0-9][0-9.]*|[0-9]{4}-[0-9]{2}-[0-9]{2}'), lambda x: true) AS raw,
         list_filter(regexp_extract_all(body, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9][0-9.]*'), lambda x: length(x) <= 19) AS vals FROM notes))""",
   lambda s, p: src.notes(s, p).select("rel_path", F.array_join(a.clean_candidates(
       a.candidates(F.col("body"), F.lit("quantity")), F.lit("quantity"), lambda c: serving.sanitize_folded(c, 40)), " ").alias("clean")))

_CRED = "CASE evidence WHEN 'observed' THEN '1' WHEN 'sourced' THEN '2' WHEN 'synthesized' THEN '3' ELSE '6' END"
_q("f31_credibility", ["docs"], f"SELECT rel_path, {_CRED} AS digit FROM docs",
   lambda s, p: src.docs(s, p).select("rel_path", grading.credibility("evidence").alias("digit")))


def _identities(s, p):
    ps = table(s, p, "customer").select(
        "c_custkey",
        F.concat(F.lit("gcx://"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string")).alias("author"),
        F.when(F.col("c_nationkey") % 4 == 0, F.concat(F.lit("gcx://"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string")))
        .when(F.col("c_nationkey") % 4 == 1, F.concat(F.lit("aet://"), F.lower("c_mktsegment"), F.lit("/a")))
        .when(F.col("c_nationkey") % 4 == 2, F.lit("gcx://machinery/desk")).otherwise(F.lit("")).alias("reader"),
        (F.col("c_custkey") % 5 != 0).alias("verified"))
    return ps


_q("f32_source_letter", [], """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_nationkey % 4 = 3 THEN 'F' WHEN c_nationkey % 4 = 0 THEN 'A'
  WHEN c_nationkey % 4 = 2 AND c_mktsegment = 'MACHINERY' THEN 'B' ELSE 'C' END AS letter FROM customer""",
   lambda s, p: _identities(s, p).select("c_custkey", grading.source_letter("author", "reader", "verified").alias("letter")))

_q("f33_grade_pair", ["docs"],
   f"SELECT rel_path, CASE WHEN evidence <> '' THEN 'F' || {_CRED} ELSE '' END AS grade FROM docs",
   lambda s, p: src.docs(s, p).select(
       "rel_path", F.when(grading.is_graded("evidence"), grading.grade_pair("evidence")).otherwise(F.lit("")).alias("grade")))

_q("f34_parse_references", ["beliefs", "belief_evidence"],
   "SELECT belief_id, ref, kind, verified FROM belief_evidence",
   lambda s, p: src.belief_evidence(s, p)
   .groupBy("belief_id", "ref")
   .agg(F.struct(F.when(F.max("kind") == "link", F.concat(F.lit("[["), "ref", F.lit("|source]]"))).otherwise(F.col("ref")).alias("ref"),
                 F.max("verified").alias("verified")).alias("written"))
   .select("belief_id", F.explode(r.parse_references(F.array("written"))).alias("e"))
   .select("belief_id", "e.ref", "e.kind", "e.verified"))

_q("f35_disclosure_class", ["docs", "beliefs"], f"""
SELECT d.rel_path, CASE WHEN disclosure <> '' THEN disclosure WHEN state = 'draft' THEN 'private' WHEN state IS NOT NULL THEN 'artifact'
  WHEN {sql_is_abstraction('d.doc_type', 'd.slug')} THEN 'proposal' ELSE '' END AS class
FROM docs d LEFT JOIN beliefs b USING (rel_path)""",
   lambda s, p: src.docs(s, p).join(src.beliefs(s, p).select("rel_path", "state"), "rel_path", "left").select(
       "rel_path", v.disclosure_class("disclosure", "state", F.lit(""), "doc_type", "rel_path").alias("class")))


def _requests(s, p):
    """One disclosure request per order; every mix of ceilings, asks and malformed values."""
    k = F.col("o_orderkey")
    pick = lambda xs, e: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (e + 1).cast("int"))
    return table(s, p, "orders").select(
        k.alias("request_id"),
        pick([None, "full", "independent", "collaborative", "ADVERSARIAL ", "open"], k % 6).alias("ceiling_mode"),
        pick([None, "order-1, order-2 order-3", "", "../order-1 order-2"], F.floor(k / 6) % 4).alias("ceiling_seal"),
        pick([None, "independent", "adversarial", "bogus", "full"], F.floor(k / 24) % 5).alias("requested_mode"),
        pick([None, "order-2 order-9", "order-3,order-1"], F.floor(k / 120) % 3).alias("requested_seal"),
        F.when(k % 2 == 0, F.array(F.lit("project "), F.lit(" "))).otherwise(t.no_strings()).alias("allowed_doc_types"),
        t.no_strings().alias("allowed_path_prefixes"), (k % 7 == 0).alias("force_priority_only"),
        pick(["", "Artifact", "secret"], k % 3).alias("default_class"))


_SQL_REQ = """req AS (SELECT o_orderkey AS request_id,
  ([NULL, 'full', 'independent', 'collaborative', 'adversarial', 'open'])[(o_orderkey % 6 + 1)::INT] AS cm,
  (o_orderkey // 6) % 4 AS cs, ([NULL, 'independent', 'adversarial', 'bogus', 'full'])[((o_orderkey // 24) % 5 + 1)::INT] AS rm,
  (o_orderkey // 120) % 3 AS rs FROM orders)"""
_SQL_SEALS = """(CASE WHEN cm = 'open' OR rm = 'bogus' THEN [] WHEN cs = 0 THEN NULL WHEN cs = 1 THEN ['order-1', 'order-2', 'order-3'] ELSE [] END)"""

query("f36_parse_seal", f"WITH {_SQL_REQ} SELECT request_id, CASE cs WHEN 0 THEN 'undeclared' WHEN 1 THEN 'order-1|order-2|order-3' ELSE '' END AS seal FROM req")(
    lambda s, p: _requests(s, p).select("request_id", F.coalesce(joined(v.parse_seal("ceiling_seal")), F.lit("undeclared")).alias("seal")))

query("f37_resolve_envelope", f"""WITH {_SQL_REQ}, e AS (SELECT *, {_SQL_SEALS} AS base,
  CASE rs WHEN 1 THEN ['order-2', 'order-9'] WHEN 2 THEN ['order-3', 'order-1'] END AS ask,
  list_position(['adversarial', 'independent', 'collaborative', 'full'], CASE WHEN cm IS NULL THEN 'full' WHEN cm = 'open' THEN 'adversarial' ELSE cm END) AS c,
  list_position(['adversarial', 'independent', 'collaborative', 'full'], CASE WHEN rm = 'bogus' THEN 'adversarial' ELSE rm END) AS q FROM req)
SELECT request_id, (['adversarial', 'independent', 'collaborative', 'full'])[CASE WHEN q < c THEN q ELSE c END] AS mode,
  coalesce(array_to_string(list_sort(CASE WHEN ask IS NULL THEN base WHEN base IS NULL THEN ask ELSE list_filter(base, lambda x: list_contains(ask, x)) END), '|'), 'undeclared') AS sealed,
  CASE WHEN request_id % 2 = 0 THEN 'project' ELSE '' END AS types, request_id % 7 = 0 AS priority_only,
  CASE WHEN request_id % 3 = 1 THEN 'artifact' ELSE '' END AS default_class,
  CAST((cm = 'open') IS TRUE AS INT) + CAST((rm = 'bogus') IS TRUE AS INT) + CAST(cs = 3 AS INT) + CAST(request_id % 3 = 2 AS INT) AS warnings FROM e""")(
    lambda s, p: v.resolve_envelope(_requests(s, p)).select(
        "request_id", "envelope.mode", F.coalesce(joined(F.array_sort("envelope.sealed")), F.lit("undeclared")).alias("sealed"),
        joined(F.col("envelope.allowed_doc_types")).alias("types"), F.col("envelope.force_priority_only").alias("priority_only"),
        "envelope.default_class", "envelope.warnings"))

query("u02_seal_intersection", f"""WITH {_SQL_REQ}, e AS (SELECT request_id, CASE cs WHEN 1 THEN ['order-1', 'order-2', 'order-3'] WHEN 0 THEN NULL ELSE [] END AS base,
  CASE rs WHEN 1 THEN ['order-2', 'order-9'] WHEN 2 THEN ['order-3', 'order-1'] END AS ask FROM req)
SELECT request_id, coalesce(len(CASE WHEN ask IS NULL THEN base WHEN base IS NULL THEN ask ELSE list_filter(base, lambda x: list_contains(ask, x)) END), -1) AS allowed FROM e""")(
    lambda s, p: _requests(s, p).select("request_id", v.parse_seal("ceiling_seal").alias("base"), v.parse_seal("requested_seal").alias("ask"))
    .select("request_id", F.coalesce(F.size(
        F.when(F.col("ask").isNull(), F.col("base")).when(F.col("base").isNull(), F.col("ask")).otherwise(F.array_intersect("base", "ask"))), F.lit(-1)).alias("allowed"))
    .withColumn("allowed", F.when(F.col("allowed").isNull(), F.lit(-1)).otherwise(F.col("allowed"))))

_q("f38_sanitize_field", [], r"""
SELECT doc_id, CASE WHEN length(s) > 120 THEN rtrim(left(s, 120)) || '…' ELSE s END AS shown FROM (
  SELECT doc_id, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS s FROM documents)""",
   lambda s, p: table(s, p, "documents").select("doc_id", serving.sanitize_field("text", 120).alias("shown")))

_q("f39_fence_block", [], """
SELECT doc_id, '⟪note⟫' || chr(10) || '│ ' || replace(text, chr(10), chr(10) || '│ ') || chr(10) || '⟪/note⟫' AS block FROM documents""",
   lambda s, p: table(s, p, "documents").select("doc_id", serving.fence_block("text").alias("block")))

_q("f40_source_date", ["notes"], rf"""
SELECT rel_path, CASE WHEN regexp_matches(rel_path, '{ISO}') THEN 'dated ' || regexp_extract_all(rel_path, '{ISO}')[-1]
  ELSE 'last modified ' || {sql_iso('mtime')} END AS dated FROM notes""",
   _notes(lambda: d.source_date("rel_path", "mtime").alias("dated")))

_q("f42_match_phrases", [], r"""
SELECT item_id, array_to_string(list_concat(CASE WHEN len(toks) BETWEEN 2 AND 6 THEN [array_to_string(toks, ' ')] ELSE [] END, toks), '|') AS phrases
FROM (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: length(w) > 1) AS toks FROM benchmark)""",
   lambda s, p: table(s, p, "benchmark").select("item_id", joined(F.transform(a.match_phrases("text"), lambda x: F.array_join(x, " "))).alias("phrases")))

_IGN = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in g.IGNORED) + ")"


def sql_stem(w):
    return "(CASE " + " ".join(f"WHEN length({w}) >= {len(x) + 4} AND ends_with({w}, '{x}') THEN left({w}, length({w}) - {len(x)})" for x in g.SUFFIXES) + f" ELSE {w} END)"


def sql_rule_tokens(text):
    words = f"list_transform(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9\\-.]{{2,}}'), lambda w: trim(w, '-.'))"
    pieces = f"flatten(list_transform({words}, lambda w: list_concat([w], regexp_split_to_array(w, '[-.]'))))"
    kept = f"list_filter({pieces}, lambda x: length(x) >= 3 AND x NOT IN {_IGN})"
    return f"list_distinct(list_filter(list_transform({kept}, lambda x: {sql_stem('x')}), lambda x: x NOT IN {_IGN}))"


_q("f43_rule_tokens", ["notes"], f"SELECT rel_path, array_to_string(list_sort({sql_rule_tokens('body')}), ' ') AS tokens FROM notes",
   _notes(lambda: F.array_join(F.array_sort(g.rule_tokens("body")), " ").alias("tokens")))


def _turns(s, p):
    """Conversation turns behind phrases that carry the retention signals."""
    phrases = ["remember: ", "we decided, going forward 2026-05-01: ", "please don't ", "see https://ex.test/a and the gotcha ", ""]
    return table(s, p, "conversations").select("conv_id", "turn", F.concat(
        F.element_at(F.array(*[F.lit(x) for x in phrases]), (F.col("turn") % 5 + 1).cast("int")), F.col("text")).alias("text"))


_SQL_TURNS = """turns AS (SELECT conv_id, turn, (['remember: ', 'we decided, going forward 2026-05-01: ', 'please don''t ', 'see https://ex.test/a and the gotcha ', ''])[(turn % 5 + 1)::INT] || text AS text FROM conversations)"""


def _rx(pattern):
    return f"regexp_matches(lower(text), '" + pattern.replace("'", "''") + "')"


_SQL_SCORED = f"""scored AS (SELECT conv_id, turn, text,
  (CASE WHEN {_rx(g.SAVE_INTENT)} THEN 0.85::DOUBLE ELSE 0 END) + (CASE WHEN {_rx(g.DECISION)} OR {_rx(g.COMMITMENT)} THEN 0.5::DOUBLE ELSE 0 END)
  + (CASE WHEN {_rx(g.DECISION)} AND {_rx(g.COMMITMENT)} THEN 0.2::DOUBLE ELSE 0 END)
  + (CASE WHEN ({_rx(g.DECISION)} OR {_rx(g.COMMITMENT)}) AND {_rx(g.NEAR_DATE)} THEN 0.2::DOUBLE ELSE 0 END)
  + (CASE WHEN {_rx(g.FEEDBACK)} THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN {_rx(g.PROFILE)} THEN 0.35::DOUBLE ELSE 0 END)
  + (CASE WHEN {_rx(g.REFERENCE)} THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN {_rx(g.SURPRISE)} THEN 0.3::DOUBLE ELSE 0 END) AS score,
  CASE WHEN {_rx(g.REFERENCE)} THEN 'reference' WHEN {_rx(g.PROFILE)} THEN 'user' WHEN {_rx(g.FEEDBACK)} THEN 'feedback' ELSE 'project' END AS kind FROM turns)"""

query("f44_retention_score", f"WITH {_SQL_TURNS}, {_SQL_SCORED} SELECT conv_id, turn, round(least(score, 1), 6) AS confidence, round(least(score, 1), 9) >= 0.5 AS commit, kind AS type FROM scored")(
    lambda s, p: _turns(s, p).select("conv_id", "turn", g.retention("text").alias("r"))
    .select("conv_id", "turn", F.round("r.confidence", 6).alias("confidence"), "r.commit", "r.type"))

query("f45_suggested_slug", f"""WITH {_SQL_TURNS}, {_SQL_SCORED}, w AS (SELECT conv_id, turn, kind,
  regexp_extract_all(lower(left(string_split(trim(text), chr(10))[1], 80)), '[A-Za-z0-9]+')[1:6] AS words FROM scored)
SELECT conv_id, turn, kind || '_' || (CASE WHEN len(words) > 0 THEN array_to_string(words, '-') ELSE 'entry' END) AS slug FROM w""")(
    lambda s, p: _turns(s, p).select("conv_id", "turn", g.suggested_slug("text", g.retention("text")["type"]).alias("slug")))

query("f46_extractive_snapshot", r"""
WITH l AS (SELECT doc_id, text, greatest(CAST(floor(length(text) * 0.25::DOUBLE) AS INT), 200) AS budget, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 f AS (SELECT *, trim(line) AS s, coalesce(lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY i), '') AS prev FROM l),
 kept AS (SELECT *, rtrim(line) AS shown, sum(length(rtrim(line))) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM f
   WHERE s <> '' AND (i = 1 OR prev = '' OR starts_with(prev, '#') OR regexp_matches(s, '^(#|- |\* |>)') OR regexp_matches(s, '^\d\d.?\.'))),
 pre AS (SELECT * FROM kept WHERE used - length(shown) < budget),
 snap AS (SELECT doc_id, trim(string_agg(shown, chr(10) ORDER BY i) || (CASE WHEN max(used) >= min(budget) THEN chr(10) || '… [snapshot truncated — full session in the archived record]' ELSE '' END)) AS snapshot FROM pre GROUP BY doc_id)
SELECT d.doc_id, coalesce(nullif(snapshot, ''), left(d.text, greatest(CAST(floor(length(d.text) * 0.25::DOUBLE) AS INT), 200))) AS snapshot FROM documents d LEFT JOIN snap USING (doc_id)""")(
    lambda s, p: table(s, p, "documents").select("doc_id", r.extractive_snapshot("text").alias("snapshot")))

_q("f47_ascii_tag", [], "SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS tag FROM documents",
   lambda s, p: table(s, p, "documents").select("doc_id", r.ascii_tag("text").alias("tag")))

_q("f48_source_hash", [], "SELECT doc_id, sha256(text) AS source_hash FROM documents",
   lambda s, p: table(s, p, "documents").select("doc_id", r.source_hash("text").alias("source_hash")))

_q("s15_content_id", [], "SELECT doc_id, rtrim(translate(to_base64(unhex(sha256(text))), '+/', '-_'), '=') AS txid FROM documents",
   lambda s, p: table(s, p, "documents").select("doc_id", r.content_id("text").alias("txid")))


def pages_of_projects(s, p):
    """One project page per customer, with the signals the harvest looks for."""
    k, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    text = F.concat_ws(
        "\n", F.concat(F.lit("# "), "c_name", F.lit(" service")),
        F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("**Status**: "), F.element_at(F.array(*[F.lit(x) for x in ("ACTIVE", "DONE", "BLOCKED")]), (F.col("c_nationkey") % 3 + 1)))),
        F.when(F.col("c_custkey") % 4 > 0, F.lit("**Priority**: HIGH")),
        F.concat(F.lit("**Mission**: serve the "), seg, F.lit(" segment")),
        F.when(F.col("c_custkey") % 5 > 0, F.lit("**Last Updated**: 2001-06-01")),
        F.lit("## Current State"), F.lit("| key | value |"), F.lit("|---|---|"),
        F.concat(F.lit("| nation | "), F.col("c_nationkey").cast("string"), F.lit(" |")), F.lit(""),
        F.concat(F.lit("see src/app_"), F.col("c_nationkey").cast("string"), F.lit(".py:"), k, F.lit(" and `lib/core.rs:7`")),
        F.lit("```bash"), F.concat(F.lit("run --id "), k), F.lit("```"),
        F.when(F.col("c_acctbal") < 0, F.lit("Currently BLOCKED, todo: collect")),
        F.concat(F.lit("docs at https://ex.test/c/"), k, F.lit("?full=1")),
        F.when(seg == "HOUSEHOLD", F.lit("Deployed to production.")),
        F.when(seg == "MACHINERY", F.lit("payment flow")),
        F.when(F.col("c_custkey") % 6 > 0, F.lit("## Related Lairs")))
    return fan_out(table(s, p, "customer")).select(
        "c_custkey", text.alias("text"), F.concat(F.lower(seg), F.lit("/"), F.when(F.col("c_custkey") % 9 == 0, F.lit("_archive/")).otherwise(F.lit("")), k).alias("path"),
        F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("Dockerfile"))).otherwise(t.no_strings()).alias("artifacts"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("c_custkey") % 210).cast("int")).cast("string").alias("last_change"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("critical")).otherwise(F.lit("")).alias("flag"), "c_name")


PROJECT_PAGES = """
project_pages AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey, concat_ws(chr(10), '# ' || c_name || ' service',
  CASE WHEN c_custkey % 3 > 0 THEN '**Status**: ' || (['ACTIVE', 'DONE', 'BLOCKED'])[c_nationkey % 3 + 1] END,
  CASE WHEN c_custkey % 4 > 0 THEN '**Priority**: HIGH' END, '**Mission**: serve the ' || c_mktsegment || ' segment',
  CASE WHEN c_custkey % 5 > 0 THEN '**Last Updated**: 2001-06-01' END, '## Current State', '| key | value |', '|---|---|',
  '| nation | ' || c_nationkey || ' |', '', 'see src/app_' || c_nationkey || '.py:' || c_custkey || ' and `lib/core.rs:7`',
  '```bash', 'run --id ' || c_custkey, '```', CASE WHEN c_acctbal < 0 THEN 'Currently BLOCKED, todo: collect' END,
  'docs at https://ex.test/c/' || c_custkey || '?full=1', CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Deployed to production.' END,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'payment flow' END, CASE WHEN c_custkey % 6 > 0 THEN '## Related Lairs' END) AS text FROM customer)"""

query("f49_signal_harvest", "WITH" + PROJECT_PAGES + r"""
SELECT c_custkey, regexp_extract(text, '(?m)^#\s+(.+)$', 1) AS h1, regexp_extract(text, '\*\*Mission\*\*: (.+)', 1) AS mission,
  len(regexp_extract_all(text, '(?m)(?:^\|.*\|\s*$\n?){2,}')) AS n_tables,
  array_to_string(regexp_extract_all(text, '[\w./-]+\.\w+:\d+'), '|') AS file_refs,
  array_to_string(regexp_extract_all(text, '(?s)```bash\n(.*?)```', 1), '|') AS shell,
  CASE WHEN c_acctbal < 0 THEN 'BLOCKED|todo' WHEN c_custkey % 3 > 0 AND c_nationkey % 3 = 2 THEN 'BLOCKED' ELSE '' END AS blockers,
  array_to_string(regexp_extract_all(text, 'https?://[\w.-]+[\w./?=&%-]*'), '|') AS urls FROM project_pages""")(
    lambda s, p: pages_of_projects(s, p).select("c_custkey", r.harvest("text").alias("h")).select(
        "c_custkey", "h.h1", "h.mission", F.size("h.tables").alias("n_tables"), joined(F.col("h.file_refs")).alias("file_refs"),
        joined(F.col("h.shell_blocks")).alias("shell"), joined(F.col("h.blockers")).alias("blockers"), joined(F.col("h.urls")).alias("urls")))

_SQL_BLOCKED = "(c_acctbal < 0 OR (c_custkey % 3 > 0 AND c_nationkey % 3 = 2))"
query("f50_status_inference", "WITH" + PROJECT_PAGES + f"""
SELECT c_custkey, CASE WHEN {_SQL_BLOCKED} THEN 'BLOCKED' WHEN c_nationkey % 2 = 0 AND c_mktsegment = 'HOUSEHOLD' THEN 'OPERATIONAL'
  WHEN date_diff('day', DATE '2001-01-01' + (c_custkey % 210)::INT, DATE '2001-08-02') > 60 THEN 'DORMANT' ELSE 'ACTIVE' END AS status FROM project_pages""")(
    lambda s, p: pages_of_projects(s, p).select("c_custkey", r.infer_status(
        "text", r.harvest("text")["blockers"], "artifacts", "last_change", src.TODAY).alias("status")))

_SQL_PRIO = "CASE WHEN c_custkey % 10 = 0 THEN 'CRITICAL' WHEN c_custkey % 9 = 0 THEN 'LOW' WHEN c_mktsegment = 'MACHINERY' THEN 'HIGH' ELSE 'MEDIUM' END"
query("f51_priority_inference", f"SELECT c_custkey, {_SQL_PRIO} AS priority FROM customer")(
    lambda s, p: pages_of_projects(s, p).select("c_custkey", r.infer_priority("text", "path", "flag").alias("priority")))

query("f52_folder_name", f"""SELECT c_custkey, CASE WHEN {_SQL_PRIO} IN ('CRITICAL', 'HIGH') THEN '000-PRIORITY-CUSTOMER-' ELSE 'customer-' END
  || lpad(c_custkey::VARCHAR, 9, '0') AS folder FROM customer""")(
    lambda s, p: pages_of_projects(s, p).select("c_custkey", r.folder_name("c_name", r.infer_priority("text", "path", "flag")).alias("folder")))

query("f53_owner_address", "SELECT p_partkey, rtrim(translate(to_base64(unhex(sha256('key-' || p_brand))), '+/', '-_'), '=') AS address FROM part")(
    lambda s, p: table(s, p, "part").select("p_partkey", r.owner_address(r.base64url(F.encode(F.concat(F.lit("key-"), "p_brand"), "UTF-8"))).alias("address")))

query("f54_name_parse", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'gcx' ELSE 'aet' END AS scheme,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'part/' || replace(p_name, ' ', '-') END AS path FROM part""")(
    lambda s, p: table(s, p, "part").select("p_partkey", r.name_parts(F.concat(
        F.element_at(F.array(F.lit("http://"), F.lit(" gcx://"), F.lit("aet://")), F.col("p_size") % 3 + 1),
        F.lit("part/"), F.translate("p_name", " ", "-"))).alias("n")).select("p_partkey", "n.scheme", "n.path"))

query("f55_hash_status", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UNVERIFIABLE (no hash recorded on-chain)' WHEN doc_id % 3 = 1 THEN 'HASH MISMATCH'
  WHEN doc_id % 2 = 0 THEN 'VERIFIED (address-derived)' ELSE 'VERIFIED' END AS status FROM documents""")(
    lambda s, p: table(s, p, "documents").select("doc_id", r.hash_status(
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.lit("00ff")).otherwise(F.upper(r.source_hash("text"))),
        r.source_hash("text"), F.when(F.col("doc_id") % 2 == 0, F.lit("address-derived")).otherwise(F.lit(""))).alias("status")))

query("f56_table_lines", with_views(["notes"], r"""
SELECT count(*) FILTER (regexp_matches(line, '^\s*\|.*\|\s*$')) AS table_rows, count(*) FILTER (regexp_matches(line, '^\s*\|[\s:|\-]+\|\s*$')) AS rules, count(*) AS n_lines
FROM (SELECT unnest(string_split(body || chr(10) || '|---|:-:|', chr(10))) AS line FROM notes)"""))(
    lambda s, p: src.notes(s, p).select(F.explode(t.lines(F.concat("body", F.lit("\n|---|:-:|")))).alias("line")).agg(
        F.count_if(t.is_table_row("line")).alias("table_rows"), F.count_if(t.is_table_rule("line")).alias("rules"), F.count(F.lit(1)).alias("n_lines")))

# ---- predicates ------------------------------------------------------------

_BACK = " OR ".join(f"contains(path, '{m}')" for m in t.BACKUP_MARKERS)
query("p01_backup_path", with_views(["notes"], f"SELECT path, {_BACK} AS is_backup FROM (SELECT (CASE WHEN k % 6 = 0 THEN 'x/backups/' WHEN k % 6 = 1 THEN 'y-pre-scrub/' ELSE '' END) || rel_path || (CASE WHEN k % 6 = 2 THEN '.bak' ELSE '' END) AS path FROM notes)"))(
    lambda s, p: src.notes(s, p).select(F.concat(
        F.when(F.col("k") % 6 == 0, F.lit("x/backups/")).when(F.col("k") % 6 == 1, F.lit("y-pre-scrub/")).otherwise(F.lit("")), "rel_path",
        F.when(F.col("k") % 6 == 2, F.lit(".bak")).otherwise(F.lit(""))).alias("path")).withColumn("is_backup", t.is_backup_path("path")))

_q("p02_archive_path", ["notes"], f"SELECT rel_path, {sql_archived('rel_path')} AS excluded FROM notes",
   _notes(lambda: t.is_archive_path("rel_path").alias("excluded")))

_q("p03_self_made", ["notes"], "SELECT rel_path FROM notes WHERE NOT (rel_path ILIKE 'abstraction-%' OR rel_path ILIKE '%/abstraction-%' OR rel_path ILIKE 'abstraction_%' OR rel_path ILIKE '%/abstraction_%')",
   lambda s, p: src.notes(s, p).filter(~t.is_self_made("rel_path")).select("rel_path"))

query("p13_directive_line", with_views(["notes"], "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) >= 12 AND ("
      + " OR ".join(f"contains(lower(trim(l)), '{m}')" for m in [x.replace("'", "''") for x in g.PROHIBITIVE + g.PRESCRIPTIVE])
      + "))) AS directives FROM (SELECT doc_id, text || chr(10) || '- Always keep line ' || doc_id || chr(10) || 'never x' AS text FROM documents)"))(
    lambda s, p: table(s, p, "documents").select("doc_id", F.size(F.filter(
        t.lines(F.concat("text", F.lit("\n- Always keep line "), F.col("doc_id").cast("string"), F.lit("\nnever x"))), g.is_directive)).alias("directives")))

_q("p14_open_claims", ["notes"], rf"SELECT rel_path, array_to_string(list_transform({sql_open_lines('body')}, lambda l: regexp_replace(l, '\s+', ' ', 'g')), '/') AS claims FROM notes",
   _notes(lambda: F.array_join(d.open_claims("body"), "/").alias("claims")))

_GSTOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in a.GATE_STOP_WORDS) + ")"
_GREET = "(" + ", ".join(f"'{w}'" for w in a.GREETINGS) + ")"
query("p15_retrieval_gate", "WITH RECURSIVE " + with_views(["notes"], "", _SQL_QUESTIONS).replace("WITH RECURSIVE ", "") + f"""
SELECT k, CASE WHEN length(trim(question)) < 3 THEN 'empty/near-empty query' WHEN trim(lower(trim(question)), ' .!?') IN {_GREET} THEN 'greeting/acknowledgement'
  WHEN len(list_filter(regexp_extract_all(lower(question), '[a-z0-9]{{3,}}'), lambda w: w NOT IN {_GSTOP})) < 1 THEN 'no content terms' ELSE '' END AS reason FROM questions""")(
    lambda s, p: _questions(s, p).select("k", a.retrieval_gate("question")["reason"].alias("reason")))

query("p16_question_shape", with_views(["notes"], "SELECT k, k % 4 < 2 AS is_question FROM questions", _SQL_QUESTIONS))(
    lambda s, p: _questions(s, p).select("k", a.is_question("question").alias("is_question")))

query("p17_temporal", with_views(["notes"], "SELECT k, k % 4 = 2 AS temporal FROM questions", _SQL_QUESTIONS))(
    lambda s, p: _questions(s, p).select("k", a.is_temporal("question").alias("temporal")))

_q("p18_is_abstraction", ["docs"], f"SELECT rel_path, {sql_is_abstraction('doc_type', 'slug')} AS abstraction FROM docs",
   _notes(lambda: t.is_abstraction("doc_type", "rel_path").alias("abstraction")))

_q("p19_record_quality", ["notes"], """
SELECT rel_path, unnest(list_filter([CASE WHEN claim_date = '' THEN 'no-date' END,
  CASE evidence_raw WHEN 'observed' THEN 'observed-shipped' WHEN 'guess' THEN 'no-evidence' END], lambda x: x IS NOT NULL)) AS rule FROM notes""",
   lambda s, p: src.notes(s, p).select("rel_path", F.explode(r.record_violations("rel_path", "claim_date", "evidence_raw")).alias("rule")))

query("p20_structure_lint", "WITH" + PROJECT_PAGES + """
SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 3 = 0 OR c_nationkey % 3 = 1 THEN 'bad-status' END, CASE WHEN c_custkey % 4 = 0 THEN 'bad-priority' END,
  CASE WHEN c_custkey % 5 = 0 THEN 'bad-updated' END, CASE WHEN c_custkey % 6 = 0 THEN 'no-related' END], lambda x: x IS NOT NULL)) AS code FROM project_pages""")(
    lambda s, p: pages_of_projects(s, p).select("c_custkey", F.explode(r.structure_violations("text")).alias("code")))

# ---- shipped-document rules ------------------------------------------------

_q("z01_age_bands", ["notes"], f"""
SELECT rel_path, CASE WHEN days IS NULL THEN 'undated' WHEN days < 30 THEN 'active' WHEN days < 60 THEN 'flag' ELSE 'archive-candidate' END AS band FROM (
  SELECT rel_path, CASE WHEN k % 4 = 0 THEN {sql_days('iso')} END AS days FROM notes)""",
   _notes(lambda: d.age_band(d.days_since(F.regexp_extract("body", d.UPDATED_HEADER, 1), src.TODAY)).alias("band")))


def change_delta(docs, since, most=None):
    """Documents changed since a marker, in path order; all of them unless a report asks for the first `most`."""
    changed = docs.filter((F.col("mtime") > since) & ~F.endswith("rel_path", F.lit("MEMORY.md"))).select("rel_path", "title").orderBy("rel_path")
    return changed.limit(most) if most else changed


_DELTA = "SELECT rel_path, title FROM docs WHERE mtime > 996710400.0 AND NOT ends_with(rel_path, 'MEMORY.md') ORDER BY rel_path"
_q("z07_change_delta", ["docs"], _DELTA + " LIMIT 25", lambda s, p: change_delta(src.docs(s, p), src.NOW, 25))
_q("z07_change_delta_all", ["docs"], _DELTA, lambda s, p: change_delta(src.docs(s, p), src.NOW))
