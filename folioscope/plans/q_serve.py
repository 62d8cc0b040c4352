"""Served records, ambiguity, budgets, rules and suggestions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import admission as a
from ..functions import directives as g
from ..functions import text as t
from ..operators import excerpt as x
from ..operators import rank as R
from ..operators import rules as ru
from ..operators import serving as sv
from ..params import DEFAULTS
from ..session import written
from ..sources import notes as src
from .catalog import query, table
from .oracle_views import (
    sql_is_abstraction, sql_norm, sql_record_date, sql_stale_marker, sql_terms_of, with_views,
)
from .q_scalar import _SQL_SCORED, _SQL_TURNS, _turns, sql_rule_tokens

# ---- every customer asks about the first order; the hits are that customer's notes


def customer_hits(s, p):
    # every document meets every customer of its path; hits stay narrow until they are ranked, their texts are made last
    rows = src.note_rows(s, p).filter("rel_path IS NOT NULL")
    dd = rows.withColumn("custkeys", F.collect_list("custkey").over(Window.partitionBy("rel_path")))
    dd = dd.withColumn("query_id", F.explode("custkeys")).drop("custkeys")
    w = Window.partitionBy("query_id").orderBy("k")
    ranked = dd.withColumns({"rank": F.row_number().over(w), "first_k": F.min("k").over(Window.partitionBy("query_id"))})
    hits = ranked.withColumns({
        "score": F.lit(1.0) / (F.col("rank") + 60), "slug": t.basename_slug("rel_path"),
        "boosts": F.create_map().cast("map<string,double>"), "persona": F.lit("p1")})
    hits = R.bury_superseded(hits, R.superseded_slugs(src.supersessions(src.notes(s, p))), 1.0)
    hits = R.belief_visibility(hits, src.beliefs(s, p), rank=False)
    # dropping foreign drafts closes the ranks up again
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    more = ("query_id", "rank", "score", "first_k", "boosts", "persona", "belief_state")
    return written(src.as_docs(src.as_notes(hits, *more), *more).select(
        "rel_path", "slug", "query_id", "rank", "score",
        F.concat(F.lit("How many units did the order-"), F.col("first_k").cast("string"), F.lit(" invoice record?")).alias("query"),
        F.col("body").alias("text"), "title", F.lit(0).alias("chunk_idx"), F.lit("").alias("heading_path"),
        "doc_type", "mtime", "claim_date", "evidence", "is_priority", "boosts", "persona", "belief_state"), "hits")


_CAND_RX = r"regexp_extract_all({}, '\d{{4}}-\d{{2}}-\d{{2}}|[0-9][0-9.]*')"


def sql_judge(source, question="query", record="text", keys="*"):
    """CTEs adding verdict, cov, over, bound to a source of (question, record) rows without proper nouns."""
    hit = ("(list_contains(rtok, w) OR (length(w) >= 6 AND contains(rnorm, w)) OR (length(w) >= 6 AND contains(rflat, replace(w, '-', ' '))) "
           "OR (length(regexp_replace(w, '(ing|back|ed|es|s)$', '')) >= 5 AND contains(rflat, regexp_replace(w, '(ing|back|ed|es|s)$', ''))))")
    spec = "(regexp_matches(w, '[0-9]') OR contains(w, '-') OR contains(w, '/') OR length(w) >= 8)"
    return f"""
j1 AS (SELECT {keys}, {sql_terms_of(sql_norm(question))} AS qt, {sql_norm(record)} AS rnorm,
    string_split(regexp_replace({record}, '([.;!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS sents FROM {source}),
j2 AS (SELECT *, list_filter(qt, lambda w: {spec}) AS spec, list_filter(qt, lambda w: NOT {spec}) AS gen, string_split(rnorm, ' ') AS rtok, replace(rnorm, '-', ' ') AS rflat,
    list_transform(sents, lambda z: {sql_norm('z')}) AS norms FROM j1),
j3 AS (SELECT *, list_transform(range(1, len(sents) + 1), lambda i: array_to_string(norms[greatest(i - 1, 1):i + 1], ' ')) AS wins FROM j2),
j4 AS (SELECT *, list_transform(wins, lambda z: {sql_terms_of('z')}) AS wterms FROM j3),
j5 AS (SELECT *, CASE WHEN len(spec) > 0 THEN len(list_filter(spec, lambda w: {hit})) / len(spec) ELSE 1 END AS cov,
    CASE WHEN len(gen) > 0 THEN len(list_filter(gen, lambda w: {hit})) / len(gen) ELSE 0 END AS over,
    flatten(list_transform(range(1, len(sents) + 1), lambda i: CASE WHEN len(list_filter(spec, lambda w: list_contains(wterms[i], w) OR (length(w) >= 6 AND contains(wins[i], w)))) >= 1
      AND len(list_filter(spec, lambda w: list_contains(wterms[i], w) OR (length(w) >= 6 AND contains(wins[i], w)))) + len(list_filter(gen, lambda w: list_contains(wterms[i], w))) >= 2
      THEN {_CAND_RX.format('sents[i]')} ELSE [] END)) AS bound FROM j4),
judged AS (SELECT *, CASE WHEN len(bound) > 0 AND cov >= 0.5 THEN 'ADMISSIBLE' WHEN greatest(over, cov) >= 0.28 THEN 'INADMISSIBLE_NEAR' ELSE 'IRRELEVANT' END AS verdict FROM j5)"""


def _pairs(s, p):
    n = src.notes(s, p).select("k", F.col("body").alias("record"))
    q = src.notes(s, p).select(F.col("k").alias("qk"), F.concat(F.lit("How many units did the order-"), F.col("k").cast("string"), F.lit(" invoice record?")).alias("question"))
    return q.withColumn("k", F.explode(F.array(F.col("qk"), F.col("qk") + 1))).join(n, "k")


_PAIRS = """pairs AS (SELECT a.k AS qk, b.k AS k, 'How many units did the order-' || a.k || ' invoice record?' AS question, b.body AS record FROM notes a JOIN notes b ON b.k = a.k
  UNION ALL SELECT a.k, b.k, 'How many units did the order-' || a.k || ' invoice record?', b.body FROM notes a JOIN notes b ON b.k = a.k + 1),"""
query("r16_admissibility", with_views(["notes"], "SELECT qk, k, verdict, round(cov, 6) AS coverage, round(over, 6) AS overlap, array_to_string(bound, ' ') AS bound FROM judged",
                                      _PAIRS + sql_judge("pairs", "question", "record")))(
    lambda s, p: a.judge(_pairs(s, p)).select(
        "qk", "k", "verdict.verdict", F.round("verdict.specific_coverage", 6).alias("coverage"), F.round("verdict.generic_overlap", 6).alias("overlap"),
        F.array_join("verdict.bound", " ").alias("bound")))

query("w09_sentence_windows", with_views(["notes"], """
SELECT k, i, concat_ws(' ', lag(sent) OVER w, sent, lead(sent) OVER w) AS win FROM (
  SELECT k, unnest(ss) AS sent, generate_subscripts(ss, 1) AS i FROM (SELECT k, string_split(regexp_replace(body, '([.;!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM notes))
WINDOW w AS (PARTITION BY k ORDER BY i)"""))(
    lambda s, p: src.notes(s, p).select("k", F.split("body", a.SENTENCE_END).alias("ss")).select(
        "k", F.posexplode(F.transform("ss", lambda z, i: F.array_join(F.slice("ss", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " "))).alias("at", "win"))
    .select("k", (F.col("at") + 1).alias("i"), "win"))

_CUST = f"""
ch0 AS (SELECT custkey AS query_id, row_number() OVER (PARTITION BY custkey ORDER BY k) AS rank0, 'How many units did the order-' || min(k) OVER (PARTITION BY custkey) || ' invoice record?' AS query,
   body AS text, title, docs.rel_path, doc_type, mtime, claim_date, evidence, is_priority, slug, b.state, b.persona AS author, slug IN (SELECT tgt_slug FROM supersessions) AS gone
  FROM docs LEFT JOIN (SELECT rel_path, state, persona FROM beliefs) b ON b.rel_path = docs.rel_path),
ch AS (SELECT *, 1.0::DOUBLE / (rank0 + 60) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank0) AS rank FROM ch0 WHERE coalesce(state, '') <> 'draft' OR author = 'p1'),"""
_RL, _RD = sql_record_date("text", "rel_path", "doc_type", "slug", "mtime", "claim_date")
_HEAD = f"""
'[' || rank || '] ' || (CASE WHEN is_priority THEN '★ ' ELSE '' END) || title || printf('  (score=%.3f)', score) || chr(10) || '    ' || concat_ws(' · ', 'src: ' || rel_path, 'chunk 0',
  CASE WHEN doc_type <> '' THEN 'type=' || doc_type END, {_RL} || ' ' || {_RD}, CASE evidence WHEN 'observed' THEN 'observed (F1)' WHEN 'sourced' THEN 'sourced (F2)' WHEN 'synthesized' THEN 'synthesized (F3)' END,
  nullif({sql_stale_marker('text', 'rel_path', 'doc_type', 'slug', 'mtime', 'claim_date')}, ''), CASE WHEN gone THEN 'SUPERSEDED' END,
  CASE state WHEN 'draft' THEN 'DRAFT — your own prior output, NOT evidence' WHEN 'retracted' THEN 'RETRACTED' WHEN 'needs_review' THEN 'NEEDS-REVIEW — evidence beneath this was withdrawn' WHEN 'promoted' THEN 'belief (promoted)' END,
  CASE WHEN {sql_is_abstraction('doc_type', 'slug')} THEN 'abstraction' END, CASE verdict WHEN 'ADMISSIBLE' THEN 'binds' WHEN 'INADMISSIBLE_NEAR' THEN 'near-miss' END)"""
_SERVED = _CUST + sql_judge("ch") + f""",
blocks AS (SELECT *, {_HEAD} AS header FROM judged),
fenced AS (SELECT *, header || chr(10) || '⟪note⟫' || chr(10) || '│ ' || replace(text, chr(10), chr(10) || '│ ') || chr(10) || '⟪/note⟫' AS block FROM blocks),
served AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM fenced QUALIFY used <= 6000 OR rank = 1),
gates AS (SELECT query_id, count(*) AS kept, count(*) FILTER (verdict = 'INADMISSIBLE_NEAR') AS near FROM served GROUP BY ALL)"""
_SV = ["docs", "beliefs", "supersessions"]


def _served(s, p):
    return sv.serve(customer_hits(s, p), src.TODAY)


query("r18_record_rendering", with_views(_SV, "SELECT query_id, rank, header, sha1(block) AS block FROM served", _SERVED))(
    lambda s, p: _served(s, p).select("query_id", "rank", "header", F.sha1(F.encode("block", "UTF-8")).alias("block")))
query("w03_block_budget", with_views(_SV, "SELECT query_id, count(*) AS kept, max(used) AS used FROM served GROUP BY ALL", _SERVED))(
    lambda s, p: _served(s, p).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.max("used").alias("used")))
query("a06_ambiguity_gate", with_views(_SV, "SELECT query_id, kept, near, near >= 3 AND near / kept >= 0.5 AS gate FROM gates", _SERVED))(
    lambda s, p: sv.notices(_served(s, p)).select("query_id", "kept", "near", "gate"))
query("a05_provenance", with_views(_SV, """SELECT query_id, kept, total, sources, used, printf('injected %d/%d hits from %d source(s) · budget %d/6000 chars · score %.3f–%.3f', kept, total, sources, used, low, high) AS footer
  FROM (SELECT query_id, count(*) AS kept, count(DISTINCT rel_path) AS sources, max(used)::BIGINT AS used, min(score) AS low, max(score) AS high FROM served GROUP BY ALL) JOIN (SELECT query_id, count(*) AS total FROM ch GROUP BY ALL) USING (query_id)""", _SERVED))(
    lambda s, p: (lambda hits: sv.provenance(hits, sv.serve(hits, src.TODAY)))(customer_hits(s, p)).select("query_id", "kept", "total", "sources", "used", "footer"))
_TABLE = """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS row, value, title FROM (SELECT query_id, rank, title, unnest(vals) AS value, generate_subscripts(vals, 1) AS pos FROM (
   SELECT query_id, rank, title, (list_filter(bound, lambda v, i: length(v) <= 19 AND list_position(bound, v) = i))[1:3] AS vals FROM served JOIN gates USING (query_id)
   WHERE near >= 3 AND near / kept >= 0.5 AND verdict = 'ADMISSIBLE')) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) <= 10"""
query("r19_binding_table", with_views(_SV, _TABLE, _SERVED))(lambda s, p: sv.binding_table(_served(s, p)))
query("t09_binding_caps", with_views(_SV, f"SELECT query_id, count(*) AS n FROM ({_TABLE}) GROUP BY ALL", _SERVED))(
    lambda s, p: sv.binding_table(_served(s, p)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")))
query("w02_preview_budget", with_views(_SV, """SELECT query_id, rank, used FROM (SELECT query_id, rank, sum(least(length(trim(text)), 360)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ch) WHERE used <= 6000 OR rank = 1""", _CUST.rstrip(",")))(
    lambda s, p: sv.preview_budget(customer_hits(s, p)).select("query_id", "rank", "used"))

_INV = _SERVED + """,
inv AS (SELECT 'honest-dating' AS name, count(*) FILTER (contains(text, '**Last Updated**') AND NOT made) AS cases, count(*) FILTER (contains(text, '**Last Updated**') AND NOT made AND contains(header, ' · verified ')) AS ok FROM (SELECT *, """ + sql_is_abstraction("doc_type", "slug") + """ AS made FROM served)
  UNION ALL SELECT 'supersession', count(*) FILTER (gone), count(*) FILTER (gone AND contains(header, 'SUPERSEDED')) FROM served
  UNION ALL SELECT 'staleness', count(*) FILTER (contains(text, '**PENDING**') AND NOT contains(text, 'volatile: false') AND NOT contains(rel_path, '_archive')),
     count(*) FILTER (contains(text, '**PENDING**') AND NOT contains(text, 'volatile: false') AND NOT contains(rel_path, '_archive') AND regexp_matches(header, 'unverified|EXPIRED')) FROM served
  UNION ALL SELECT 'untrusted-fence', count(*), count(*) FILTER (contains(block, chr(10) || '│ # Order')) FROM served)"""


def _invariants(s, p):
    d = _served(s, p).withColumn("made", t.is_abstraction("doc_type", "rel_path"))
    has = lambda col, s_: F.contains(F.col(col), F.lit(s_))
    stale = has("text", "**PENDING**") & ~has("text", "volatile: false") & ~t.is_archive_path("rel_path")
    dated = has("text", "**Last Updated**") & ~F.col("made")
    gone = F.map_contains_key("boosts", "superseded")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), case.alias("case"), (case & ok).alias("ok")) for n, case, ok in (
        ("honest-dating", dated, has("header", " · verified ")), ("supersession", gone, has("header", "SUPERSEDED")),
        ("staleness", stale, F.col("header").rlike("unverified|EXPIRED")), ("untrusted-fence", F.lit(True), has("block", "\n│ # Order")))])
    return d.select(F.inline(rows)).groupBy("name").agg(F.count_if("case").alias("cases"), F.count_if("ok").alias("ok"))


query("q05_serving_invariants", with_views(_SV, "SELECT name, cases, ok FROM inv", _INV))(_invariants)

# ---- excerpts over whole documents ------------------------------------------


def _doc_queries(s, p):
    """Every document with one benchmark text as its query."""
    n = table(s, p, "benchmark").agg(F.count(F.lit(1))).scalar()
    b = table(s, p, "benchmark").select(F.col("item_id"), F.col("text").alias("query"))
    return table(s, p, "documents").select("doc_id", "text").withColumn("item_id", F.col("doc_id") % n).join(b, "item_id").withColumn("terms", a.terms("query"))


_DQ = f"""
dq AS (SELECT doc_id, trim(d.text, chr(10)) AS text, {sql_terms_of(sql_norm('b.text'))} AS terms FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
ln AS (SELECT doc_id, terms, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM dq),
sc AS (SELECT doc_id, i, length(line) + 1 AS w, len(list_filter(terms, lambda t: list_contains(string_split({sql_norm('line')}, ' '), t) OR (length(t) >= 6 AND contains({sql_norm('line')}, t)))) AS s FROM ln),
cu AS (SELECT doc_id, i, s, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c1,
   coalesce(sum(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS s1 FROM sc),
wn AS (SELECT a.doc_id, a.i - 1 AS first, greatest(coalesce(max(b.i), a.i - 1), a.i - 1) AS last, CASE WHEN max(b.i) IS NULL THEN a.s ELSE max(b.s1) - a.s0 END AS score
  FROM cu a LEFT JOIN cu b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.c1 <= a.c0 + 697 GROUP BY a.doc_id, a.i, a.s, a.s0)"""
query("w10_best_window", "WITH" + _DQ + " SELECT doc_id, first, last, score FROM wn QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) = 1")(
    lambda s, p: x.best_windows(_doc_queries(s, p).withColumn("text", F.btrim("text", F.lit("\n"))), ["doc_id"], "text", "terms", 700)
    .select("doc_id", F.col("i").alias("first"), F.col("stop").alias("last"), F.col("gain").alias("score")))


def _sql_cut(src):
    """CTEs that cut `line` of src(doc_id, line, terms, lim) to `lim` around its densest region of terms."""
    return f"""
lw AS (SELECT doc_id, lim, lower(line) AS low, unnest(list_distinct(list_transform(terms, lambda t: lower(t)))) AS t FROM {src} WHERE length(line) > lim AND lim > 2),
hi AS (SELECT doc_id, lim, t, strpos(low, t) - 1 AS pos FROM lw WHERE contains(low, t)
  UNION ALL SELECT doc_id, h.lim, t, pos + strpos(substr(low, pos + 2), t) FROM hi h JOIN lw USING (doc_id, t) WHERE contains(substr(low, pos + 2), t)),
de AS (SELECT a.doc_id, a.pos, max(b.pos) - a.pos AS reach, count(*) AS n FROM (SELECT DISTINCT doc_id, lim, pos FROM hi) a JOIN hi b ON b.doc_id = a.doc_id AND b.pos BETWEEN a.pos AND a.pos + greatest(a.lim - 12, 1) GROUP BY a.doc_id, a.pos),
rg AS (SELECT * FROM de QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1),
c1 AS (SELECT doc_id, line, lim, coalesce(greatest(0, pos - greatest(lim - reach, 0) // 2), 0) AS f FROM {src} LEFT JOIN rg USING (doc_id)),
c2 AS (SELECT *, f > 0 AS l, f + lim - (f > 0)::INT < length(line) AS r FROM c1),
c3 AS (SELECT *, least(length(line), f + lim - l::INT - r::INT) AS e, lim - l::INT - r::INT AS w FROM c2),
c4 AS (SELECT *, substr(line, greatest(0, e - w) + 1, e - greatest(0, e - w)) AS b0 FROM c3),
c5 AS (SELECT *, CASE WHEN l AND strpos(b0, ' ') > 0 AND strpos(b0, ' ') - 1 < length(b0) // 4 THEN substr(b0, strpos(b0, ' ') + 1) ELSE b0 END AS b1 FROM c4),
c6 AS (SELECT *, CASE WHEN r AND contains(b1, ' ') AND length(b1) - strpos(reverse(b1), ' ') > length(b1) * 3 // 4 THEN substr(b1, 1, length(b1) - strpos(reverse(b1), ' ')) ELSE b1 END AS b2 FROM c5),
cut AS (SELECT doc_id, CASE WHEN lim <= 2 THEN substr(line, 1, greatest(lim, 0)) WHEN length(line) <= lim THEN line ELSE CASE WHEN l THEN '…' ELSE '' END || b2 || CASE WHEN r THEN '…' ELSE '' END END AS piece FROM c6)"""


query("r17_excerpt", "WITH RECURSIVE" + _DQ + """,
bw AS (SELECT doc_id, first, last, score FROM wn QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) = 1),
ss AS (SELECT doc_id, list(s ORDER BY i) AS ss FROM sc GROUP BY ALL),
k1 AS (SELECT *, string_split(text, chr(10)) AS ls, first = last AS alone FROM bw JOIN dq USING (doc_id) JOIN ss USING (doc_id) WHERE length(text) > 700),
k2 AS (SELECT *, len(ls) AS n, CASE WHEN alone THEN [] ELSE ls[first + 1:last] END AS shown, first > 0 AND (last >= len(ls) OR ss[last + 1] < ss[first]) AS up FROM k1),
k3 AS (SELECT *, 696 - length(array_to_string(shown, chr(10))) AS spare, CASE WHEN up THEN ls[first] WHEN last < n THEN ls[last + 1] END AS nb FROM k2),
k4 AS (SELECT *, coalesce(NOT alone AND score > 0 AND spare > 696 * 0.4 AND length(nb) > spare, false) AS fill FROM k3),
src AS (SELECT doc_id, terms, CASE WHEN alone THEN ls[first + 1] WHEN fill THEN nb END AS line, CASE WHEN alone THEN 696 ELSE spare - 3 END AS lim FROM k4 WHERE alone OR fill),""" + _sql_cut("src") + """
SELECT doc_id, CASE WHEN k4.doc_id IS NULL THEN dq.text WHEN alone THEN piece ELSE array_to_string(
  (CASE WHEN first - (fill AND up)::INT > 0 THEN ['…'] ELSE [] END) || (CASE WHEN fill AND up THEN [piece] ELSE [] END) || shown
  || (CASE WHEN fill AND NOT up THEN [piece] ELSE [] END) || (CASE WHEN last + (fill AND NOT up)::INT < n THEN ['…'] ELSE [] END), chr(10)) END AS excerpt
FROM dq LEFT JOIN k4 USING (doc_id) LEFT JOIN cut USING (doc_id)""")(
    lambda s, p: x.excerpts(_doc_queries(s, p), ["doc_id"], "text", F.col("terms"), 700).select("doc_id", "excerpt"))
query("w11_densest_region", "WITH RECURSIVE" + _DQ + ", src AS (SELECT doc_id, terms, replace(d.text, chr(10), ' ') AS line, 300 AS lim FROM dq JOIN documents d USING (doc_id))," + _sql_cut("src") + " SELECT doc_id, piece AS cut FROM cut")(
    lambda s, p: x.cut_lines(_doc_queries(s, p).withColumn("line", F.regexp_replace("text", "\n", " ")), ["doc_id"], budget=300).select("doc_id", "cut"))
query("f57_line_score", "WITH" + _DQ + " SELECT doc_id, i - 1 AS line, s AS score FROM sc WHERE s > 0")(
    lambda s, p: _doc_queries(s, p).select("doc_id", "terms", F.posexplode(F.split(F.btrim("text", F.lit("\n")), "\n")).alias("line", "content"))
    .withColumn("norm", a.normalise("content")).transform(lambda z: t.pin(z, words=F.split("norm", " "), whole=F.col("norm")))
    .select("doc_id", "line", F.size(F.filter("terms", lambda w: F.array_contains(F.col("words"), w) | ((F.length(w) >= 6) & F.contains(F.col("whole"), w)))).alias("score"))
    .filter("score > 0"))
query("f41_sanitize_wikilinks", with_views(["notes"], r"""SELECT rel_path, sha1(regexp_replace(regexp_replace(body, '\[\[order-' || (k - 1) || '\]\]', '<' || '<order-' || (k - 1) || '>>', 'g'), '\[\[([^\]]+)\]\]', '\1', 'g')) AS h,
  len(regexp_extract_all(body, '\[\[([^\]]+)\]\]')) - len(regexp_extract_all(body, '\[\[order-' || (k - 1) || '\]\]')) AS removed FROM notes"""))(
    lambda s, p: src.notes(s, p).select("rel_path", x.unlink(F.col("body"), F.array(F.concat(F.lit("order-"), (F.col("k") - 1).cast("string")))).alias("u"))
    .select("rel_path", F.sha1(F.encode(F.regexp_replace("u.text", r"\[\[([^\]]+)\]\]", "<<$1>>"), "UTF-8")).alias("h"), "u.removed"))

# ---- guidance ---------------------------------------------------------------


def _part_rule():
    """Path and text of a part's feedback note."""
    path = F.concat(F.lit("rules/part-"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return path, F.concat(F.lit("# Part rules\nNever ship the "), "p_name", F.lit(" without a "), F.lower("p_type"), F.lit(" receipt.\nStored in bay "), F.col("p_size").cast("string"),
                          F.lit("\nAlways verify "), "p_brand", F.lit(" invoices before paying."))


def part_rules(s, p):
    """One feedback note per part."""
    path, text = _part_rule()
    return table(s, p, "part").select("p_partkey", path.alias("rel_path"), text.alias("text"))


def action_hits(s, p):
    """Each order proposes one action; the rules of the parts it contains are the supplied notes."""
    li = table(s, p, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.col("l_partkey").alias("p_partkey")).filter("action_id is not null").distinct()
    parts = table(s, p, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    w = Window.partitionBy("action_id")
    # the parts' columns travel, the texts are put together where an order's parts have met
    named = li.join(parts, "p_partkey").withColumns({"nm": F.min("p_name").over(w), "ty": F.max("p_type").over(w), "br": F.min("p_brand").over(w)})
    action = F.concat(F.lit("shipping order-"), F.col("action_id").cast("string"), F.lit(" holding one "), "nm", F.lit(" and paying the unverified "), "br", F.lit(" invoice, "), F.lower("ty"), F.lit(" receipts missing"))
    path, text = _part_rule()
    return named.select("action_id", action.alias("action"), path.alias("rel_path"), F.lit("feedback").alias("doc_type"), text.alias("text"), F.col("p_partkey").alias("pos"))


_RULES = """
li AS (SELECT DISTINCT l_orderkey AS action_id, l_partkey AS p_partkey FROM lineitem),
acts AS (SELECT action_id, 'shipping order-' || action_id || ' holding one ' || min(p_name) || ' and paying the unverified ' || min(p_brand) || ' invoice, ' || lower(max(p_type)) || ' receipts missing' AS action FROM li JOIN part USING (p_partkey) GROUP BY action_id),
rl AS (SELECT p_partkey, 'rules/part-' || p_partkey || '.md' AS rel_path, ['Never ship the ' || p_name || ' without a ' || lower(p_type) || ' receipt.', 'Always verify ' || p_brand || ' invoices before paying.'] AS dir,
   '# Part rules' || chr(10) || 'Never ship the ' || p_name || ' without a ' || lower(p_type) || ' receipt.' || chr(10) || 'Stored in bay ' || p_size || chr(10) || 'Always verify ' || p_brand || ' invoices before paying.' AS text FROM part),
rt AS (SELECT p_partkey, """ + sql_rule_tokens("text") + """ AS toks FROM rl),
rd AS (SELECT p_partkey, rel_path, unnest(dir) AS line, generate_subscripts(dir, 1) AS line_no FROM rl),
rdt AS (SELECT *, """ + sql_rule_tokens("line") + """ AS r FROM rd),
atk AS (SELECT action_id, action, """ + sql_rule_tokens("action") + """ AS a FROM acts),
nn AS (SELECT action_id, count(*) AS n FROM li GROUP BY ALL),
idf AS (SELECT action_id, token, ln((max(n) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT action_id, unnest(toks) AS token FROM li JOIN rt USING (p_partkey)) JOIN nn USING (action_id) GROUP BY action_id, token),
dflt AS (SELECT action_id, max(idf) AS d FROM idf GROUP BY ALL),
pr AS (SELECT li.action_id, rdt.p_partkey AS pos, rel_path, line, line_no, a, r,
   list_filter(a, lambda x: len(list_filter(r, lambda y: x = y OR (length(x) >= 5 AND length(y) >= 5 AND (contains(x, y) OR contains(y, x))))) > 0) AS m
  FROM li JOIN rdt USING (p_partkey) JOIN atk USING (action_id)),
ws AS (SELECT action_id, pos, line_no, side, sum(coalesce(idf, d)) AS w FROM (
   SELECT action_id, pos, line_no, 'a' AS side, unnest(a) AS token FROM pr UNION ALL SELECT action_id, pos, line_no, 'r', unnest(r) FROM pr UNION ALL SELECT action_id, pos, line_no, 'm', unnest(m) FROM pr)
   LEFT JOIN idf USING (action_id, token) JOIN dflt USING (action_id) GROUP BY ALL),
sc AS (SELECT pr.*, m.w / least(x.w, y.w) AS score FROM pr JOIN ws m ON (m.action_id, m.pos, m.line_no, m.side) = (pr.action_id, pr.pos, pr.line_no, 'm')
   JOIN ws x ON (x.action_id, x.pos, x.line_no, x.side) = (pr.action_id, pr.pos, pr.line_no, 'a') JOIN ws y ON (y.action_id, y.pos, y.line_no, y.side) = (pr.action_id, pr.pos, pr.line_no, 'r') WHERE len(pr.m) > 0),
warn AS (SELECT action_id, row_number() OVER (PARTITION BY action_id ORDER BY round(score, 9) DESC, pos, line_no) AS rank, rel_path, line, array_to_string(list_sort(m), ', ') AS matched, score FROM sc WHERE round(score, 9) >= 0.3
   QUALIFY row_number() OVER (PARTITION BY action_id ORDER BY round(score, 9) DESC, pos, line_no) <= 5)"""
query("r20_action_check", "WITH" + _RULES + " SELECT action_id, rank, rel_path, line, matched, round(score, 6) AS score FROM warn")(
    lambda s, p: ru.check_actions(action_hits(s, p)).withColumn("score", F.round("score", 6)))
query("t05_top_warnings", "WITH" + _RULES + " SELECT action_id, count(*) AS n FROM warn GROUP BY ALL")(
    lambda s, p: ru.check_actions(action_hits(s, p)).groupBy("action_id").agg(F.count(F.lit(1)).alias("n")))
query("a03_rule_idf", "WITH" + _RULES + " SELECT action_id, token, round(idf, 6) AS idf, round(d, 6) AS default_idf FROM idf JOIN dflt USING (action_id)")(
    lambda s, p: ru.rule_idf(action_hits(s, p)).select("action_id", "token", F.round("idf", 6).alias("idf"), F.round("default_idf", 6).alias("default_idf")))
query("a17_detector_rates", "WITH" + _RULES + " SELECT o_orderstatus AS label, count(*) AS cases, round(avg((o_orderkey IN (SELECT action_id FROM warn))::INT), 6) AS rate FROM orders GROUP BY ALL")(
    lambda s, p: ru.detector_rates(table(s, p, "orders").select(F.col("o_orderkey").alias("action_id"), F.col("o_orderstatus").alias("label")), ru.check_actions(action_hits(s, p))))
_CORE = "Never ship a missing receipt.\nKeep calm."
query("r21_core_rules", "WITH" + _RULES + f""", ct AS (SELECT {sql_rule_tokens("'Never ship a missing receipt.'")} AS r)
 SELECT action_id, array_to_string(list_sort(list_filter(a, lambda x: len(list_filter(r, lambda y: x = y OR (length(x) >= 5 AND length(y) >= 5 AND (contains(x, y) OR contains(y, x))))) > 0)), ', ') AS matched FROM atk, ct""")(
    lambda s, p: ru.check_actions(ru.core_rules(_CORE, action_hits(s, p).select("action_id", "action").distinct())).select("action_id", "matched"))


def _tokens(d, column):
    return d.select(g.rule_tokens(column).alias("tokens")).select(F.explode("tokens").alias("token"))


_VOC = "WITH" + _RULES + """, va AS (SELECT DISTINCT unnest(a) AS a FROM atk), vr AS (SELECT DISTINCT unnest(toks) AS r FROM rt)
SELECT a, r FROM va, vr WHERE a = r OR (length(a) >= 5 AND length(r) >= 5 AND (contains(a, r) OR contains(r, a)))"""
query("j14_related_tokens", _VOC)(lambda s, p: (lambda h: ru.related_vocabulary(
    _tokens(h.select("action_id", "action").distinct(), "action"), _tokens(part_rules(s, p), "text")))(action_hits(s, p)))


def _suggest_hits(s, p):
    """Each conversation turn against the notes of the order with its number."""
    tt = _turns(s, p).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", (F.col("conv_id") * 7 + F.col("turn")).alias("k"))
    n = src.docs(s, p).select("k", "rel_path", "title")
    return tt, tt.select("query_id", "k").join(n, "k").select("query_id", F.lit(1).alias("rank"), F.concat(F.lit("remember/decided-please-"), "rel_path").alias("rel_path"), "title")


_SUG = f"""WITH {_SQL_TURNS}, {_SQL_SCORED}, w AS (SELECT conv_id * 1000 + turn AS query_id, conv_id * 7 + turn AS k, kind, round(least(score, 1), 6) AS confidence, score,
  kind || '_' || array_to_string(regexp_extract_all(lower(left(string_split(trim(text), chr(10))[1], 80)), '[A-Za-z0-9]+')[1:6], '-') AS slug FROM scored), """
query("r22_create_or_amend", with_views(["docs"], """SELECT query_id, confidence, kind AS type, slug, CASE WHEN shared >= 2 THEN 'amend' ELSE 'create' END AS action, CASE WHEN shared >= 2 THEN path ELSE kind || '-' || slug || '.md' END AS target FROM (
  SELECT w.*, 'remember/decided-please-' || rel_path AS path, len(list_intersect(list_distinct(regexp_extract_all(lower(w.slug), '[a-z0-9]{4,}')), list_distinct(regexp_extract_all(lower('remember/decided-please-' || rel_path || ' ' || title), '[a-z0-9]{4,}')))) AS shared
  FROM w LEFT JOIN docs ON docs.k = w.k WHERE round(least(score, 1), 9) >= 0.5)""", _SUG[5:].rstrip(", ")))(
    lambda s, p: (lambda tt, hh: ru.suggest(tt, hh).withColumn("confidence", F.round("confidence", 6)))(*_suggest_hits(s, p)))
query("u07_amend_words", with_views(["docs"], """SELECT k, len(list_intersect(list_distinct(regexp_extract_all(lower('project_' || title || ' ledger'), '[a-z0-9]{4,}')), list_distinct(regexp_extract_all(lower(rel_path), '[a-z0-9]{4,}')))) >= 2 AS amend FROM docs"""))(
    lambda s, p: src.docs(s, p).select("k", (F.size(F.array_intersect(g.long_words(F.concat(F.lit("project_"), "title", F.lit(" ledger"))), g.long_words("rel_path"))) >= 2).alias("amend")))

_ZORD = f"z AS (SELECT *, k // 100 AS query_id, floor(k / 10) AS bucket, CASE evidence WHEN 'observed' THEN '1' WHEN 'sourced' THEN '2' WHEN 'synthesized' THEN '3' ELSE '6' END AS cred, {sql_is_abstraction('doc_type', 'slug')} AS made FROM docs)"


def _tied(s, p):
    k = F.col("k")
    return src.docs(s, p).withColumns({
        "query_id": F.floor(k / 100), "score": F.lit(1.0) / (F.floor(k / 10) + 1), "pos": (k + 1).cast("int"), "boosts": F.create_map().cast("map<string,double>"),
        "recency": F.lit(False), "query": F.lit("the invoice"), "chunk_id": k}).withColumn("k", F.lit(1 << 30))


query("z06_grade_tiebreak", with_views(["docs"], """SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, cred, chunk_id) AS rank FROM (
  SELECT *, k AS chunk_id, round(1.0::DOUBLE / (bucket + 1), 6) AS sc, sum(made::INT) OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (bucket + 1), 6) DESC, cred, k) AS n_made FROM z) WHERE NOT made OR n_made <= 2""", _ZORD))(
    lambda s, p: R.assemble(_tied(s, p), DEFAULTS, evidence_tiebreak=True).select("query_id", "chunk_id", "rank"))
