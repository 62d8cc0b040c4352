"""Incremental import, index currency, belief graph and staleness audits."""

from pyspark.sql import functions as F

from ..functions import dating as d
from ..functions import records as r
from ..functions import text as t
from ..operators import graph as g
from ..operators import incremental as inc
from ..operators import vectors as vx
from ..session import cut, written
from ..sources import corpus as c
from ..sources import notes as src
from .catalog import query, table
from .oracle_views import sql_claim, sql_days, sql_expired, sql_iso, sql_open_lines, sql_volatility, with_views

# ---- a second wave of the note files ---------------------------------------
# k%20: 0 edited body, 1 edited class only, 2 removed, 3 arrived later, 4 no longer covered by a source.


def stored_docs(s, p):
    return src.docs(s, p).filter("k % 20 <> 3")


def offered_docs(s, p):
    k = F.col("k")
    dd = src.docs(s, p).filter("k % 20 not in (2, 4)")
    dd = dd.withColumn("body", F.when(k % 20 == 0, F.concat("body", F.lit("\nEdited [[order-1]]."))).otherwise(F.col("body")))
    return dd.withColumns({
        "doc_hash": t.doc_hash("body"),
        "disclosure": F.when(k % 20 == 1, F.lit("private")).otherwise(F.col("disclosure")),
        "metadata": F.when(k % 20 == 1, F.lit("{}")).otherwise(F.col("metadata")),
    })


def existing_files(s, p):
    return src.docs(s, p).filter("k % 20 <> 2").select("abs_path")


WAVES = """
stored AS (SELECT * FROM docs WHERE k % 20 <> 3),
offered AS (SELECT * REPLACE (CASE WHEN k % 20 = 0 THEN body || chr(10) || 'Edited [[order-1]].' ELSE body END AS body,
  CASE WHEN k % 20 = 0 THEN sha1(body || chr(10) || 'Edited [[order-1]].') ELSE doc_hash END AS doc_hash,
  CASE WHEN k % 20 = 1 THEN 'private' ELSE disclosure END AS disclosure) FROM docs WHERE k % 20 NOT IN (2, 4))"""


def _q(name, views, sql, fn, extra=""):
    query(name, with_views(views, sql, extra))(fn)


_q("s03_doc_upsert", ["docs"], "SELECT rel_path, doc_hash, disclosure FROM stored WHERE rel_path NOT IN (SELECT rel_path FROM offered) UNION ALL SELECT rel_path, doc_hash, disclosure FROM offered",
   lambda s, p: inc.upsert(stored_docs(s, p), offered_docs(s, p), "rel_path").select("rel_path", "doc_hash", "disclosure"), WAVES)
_CHANGE = "CASE k % 20 WHEN 3 THEN 'new' WHEN 0 THEN 'updated' WHEN 1 THEN 'meta' ELSE 'unchanged' END"
_q("s04_change_classes", ["docs"], f"SELECT rel_path, {_CHANGE} AS change FROM offered",
   lambda s, p: inc.classify_changes(stored_docs(s, p), offered_docs(s, p)).select("rel_path", "change"), WAVES)
_q("a20_import_counters", ["docs"], f"SELECT {_CHANGE} AS change, count(*) AS n FROM offered GROUP BY ALL",
   lambda s, p: inc.import_counters(inc.classify_changes(stored_docs(s, p), offered_docs(s, p))), WAVES)
_q("f17_metadata_differs", ["docs"], "SELECT rel_path, k % 20 = 1 AS differs FROM offered WHERE k % 20 <> 3",
   lambda s, p: stored_docs(s, p).alias("o").join(offered_docs(s, p).alias("n"), F.col("o.rel_path") == F.col("n.rel_path"))
   .select("o.rel_path", inc.metadata_differs("o", "n").alias("differs")), WAVES)
_q("s05_delete_doc_chunks", ["docs"], "SELECT doc_id AS chunk_id FROM documents JOIN notes ON notes.k = doc_id WHERE doc_id % 20 NOT IN (0, 3)",
   lambda s, p: inc.delete_doc_chunks(c.chunks(s, p), inc.classify_changes(stored_docs(s, p), offered_docs(s, p)).filter("change in ('new', 'updated')")).select("chunk_id"))
_q("s06_prune_missing", ["docs"], "SELECT rel_path FROM stored WHERE k % 20 = 2",
   lambda s, p: inc.prune_missing(stored_docs(s, p), existing_files(s, p)), WAVES)
_q("s07_rebuild_links", ["docs", "links"], """SELECT src_path, tgt_raw FROM links WHERE src_path IN (SELECT rel_path FROM stored)
   UNION SELECT rel_path, 'order-1' FROM offered WHERE k % 20 = 0""",
   lambda s, p: (lambda up: inc.replace_edges(src.links(stored_docs(s, p)), up, src.links(up)).select("src_path", "tgt_raw"))(
       offered_docs(s, p).join(inc.classify_changes(stored_docs(s, p), offered_docs(s, p)).filter("change = 'updated'").select("rel_path"), "rel_path", "left_semi")), WAVES)
_q("s08_rebuild_supersessions", ["docs", "supersessions"], """SELECT src_path, tgt_slug FROM supersessions WHERE src_path IN (SELECT rel_path FROM stored UNION SELECT rel_path FROM offered)""",
   lambda s, p: inc.replace_edges(src.supersessions(stored_docs(s, p)), offered_docs(s, p), src.supersessions(offered_docs(s, p))).select("src_path", "tgt_slug"), WAVES)


def _belief_wave(s, p):
    """k%4=0 promoted later, k%4=1 unreadable metadata, k%4=2 no longer a belief."""
    b = src.beliefs(s, p)
    fresh = b.filter("k % 4 in (0, 3)").withColumn("state", F.when(F.col("k") % 4 == 0, F.lit("promoted")).otherwise(F.col("state")))
    docs = b.select("rel_path", (F.col("k") % 4 != 1).alias("metadata_ok"))
    return b, docs, fresh


_q("s09_belief_projection", ["beliefs"], "SELECT belief_id, CASE WHEN k % 4 = 0 THEN 'promoted' ELSE state END AS state FROM beliefs WHERE k % 4 <> 2",
   lambda s, p: inc.project_beliefs(*_belief_wave(s, p)).select("belief_id", "state"))
_q("s10_belief_upsert", ["beliefs"], "SELECT CASE WHEN k % 4 = 0 THEN belief_id || '-renamed' ELSE belief_id END AS belief_id, rel_path FROM beliefs",
   lambda s, p: inc.replace_beliefs(src.beliefs(s, p), src.beliefs(s, p).filter("k % 4 = 0").withColumn("belief_id", F.concat("belief_id", F.lit("-renamed")))).select("belief_id", "rel_path"))
_q("s10_evidence_replace", ["belief_evidence"], """SELECT belief_id, ref FROM belief_evidence e JOIN beliefs USING (belief_id) WHERE k % 4 <> 0
   UNION ALL SELECT DISTINCT belief_id, 'order-0' FROM beliefs WHERE k % 4 = 0""",
   lambda s, p: (lambda b, e: inc.replace_evidence(e, b, b.select("belief_id", F.lit("order-0").alias("ref"), F.lit("link").alias("kind"), F.lit(True).alias("verified"), F.lit("order-0").alias("slug"))))(
       src.beliefs(s, p).filter("k % 4 = 0"), src.belief_evidence(s, p)).select("belief_id", "ref"))


def _ctx_chunks(s, p):
    k = F.col("chunk_id")
    return c.chunks(s, p).withColumns({"context": F.when(k % 2 == 0, F.lit("Ledger")).otherwise(F.lit("")), "heading_path": F.when(k % 3 == 0, F.concat(F.lit("H "), k.cast("string"))).otherwise(F.lit(""))})


_IDX = "concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN 'Ledger' END, CASE WHEN doc_id % 3 = 0 THEN 'H ' || doc_id END, text)"
_q("s11_index_text", ["notes"], f"SELECT doc_id AS chunk_id, sha1({_IDX}) AS h FROM documents JOIN notes ON notes.k = doc_id",
   lambda s, p: _ctx_chunks(s, p).select("chunk_id", F.sha1(F.encode(t.index_text("text", "context", "heading_path"), "UTF-8")).alias("h")))
_q("p11_embed_text", ["notes"], f"SELECT doc_id AS chunk_id, sha1({_IDX}) AS h FROM documents JOIN notes ON notes.k = doc_id",
   lambda s, p: _ctx_chunks(s, p).select("chunk_id", F.sha1(F.encode(t.embed_text("text", "context", "heading_path"), "UTF-8")).alias("h")))
query("s12_stale_chunks", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")(
    lambda s, p: vx.stale_chunks(table(s, p, "documents").select(F.col("doc_id").alias("chunk_id")), c.vectors(s, p)).select("chunk_id"))
query("s13_write_embeddings", "SELECT vec_id AS chunk_id, label % 2 = 0 AS replaced, 64 AS dim FROM embeddings")(
    lambda s, p: vx.write_embeddings(
        c.vectors(s, p).withColumn("replaced", F.lit(False)),
        table(s, p, "embeddings").filter("label % 2 = 0").select(F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(True).alias("replaced")), 64)
    .select("chunk_id", "replaced", F.size("embedding").alias("dim")))
query("s14_reset_vectors", "SELECT doc_id AS chunk_id, false AS embedded FROM documents")(
    lambda s, p: vx.reset_vectors(table(s, p, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit(True).alias("embedded")), c.vectors(s, p))[0])
query("j10_true_coverage", "SELECT count(*) AS chunks, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS embedded FROM documents")(
    lambda s, p: table(s, p, "documents").agg(F.count(F.lit(1)).alias("chunks")).withColumn(
        "embedded", table(s, p, "documents").join(c.vectors(s, p), F.col("doc_id") == F.col("chunk_id"), "left_semi").agg(F.count(F.lit(1))).scalar()))
_EMBEDDED = r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)),
h AS (SELECT doc_id, ('0x' || left(md5(word), 8))::BIGINT AS h FROM w WHERE word <> ''),
b AS (SELECT doc_id, h % 64 AS bucket, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL),
s AS (SELECT doc_id, sqrt(sum(v * v)) AS length, count(*) FILTER (v > 0) AS n_positive, count(*) FILTER (v < 0) AS n_negative, max(abs(v)) AS most FROM b GROUP BY doc_id)
SELECT d.doc_id AS chunk_id, 64 AS dim, CASE WHEN length > 0 THEN 1.0 ELSE 0.0 END AS norm, coalesce(n_positive, 0) AS n_positive, coalesce(n_negative, 0) AS n_negative,
  (SELECT min(bucket) FROM b WHERE b.doc_id = d.doc_id AND abs(b.v) = s.most AND most > 0) AS strongest
FROM documents d LEFT JOIN s USING (doc_id) WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings)"""
query("r24_batch_embedding", _EMBEDDED)(lambda s, p: vx.embed(
    vx.stale_chunks(table(s, p, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), c.vectors(s, p)), vx.encoder("hash", 64), 64,
    {"model": "hash", "provider": "built-in"}, {"dim": 64, "model": "hash", "provider": "built-in"})
    .withColumn("most", F.array_max(F.transform("embedding", F.abs)))
    .select("chunk_id", F.size("embedding").alias("dim"), F.round(vx.norm("embedding"), 4).alias("norm"),
            F.size(F.filter("embedding", lambda x: x > 0)).alias("n_positive"), F.size(F.filter("embedding", lambda x: x < 0)).alias("n_negative"),
            F.when(F.col("most") > 0, F.array_position(F.transform("embedding", F.abs), F.col("most")) - 1).alias("strongest")))
query("f58_unit_and_cosine", """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS square, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS mirrored FROM embeddings""")(
    lambda s, p: table(s, p, "embeddings").select("vec_id", F.round(F.pow(vx.norm("embedding"), 2), 4).alias("square"), F.round(vx.cosine("embedding", F.reverse("embedding")), 6).alias("mirrored")))

# ---- currency --------------------------------------------------------------

_STATE = "CASE k % 20 WHEN 0 THEN 'CHANGED' WHEN 1 THEN 'METADATA' WHEN 2 THEN '{}' WHEN 3 THEN 'UNINDEXED' WHEN 4 THEN '{}' ELSE 'CURRENT' END"


def _survey(s, p, missing=()):
    return inc.survey(stored_docs(s, p), offered_docs(s, p), existing_files(s, p), missing)


_q("q02_index_currency", ["docs"], f"SELECT rel_path, {_STATE.format('ORPHANED', 'UNREACHABLE')} AS state FROM docs", lambda s, p: _survey(s, p))
_q("j11_disk_against_index", ["docs"], f"""SELECT rel_path, CASE WHEN k % 20 IN (2, 4) AND starts_with(rel_path, '_archive/') THEN 'UNCHECKED' ELSE {_STATE.format('ORPHANED', 'UNREACHABLE')} END AS state FROM docs""",
   lambda s, p: _survey(s, p, ("/corpus/_archive",)))
_COUNTS = ", ".join(f"count(*) FILTER (state = '{x}') AS {x.lower()}" for x in ("CHANGED", "METADATA", "UNINDEXED", "ORPHANED", "UNREACHABLE", "UNCHECKED", "CURRENT"))
_q("a12_currency_summary", ["docs"], f"SELECT {_COUNTS}, count(*) FILTER (state IN ('CHANGED', 'METADATA', 'UNINDEXED', 'ORPHANED')) AS divergent, false AS is_current FROM (SELECT {_STATE.format('ORPHANED', 'UNREACHABLE')} AS state FROM docs)",
   lambda s, p: inc.survey_summary(_survey(s, p)))
_q("s17_currency_report", ["docs"], f"SELECT state, count(*) AS n, min(rel_path) AS first_path FROM (SELECT rel_path, {_STATE.format('ORPHANED', 'UNREACHABLE')} AS state FROM docs) GROUP BY ALL",
   lambda s, p: _survey(s, p).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("first_path")))
_q("u03_indexed_except_seen", ["docs"], "SELECT rel_path FROM docs WHERE k % 20 IN (2, 4)",
   lambda s, p: stored_docs(s, p).select("rel_path").join(offered_docs(s, p).select("rel_path"), "rel_path", "left_anti"))
query("u06_source_coverage", "SELECT c_mktsegment AS root, c_mktsegment IN ('FURNITURE', 'MACHINERY') AS stranded FROM (SELECT DISTINCT c_mktsegment FROM customer)")(
    lambda s, p: table(s, p, "customer").select("c_mktsegment").distinct().select(
        F.col("c_mktsegment").alias("root"),
        (F.size(inc.uncovered_roots(F.array("c_mktsegment"), F.array(F.lit("BUILDING"), F.lit("HOUSEHOLD"), F.lit("AUTOMOBILE")))) > 0).alias("stranded")))


def _manifests(s, p):
    """One manifest per part: what the stored index was built with."""
    size = F.col("p_size")
    return table(s, p, "part").select(
        "p_partkey",
        F.when(size % 4 == 0, F.lit(None).cast("int")).when(size % 4 == 1, F.lit(128)).otherwise(F.lit(64)).alias("stored_dim"),
        F.when(size % 4 == 2, F.lit("m1")).otherwise(F.lit("m0")).alias("stored_model"), F.lit("local").alias("stored_provider"),
        F.when(size % 3 == 0, F.lit(None).cast("string")).when(size % 3 == 1, F.lit("30:512:64:0:words")).otherwise(
            inc.chunker_fingerprint(F.lit("3"), F.lit("512"), F.lit("64"), F.lit(False))).alias("stored_cut"))


_SQL_STATUS = "CASE p_size % 4 WHEN 0 THEN 'unset' WHEN 1 THEN 'dim_changed' WHEN 2 THEN 'model_changed' ELSE 'match' END"
_SQL_DRIFT = "CASE p_size % 3 WHEN 0 THEN 'unset' WHEN 1 THEN '30:512:64:0:words != 3:512:64:0:words' ELSE 'match' END"


def _status():
    return vx.embedding_status(F.lit(64), F.lit("m0"), F.lit("local"), F.col("stored_dim"), F.col("stored_model"), F.col("stored_provider"))


def _drift():
    return inc.chunker_drift(inc.chunker_fingerprint(F.lit("3"), F.lit("512"), F.lit("64"), F.lit(False)), F.col("stored_cut"))


query("f13_chunker_fingerprint", f"SELECT p_partkey, {_SQL_DRIFT} AS drift FROM part")(lambda s, p: _manifests(s, p).select("p_partkey", _drift().alias("drift")))
query("f14_embedding_status", f"SELECT p_partkey, {_SQL_STATUS} AS status FROM part")(lambda s, p: _manifests(s, p).select("p_partkey", _status().alias("status")))
query("q03_fingerprint_drift", f"SELECT {_SQL_STATUS} AS status, {_SQL_DRIFT} AS drift, count(*) AS n FROM part GROUP BY ALL")(
    lambda s, p: _manifests(s, p).groupBy(_status().alias("status"), _drift().alias("drift")).agg(F.count(F.lit(1)).alias("n")))

_q("a01_corpus_stats", ["docs", "links"], """SELECT (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM docs WHERE is_priority) AS priority_docs, (SELECT count(*) FROM documents) AS chunks,
  (SELECT count(*) FROM documents WHERE doc_id % 3 > 0) AS embedded_flagged, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS embedded,
  (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM documents WHERE doc_id % 5 > 0) AS archives,
  round((SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) * 100.0 / (SELECT count(*) FROM documents), 6) AS coverage_pct""",
   lambda s, p: inc.corpus_stats(
       src.docs(s, p), table(s, p, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 3 > 0).alias("embedded")), c.vectors(s, p),
       src.links(src.notes(s, p)), table(s, p, "documents").select((F.col("doc_id") % 5 == 0).alias("shredded"))))
_q("a19_link_resolution", ["docs", "links"], """SELECT count(*) AS links, count(*) FILTER (tgt_slug IN (SELECT slug FROM docs)) AS resolved,
   round(count(*) FILTER (tgt_slug IN (SELECT slug FROM docs)) / count(*), 6) AS rate FROM links""",
   lambda s, p: inc.resolution_rate(src.links(src.notes(s, p)), src.docs(s, p)))
_q("u04_resolvable_slugs", ["docs", "beliefs"], "SELECT slug FROM docs UNION SELECT belief_id FROM beliefs",
   lambda s, p: src.docs(s, p).select("slug").union(src.beliefs(s, p).select("belief_id")).distinct())
_q("g08_dangling_links", ["docs", "links"], "SELECT tgt_slug AS slug, count(*) AS edges FROM links WHERE tgt_slug <> '' AND tgt_slug NOT IN (SELECT slug FROM docs) GROUP BY ALL",
   lambda s, p: g.dangling_targets(src.links(src.notes(s, p)), src.docs(s, p)))
_q("z05_one_way_references", ["docs", "links"], "SELECT src_slug, tgt_slug FROM e WHERE src_slug <> tgt_slug EXCEPT SELECT tgt_slug, src_slug FROM e",
   lambda s, p: g.one_way_links(src.links(src.notes(s, p)), src.docs(s, p)),
   "e AS (SELECT DISTINCT d.slug AS src_slug, l.tgt_slug FROM links l JOIN docs d ON d.rel_path = l.src_path WHERE l.tgt_slug IN (SELECT slug FROM docs))")

# ---- belief graph ----------------------------------------------------------

GRAPH_VIEWS = ["docs", "beliefs", "belief_evidence", "supersessions"]
_EDGES = """
edges AS (SELECT e.belief_id, e.ref, e.slug, b.state, CASE WHEN kind = 'external' THEN (CASE WHEN verified THEN 'attested' ELSE 'unattested' END)
    WHEN b.state IS NULL AND d.slug IS NULL THEN 'unresolved' WHEN b.state IS NULL THEN 'observation' WHEN b.state IN ('draft', 'retracted') THEN 'unsound' ELSE 'belief' END AS target,
    CASE WHEN kind = 'link' AND b.state IS NULL AND d.k % 3 = 0 THEN 'p' || (d.k % 4) ELSE '' END AS author
  FROM belief_evidence e LEFT JOIN beliefs b ON b.belief_id = e.slug LEFT JOIN docs d ON d.slug = e.slug AND e.slug <> ''),
reach(start, node) AS (SELECT belief_id, belief_id FROM beliefs UNION SELECT r.start, e.slug FROM reach r JOIN edges e ON e.belief_id = r.node WHERE e.target = 'belief'),
hop(node, dd) AS (SELECT DISTINCT belief_id, 1 FROM edges WHERE target IN ('attested', 'observation') UNION SELECT e.belief_id, h.dd + 1 FROM hop h JOIN edges e ON e.slug = h.node AND e.target = 'belief' WHERE h.dd < 300),
arr AS (SELECT r.start AS belief_id, e.target, CASE WHEN e.target IN ('attested', 'unattested', 'unresolved') THEN e.ref ELSE e.slug END AS item, e.author, e.state FROM reach r JOIN edges e ON e.belief_id = r.node),
per AS (SELECT belief_id, target, item, count(*) AS times, max(author) AS author, max(state) AS state FROM arr GROUP BY ALL),
summary AS (SELECT b.belief_id, CASE WHEN confidence = 'high' OR impact = 'action' THEN 2 ELSE 1 END AS need, min(h.dd) AS depth,
    count(DISTINCT item) FILTER (target IN ('attested', 'observation')) AS n_roots,
    count(DISTINCT item) FILTER (target IN ('attested', 'observation') AND p.author <> b.persona) AS n_independent,
    count(DISTINCT item) FILTER (target = 'unresolved') AS n_unresolved, count(DISTINCT item) FILTER (target = 'unattested') AS n_unattested,
    count(DISTINCT item) FILTER (target = 'unsound') AS n_unsound, count(DISTINCT item) FILTER (target = 'belief' AND (times > 1 OR item = p.belief_id)) AS n_cycle
  FROM beliefs b LEFT JOIN per p USING (belief_id) LEFT JOIN (SELECT node AS belief_id, min(dd) AS dd FROM hop GROUP BY ALL) h USING (belief_id) GROUP BY b.belief_id, b.confidence, b.impact)"""


def _doc_authors(s, p):
    k = F.col("k")
    return src.docs(s, p).select("slug", F.when(k % 3 == 0, F.concat(F.lit("p"), (k % 4).cast("string"))).otherwise(F.lit("")).alias("author"))


def _edges(s, p, evidence=None, beliefs=None):
    evidence, beliefs = (src.belief_evidence(s, p) if evidence is None else evidence), (src.beliefs(s, p) if beliefs is None else beliefs)
    return cut(g.resolve_evidence(evidence, _doc_authors(s, p), beliefs))


_q("j13_resolve_evidence", GRAPH_VIEWS, "SELECT belief_id, ref, target FROM edges",
   lambda s, p: g.resolve_evidence(src.belief_evidence(s, p), _doc_authors(s, p), src.beliefs(s, p)).select("belief_id", "ref", "target"), _EDGES)
_q("j17_evidence_closure", GRAPH_VIEWS, "SELECT start, node FROM reach", lambda s, p: g.reach(_edges(s, p), src.beliefs(s, p)).select("start", "node"), _EDGES)
_SUMMARY = ["belief_id", "need", "depth", "n_roots", "n_independent", "n_unresolved", "n_unattested", "n_unsound", "n_cycle"]
_q("g01_grounding", GRAPH_VIEWS, f"SELECT {', '.join(_SUMMARY)} FROM summary",
   lambda s, p: (lambda e, b: g.ground_summary(b, g.ground(e, b)).select(*_SUMMARY))(_edges(s, p), src.beliefs(s, p)), _EDGES)
_q("u05_root_set", GRAPH_VIEWS, "SELECT DISTINCT belief_id, item FROM per WHERE target IN ('attested', 'observation')",
   lambda s, p: g.ground(_edges(s, p), src.beliefs(s, p)).filter("category = 'root'").select("belief_id", "item"), _EDGES)
_q("a08_corroboration", GRAPH_VIEWS, "SELECT belief_id, n_roots, n_independent, n_roots >= need AND n_independent > 0 AS corroborated FROM summary",
   lambda s, p: (lambda e, b: g.ground_summary(b, g.ground(e, b)).select("belief_id", "n_roots", "n_independent", ((F.col("n_roots") >= F.col("need")) & (F.col("n_independent") > 0)).alias("corroborated")))(_edges(s, p), src.beliefs(s, p)), _EDGES)
_RIVALS = """SELECT a.belief_id, count(*) AS n_rivals FROM beliefs a JOIN beliefs b ON a.subject = b.subject AND b.state = 'promoted' AND a.belief_id <> b.belief_id
   WHERE NOT EXISTS (SELECT 1 FROM supersessions s WHERE s.src_path = a.rel_path AND s.tgt_slug = b.belief_id) GROUP BY ALL"""
_q("j12_subject_rivals", GRAPH_VIEWS, _RIVALS, lambda s, p: g.rivals(src.beliefs(s, p), src.supersessions(src.notes(s, p))))
_GATE = _EDGES + f""",
rv AS ({_RIVALS}),
checks AS (SELECT b.belief_id, b.impact, b.persona, b.countersigned_by, [n_unresolved + n_unattested = 0 AND c.n_cited > 0, n_cycle + n_unsound = 0, coalesce(depth <= 3, false), n_roots >= need AND n_independent > 0,
    coalesce(n_rivals, 0) = 0, c.n_cited > 0, verify_by::DATE >= DATE '2001-08-02'] AS ok
  FROM beliefs b JOIN summary USING (belief_id) LEFT JOIN rv USING (belief_id) LEFT JOIN (SELECT belief_id, count(*) AS n_cited FROM belief_evidence GROUP BY ALL) c USING (belief_id)),
codes AS (SELECT belief_id, 'G' || i AS code, coalesce(ok[i], false) AS passed FROM checks, range(1, 8) t(i)
  UNION ALL SELECT belief_id, 'G7a', countersigned_by <> '' AND countersigned_by <> persona FROM checks WHERE impact = 'action')"""


def _gate(s, p, some="true"):
    """The gate over derived tables that are written once, as a job would find them."""
    b, e = written(src.beliefs(s, p), "beliefs"), written(src.belief_evidence(s, p), "evidence")
    return g.gate(b, e, _edges(s, p, e, b), written(src.supersessions(src.notes(s, p)), "supersessions"), src.TODAY, asked=b.filter(some))


_q("g02_gate_details", GRAPH_VIEWS, """SELECT belief_id, CASE WHEN target IN ('unresolved', 'unattested') THEN 'G1' ELSE 'G2' END AS code, CASE WHEN target = 'unsound' THEN item || ' (' || state || ')' ELSE item END AS item FROM per
   WHERE target IN ('unresolved', 'unattested', 'unsound') OR (target = 'belief' AND (times > 1 OR item = belief_id))
   UNION ALL SELECT a.belief_id, 'G5', b.belief_id FROM beliefs a JOIN beliefs b ON a.subject = b.subject AND a.subject <> '' AND b.state = 'promoted' AND a.belief_id <> b.belief_id
   WHERE NOT EXISTS (SELECT 1 FROM supersessions s WHERE s.src_path = a.rel_path AND s.tgt_slug = b.belief_id)""",
   lambda s, p: (lambda b: g.gate_details(b, g.ground(_edges(s, p), b), src.supersessions(src.notes(s, p))))(src.beliefs(s, p)), _EDGES)


_q("g02_promotion_gate", GRAPH_VIEWS, "SELECT belief_id, code, passed FROM codes", lambda s, p: _gate(s, p).select("belief_id", "code", "passed"), _GATE)
_q("g03_promote", GRAPH_VIEWS, """SELECT belief_id, CASE WHEN state = 'draft' AND ok THEN 'promoted' ELSE state END AS state, CASE WHEN state = 'draft' AND ok THEN '2001-08-02' ELSE '' END AS promoted_at
   FROM beliefs JOIN (SELECT belief_id, bool_and(passed) AS ok FROM codes GROUP BY ALL) USING (belief_id)""",
   lambda s, p: (lambda drafts: g.promote(src.beliefs(s, p), _gate(s, p, "state = 'draft'"), drafts, src.TODAY))(src.beliefs(s, p).filter("state = 'draft'")).select("belief_id", "state", "promoted_at"), _GATE)
_CASC = """
casc(belief_id, hops) AS (SELECT belief_id, 0 FROM beliefs WHERE state = 'needs_review' UNION SELECT e.belief_id, c.hops + 1 FROM casc c JOIN belief_evidence e ON e.kind = 'link' AND e.slug = c.belief_id JOIN beliefs b ON b.belief_id = e.belief_id AND b.state = 'promoted' WHERE c.hops < 300),
targets AS (SELECT belief_id, min(hops) AS hops FROM casc WHERE hops > 0 GROUP BY ALL)"""
_q("g04_retraction_cascade", GRAPH_VIEWS, "SELECT belief_id, hops FROM targets",
   lambda s, p: g.cascade(src.beliefs(s, p), src.belief_evidence(s, p), src.beliefs(s, p).filter("state = 'needs_review'")), _CASC)
_q("g04_retract_states", GRAPH_VIEWS, "SELECT belief_id, CASE WHEN belief_id IN (SELECT belief_id FROM targets) THEN 'needs_review' WHEN state = 'needs_review' THEN 'retracted' ELSE state END AS state FROM beliefs",
   lambda s, p: g.retract(src.beliefs(s, p), src.belief_evidence(s, p), src.beliefs(s, p).filter("state = 'needs_review'")).select("belief_id", "state"), _CASC)
_q("p10_belief_list", ["beliefs"], "SELECT belief_id, persona, state FROM beliefs WHERE persona = 'p1' AND state = 'promoted' ORDER BY belief_id",
   lambda s, p: src.beliefs(s, p).filter("persona = 'p1' and state = 'promoted'").select("belief_id", "persona", "state").orderBy("belief_id"))

# ---- staleness audit -------------------------------------------------------


def audit(files, today, since=0, prefix=""):
    """(decidable, ranked, blind spot) over raw file texts: rel_path, text, mtime."""
    kept = files.filter(~t.is_archive_path("rel_path") & F.startswith("rel_path", F.lit(prefix)))
    kept, claim = kept.select("rel_path", "text", "mtime"), d.claim_date("text", "rel_path", d.epoch_to_iso("mtime"))
    # each result finds only what it needs; the dates of a text are sought once its claims are known to be open
    decidable = t.pin(kept, expired=d.expired("text", today)).filter("expired is not null").select("rel_path", "expired", d.days_since("expired", today).alias("days"))
    seen = t.pin(t.pin(kept, lines=d.open_claim_lines("text")), volatility=d.volatility("text", "lines")).filter("volatility = 'open'")
    seen = t.pin(t.pin(seen, c=claim), days=d.days_since("c.date", today))
    ranked = seen.filter(F.col("days") >= since).select(
        "rel_path", "days", "c.label", F.col("c.date").alias("claimed"), F.array_join(d.open_claims("text", lines="lines"), " / ").alias("claims"))
    undated = F.count_if(F.col("c.label").isin("file-dated", ""))
    blind = t.pin(kept, c=claim).agg(F.count(F.lit(1)).alias("scanned"), undated.alias("undated"), F.bround(undated * 100 / F.count(F.lit(1))).cast("int").alias("pct"))
    return decidable, ranked, blind


_RAW = """
files AS (SELECT k, rel_path, mtime, concat_ws(chr(10), '---', 'type: ''' || doc_type || '''', CASE WHEN claim_date <> '' THEN 'date: ' || claim_date END,
  'metadata: {disclosure: ''' || disclosure_raw || ''', evidence: ' || evidence_raw || ', type: ''' || doc_type || '''}', '---', '', body) AS text FROM notes)"""
_L, _D = sql_claim("text", "rel_path", sql_iso("mtime"))
_SEEN = _RAW + f""",
seen AS (SELECT rel_path, text, {_L} AS label, {_D} AS claimed, {sql_expired('text')} AS expired, {sql_volatility('text')} AS volatility FROM files
  WHERE NOT contains(rel_path, '_archive') AND NOT contains(rel_path, 'archived-'))"""
_q("q01_decidable", ["notes"], f"SELECT rel_path, expired, {sql_days('expired')} AS days FROM seen WHERE expired IS NOT NULL", lambda s, p: audit(src.raw_files(s, p), src.TODAY)[0], _SEEN)
_q("q01_open_claims", ["notes"], rf"""SELECT rel_path, {sql_days('claimed')} AS days, label, claimed,
   array_to_string(list_transform({sql_open_lines('text')}, lambda l: regexp_replace(l, '\s+', ' ', 'g')), ' / ') AS claims FROM seen WHERE volatility = 'open' AND {sql_days('claimed')} >= 30""",
   lambda s, p: audit(src.raw_files(s, p), src.TODAY, since=30)[1], _SEEN)
_q("a10_blind_spot", ["notes"], "SELECT count(*) AS scanned, count(*) FILTER (label IN ('file-dated', '')) AS undated, CAST(round_even(count(*) FILTER (label IN ('file-dated', '')) * 100 / count(*), 0) AS INT) AS pct FROM seen",
   lambda s, p: audit(src.raw_files(s, p), src.TODAY)[2], _SEEN)
_q("p08_staleness_filters", ["notes"], f"SELECT rel_path, {sql_days('claimed')} AS days FROM seen WHERE volatility = 'open' AND starts_with(rel_path, 'furniture/') AND {sql_days('claimed')} >= 400",
   lambda s, p: audit(src.raw_files(s, p), src.TODAY, since=400, prefix="furniture/")[1].select("rel_path", "days"), _SEEN)


def stale_list(ranked, most=None):
    """Open claims by age, oldest first; all of them unless a report asks for the first `most`. A whole order first draws
    a sample of its rows, so they are written and not found twice."""
    order, ranked = (F.desc("days"), "rel_path"), ranked.select("rel_path", "days", "claims")
    return ranked.orderBy(*order).limit(most) if most else written(ranked, "stale").orderBy(*order)


_STALE = rf"""SELECT rel_path, {sql_days('claimed')} AS days, array_to_string(list_transform({sql_open_lines('text')}, lambda l: regexp_replace(l, '\s+', ' ', 'g')), ' / ') AS claims
   FROM seen WHERE volatility = 'open' AND {sql_days('claimed')} >= 0 ORDER BY days DESC, rel_path"""
_q("t06_stale_list", ["notes"], _STALE + " LIMIT 20", lambda s, p: stale_list(audit(src.raw_files(s, p), src.TODAY)[1], 20), _SEEN)
_q("t06_stale_list_all", ["notes"], _STALE, lambda s, p: stale_list(audit(src.raw_files(s, p), src.TODAY)[1]), _SEEN)
_q("a09_newest_as_of", ["notes"], "SELECT rel_path, CASE WHEN k % 9 = 0 THEN CAST(day + 10 AS VARCHAR) END AS newest FROM notes",
   lambda s, p: src.notes(s, p).select("rel_path", F.array_max(F.regexp_extract_all("body", F.lit(d.AS_OF), F.lit(1))).alias("newest")))
_q("q04_record_pack", ["notes"], "SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN claim_date = '' THEN 'no-date' END, CASE evidence_raw WHEN 'observed' THEN 'observed-shipped' WHEN 'guess' THEN 'no-evidence' END], lambda x: x IS NOT NULL)) AS rule FROM notes) GROUP BY ALL",
   lambda s, p: src.notes(s, p).select(F.explode(r.record_violations("rel_path", "claim_date", "evidence_raw")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n")))
