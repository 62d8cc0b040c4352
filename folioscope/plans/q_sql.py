"""Jobs written in SQL over the registered functions."""

from ..functions import sqlfunctions
from ..sources import notes as src
from .catalog import query
from .oracle_views import sql_canonical, sql_claim, sql_is_abstraction, sql_iso, sql_slug, sql_stale_marker, with_views
from .q_ingest import _LONG, long_documents

_L, _D = sql_claim("body", "rel_path", sql_iso("mtime"), "claim_date")


@query("sql_note_functions", with_views(["notes", "docs", "beliefs"], f"""SELECT rel_path, {sql_slug('rel_path')} AS slug, {_L} AS label, {_D} AS claimed,
  {sql_stale_marker('body', 'rel_path', 'doc_type', sql_slug('rel_path'), 'mtime', 'claim_date')} AS marker,
  (SELECT CASE WHEN d.disclosure <> '' THEN d.disclosure WHEN max(b.state) = 'draft' THEN 'private' WHEN max(b.state) IS NOT NULL THEN 'artifact'
     WHEN {sql_is_abstraction('notes.doc_type', sql_slug('notes.rel_path'))} THEN 'proposal' ELSE '' END FROM docs d LEFT JOIN beliefs b USING (rel_path) WHERE d.rel_path = notes.rel_path GROUP BY d.disclosure) AS class
  FROM notes"""))
def _note_functions(s, p):
    sqlfunctions.register(s)
    notes = src.notes(s, p).select("rel_path", "body", "doc_type", "mtime", "claim_date")
    docs, beliefs = src.docs(s, p).select("rel_path", "disclosure"), src.beliefs(s, p).select("rel_path", "state")
    return s.sql("""
        SELECT rel_path, basename_slug(rel_path) AS slug, c.label, c.date AS claimed, marker, class FROM (
          SELECT n.rel_path, claim_date(n.body, n.rel_path, nullif(CAST(CAST(timestamp_seconds(n.mtime) AS DATE) AS STRING), '1970-01-01'), n.claim_date) AS c,
            stale_marker(n.body, n.rel_path, n.doc_type, n.claim_date, CAST(:today AS DATE)) AS marker,
            disclosure_class(d.disclosure, b.state, '', n.doc_type, n.rel_path) AS class
          FROM {notes} n JOIN {docs} d ON d.rel_path = n.rel_path LEFT JOIN {beliefs} b ON b.rel_path = n.rel_path)
        """, args={"today": src.TODAY}, notes=notes, docs=docs, beliefs=beliefs)


@query("sql_link_targets", with_views(["links"], f"SELECT {sql_canonical('tgt_raw')} AS slug, count(*) AS edges FROM links GROUP BY 1"))
def _link_targets(s, p):
    sqlfunctions.register(s)
    return s.sql("SELECT canonical_slug(tgt_raw) AS slug, count(*) AS edges FROM {links} GROUP BY 1", links=src.links(src.notes(s, p)))


@query("sql_chunk_notes", "WITH" + _LONG + r""", x AS (SELECT rel_path, unnest(ls) AS line FROM ld)
SELECT rel_path, count(DISTINCT line) FILTER (regexp_matches(line, '^\| \d+ \| ')) AS table_rows, count(DISTINCT line) FILTER (regexp_matches(line, '^#{1,2} ')) AS headings, 0 AS gaps FROM x GROUP BY ALL""")
def _chunk_notes(s, p):
    sqlfunctions.register(s)
    return s.sql(r"""
        WITH cut AS (SELECT n.rel_path, c.chunk_idx, c.text FROM {notes} n, LATERAL chunk_note(n.body, 512, 64) c),
        line AS (SELECT rel_path, chunk_idx, explode(split(text, '\n')) AS line FROM cut)
        SELECT rel_path, count(DISTINCT CASE WHEN line RLIKE '^\\| [0-9]+ \\| ' THEN line END) AS table_rows,
          count(DISTINCT CASE WHEN line RLIKE '^#{{1,2}} ' THEN line END) AS headings, max(chunk_idx) + 1 - count(DISTINCT chunk_idx) AS gaps
        FROM line GROUP BY rel_path""", notes=long_documents(s, p))
