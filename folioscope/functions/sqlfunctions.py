"""The note functions under SQL names, for jobs written in `spark.sql`.

`register(spark)` adds them to a session. All but the chunker are SQL functions, so Catalyst puts their bodies into the
query and they stay inside the JVM; patterns come from the column functions' constants, and tests hold both forms equal.
The chunker is a table function: `SELECT ... FROM notes, LATERAL chunk_note(body, 512, 64)`.

Functions: basename_slug(path), canonical_slug(target), is_abstraction_note(doc_type, path), claim_date(text, path,
file_date, declared), stale_marker(text, path, doc_type, declared, today), disclosure_class(declared,
belief_state, fallback, doc_type, path). Nulls count as empty where the column functions say so."""

from pyspark.sql.functions import udtf

from . import dating as d
from . import text as t
from .disclosure import DISCLOSURE_CLASSES


def quoted(value):
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(test, values):
    return "(" + " OR ".join(test.format(quoted(v)) for v in values) + ")"


def _stem(parts, fallback):
    last = f"coalesce(try_element_at({parts}, -1), {fallback})"
    stem = f"regexp_replace({last}, {quoted(chr(92) + '.md' + chr(92) + 'z')}, '')"
    directory = f"{stem} = {quoted(t.DIRECTORY_NOTE_STEM)} AND size({parts}) >= 2"
    return f"CASE WHEN {directory} THEN try_element_at({parts}, -2) ELSE {stem} END"


_SLASH = quoted(r"[\\/]")
_BLANKS = "concat(' ', char(9), char(10), char(13), char(11), char(12))"
_OPEN_LINE = f"""s <> '' AND NOT startswith(s, '>') AND NOT contains(s, '":')
  AND NOT {_any("startswith(s, {})", d.CODE_LIKE_STARTS)} AND s RLIKE {quoted(d.OPEN_MARKER)}"""

FUNCTIONS = {
    "basename_slug(path STRING) RETURNS STRING": _stem(f"filter(split(path, {_SLASH}), x -> x <> '')", "path"),
    "canonical_slug(target STRING) RETURNS STRING": _stem(
        f"filter(split(btrim(btrim(coalesce(target, ''), {_BLANKS}), '/'), {_SLASH}), x -> x NOT IN ('', '.', '..'))", "''"),
    "is_abstraction_note(doc_type STRING, path STRING) RETURNS BOOLEAN": f"""lower(btrim(coalesce(doc_type, ''), {_BLANKS})) = 'abstraction'
  OR startswith(basename_slug(path), 'abstraction-') OR startswith(basename_slug(path), 'abstraction_')""",
    "claim_date(text STRING, path STRING, file_date STRING, declared STRING) RETURNS STRUCT<label STRING, date STRING>": f"""CASE
  WHEN regexp_extract(text, {quoted(d.UPDATED_HEADER)}, 1) <> '' THEN named_struct('label', 'verified', 'date', regexp_extract(text, {quoted(d.UPDATED_HEADER)}, 1))
  WHEN size(regexp_extract_all(text, {quoted(d.AS_OF)}, 1)) > 0 THEN named_struct('label', 'as-of', 'date', array_max(regexp_extract_all(text, {quoted(d.AS_OF)}, 1)))
  WHEN coalesce(declared, '') <> '' THEN named_struct('label', 'dated', 'date', declared)
  WHEN regexp_extract(text, {quoted(d.LEADING_DATE)}, 1) <> '' THEN named_struct('label', 'dated', 'date', regexp_extract(text, {quoted(d.LEADING_DATE)}, 1))
  WHEN regexp_extract(element_at(split(path, {_SLASH}), -1), {quoted(f"({d.ISO})")}, 1) <> ''
    THEN named_struct('label', 'dated', 'date', regexp_extract(element_at(split(path, {_SLASH}), -1), {quoted(f"({d.ISO})")}, 1))
  WHEN coalesce(file_date, '') <> '' THEN named_struct('label', 'file-dated', 'date', file_date)
  ELSE named_struct('label', '', 'date', '') END""",
    "stale_marker(text STRING, path STRING, doc_type STRING, declared STRING, today DATE) RETURNS STRING": f"""CASE
  WHEN {_any("contains(replace(path, char(92), '/'), {})", t.ARCHIVE_MARKERS)} THEN ''
  WHEN try_to_date(regexp_extract(text, {quoted(d.VERIFY_BY)}, 1), 'yyyy-MM-dd') < today THEN concat('EXPIRED ', regexp_extract(text, {quoted(d.VERIFY_BY)}, 1))
  WHEN text RLIKE {quoted(d.NOT_VOLATILE)} THEN ''
  WHEN NOT coalesce({_any(f"contains(upper(regexp_extract(text, {quoted(d.STATUS_HEADER).replace('{', '{{').replace('}', '}}')}, 1)), {{}})", d.OPEN_STATUS_WORDS)}, false)
    AND NOT coalesce(exists(transform(split(text, {quoted(d.LINE_BREAKS)}), x -> btrim(x, {_BLANKS})), s -> {_OPEN_LINE}), false) THEN ''
  WHEN NOT coalesce(is_abstraction_note(doc_type, path), false) AND claim_date(text, path, '', declared).label IN ('verified', 'as-of', 'dated')
    AND try_to_date(claim_date(text, path, '', declared).date, 'yyyy-MM-dd') IS NOT NULL
    THEN concat('unverified ', datediff(today, try_to_date(claim_date(text, path, '', declared).date, 'yyyy-MM-dd')), 'd')
  ELSE 'unverified (no claim date)' END""",
    "disclosure_class(declared STRING, belief_state STRING, fallback STRING, doc_type STRING, path STRING) RETURNS STRING": f"""CASE
  WHEN lower(btrim(coalesce(declared, ''), {_BLANKS})) IN ({', '.join(map(quoted, DISCLOSURE_CLASSES))}) THEN lower(btrim(declared, {_BLANKS}))
  WHEN belief_state = 'draft' THEN 'private'
  WHEN coalesce(belief_state, '') <> '' THEN 'artifact'
  WHEN is_abstraction_note(doc_type, path) THEN 'proposal'
  ELSE coalesce(fallback, '') END""",
}


class ChunkNote:
    """Rows (chunk_idx, text, token_count, heading_path) of one note; a null body has none."""

    def eval(self, body: str, size: int, overlap: int):
        from ..operators.chunking import cut_document

        if body is not None:
            for i, (text, tokens, heading) in enumerate(cut_document(body, size, overlap)):
                yield i, text, tokens, heading


def register(spark):
    """Adds all functions to the session, replacing those of the same names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    table_function = udtf(ChunkNote, returnType="chunk_idx int, text string, token_count int, heading_path string", useArrow=True)
    spark.udtf.register("chunk_note", table_function)
