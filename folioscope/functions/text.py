"""Column expressions for paths, slugs, links and document fields."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and patterns of the note format.
DIRECTORY_NOTE_STEM = "LAIR"
PRIORITY_PREFIX = "000-PRIORITY"
BACKUP_MARKERS = (
    "backups-pre-apply", "backups-pre-", "-pre-scrub", "/backups/", ".bak", "_ARCHIVED-", ".orig",
)
ARCHIVE_MARKERS = ("_archive", "_archive_legacy", "archived-", "/sessions/", "MEMORY-ARCHIVE")
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
HEADER = r"(?md)^(#{1,6})\s+(.+)$"
SUPERSEDES = r"(?imd)^[#>\s]*\**\s*supersedes\b[\s:*]*([^\n·|]*)"
SUPERSEDES_NOTHING = ("", "nothing", "none", "n/a", "na", "-", "—")
DISCLOSURE_CLASSES = ("artifact", "proposal", "private")
EVIDENCE_CLASSES = ("observed", "sourced", "synthesized")
BELIEF_STATES = ("draft", "promoted", "retracted", "needs_review")
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

WHITESPACE = " \t\n\r\x0b\x0c"


def no_strings():
    return F.array().cast("array<string>")


def col(c):
    return F.col(c) if isinstance(c, str) else c


def strip(c, chars=WHITESPACE):
    return F.btrim(col(c), F.lit(chars))


def pin(df, **columns):
    """Add columns that are computed once per row. A plain projection may be merged into the lambdas that use it and
    then runs once per array element; a generator output is not."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value, use):
    """`use` of a value that is computed once per row, however often `use` names it: Spark puts a named expression in
    at every place where it is named, but binds the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank(c):
    return F.coalesce(col(c), F.lit(""))


def contains_any(c, needles):
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(col(c), F.lit(n))
    return out


def starts_with_any(c, prefixes):
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(col(c), F.lit(p))
    return out


def lines(c):
    return F.split(col(c), "\n")


# ---- paths and slugs -------------------------------------------------------

def _stem_or_directory(parts, fallback):
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), fallback)
    return let(F.regexp_replace(last, r"\.md\z", ""), lambda stem: F.when(
        (stem == DIRECTORY_NOTE_STEM) & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(-2))
    ).otherwise(stem))


def basename_slug(path):
    path = col(path)
    return let(F.filter(F.split(path, r"[\\/]"), lambda x: x != ""), lambda parts: _stem_or_directory(parts, path))


def canonical_slug(target):
    trimmed = strip(strip(blank(target)), "/")
    parts = F.filter(F.split(trimmed, r"[\\/]"), lambda x: ~x.isin("", ".", ".."))
    return _stem_or_directory(parts, F.lit(""))


def link_slug(raw):
    raw = blank(raw)
    inner = F.regexp_extract(raw, WIKILINK, 1)
    return canonical_slug(F.when(inner != "", inner).otherwise(raw))


def name_slug(name, path):
    return F.coalesce(F.nullif(col(name), F.lit("")), basename_slug(path))


def is_priority_path(path):
    return F.exists(F.split(col(path), r"[\\/]"), lambda x: F.startswith(x, F.lit(PRIORITY_PREFIX)))


def is_backup_path(path):
    return contains_any(path, BACKUP_MARKERS)


def is_archive_path(path):
    return F.replace(col(path), F.lit("\\"), F.lit("/")).rlike("|".join(map(re.escape, ARCHIVE_MARKERS)))  # one look at a derived path


def is_abstraction(doc_type, path):
    made = let(basename_slug(path), lambda slug: starts_with_any(slug, ("abstraction-", "abstraction_")))
    return (F.lower(strip(blank(doc_type))) == "abstraction") | made


def is_self_made(path, folder=None):
    """Notes the clustering job wrote itself; they must not feed it again. `_` is a one-character wildcard."""
    p = col(path)
    out = (
        p.ilike("abstraction-%") | p.ilike("%/abstraction-%")
        | p.ilike("abstraction_%") | p.ilike("%/abstraction_%")
    )
    return out | p.ilike(f"%{folder}%") if folder else out


# ---- document fields -------------------------------------------------------

def wikilinks(body):
    found = F.regexp_extract_all(col(body), F.lit(WIKILINK), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: strip(x)))


def supersedes(body, declared=None):
    clauses = F.transform(
        F.regexp_extract_all(col(body), F.lit(SUPERSEDES), F.lit(1)), lambda c: strip(strip(strip(c), "*"))
    )
    real = F.filter(clauses, lambda c: ~F.lower(c).isin(*SUPERSEDES_NOTHING))
    targets = F.flatten(F.transform(real, lambda c: F.regexp_extract_all(c, F.lit(WIKILINK), F.lit(1))))
    if declared is not None:
        targets = F.concat(F.coalesce(col(declared), no_strings()), targets)
    kept = F.filter(F.transform(targets, lambda x: strip(x)), lambda t: t != "")
    return F.array_sort(F.array_distinct(kept))


def first_header(body):
    return strip(F.regexp_extract(col(body), HEADER, 2))


def title(name, body, path):
    last = F.element_at(F.split(col(path), r"[\\/]"), -1)
    return F.coalesce(
        F.nullif(col(name), F.lit("")),
        F.nullif(first_header(body), F.lit("")),
        F.regexp_replace(last, r"(.)\.[^.]*\z", "$1"),
    )


def known_or_blank(raw, allowed):
    v = F.lower(strip(blank(raw)))
    return F.when(v.isin(*allowed), v).otherwise(F.lit(""))


def prefer_nested(nested, top):
    return F.coalesce(F.nullif(col(nested), F.lit("")), col(top), F.lit(""))


def doc_hash(body):
    return F.sha1(F.encode(col(body), "UTF-8"))


def prefixed(prefix, sep, rest):
    return F.concat(F.when(blank(prefix) != "", F.concat(col(prefix), F.lit(sep))).otherwise(F.lit("")), rest)


def chunk_hash(text, context, heading_path):
    return F.sha1(F.encode(prefixed(heading_path, "\x01", prefixed(context, "\x00", col(text))), "UTF-8"))


def embed_text(text, context, heading_path):
    return prefixed(context, "\n", prefixed(heading_path, "\n", col(text)))


def index_text(text, context, heading_path):
    """Searchable text: the non-empty parts on separate lines."""
    return F.concat_ws(
        "\n",
        F.nullif(col(context), F.lit("")), F.nullif(col(heading_path), F.lit("")), F.nullif(col(text), F.lit("")),
    )


def macro_context(title_col, description):
    return F.concat_ws(" — ", strip(title_col), F.nullif(strip(blank(description)), F.lit("")))


def token_count(text):
    """Default counter: words and single marks. Pluggable; named in the chunker fingerprint."""
    return F.size(F.regexp_extract_all(col(text), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def is_table_row(line):
    return col(line).rlike(r"^\s*\|.*\|\s*$")


def is_table_rule(line):
    return col(line).rlike(r"^\s*\|[\s:|\-]+\|\s*$")


# ---- folding ---------------------------------------------------------------

def nfkd_ascii(x):
    return unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()


@F.pandas_udf(T.StringType())
def _nfkd_ascii(s: pd.Series) -> pd.Series:
    return s.map(nfkd_ascii, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def is_ascii(c):
    return F.octet_length(col(c)) == F.length(col(c))


def _only_when_needed(c, udf):
    # ASCII rows stay in the JVM; only the others carry their text to Python.
    return F.when(is_ascii(c), col(c)).otherwise(udf(F.when(~is_ascii(c), col(c))))


def fold_ascii(c):
    return _only_when_needed(c, _nfkd_ascii)


def fold_compat(c):
    return _only_when_needed(c, _nfkc)


def _base_letters():
    """Letters that decompose to one base letter plus combining marks, with that base letter."""
    src, dst = [], []
    for cp in range(0xC0, 0x2000):
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if d != ch and d[0].isalnum() and all(unicodedata.combining(x) for x in d[1:]):
            src.append(ch)
            dst.append(d[0])
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _base_letters()


def strip_accents(c):
    return F.translate(col(c), _ACCENTED, _PLAIN)

