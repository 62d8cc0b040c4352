"""The derived views once more, as DuckDB common table expressions."""

_WIKI = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"


def sql_slug(p):
    parts = f"list_filter(regexp_split_to_array({p}, '[\\\\/]'), lambda x: x <> '')"
    stem = f"regexp_replace(coalesce({parts}[-1], {p}), '\\.md$', '')"
    return f"(CASE WHEN {stem} = 'LAIR' AND len({parts}) >= 2 THEN {parts}[-2] ELSE {stem} END)"


def sql_canonical(p):
    parts = f"list_filter(regexp_split_to_array(trim(trim({p}), '/'), '[\\\\/]'), lambda x: x NOT IN ('', '.', '..'))"
    stem = f"regexp_replace(coalesce({parts}[-1], ''), '\\.md$', '')"
    return f"(CASE WHEN {stem} = 'LAIR' AND len({parts}) >= 2 THEN {parts}[-2] ELSE {stem} END)"


NOTES = r"""
notes AS (
  SELECT o_orderkey AS k, (SELECT count(*) FROM orders) AS n, o_custkey AS custkey, o_orderstatus AS status,
    o_totalprice AS price, o_orderdate::DATE AS day, CAST(o_orderdate::DATE AS VARCHAR) AS iso,
    (CASE WHEN o_orderpriority = '1-URGENT' THEN '000-PRIORITY-' || c_mktsegment
          WHEN o_orderpriority = '5-LOW' THEN '_archive' ELSE lower(c_mktsegment) END) || '/' ||
    (CASE WHEN o_orderkey % 11 = 0 THEN 'order-' || o_orderkey || '/LAIR.md'
          WHEN o_orderkey % 13 = 0 THEN 'abstraction-order-' || o_orderkey || '.md'
          WHEN o_orderkey % 7 = 0 THEN 'order-' || o_orderkey || '-' || CAST(o_orderdate::DATE AS VARCHAR) || '.md'
          ELSE 'order-' || o_orderkey || '.md' END) AS rel_path,
    CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 2 = 0 THEN 'abstraction'
         ELSE (['feedback', 'project', 'reference', 'user', '', 'belief'])[(o_orderkey % 6 + 1)::INT] END AS doc_type,
    (['artifact', 'proposal', 'private', 'public', ''])[(o_orderkey % 5 + 1)::INT] AS disclosure_raw,
    (['observed', 'sourced', 'synthesized', 'guess'])[(o_orderkey % 4 + 1)::INT] AS evidence_raw,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate::DATE AS VARCHAR) ELSE '' END AS claim_date,
    (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 30) * 86400.0::DOUBLE AS mtime,
    concat_ws(chr(10),
      '# Order ' || o_orderkey,
      CASE WHEN o_orderkey % 4 = 0 THEN '**Last Updated**: ' || CAST(o_orderdate::DATE AS VARCHAR) END,
      CASE o_orderstatus WHEN 'O' THEN '**Status**: ⏳ **PENDING** payment'
           WHEN 'P' THEN '| shipment | ⚠' || chr(65039) || ' **IN PROGRESS** |' ELSE 'All lines delivered.' END,
      CASE WHEN o_orderkey % 9 = 0 THEN 'Counted as of ' || CAST(o_orderdate::DATE + 10 AS VARCHAR) || ', before that as of '
           || CAST(o_orderdate::DATE AS VARCHAR) || '.' END,
      CASE WHEN o_orderkey % 10 = 0 THEN 'verify_by: ' || CAST(o_orderdate::DATE + 365 AS VARCHAR) END,
      CASE WHEN o_orderkey % 12 = 0 THEN 'volatile: false' END,
      'The order-' || o_orderkey || ' invoice recorded ' || printf('%.2f', o_totalprice) || ' units.',
      CASE WHEN o_orderkey > 0 THEN 'Follows [[order-' || (o_orderkey - 1) || ']].' END,
      'See [[../../x/order-' || ((o_orderkey * 7) % (SELECT count(*) FROM orders)) || '/LAIR]] and [[order-' || (o_orderkey % 50) || '|hub]].',
      CASE WHEN o_orderkey % 8 = 0 AND o_orderkey >= 8 THEN '**Supersedes:** [[order-' || (o_orderkey - 8) || ']]' END,
      CASE WHEN o_orderkey % 8 = 4 THEN '**Supersedes**: nothing · **Superseded by**: [[order-' || (o_orderkey + 4) || ']]' END
    ) AS body
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

DOCS = f"""
docs AS (
  SELECT k, n, rel_path, '/corpus/' || rel_path AS abs_path, body, mtime, doc_type, claim_date, 'Order ' || k AS title,
    sha1(body) AS doc_hash, starts_with(rel_path, '000-PRIORITY') AS is_priority,
    CASE WHEN disclosure_raw IN ('artifact', 'proposal', 'private') THEN disclosure_raw ELSE '' END AS disclosure,
    CASE WHEN evidence_raw IN ('observed', 'sourced', 'synthesized') THEN evidence_raw ELSE '' END AS evidence,
    {sql_slug('rel_path')} AS slug, day, custkey, price, status
  FROM notes)"""

LINKS = f"""
links AS (
  SELECT DISTINCT src_path, tgt_raw, {sql_canonical('tgt_raw')} AS tgt_slug
  FROM (SELECT rel_path AS src_path, trim(unnest(regexp_extract_all(body, '{_WIKI}', 1))) AS tgt_raw FROM notes))"""

SUPERSESSIONS = r"""
supersessions AS (
  SELECT rel_path AS src_path, 'order-' || (k - 8) AS tgt_raw, 'order-' || (k - 8) AS tgt_slug
  FROM notes WHERE k % 8 = 0 AND k >= 8)"""

BELIEFS = f"""
beliefs AS (
  SELECT {sql_slug('rel_path')} AS belief_id, rel_path, 'p' || (k % 4) AS persona,
    (['draft', 'promoted', 'promoted', 'retracted', 'needs_review'])[((k // 6) % 5 + 1)::INT] AS state,
    's' || custkey AS subject, 'The order-' || k || ' invoice recorded ' || printf('%.2f', price) || ' units.' AS claim,
    CASE WHEN k % 7 = 1 THEN 'high' ELSE 'medium' END AS confidence,
    CASE WHEN k % 17 = 0 THEN 'action' ELSE 'analysis' END AS impact, iso AS created, '' AS promoted_at,
    CAST(day + CAST(365 * (k % 9) AS INT) AS VARCHAR) AS verify_by,
    CASE WHEN k % 2 = 1 THEN 'p' || ((k + 1) % 4) ELSE '' END AS countersigned_by, k
  FROM notes WHERE doc_type = 'belief')"""

EVIDENCE = """
belief_evidence AS (
  SELECT belief_id, ref, max(kind) AS kind, max(verified) AS verified, max(CASE WHEN kind = 'link' THEN ref ELSE '' END) AS slug
  FROM (
    SELECT belief_id,
      CASE WHEN l_suppkey % 5 = 0 THEN 'https://ex.test/' || l_suppkey
           WHEN l_partkey % 3 = 0 THEN 'order-' || greatest(k - 12, 0)
           ELSE 'order-' || ((5 * l_partkey + 1) % (SELECT count(*) FROM orders)) END AS ref,
      CASE WHEN l_suppkey % 5 = 0 THEN 'external' ELSE 'link' END AS kind,
      CASE WHEN l_suppkey % 5 = 0 THEN l_quantity > 25 ELSE true END AS verified
    FROM beliefs JOIN lineitem ON l_orderkey = k)
  GROUP BY belief_id, ref)"""

VIEWS = {
    "notes": NOTES, "docs": DOCS, "links": LINKS, "supersessions": SUPERSESSIONS,
    "beliefs": BELIEFS, "belief_evidence": EVIDENCE,
}
NEEDS = {"docs": ["notes"], "links": ["notes"], "supersessions": ["notes"], "beliefs": ["notes"],
         "belief_evidence": ["notes", "beliefs"]}


def with_views(names, body, extra=""):
    """Prefix `body` with the named views and whatever they need."""
    wanted = []
    for name in names:
        for v in NEEDS.get(name, []) + [name]:
            if v not in wanted:
                wanted.append(v)
    ctes = [VIEWS[v].strip() for v in wanted]
    if extra:
        ctes.append(extra.strip())
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body if ctes else body


# ---- fragments of the scalar rules, as SQL ---------------------------------

ISO = r"\d{4}-\d{2}-\d{2}"
_LEAD = r"^[ \t>\-|*]*"
_OPEN = (r"DELINQUENT|UNPAID|OVERDUE|PAST\s+DUE|PENDING|AWAITING|BLOCKED|ON\s+HOLD|UNRESOLVED|UNVERIFIED|UNCONFIRMED|"
         r"NOT\s+FILED|NOT\s+PAID|NOT\s+YET|IN\s+PROGRESS|IN\s+REVIEW|UNDER\s+REVIEW|OUTSTANDING|SUSPENDED|EXPIRED|"
         r"LAPSED|NEEDS\s+REFRESH|TBD|WIP")
_SIGN = r"⚠✅❌⏸\x{1F504}⬜\x{1F6A7}⏳"
OPEN_MARKER = (rf"(?i)(\*\*\s*[{_SIGN}\x{{FE0F}}]*\s*\**\s*({_OPEN})\b|\|\s*[{_SIGN}\x{{FE0F}}]*\s*\**\s*({_OPEN})\b"
               rf"|[{_SIGN}]\x{{FE0F}}?\s*\**\s*({_OPEN})\b)")


def sql_iso(mtime):
    return f"(CASE WHEN {mtime} = 0 THEN '' ELSE CAST(DATE '1970-01-01' + CAST(floor({mtime} / 86400) AS INT) AS VARCHAR) END)"


def sql_is_abstraction(doc_type, slug):
    return f"(lower(trim({doc_type})) = 'abstraction' OR starts_with({slug}, 'abstraction-') OR starts_with({slug}, 'abstraction_'))"


def sql_claim(text, path, iso, declared="''"):
    """(label expression, date expression)"""
    upd = rf"regexp_extract({text}, '(?m){_LEAD}\*\*Last Updated\*\*\s*:\s*({ISO})', 1)"
    asof = rf"list_max(regexp_extract_all({text}, '(?i)\bas of\s+({ISO})', 1))"
    lead = rf"regexp_extract({text}, '(?sm)\A---\r?\n.*?^date:\s*[''\"]?({ISO})', 1)"
    name = rf"regexp_extract(regexp_split_to_array({path}, '[\\/]')[-1], '({ISO})', 1)"
    label = (f"(CASE WHEN {upd} <> '' THEN 'verified' WHEN {asof} IS NOT NULL THEN 'as-of' WHEN {declared} <> '' THEN 'dated' "
             f"WHEN {lead} <> '' THEN 'dated' WHEN {name} <> '' THEN 'dated' WHEN {iso} <> '' THEN 'file-dated' ELSE '' END)")
    date = (f"(CASE WHEN {upd} <> '' THEN {upd} WHEN {asof} IS NOT NULL THEN {asof} WHEN {declared} <> '' THEN {declared} "
            f"WHEN {lead} <> '' THEN {lead} WHEN {name} <> '' THEN {name} ELSE {iso} END)")
    return label, date


def sql_open_lines(text):
    code = " OR ".join(f"starts_with(s, {x})" for x in ("'>'", "chr(34)", "chr(39)", "'//'", "'#!'", "'|--'", "'```'"))
    return (f"list_filter(list_transform(string_split({text}, chr(10)), lambda l: trim(l)), lambda s: s <> '' AND NOT ({code}) "
            f"AND NOT contains(s, chr(34) || ':') AND regexp_matches(s, '{OPEN_MARKER}'))")


def sql_volatility(text):
    status = rf"upper(regexp_extract({text}, '(?m){_LEAD}\*\*Status\*\*\s*:\s*(.+)$', 1))"
    words = " OR ".join(f"contains({status}, '{w}')" for w in ("ACTIVE", "PLANNING", "BLOCKED", "IN PROGRESS", "PENDING"))
    return (rf"(CASE WHEN regexp_matches({text}, '(?im)^volatile\s*:\s*(false|no)\s*$') THEN '' WHEN {words} "
            rf"OR len({sql_open_lines(text)}) > 0 THEN 'open' ELSE '' END)")


def sql_verify_by(text):
    return rf"regexp_extract({text}, '(?im)^verify_by\s*:\s*({ISO})', 1)"


def sql_expired(text, today="2001-08-02"):
    v = sql_verify_by(text)
    return f"(CASE WHEN TRY_CAST({v} AS DATE) < DATE '{today}' THEN {v} END)"


def sql_days(date, today="2001-08-02"):
    return f"date_diff('day', TRY_CAST({date} AS DATE), DATE '{today}')"


def sql_archived(path):
    return "(" + " OR ".join(
        f"contains(replace({path}, '\\', '/'), '{m}')"
        for m in ("_archive", "_archive_legacy", "archived-", "/sessions/", "MEMORY-ARCHIVE")) + ")"


def sql_record_date(text, path, doc_type, slug, mtime, declared):
    label, date = sql_claim(text, path, sql_iso(mtime), declared)
    a = sql_is_abstraction(doc_type, slug)
    return (f"(CASE WHEN {a} THEN (CASE WHEN {sql_iso(mtime)} <> '' THEN 'generated' ELSE '' END) ELSE {label} END)",
            f"(CASE WHEN {a} THEN {sql_iso(mtime)} ELSE {date} END)")


def sql_stale_marker(text, path, doc_type, slug, mtime, declared, today="2001-08-02"):
    label, date = sql_record_date(text, path, doc_type, slug, mtime, declared)
    e = sql_expired(text, today)
    return (f"(CASE WHEN {sql_archived(path)} THEN '' WHEN {e} IS NOT NULL THEN 'EXPIRED ' || {e} "
            f"WHEN {sql_volatility(text)} = '' THEN '' WHEN {label} IN ('verified', 'as-of', 'dated') AND {sql_days(date, today)} IS NOT NULL "
            f"THEN 'unverified ' || {sql_days(date, today)} || 'd' ELSE 'unverified (no claim date)' END)")


def sql_norm(x):
    return (f"trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9$%/.#-]+', ' ', 'g'))")


STOP_LIST = "(" + ", ".join(f"'{w}'" for w in (
    "the a an is was were are did does do of in on at to for with and or by from as it its this that what which "
    "who when where how many much about roughly per after before").split()) + ")"


def sql_terms_of(norm):
    return (f"flatten(list_transform(list_filter(string_split({norm}, ' '), lambda w: w <> '' AND w NOT IN {STOP_LIST}), "
            f"lambda w: CASE WHEN contains(w, '-') THEN list_concat([w], list_filter(string_split(w, '-'), "
            f"lambda p: length(p) >= 3 AND p NOT IN {STOP_LIST})) ELSE [w] END))")
