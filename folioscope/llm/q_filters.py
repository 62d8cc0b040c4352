"""Registered queries of decontamination and of the secret scan."""

from . import decontaminate, secrets
from .common import table


def op4_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CONTAINED = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 5) AS width FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, width, array_to_string(w[k:k + width - 1], ' ') AS shingle
      FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM i)),
c AS (SELECT item_id, width, count(*) AS n_shingles FROM s GROUP BY ALL),
t AS (SELECT DISTINCT doc_id, width, array_to_string(w[k:k + width - 1], ' ') AS shingle
      FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM d, (SELECT DISTINCT width FROM i))),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM t JOIN s USING (width, shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN c USING (item_id) WHERE n_shared * 100 >= n_shingles * 80
"""



def _spans(kind, order, pattern, group, least):
    return f"""SELECT rid, {order} AS ord, '{kind}' AS kind, vals[i] AS value, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, length(ms[i]) AS n
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_split_to_array(text, $re${pattern}$re$) AS gaps, regexp_extract_all(text, $re${pattern}$re$, 0) AS ms, regexp_extract_all(text, $re${pattern}$re$, {group}) AS vals FROM d
    WHERE regexp_matches(text, $re${pattern}$re$))) WHERE length(vals[i]) >= {least}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
b AS ({" UNION ALL ".join(_spans(k, i, *secrets.BASE[k]) for i, k in enumerate(secrets.BASE))}),
t AS (SELECT * FROM ({_spans("owned", len(secrets.BASE), "[A-Za-z0-9_-]{20,}", 0, 20)}) o WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = o.rid AND b.s < o.s + o.n AND o.s < b.s + b.n)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM t),
f AS (SELECT value, count(DISTINCT owner) < {secrets.WIDE} AS live FROM a JOIN d USING (rid) GROUP BY value),
k AS (SELECT rid, ord, kind, s, kind || ':' || s || ':' || (s + n) AS shown, live FROM a JOIN f USING (value) WHERE ord < {len(secrets.BASE)} OR live),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(shown, ',' ORDER BY s, ord) FILTER (ord < {len(secrets.BASE)}), '') AS base, string_agg(shown, ',' ORDER BY s, ord) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g USING (rid)
"""

QUERIES = {"op4_secret_scan": op4_secret_scan, "op6_decontamination": op6_decontamination}
ORACLES = {"op4_secret_scan": SECRETS, "op6_decontamination": CONTAINED}
