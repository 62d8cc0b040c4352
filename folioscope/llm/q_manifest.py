"""Registered query of the dataset manifest and its SQL."""

from .common import table
from .merkle import manifest


def op12_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))


#: crc32 of the decimal doc_id by its table; levels of both trees by recursion; siblings by the run a node stands in.
MANIFEST = r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
chosen AS (SELECT *, coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0, false) AS tampers
           FROM documents, crc),
made AS (SELECT doc_id, coalesce('s' || source, '') AS tree,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
           sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN tampers THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE leaf END AS now
         FROM chosen),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM made),
nodes AS (SELECT tree, 0 AS lvl, pos, leaf AS digest, n FROM leaves
          UNION ALL
          SELECT tree, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 16),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, pos, digest, n FROM subroots
         UNION ALL
         SELECT lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 15) // 16 FROM tops WHERE n > 1 GROUP BY lvl, pos // 16),
near AS (SELECT d.tree, d.pos, t.lvl, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < d.pos >> (4 * t.lvl)), '') AS l,
                coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > d.pos >> (4 * t.lvl)), '') AS r
         FROM leaves d JOIN nodes t ON t.tree = d.tree AND t.n > 1 AND t.pos >> 4 = d.pos >> (4 * t.lvl + 4) GROUP BY d.tree, d.pos, t.lvl),
far AS (SELECT d.tree, t.lvl, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < d.pos >> (4 * t.lvl)), '') AS l,
               coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > d.pos >> (4 * t.lvl)), '') AS r
        FROM subroots d JOIN tops t ON t.n > 1 AND t.pos >> 4 = d.pos >> (4 * t.lvl + 4) GROUP BY d.tree, t.lvl),
lower_ AS (SELECT tree, pos, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS steps FROM near GROUP BY tree, pos),
upper_ AS (SELECT tree, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS steps FROM far GROUP BY tree)
SELECT d.doc_id, d.leaf, s.digest AS subroot, e.digest AS root,
  sha256(coalesce(a.proof, '') || coalesce(b.proof, '')) AS proof_sha256,
  list_reduce(list_concat([d.now], coalesce(a.steps, []), coalesce(b.steps, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root,
  folded_root = e.digest AS verified
FROM leaves d JOIN subroots s USING (tree) JOIN tops e ON e.n = 1 LEFT JOIN lower_ a ON a.tree = d.tree AND a.pos = d.pos LEFT JOIN upper_ b ON b.tree = d.tree
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": MANIFEST}
