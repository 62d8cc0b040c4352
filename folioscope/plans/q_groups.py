"""Near-duplicate groups, archive catalogue and name registry."""

from pyspark.sql import functions as F

from ..functions import records as r
from ..operators import archive as ar
from ..operators import cluster as cl
from ..operators import vectors as vx
from ..session import cut
from ..sources import corpus as c
from ..sources import notes as src
from .catalog import query, table
from .oracle_views import with_views

# ---- the given vectors, slightly moved copies of every tenth, exact copies of one label; ids 3n, 3n + 1, 3n + 2


def near_copies(s, p):
    e = table(s, p, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    moved = F.concat(F.array((F.get("embedding", F.lit(0)) + F.lit(0.05).cast("float")).cast("float")), F.slice("embedding", F.lit(2), F.size("embedding")))
    parts = [
        e.select((F.col("id") * 3).alias("chunk_id"), "embedding", F.col("id").alias("origin")),
        e.filter("id % 10 = 0").select((F.col("id") * 3 + 1).alias("chunk_id"), moved.alias("embedding"), F.col("id").alias("origin")),
        e.filter("label = 3").select((F.col("id") * 3 + 2).alias("chunk_id"), "embedding", F.col("id").alias("origin")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_V = """
vv AS (SELECT vec_id * 3 AS chunk_id, embedding, vec_id AS origin FROM embeddings
  UNION ALL SELECT vec_id * 3 + 1, list_concat([(embedding[1] + 0.05::FLOAT)::FLOAT], embedding[2:]), vec_id FROM embeddings WHERE vec_id % 10 = 0
  UNION ALL SELECT vec_id * 3 + 2, embedding, vec_id FROM embeddings WHERE label = 3),
reps AS (SELECT min(chunk_id) AS rep, embedding FROM vv GROUP BY embedding),
member AS (SELECT chunk_id, rep FROM vv JOIN reps USING (embedding)),
prs AS (SELECT a.rep AS a, b.rep AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cos FROM reps a JOIN reps b ON a.rep <> b.rep
  WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.92),
walk(x, y) AS (SELECT rep, rep FROM reps UNION SELECT w.x, p.b FROM walk w JOIN prs p ON p.a = w.y),
lab AS (SELECT x AS rep, min(y) AS label FROM walk GROUP BY x),
grp AS (SELECT label AS cluster_id, chunk_id, row_number() OVER (PARTITION BY label ORDER BY chunk_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM member JOIN lab USING (rep)),
cl AS (SELECT cluster_id, CAST((i - 1) // 2 AS INT) AS part, chunk_id FROM grp WHERE n > 1)"""


def _with(sql, views=()):
    return with_views(list(views), sql, _V)


query("g06_near_duplicate_partners", _with("SELECT a AS chunk_id, count(*) AS n_partners, min(b) AS first_partner, round(max(cos), 6) AS best_cos FROM prs GROUP BY a"))(
    lambda s, p: cl.partners(cl.representatives(near_copies(s, p))[0]).withColumn("best_cos", F.round("best_cos", 6)))
query("g05_near_duplicate_groups", _with("SELECT cluster_id, part, chunk_id FROM cl"))(lambda s, p: cl.groups(near_copies(s, p), max_size=2))
_LEADERS = "WITH RECURSIVE" + _V.split(",\nreps AS")[0] + """,
ordered AS (SELECT chunk_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v, row_number() OVER (ORDER BY chunk_id) AS n
  FROM vv WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
pass(n, chunk_id, sums, sizes, names, hit) AS (
  SELECT n, chunk_id, [v], [1], [chunk_id], 1 FROM ordered WHERE n = 1
  UNION ALL
  SELECT n, chunk_id, CASE WHEN hit IS NULL THEN list_append(sums, v) ELSE list_concat(sums[:hit - 1], [list_transform(list_zip(sums[hit], v), lambda z: z[1] + z[2])], sums[hit + 1:]) END,
    CASE WHEN hit IS NULL THEN list_append(sizes, 1) ELSE list_concat(sizes[:hit - 1], [sizes[hit] + 1], sizes[hit + 1:]) END,
    CASE WHEN hit IS NULL THEN list_append(names, chunk_id) ELSE names END, coalesce(hit, len(sums) + 1)
  FROM (SELECT o.n, o.chunk_id, o.v, p.sums, p.sizes, p.names,
      list_filter(range(1, len(p.sums) + 1), lambda i: p.sizes[i] < 20 AND round(list_dot_product(p.sums[i], o.v) / sqrt(list_dot_product(p.sums[i], p.sums[i])), 9) >= 0.92)[1] AS hit
    FROM pass p JOIN ordered o ON o.n = p.n + 1)),
led AS (SELECT chunk_id, names[hit] AS cluster_id FROM pass)
SELECT cluster_id, chunk_id FROM led QUALIFY count(*) OVER (PARTITION BY cluster_id) > 1"""
query("g05_leader_clusters", _LEADERS)(lambda s, p: cl.leader_clusters(cl.leader_blocks(near_copies(s, p))))


def _members(s, p):
    g = cut(cl.groups(near_copies(s, p), max_size=2))
    texts = table(s, p, "documents").select(F.col("doc_id").alias("origin"), "text")
    dd = src.docs(s, p).select(F.col("k").alias("origin"), "rel_path", "mtime")
    return g.join(near_copies(s, p).select("chunk_id", "origin"), "chunk_id").join(texts, "origin").join(dd, "origin").withColumn(
        "rel_path", F.when(F.col("chunk_id") % 3 == 0, F.col("rel_path")).otherwise(F.concat(F.lit("copy/"), "rel_path")))


_MEM = _V + """,
mem AS (SELECT cluster_id, part, vv.chunk_id, text, CASE WHEN vv.chunk_id % 3 = 0 THEN '' ELSE 'copy/' END || docs.rel_path AS rel_path, mtime
  FROM cl JOIN vv USING (chunk_id) JOIN documents ON doc_id = origin JOIN docs ON docs.k = origin),
cat AS (SELECT cluster_id, part, left(sha256(string_agg(left(sha256(text), 16), '' ORDER BY left(sha256(text), 16))), 12) AS signature, count(*) AS size, count(DISTINCT rel_path) AS n_sources, max(mtime) AS newest,
  string_agg(DISTINCT rel_path, '|' ORDER BY rel_path) AS sources FROM mem GROUP BY ALL)"""
query("a11_cluster_signature", with_views(["docs"], "SELECT cluster_id, part, signature FROM cat", _MEM))(lambda s, p: cl.catalogue(_members(s, p)).select("cluster_id", "part", "signature"))
query("g07_cluster_catalogue", with_views(["docs"], "SELECT cluster_id, part, size, n_sources, newest, sources FROM cat", _MEM))(
    lambda s, p: cl.catalogue(_members(s, p)).select("cluster_id", "part", "size", "n_sources", "newest", "sources"))
query("s18_synthesis_sink", with_views(["docs"], "SELECT signature, cluster_id, part FROM cat WHERE signature NOT IN (SELECT signature FROM cat WHERE cluster_id % 20 = 0)", _MEM))(
    lambda s, p: (lambda cat: cl.missing_syntheses(cat, cat.filter("cluster_id % 20 = 0").select("signature").distinct()).select("signature", "cluster_id", "part"))(cut(cl.catalogue(_members(s, p)))))
query("z04_merge_candidates", with_views(["docs"], """SELECT chunk_id, merge_with, round(cosine, 6) AS cosine, n_partners FROM (
  SELECT a.chunk_id, b.chunk_id AS merge_with, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine, count(*) OVER (PARTITION BY a.chunk_id) AS n_partners
  FROM mm a JOIN mm b ON a.rel_path <> b.rel_path WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.92)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY cosine DESC, merge_with) = 1""",
      _V + ", mm AS (SELECT chunk_id, embedding, CASE WHEN chunk_id % 3 = 0 THEN '' ELSE 'copy/' END || docs.rel_path AS rel_path FROM vv JOIN docs ON docs.k = origin)"))(
    lambda s, p: cl.merge_candidates(near_copies(s, p).join(src.docs(s, p).select(F.col("k").alias("origin"), "rel_path"), "origin")
        .withColumn("rel_path", F.when(F.col("chunk_id") % 3 == 0, F.col("rel_path")).otherwise(F.concat(F.lit("copy/"), "rel_path")))).withColumn("cosine", F.round("cosine", 6)))
query("j08_clusterable_chunks", with_views(["docs"], "SELECT doc_id AS chunk_id, mtime FROM documents JOIN docs ON docs.k = doc_id WHERE doc_id IN (SELECT vec_id FROM embeddings) AND NOT (rel_path ILIKE 'abstraction-%' OR rel_path ILIKE '%/abstraction_%')"))(
    lambda s, p: cl.clusterable(c.chunks(s, p), c.vectors(s, p), src.docs(s, p)).select("chunk_id", "mtime"))


def _nearest(s, p):
    """Every copy as a candidate against the given vectors."""
    cand = near_copies(s, p).filter("chunk_id % 3 > 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    near = vx.knn_topn(cand, c.vectors(s, p), 1)
    o = F.col("chunk_id")
    kinds = F.array(*[F.lit(x) for x in ("project", "feedback", "reference")])
    verdict = cl.dedup_verdict(F.lit(1.0) - F.col("dist"), o % 4 == 0, o % 4 == 1, o % 8 == 2, F.element_at(kinds, (o % 3 + 1).cast("int")), o % 100 == 90)
    return near.select("query_id", "chunk_id", verdict.alias("verdict"), F.element_at(kinds, (o % 3 + 1).cast("int")).alias("kind"), ((o % 11) / 10).alias("confidence"))


_NEAR = _V + """,
nn AS (SELECT q.chunk_id AS query_id, e.vec_id AS o, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS dist FROM vv q, embeddings e WHERE q.chunk_id % 3 > 0
   QUALIFY row_number() OVER (PARTITION BY q.chunk_id ORDER BY round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), e.vec_id) = 1),
vd AS (SELECT query_id, o, (['project', 'feedback', 'reference'])[o % 3 + 1] AS kind, (o % 11) / 10 AS confidence, CASE WHEN o % 100 = 90 THEN 'CONFLICT' WHEN 1 - dist >= 0.92 AND o % 4 = 0 THEN 'DUPLICATE'
   WHEN o % 8 = 2 AND o % 3 <> 1 AND 1 - dist >= 0.78 THEN 'POINTER' WHEN 1 - dist >= 0.78 AND 1 - dist < 0.92 AND o % 4 = 1 THEN 'UPDATE' ELSE 'CREATE' END AS verdict FROM nn)"""
query("z02_dedup_verdict", with_views([], "SELECT query_id, o AS chunk_id, verdict FROM vd", _NEAR))(lambda s, p: _nearest(s, p).select("query_id", "chunk_id", "verdict"))
query("z03_write_risk", with_views([], """SELECT query_id, CASE WHEN verdict = 'CONFLICT' THEN 'high' WHEN verdict = 'UPDATE' THEN 'low' WHEN kind = 'feedback' THEN 'med' ELSE 'low-med' END AS tier,
   CASE WHEN verdict = 'CONFLICT' THEN 'queue' WHEN verdict <> 'UPDATE' AND kind = 'feedback' THEN (CASE WHEN confidence >= 0.75 THEN 'auto' ELSE 'queue' END) WHEN confidence >= 0.5 THEN 'auto' ELSE 'queue' END AS autonomy FROM vd""", _NEAR))(
    lambda s, p: _nearest(s, p).select("query_id", cl.write_risk(F.col("verdict"), F.col("kind"), F.col("confidence")).alias("w")).select("query_id", "w.tier", "w.autonomy"))

# ---- archive ----------------------------------------------------------------
# Every document is archived; those divisible by 15 are shredded. For capture, the odd ids are the ones held already.


def _held(s, p, some="true"):
    i = F.col("doc_id")
    return table(s, p, "documents").filter(some).select(
        r.content_id(F.concat(F.lit("v1"), "text")).alias("txid"), F.element_at(F.array(F.lit("private"), F.lit("team"), F.lit("public")), (i % 3 + 1).cast("int")).alias("namespace"),
        F.concat(F.lit("Doc "), i.cast("string")).alias("title"), r.extractive_snapshot("text").alias("snapshot"), F.lit('{"v":1}').alias("tags"), F.octet_length("text").alias("n_bytes"),
        i.cast("double").alias("created"), r.source_hash("text").alias("source_hash"), (i % 15 == 0).alias("shredded"), (i % 4 == 1).alias("embedded"), i.alias("chunk_id"))


def _catalogue(s, p, some="true"):
    """One row per txid, as an earlier capture would have left it."""
    return ar.upsert_archives(_held(s, p, some).filter(F.lit(False)), _held(s, p, some)).drop("shredded", "embedded").withColumns(
        {"shredded": F.col("chunk_id") % 15 == 0, "embedded": F.col("chunk_id") % 4 == 1})


_HELD = """
held AS (SELECT rtrim(translate(to_base64(unhex(sha256('v1' || text))), '+/', '-_'), '=') AS txid, (['private', 'team', 'public'])[(doc_id % 3 + 1)::INT] AS namespace, 'Doc ' || doc_id AS title, text, doc_id,
   sha256(text) AS source_hash FROM documents),
arch AS (SELECT *, doc_id % 15 = 0 AS shredded, doc_id % 4 = 1 AS embedded FROM held QUALIFY row_number() OVER (PARTITION BY txid ORDER BY doc_id DESC) = 1)"""


def _incoming(s, p):
    return table(s, p, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("payload"))


query("h01_idempotent_capture", "WITH" + _HELD.replace("FROM documents)", "FROM documents WHERE doc_id % 2 = 1)") + " SELECT min(doc_id) AS record_id FROM documents WHERE sha256(text) NOT IN (SELECT source_hash FROM arch WHERE NOT shredded) GROUP BY sha256(text)")(
    lambda s, p: ar.capture(_catalogue(s, p, "doc_id % 2 = 1"), _incoming(s, p)).select("record_id"))
query("s16_archive_upsert", "WITH" + _HELD + """, fresh AS (SELECT * REPLACE (title || ' again' AS title) FROM arch WHERE doc_id % 3 = 0)
 SELECT txid, title, shredded, embedded FROM arch WHERE doc_id % 3 <> 0 UNION ALL SELECT txid, title, false, false FROM fresh""")(
    lambda s, p: (lambda cat: ar.upsert_archives(cat, cat.filter("chunk_id % 3 = 0").withColumn("title", F.concat("title", F.lit(" again")))))(_catalogue(s, p)).select("txid", "title", "shredded", "embedded"))
query("p09_live_archives", "WITH" + _HELD + " SELECT txid FROM arch WHERE NOT shredded AND namespace = 'team'")(lambda s, p: ar.live(_catalogue(s, p), "team").select("txid"))
query("t07_archive_list", "WITH" + _HELD + " SELECT title, shredded FROM arch ORDER BY doc_id DESC")(lambda s, p: ar.listing(_catalogue(s, p)).select("title", "shredded"))
query("h05_catalogue_listing", "WITH" + _HELD + " SELECT title, namespace FROM arch WHERE namespace = 'private' ORDER BY doc_id DESC")(lambda s, p: ar.listing(_catalogue(s, p), "private").select("title", "namespace"))
query("a16_live_ratio", "WITH" + _HELD + " SELECT count(*) FILTER (NOT shredded) AS live, round(count(*) FILTER (NOT shredded) / count(*), 6) AS ratio FROM arch")(lambda s, p: ar.live_ratio(_catalogue(s, p)))


def _keys(s, p):
    return cut(ar.new_keys(_catalogue(s, p)))


def _sealed(s, p, keys):
    payloads = table(s, p, "documents").select(r.content_id(F.concat(F.lit("v1"), "text")).alias("txid"), F.col("text").alias("payload")).dropDuplicates(["txid"])
    return ar.encrypt(payloads, keys)


def _shredded(s, p, hard=True):
    cat, keys = _catalogue(s, p), _keys(s, p)
    arch, left = ar.shred(cat, keys, cat.filter("shredded"), hard)
    return arch, left, keys


query("h02_encrypt_round_trip", "WITH" + _HELD + " SELECT txid, sha256(text) AS h FROM arch")(
    lambda s, p: (lambda k: ar.retrieve(_sealed(s, p, k), k).select("txid", F.sha2(F.encode("payload", "UTF-8"), 256).alias("h")))(_keys(s, p)))


def _retrieved(s, p):
    _, left, keys = _shredded(s, p)
    broken = F.substr(F.hex("txid"), F.lit(1), F.lit(1)) == "4"  # some ciphertexts were altered in storage
    sealed = cut(_sealed(s, p, keys)).withColumn("sealed", F.when(broken, F.concat("sealed", F.unhex(F.lit("00")))).otherwise(F.col("sealed")))
    return ar.retrieve(sealed, left)


query("h03_retrieve", "WITH" + _HELD + """ SELECT txid, CASE WHEN shredded THEN 'no key' WHEN hex(txid)[1] = '4' THEN 'tampered' ELSE 'ok' END AS status,
  CASE WHEN NOT shredded AND hex(txid)[1] <> '4' THEN length(text) END AS n FROM arch""")(
    lambda s, p: _retrieved(s, p).select("txid", "status", F.length("payload").alias("n")))
query("h04_hard_shred", "WITH" + _HELD + " SELECT txid, shredded, shredded AS blank, CASE WHEN shredded THEN '{}' ELSE '{\"v\":1}' END AS tags FROM arch")(
    lambda s, p: _shredded(s, p)[0].select("txid", "shredded", (F.col("snapshot") == "").alias("blank"), "tags"))
query("h04_soft_shred", "WITH" + _HELD + " SELECT txid, shredded, false AS blank FROM arch")(
    lambda s, p: _shredded(s, p, hard=False)[0].select("txid", "shredded", (F.col("snapshot") == "").alias("blank")))
query("j19_unrecoverable", "WITH" + _HELD + " SELECT txid FROM arch WHERE shredded")(lambda s, p: (lambda z: ar.unrecoverable(z[0], z[1]).select("txid"))(_shredded(s, p)))
_REC = """
q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS qe FROM benchmark JOIN embeddings ON vec_id = item_id),
av AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM arch)),
near AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], qe), 9), vec_id) AS vr FROM q, av)"""


def _arch_near(s, p):
    v = c.vectors(s, p).join(_catalogue(s, p).select("chunk_id"), "chunk_id", "left_semi")
    return vx.knn_topn(c.requests(s, p), v, 15)


query("j09_archive_vectors", "WITH" + _HELD + " SELECT txid, vec_id AS chunk_id FROM arch JOIN embeddings ON vec_id = doc_id")(
    lambda s, p: c.vectors(s, p).join(_catalogue(s, p).select("chunk_id", "txid"), "chunk_id").select("txid", "chunk_id"))
query("t08_archive_knn", "WITH" + _HELD + "," + _REC + " SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY vr) AS rank FROM near JOIN arch USING (doc_id) WHERE vr <= 15 AND NOT shredded QUALIFY rank <= 5")(
    lambda s, p: ar.recall(_arch_near(s, p), _catalogue(s, p)).select("query_id", "chunk_id", "rank"))
query("r23_archive_recall", "WITH" + _HELD + "," + _REC + " SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY vr) AS rank FROM near JOIN arch USING (doc_id) WHERE vr <= 15 AND NOT shredded AND namespace = 'team' QUALIFY rank <= 5")(
    lambda s, p: ar.recall(_arch_near(s, p), _catalogue(s, p), namespace="team").select("query_id", "title", "rank"))

# ---- registry ---------------------------------------------------------------
# Every part is a record of the name gcx://part/<name>/<size>; orders of the part's customer act as pointers.

OPERATOR_KEY = "a2V5LUJyYW5kIzI"


def _registry(s, p):
    return table(s, p, "part").select(
        F.concat(F.lit("gcx://part/"), F.translate("p_name", " ", "-"), F.lit("/"), F.col("p_size").cast("string")).alias("name"),
        F.concat(F.lit("TX"), F.col("p_partkey").cast("string")).alias("txid"), (F.col("p_type") == "ECONOMY").alias("is_sidecar"),
        F.when(F.col("p_partkey") % 3 == 0, r.source_hash("p_brand")).otherwise(F.lit("")).alias("expected"))


def _pointers(s, p):
    k = F.col("p_partkey")
    return table(s, p, "part").select(
        F.concat(F.lit("gcx://part/"), F.translate("p_name", " ", "-"), F.lit("/"), F.col("p_size").cast("string")).alias("name"),
        F.concat(F.lit("A"), k.cast("string")).alias("txid"),
        F.when(k % 4 == 0, F.lit("gone")).otherwise(F.concat(F.lit("TX"), k.cast("string"))).alias("target"),
        F.when(F.col("p_size") % 2 == 0, k).alias("height"),
        r.base64url(F.encode(F.concat(F.lit("key-"), "p_brand"), "UTF-8")).alias("owner_key")).filter("p_type = 'SMALL'")


def _operator():
    return r.owner_address(F.lit(OPERATOR_KEY))


def _op(s):
    return s.range(1).select(_operator()).first()[0]


_REG = """
reg AS (SELECT 'gcx://part/' || replace(p_name, ' ', '-') || '/' || p_size AS name, 'TX' || p_partkey AS txid, CASE WHEN p_type = 'ECONOMY' THEN 2 WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS tier FROM part),
cand AS (SELECT name, count(*) AS candidates, min(txid) AS txid FROM reg JOIN (SELECT name, min(tier) AS tier FROM reg GROUP BY name) USING (name, tier) GROUP BY name),
own AS (SELECT 'gcx://part/' || replace(p_name, ' ', '-') || '/' || p_size AS name, 'A' || p_partkey AS txid, CASE WHEN p_partkey % 4 = 0 THEN 'gone' ELSE 'TX' || p_partkey END AS target, CASE WHEN p_size % 2 = 0 THEN p_partkey END AS height
   FROM part WHERE p_type = 'SMALL' AND p_brand = 'Brand#2'),
auth AS (SELECT name, count(height) AS mined, count(*) AS n, CASE WHEN count(height) > 0 THEN max_by(txid, height) ELSE max(txid) END AS authority_txid, CASE WHEN count(height) > 0 THEN max_by(target, height) ELSE max_by(target, txid) END AS target FROM own GROUP BY name)"""
query("a14_latest_authority", "WITH" + _REG + " SELECT name, authority_txid, target, mined = 0 AND n > 1 AS refused FROM auth")(lambda s, p: ar.authority(_pointers(s, p), _op(s)))
query("a15_name_ambiguity", "WITH" + _REG + " SELECT name, candidates, txid FROM cand")(lambda s, p: ar.name_candidates(_registry(s, p)))
_RES = "WITH" + _REG + """ SELECT name, CASE WHEN status = 'resolved' THEN coalesce(target, txid) END AS txid, CASE WHEN status = 'resolved' THEN authority_txid END AS authority_txid, status FROM (
  SELECT cand.*, auth.authority_txid, auth.target, CASE WHEN mined = 0 AND n > 1 THEN 'unordered authority' WHEN auth.target = 'gone' THEN 'dangling pointer' WHEN authority_txid IS NOT NULL OR candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS status
  FROM cand LEFT JOIN auth USING (name))"""
query("h06_name_resolution", _RES)(lambda s, p: ar.resolve_names(_registry(s, p), _registry(s, p), _pointers(s, p), _op(s)))
query("j18_payload_and_pointer", f"SELECT status, count(*) AS n, count(authority_txid) AS by_authority FROM ({_RES}) GROUP BY ALL")(
    lambda s, p: ar.resolve_names(_registry(s, p), _registry(s, p), _pointers(s, p), _op(s)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("authority_txid").alias("by_authority")))
query("h07_integrity_audit", """SELECT 'D' || doc_id AS txid, CASE WHEN doc_id % 3 = 0 THEN 'UNVERIFIABLE (no hash recorded on-chain)' WHEN doc_id % 3 = 1 THEN 'HASH MISMATCH' WHEN doc_id % 2 = 0 THEN 'VERIFIED (address-derived)' ELSE 'VERIFIED' END AS status,
   CASE WHEN doc_id % 3 = 2 THEN length(text) END AS released FROM documents""")(
    lambda s, p: ar.verified_content(table(s, p, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("txid"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.lit("00ff")).otherwise(F.upper(r.source_hash("text"))).alias("expected"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(ar.AUTHORITY_MODE)).otherwise(F.lit("")).alias("authority_mode"))).select("txid", "status", F.length("content").alias("released")))
