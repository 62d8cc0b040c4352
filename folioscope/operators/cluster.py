"""Near-duplicate groups of unit vectors.

Equal vectors are collapsed first. The others are dealt to the cells of pivot vectors; by the triangle inequality on
angles a vector meets only the cells that can hold a neighbour. Within a cell, blocks are compared with blocks; what a
block pair sends on is linear in its rows (best partners, or the edges of a spanning forest), never all of its pairs.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, is_self_made
from ..params import DEFAULTS
from ..session import cut

BLOCK = 4096
SLAB = 512  # rows of a block that are compared at a time
MAX_PIVOTS = 256  # pivots, their radii and the sample they are taken from are all that the driver holds
PIVOT_SAMPLE = 2048
SLACK = 1e-6  # radians; more than rounding of cosines and angles can make up
_EMPTY_EDGES = {"a": "int64", "b": "int64"}


def clusterable(chunks: DataFrame, vectors: DataFrame, docs: DataFrame, folder=None) -> DataFrame:
    """Embedded chunks of documents the clustering job did not write itself, with the file time of their document."""
    d = docs.select("rel_path", "mtime").filter(~is_self_made("rel_path", folder))
    return chunks.join(vectors, "chunk_id").join(d, "rel_path")


def _unit(series):
    m = np.stack(series.to_numpy()).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _slabs(a, b):
    """(rows of a, their cosines with all of b), some rows at a time: a pair of blocks is never one matrix of doubles."""
    left, right = _unit(a["embedding"]), _unit(b["embedding"]).T
    for start in range(0, len(left), SLAB):
        rows = slice(start, start + SLAB)
        yield rows, np.round(left[rows] @ right, 9)


def representatives(vectors: DataFrame):
    """(distinct vectors under their lowest id, map of every id to that id)."""
    keyed = vectors.filter(F.exists("embedding", lambda x: x != 0)).select(
        "chunk_id", "embedding", F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256).alias("_key")
    )
    lowest = keyed.groupBy("_key").agg(F.min("chunk_id").alias("rep"))  # combined before the shuffle, so copies are cheap
    member = keyed.select("chunk_id", "_key").join(lowest, "_key").select("chunk_id", "rep")
    reps = keyed.join(lowest.select(F.col("rep").alias("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "embedding")
    return reps, member


def _angles(series, pivots):
    return np.arccos(np.clip(_unit(series) @ pivots.T, -1.0, 1.0))


def choose_pivots(vectors: DataFrame, n) -> np.ndarray:
    """n unit vectors far from each other, taken one by one from a bounded sample of the table (lowest hashes of the
    ids): always the one whose nearest pivot is farthest away."""
    sample = vectors.select("embedding", F.xxhash64("chunk_id").alias("h"), "chunk_id").orderBy("h", "chunk_id").limit(PIVOT_SAMPLE)
    unit = _unit(sample.select("embedding").toPandas()["embedding"])
    taken, near = [0], unit @ unit[0]
    while len(taken) < min(n, len(unit)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[taken[-1]])
    return unit[taken]


def deal(vectors: DataFrame, threshold, block=BLOCK, pivots=None):
    """(home, guests): every vector with the `cell` of its nearest pivot, and copies of it for each later cell that can
    hold a neighbour, so that two vectors with a cosine of at least `threshold` meet in exactly one cell, the later of
    their two. Vectors that are null, zero or not finite have no neighbours and are left out.

    With an angle t for the threshold, a vector y of cell q near x has angle(x, q) <= angle(y, q) + t. That is at most
    the cell's radius + t, and, as y is no farther from its own pivot q than from x's, at most angle(x, home) + 2 t.
    A threshold of zero or less prunes nothing."""
    sound = F.forall("embedding", lambda x: F.abs(x) < float("inf")) & F.exists("embedding", lambda x: x != 0)
    vectors = cut(vectors.filter(sound))
    n = min(MAX_PIVOTS, -(-vectors.count() // block)) if pivots is None else pivots
    if threshold <= 0 or n <= 1:
        home = vectors.withColumn("cell", F.lit(0))
        return home, home.limit(0)
    pivot, t = choose_pivots(vectors, n), float(np.arccos(min(threshold - 1e-8, 1.0)) + SLACK)

    @F.pandas_udf("cell int, angle double")
    def nearest(embedding: pd.Series) -> pd.DataFrame:
        a = _angles(embedding, pivot)
        return pd.DataFrame({"cell": a.argmin(axis=1).astype("int32"), "angle": a.min(axis=1)})

    home = cut(vectors.withColumn("_near", nearest("embedding")).select(*vectors.columns, "_near.cell", "_near.angle"))
    radius = np.full(len(pivot), -np.inf)  # a cell without vectors has no guests
    for r in home.groupBy("cell").agg(F.max("angle").alias("angle")).collect():  # at most MAX_PIVOTS rows
        radius[r.cell] = r.angle

    @F.pandas_udf("array<int>")
    def later(embedding: pd.Series, cell: pd.Series, angle: pd.Series) -> pd.Series:
        within = np.minimum(radius[None, :] + t, angle.to_numpy()[:, None] + 2 * t)
        fits = (_angles(embedding, pivot) <= within + SLACK) & (np.arange(len(pivot)) > cell.to_numpy()[:, None])
        return pd.Series([np.flatnonzero(x).astype("int32") for x in fits])

    guests = home.withColumn("_cell", F.explode(later("embedding", "cell", "angle"))).drop("cell", "angle").withColumnRenamed("_cell", "cell")
    return home.drop("angle"), guests


def meetings(vectors: DataFrame, threshold=DEFAULTS.cluster_threshold, block=BLOCK, pivots=None) -> DataFrame:
    """(n_pairs, n_met, skipped): unordered pairs of vectors, those that meet in a cell, and the share that never does."""
    home, guests = deal(vectors.select("chunk_id", "embedding"), threshold, block, pivots)
    size = home.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(guests.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell", "left")
    n, m = F.col("n").cast("double"), F.coalesce("m", F.lit(0))
    met = size.agg(F.sum("n").cast("double").alias("_n"), F.coalesce(F.sum(n * (n - 1) / 2 + n * m), F.lit(0.0)).alias("n_met"))
    pairs = F.coalesce(F.col("_n") * (F.col("_n") - 1) / 2, F.lit(0.0))
    return met.select(pairs.alias("n_pairs"), "n_met", F.when(pairs > 0, 1 - F.col("n_met") / pairs).otherwise(0.0).alias("skipped"))


def _meet(home: DataFrame, guests: DataFrame, work, schema: str, block=BLOCK) -> DataFrame:
    """Runs `work(left, right, same)` once for every unordered pair of bounded blocks of a cell's own rows, and for every
    block of its own rows with every block of its guests."""
    def blocks(df, name):
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    size = blocks(home, "own").join(blocks(guests, "foreign"), "cell", "left").withColumn("foreign", F.coalesce("foreign", F.lit(0)))
    key = F.xxhash64("chunk_id")
    own = home.join(size, "cell").withColumn("blk", F.pmod(key, F.col("own")).cast("int"))
    visit = guests.join(size, "cell").withColumn("blk", (F.col("own") + F.pmod(key, F.col("foreign"))).cast("int"))
    left = own.withColumn("j", F.explode(F.sequence("blk", F.col("own") + F.col("foreign") - 1))).withColumnRenamed("blk", "i")
    right = own.withColumn("i", F.explode(F.sequence(F.lit(0), "blk"))).unionByName(
        visit.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))).withColumnRenamed("blk", "j")

    def run(key, a, b):
        return work(a, b, key[1] == key[2])

    keys, right = ["cell", "i", "j"], right.drop("own", "foreign")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # names of its own beside the left side
    return left.drop("own", "foreign").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _block_pairs(vectors: DataFrame, work, schema: str, threshold, block=BLOCK, pivots=None) -> DataFrame:
    """`work(left, right, same)` over blocks in which every pair of vectors at `threshold` or more meets once."""
    home, guests = deal(vectors, threshold, block, pivots)
    return _meet(home, guests, work, schema, block)


def partners(vectors: DataFrame, threshold=DEFAULTS.cluster_threshold, block=BLOCK, pivots=None) -> DataFrame:
    """(chunk_id, n_partners, first_partner, best_cos) for vectors with another one at `threshold` or more."""

    def work(a, b, same):
        rows = []
        if len(a) and len(b):
            ib = b["chunk_id"].to_numpy()
            for slab, cos in _slabs(a, b):
                ia = a["chunk_id"].to_numpy()[slab]
                near = (cos >= threshold) & (ia[:, None] != ib[None, :])
                for ids, others, hit, c in ((ia, ib, near, cos),) if same else ((ia, ib, near, cos), (ib, ia, near.T, cos.T)):
                    some = np.flatnonzero(hit.any(axis=1))
                    for r in some:
                        js = np.flatnonzero(hit[r])
                        rows.append((ids[r], len(js), others[js].min(), c[r, js].max()))
        return pd.DataFrame(rows, columns=["chunk_id", "n", "first_partner", "best_cos"])

    part = _block_pairs(vectors.select("chunk_id", "embedding"), work, "chunk_id long, n long, first_partner long, best_cos double",
                        threshold, block, pivots)
    return part.groupBy("chunk_id").agg(
        F.sum("n").alias("n_partners"), F.min("first_partner").alias("first_partner"), F.max("best_cos").alias("best_cos")
    )


def _forest(ia, ib, near):
    """Edges of a spanning forest of the bipartite hit matrix."""
    ids = np.unique(np.concatenate([ia, ib]))
    parent = np.arange(len(ids))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    pa, pb = np.searchsorted(ids, ia), np.searchsorted(ids, ib)
    for r in np.flatnonzero(near.any(axis=1)):
        x = root(pa[r])
        for c in np.flatnonzero(near[r]):
            y = root(pb[c])
            if x != y:
                out.append((ia[r], ib[c]))
                parent[max(x, y)] = min(x, y)
                x = min(x, y)
    return out


def similar_edges(vectors: DataFrame, threshold=DEFAULTS.cluster_threshold, block=BLOCK, pivots=None) -> DataFrame:
    """(a, b): edges whose connected groups equal those of all pairs at `threshold` or more."""

    def work(a, b, same):
        edges = []
        if len(a) and len(b):
            ia, ib = a["chunk_id"].to_numpy(), b["chunk_id"].to_numpy()
            near = ia[:, None] != ib[None, :]
            for slab, cos in _slabs(a, b):
                near[slab] &= cos >= threshold
            edges = _forest(ia, ib, near)
        return pd.DataFrame(edges, columns=["a", "b"]).astype(_EMPTY_EDGES)

    return _block_pairs(vectors.select("chunk_id", "embedding"), work, "a long, b long", threshold, block, pivots)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the lowest node of each connected group, by alternating star contraction: every node hands its
    larger neighbours, then its smaller ones, to the smallest neighbour it knows, until only stars are left. The edge
    table is written to the shared folder every round."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        hand = e.join(low, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = cut(hand.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        inner = e.select(F.col("u").alias("x")).intersect(e.select(F.col("v").alias("x")))
        several = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if inner.isEmpty() and several.isEmpty():
            break
    centres = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres)


def groups(vectors: DataFrame, threshold=DEFAULTS.cluster_threshold, max_size=DEFAULTS.cluster_max_size) -> DataFrame:
    """(cluster_id, part, chunk_id): connected near-duplicates, cut into parts of at most `max_size` in id order.
    Groups of one are left out. Nothing is dropped: a large group becomes many parts."""
    reps, member = representatives(vectors)
    label = components(similar_edges(cut(reps), threshold))
    all_members = member.join(label.withColumnsRenamed({"node": "rep"}), "rep", "left").select(
        "chunk_id", F.coalesce("label", "rep").alias("cluster_id")
    )
    # Number members without pulling one group through one task: count per (group, bucket), then offset.
    bucket = F.floor(F.col("chunk_id") / 65536)
    numbered = all_members.withColumn("bucket", bucket)
    sizes = numbered.groupBy("cluster_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cluster_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inner = Window.partitionBy("cluster_id", "bucket").orderBy("chunk_id")
    placed = numbered.withColumn("i", F.row_number().over(inner)).join(sizes, ["cluster_id", "bucket"])
    total = sizes.groupBy("cluster_id").agg(F.sum("n").alias("total")).filter("total > 1")
    return placed.join(total, "cluster_id").select(
        "cluster_id", F.floor((F.col("offset") + F.col("i") - 1) / max_size).cast("int").alias("part"), "chunk_id"
    )


def leader_clusters(chunks: DataFrame, threshold=DEFAULTS.cluster_threshold, max_size=DEFAULTS.cluster_max_size) -> DataFrame:
    """(cluster_id, chunk_id): single pass in chunk order; a chunk joins the first cluster with room whose centroid is
    within `threshold`. chunks: block, chunk_id, embedding; each block is clustered on its own.

    A member of such a cluster has cosine of at least threshold squared to some earlier member, so the connected groups
    at that looser threshold (`leader_blocks`) never share a cluster and give the same result as one pass over all."""

    def run(pdf):
        pdf = pdf.sort_values("chunk_id")
        unit = _unit(pdf["embedding"])
        sums = np.zeros((0, unit.shape[1]))
        sizes, label, names = np.zeros(0, dtype=int), [], []
        for i, v in enumerate(unit):
            hit = -1
            if len(sizes):
                sim = np.round(sums @ v / np.linalg.norm(sums, axis=1), 9)
                ok = np.flatnonzero((sim >= threshold) & (sizes < max_size))
                hit = int(ok[0]) if len(ok) else -1
            if hit < 0:
                sums, sizes = np.vstack([sums, v]), np.append(sizes, 1)
                names.append(pdf["chunk_id"].iloc[i])
                hit = len(names) - 1
            else:
                sums[hit] += v
                sizes[hit] += 1
            label.append(hit)
        label = np.array(label)
        keep = sizes[label] > 1
        return pd.DataFrame({"cluster_id": np.array(names)[label][keep], "chunk_id": pdf["chunk_id"].to_numpy()[keep]})

    return chunks.groupBy("block").applyInPandas(run, "cluster_id long, chunk_id long")


def leader_blocks(vectors: DataFrame, threshold=DEFAULTS.cluster_threshold) -> DataFrame:
    """chunks with the `block` they can be leader-clustered in; chunks without a partner are left out."""
    reps, member = representatives(vectors)
    label = components(similar_edges(cut(reps), threshold * threshold))
    block = member.join(label.withColumnsRenamed({"node": "rep"}), "rep", "left").select("chunk_id", F.coalesce("label", "rep").alias("block"))
    some = block.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return vectors.join(block.join(some, "block", "left_semi"), "chunk_id").select("block", "chunk_id", "embedding")


def signature(texts):
    """Content signature of a cluster from the array of its member texts' hashes (first 16 hex of sha256)."""
    return F.left(F.sha2(F.array_join(F.array_sort(texts), ""), 256), F.lit(12))


def catalogue(members: DataFrame) -> DataFrame:
    """Per cluster: signature, size, sources and newest date. members: cluster_id, part, text, rel_path, mtime."""
    return members.groupBy("cluster_id", "part").agg(
        signature(F.collect_list(F.left(F.sha2(F.encode("text", "UTF-8"), 256), F.lit(16)))).alias("signature"),
        F.count(F.lit(1)).alias("size"), F.countDistinct("rel_path").alias("n_sources"), F.max("mtime").alias("newest"),
        F.array_join(F.array_sort(F.collect_set("rel_path")), "|").alias("sources"),
    )


def missing_syntheses(catalogue_df: DataFrame, existing: DataFrame) -> DataFrame:
    """Clusters whose signature has not been written yet."""
    return catalogue_df.join(existing.select("signature"), "signature", "left_anti")


_NO_FILE = -1


def merge_candidates(vectors: DataFrame, threshold=DEFAULTS.cluster_threshold, block=BLOCK, pivots=None) -> DataFrame:
    """(chunk_id, merge_with, cosine, n_partners): for review, the closest chunk of a different file at `threshold` or
    more, the lowest of equals. vectors: chunk_id, embedding, rel_path, none of them null.

    Copies travel once. A class of equal vectors stands for its members with their number and the lowest ids of two
    different files: whoever is in the file of the best one takes the best of another file. Partners in a chunk's own
    file are counted apart, among the vectors of that file, and taken off."""
    reps, member = representatives(vectors)
    member = cut(member.join(vectors.select("chunk_id", "rel_path"), "chunk_id"))
    entry = cut(member.groupBy("rep", "rel_path").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("low")))
    first = entry.groupBy("rep").agg(F.sum("n").alias("n"), F.min(F.struct("low", "rel_path")).alias("_a"))
    other = entry.join(first.select("rep", F.col("_a.rel_path").alias("_file")), "rep").filter("rel_path <> _file")
    second = other.groupBy("rep").agg(F.min(F.struct("low", "rel_path")).alias("_b"))
    classes = reps.withColumnRenamed("chunk_id", "rep").join(first, "rep").join(second, "rep", "left").select(
        F.col("rep").alias("chunk_id"), "embedding", "n", F.col("_a.low").alias("id1"), F.col("_a.rel_path").alias("f1"),
        F.coalesce("_b.low", F.lit(_NO_FILE)).alias("id2"), blank("_b.rel_path").alias("f2"))

    def best(a, b, same):
        rows = []
        if len(a) and len(b):
            for slab, cos in _slabs(a, b):
                part = a.iloc[slab]
                if same:
                    np.fill_diagonal(cos[:, slab], 1.0)
                near = cos >= threshold
                for one, two, hit, c in ((part, b, near, cos),) if same else ((part, b, near, cos), (b, part, near.T, cos.T)):
                    n, low = two["n"].to_numpy(), two[["id1", "id2"]].to_numpy()
                    files = two[["f1", "f2"]].to_numpy()
                    for r in np.flatnonzero(hit.any(axis=1)):
                        js = np.flatnonzero(hit[r])
                        ids, fs, cs = low[js].ravel(), files[js].ravel(), np.repeat(c[r, js], 2)
                        order = np.lexsort((ids, -cs))
                        order = order[ids[order] != _NO_FILE]
                        top = order[0]
                        rows.append((one["chunk_id"].iat[r], n[js].sum(), cs[top], ids[top], fs[top]))
                        apart = order[fs[order] != fs[top]]
                        if len(apart):
                            rows.append((one["chunk_id"].iat[r], 0, cs[apart[0]], ids[apart[0]], fs[apart[0]]))
        return pd.DataFrame(rows, columns=["rep", "n", "cosine", "other", "file"])

    found = cut(_block_pairs(classes, best, "rep long, n long, cosine double, other long, file string", threshold, block, pivots))
    nearest = F.max(F.struct("cosine", (-F.col("other")).alias("other"), "file"))
    top = found.groupBy("rep").agg(F.sum("n").alias("n"), nearest.alias("top"))
    apart = found.join(top.select("rep", F.col("top.file").alias("_file")), "rep").filter("file <> _file").groupBy("rep").agg(nearest.alias("apart"))

    def inside(a, b, same):
        rows = []
        if len(a) and len(b):
            near = np.empty((len(a), len(b)), bool)
            for slab, cos in _slabs(a, b):
                near[slab] = cos >= threshold
            if same:
                np.fill_diagonal(near, True)
            near &= a["rel_path"].to_numpy()[:, None] == b["rel_path"].to_numpy()[None, :]
            for one, two, hit in ((a, b, near),) if same else ((a, b, near), (b, a, near.T)):
                n = hit @ two["n"].to_numpy()
                rows += [(one["rep"].iat[r], one["rel_path"].iat[r], n[r]) for r in np.flatnonzero(n)]
        return pd.DataFrame(rows, columns=["rep", "rel_path", "own"])

    # the vectors of a file are together in one cell, a file of many in several blocks of it
    n_cells = max(1, -(-entry.count() // block))
    home = entry.join(reps.withColumnRenamed("chunk_id", "rep"), "rep").select(
        F.pmod(F.xxhash64("rel_path"), F.lit(n_cells)).cast("int").alias("cell"), F.col("low").alias("chunk_id"), "rep", "rel_path", "n", "embedding")
    own = _meet(home, home.limit(0), inside, "rep long, rel_path string, own long", block).groupBy("rep", "rel_path").agg(F.sum("own").alias("own"))
    per = own.join(top, "rep").join(apart, "rep", "left").filter("n > own")
    pick = F.when(F.col("top.file") != F.col("rel_path"), F.col("top")).otherwise(F.col("apart"))
    verdict = per.select("rep", "rel_path", pick.alias("pick"), (F.col("n") - F.col("own")).alias("n_partners"))
    return member.join(verdict, ["rep", "rel_path"]).select(
        "chunk_id", (-F.col("pick.other")).alias("merge_with"), F.col("pick.cosine").alias("cosine"), "n_partners")


def dedup_verdict(similarity, same_file, same_concern, is_canon, candidate_type, contradicts, update_band=(0.78, 0.92)):
    """What to do with a candidate given its nearest neighbour."""
    lo, hi = update_band
    return (
        F.when(contradicts, F.lit("CONFLICT"))
        .when((similarity >= hi) & same_file, F.lit("DUPLICATE"))
        .when(is_canon & candidate_type.isin("project", "reference") & (similarity >= lo), F.lit("POINTER"))
        .when((similarity >= lo) & (similarity < hi) & same_concern, F.lit("UPDATE"))
        .otherwise(F.lit("CREATE"))
    )


def write_risk(verdict, kind, confidence, floor=0.5, review_floor=0.75):
    """STRUCT<tier, autonomy> of a write."""
    def out(tier, autonomy):
        return F.struct(F.lit(tier).alias("tier"), F.lit(autonomy).alias("autonomy"))

    enough = confidence >= floor
    return (
        F.when(verdict == "CONFLICT", out("high", "queue"))
        .when(verdict == "UPDATE", F.when(enough, out("low", "auto")).otherwise(out("low", "queue")))
        .when(kind.isin("feedback", "user"), F.when(confidence >= review_floor, out("med", "auto")).otherwise(out("med", "queue")))
        .otherwise(F.when(enough, out("low-med", "auto")).otherwise(out("low-med", "queue")))
    )
