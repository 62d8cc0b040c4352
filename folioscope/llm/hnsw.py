"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Vectors are dealt into shards by a hash of the id. Within a shard equal directions are one node with its members, so
that a vector copied many times cannot crowd out the links. A node is on level k with probability LEVEL_SHARE ** k. Each
level is a matrix of neighbour numbers (-1: none); nodes are inserted in growing batches: a beam search over the graph so
far, entered from the level above, gives candidates, and links are chosen for closeness and diversity, both ways. The
index of a shard is one row of flat arrays. Queries are dealt into blocks of bounded size and meet every shard; what
each shard finds is scored in double precision on the original vectors, and the best k over all shards are kept.

Vectors that are null, zero or hold null or non-finite components take no part. Vectors of different length are compared
only with their like. Of rows that share a vec_id the smallest vector counts. A query does not find its own vec_id. Rows
with a null vec_id take no part. Other columns are not read. An empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS = 4096
QUERY_BLOCK = 4096
LINKS, BASE_LINKS = 16, 32
BUILD_BEAM, SEARCH_BEAM = 64, 128
BATCH = 256
EXPAND = 4
LEVEL_SHARE = 1 / 16
TOP_NODES = 64
INDEX = "dim int, shard int, n_nodes int, vectors binary, member_ids binary, member_vectors binary, member_starts binary, level_sizes binary, level_nodes binary, links binary"


def usable(c):
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(c).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def beam_search(vectors, links, queries, entries, beam):
    """For each query the `beam` best nodes reached from its entries: numbers and similarities, best first (-1: none)."""
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True
    best, sims = np.full((q, beam), -1), np.full((q, beam), -np.inf, dtype=np.float32)
    fresh, open_ = np.where(entries < 0, n, entries), np.zeros((q, beam), dtype=bool)
    active = np.arange(q)
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), dtype=vectors.dtype)])
    while len(active):
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        fresh = np.where(seen[active[:, None], fresh], n, fresh)
        seen[active[:, None], fresh] = True
        near = np.einsum("qd,qmd->qm", queries[active], padded[fresh])
        near[fresh == n] = -np.inf
        all_best = np.concatenate([best[active], np.where(fresh == n, -1, fresh)], axis=1)
        all_sims = np.concatenate([sims[active], near], axis=1)
        all_open = np.concatenate([open_[active], fresh != n], axis=1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        best[active], sims[active] = np.take_along_axis(all_best, top, 1), np.take_along_axis(all_sims, top, 1)
        open_[active] = np.take_along_axis(all_open, top, 1)
        active = active[open_[active].any(axis=1)]
        if not len(active):
            break
        turn = np.cumsum(open_[active], axis=1)
        now = open_[active] & (turn <= EXPAND)
        place = np.argsort(~now, axis=1, kind="stable")[:, :EXPAND]
        chosen = np.take_along_axis(now, place, 1)
        nodes = np.where(chosen, np.take_along_axis(best[active], place, 1), -1)
        open_[active] &= ~now
        fresh = np.where((nodes < 0)[:, :, None], -1, links[nodes]).reshape(len(active), -1)
        fresh = np.where(fresh < 0, n, fresh)
    return best, sims


def diverse(vectors, candidates, sims, keep):
    """Of each row's candidates (best first, -1: none) up to `keep` that are closer to the node than to any one chosen
    before; places left over go to the closest of the others."""
    many, width = candidates.shape
    found = vectors[candidates]
    between = np.einsum("bid,bjd->bij", found, found)
    chosen, closest, count = np.zeros((many, width), dtype=bool), np.full((many, width), -np.inf, dtype=np.float32), np.zeros(many, dtype=int)
    for r in range(width):
        take = (candidates[:, r] >= 0) & (count < keep) & (sims[:, r] > closest[:, r])
        chosen[:, r] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, r, :]), closest)
    rank = np.where(candidates < 0, 3, np.where(chosen, 0, 1)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :keep]
    out = np.take_along_axis(candidates, order, 1)
    if out.shape[1] < keep:
        out = np.hstack([out, np.full((many, keep - out.shape[1]), -1)])
    return out


def add_links(vectors, links, new, candidates, sims, keep):
    """Choose the links of the new nodes and enter each also at its other end."""
    chosen = diverse(vectors, candidates, sims, keep // 2)
    links[new] = -1
    links[new, : chosen.shape[1]] = chosen
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
    if not len(nodes):
        return
    width = keep + int(counts.max())
    offered = np.full((len(nodes), width), -1)
    offered[:, :keep] = links[nodes]
    offered[np.repeat(np.arange(len(nodes)), counts), keep + np.arange(len(target)) - np.repeat(starts, counts)] = source
    offered = np.sort(offered, axis=1)[:, ::-1]
    offered[:, 1:][offered[:, 1:] == offered[:, :-1]] = -1
    for at in range(0, len(nodes), 512):
        part, own = offered[at : at + 512], nodes[at : at + 512]
        near = np.einsum("bd,bkd->bk", vectors[own], vectors[part])
        near[part < 0] = -np.inf
        top = np.argsort(-near, axis=1, kind="stable")
        part, near = np.take_along_axis(part, top, 1), np.take_along_axis(near, top, 1)
        most = max(keep, int((part >= 0).sum(axis=1).max()))
        links[own] = diverse(vectors, part[:, :most], near[:, :most], keep)


def level_graph(vectors, order, entries_of, keep):
    """Neighbour matrix over the nodes in `order`, inserted in that order."""
    n = len(vectors)
    links, done = np.full((n, keep), -1), 0
    placed = np.full(n, n)
    placed[order] = np.arange(len(order))
    while done < len(order):
        new = order[done : done + BATCH]
        own = vectors[new] @ vectors[new].T
        own[np.arange(len(new)), np.arange(len(new))] = -np.inf
        some = min(len(new) - 1, BUILD_BEAM // 2 if done else BUILD_BEAM)
        top = np.argsort(-own, axis=1, kind="stable")[:, :some]
        candidates, sims = new[top], np.take_along_axis(own, top, 1)
        if done:
            entries = entries_of(new)
            entries = np.where((entries >= 0) & (placed[entries] < done), entries, -1)
            entries = np.hstack([entries, np.full((len(new), 1), order[0])])
            far, far_sims = beam_search(vectors, links, vectors[new], entries, BUILD_BEAM)
            candidates, sims = np.hstack([candidates, far]), np.hstack([sims, far_sims])
            best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            candidates, sims = np.take_along_axis(candidates, best, 1), np.take_along_axis(sims, best, 1)
        done += len(new)
        if candidates.shape[1]:
            add_links(vectors, links, new, candidates, sims.astype(np.float32), keep)
    return links


class Graph:
    """Levels from the base up: (node numbers, neighbour matrix); the top level is searched whole."""

    def __init__(self, vectors, levels):
        self.vectors, self.levels = vectors, levels

    @staticmethod
    def build(vectors):
        n = len(vectors)
        height = np.floor(-np.log(1 - np.random.default_rng(11).random(n)) / -np.log(LEVEL_SHARE)).astype(int)
        graph = Graph(vectors, [])
        order = np.argsort(-height, kind="stable")
        sets = [order]
        while len(sets[-1]) > TOP_NODES:
            higher = order[: int((height >= len(sets)).sum())]
            if not len(higher) or len(higher) == len(sets[-1]):
                higher = sets[-1][: max(1, int(len(sets[-1]) * LEVEL_SHARE))]
            sets.append(higher)
        for k in range(len(sets) - 1, -1, -1):
            top = k == len(sets) - 1 and k > 0
            links = np.full((n, 0), -1) if top else level_graph(vectors, sets[k], lambda nodes: graph.entries(vectors[nodes], 2), BASE_LINKS if k == 0 else LINKS)
            graph.levels.insert(0, (sets[k], links))
        return graph

    def entries(self, queries, count):
        """Entry points for the level below the lowest built so far."""
        if not self.levels:
            return np.full((len(queries), 1), -1)
        top = self.levels[-1][0]
        near = queries @ self.vectors[top].T
        entry = top[np.argsort(-near, axis=1, kind="stable")[:, :count]]
        for _, links in reversed(self.levels[:-1]):
            entry = beam_search(self.vectors, links, queries, entry, 8)[0][:, :count]
        return entry

    def search(self, queries, beam):
        nodes, links = self.levels[0]
        if len(self.levels) == 1:
            upper = np.full((len(queries), 1), nodes[0])
        else:
            upper = Graph(self.vectors, self.levels[1:]).entries(queries, 4)
        return beam_search(self.vectors, links, queries, upper, beam)


def unit(vectors):
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def index_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    dim, shard = key
    rows = rows.assign(v=[tuple(v) for v in rows["v"]]).sort_values(["vec_id", "v"]).drop_duplicates("vec_id")
    ids, original = rows["vec_id"].to_numpy(np.int64), np.array(list(rows["v"]), dtype=np.float64)
    directions, member_of = np.unique(unit(original).astype(np.float32), axis=0, return_inverse=True)
    order = np.lexsort([ids, member_of.ravel()])
    starts = np.concatenate([[0], np.cumsum(np.bincount(member_of.ravel(), minlength=len(directions)))])
    graph = Graph.build(directions)
    flat = {
        "vectors": directions, "member_ids": ids[order], "member_vectors": original[order], "member_starts": starts.astype(np.int64),
        "level_sizes": np.array([[len(nodes), links.shape[1]] for nodes, links in graph.levels], dtype=np.int64),
        "level_nodes": np.concatenate([nodes for nodes, _ in graph.levels]).astype(np.int32),
        "links": np.concatenate([links[nodes].ravel() for nodes, links in graph.levels]).astype(np.int32),
    }
    return pd.DataFrame([{"dim": dim, "shard": shard, "n_nodes": len(directions), **{k: v.tobytes() for k, v in flat.items()}}])


def load(row):
    n, dim = int(row["n_nodes"]), int(row["dim"])
    vectors = np.frombuffer(row["vectors"], np.float32).reshape(n, dim)
    nodes, flat, levels = np.frombuffer(row["level_nodes"], np.int32), np.frombuffer(row["links"], np.int32), []
    for size, width in np.frombuffer(row["level_sizes"], np.int64).reshape(-1, 2):
        own, nodes = nodes[:size].astype(int), nodes[size:]
        links = np.full((n, width), -1)
        links[own] = flat[: size * width].reshape(size, width)
        flat = flat[size * width :]
        levels.append((own, links))
    ids = np.frombuffer(row["member_ids"], np.int64)
    return Graph(vectors, levels), ids, np.frombuffer(row["member_vectors"], np.float64).reshape(-1, dim), np.frombuffer(row["member_starts"], np.int64)


def searcher(k, beam):
    def search(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        queries = queries.assign(v=[tuple(v) for v in queries["v"]]).sort_values(["vec_id", "v"]).drop_duplicates("vec_id")
        graph, ids, members, starts = load(index.iloc[0])
        own = unit(np.array(list(queries["v"]), dtype=np.float64))
        exact, out = unit(members), []
        for at in range(0, len(own), BATCH):
            part = own[at : at + BATCH]
            nodes, _ = graph.search(part.astype(np.float32), beam)
            for q, found, me in zip(part, nodes, queries["vec_id"].to_numpy()[at : at + BATCH], strict=True):
                found = found[found >= 0][: k + 8]
                rows = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in found]) if len(found) else np.empty(0, int)
                rows = rows[ids[rows] != me]
                score = exact[rows] @ q
                best = np.lexsort([ids[rows], -score])[:k]
                out += [(int(me), int(i), float(s)) for i, s in zip(ids[rows][best], score[best], strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64"})

    return search


def shards(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))


def build_index(vectors: DataFrame, count: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, v) -> one row of flat arrays per (dim, shard)."""
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards(count, shard_rows))).cast("int")
    dealt = vectors.select(F.size("v").alias("dim"), shard.alias("shard"), "vec_id", "v")
    return dealt.groupBy("dim", "shard").applyInPandas(index_shard, INDEX)


def nearest(embeddings: DataFrame, is_query, k: int = 5, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that `is_query` selects."""
    usable_rows = embeddings.filter(usable("embedding") & F.col("vec_id").isNotNull())
    vectors = usable_rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = vectors.filter(is_query)
    index = stored(build_index(vectors, vectors.count(), shard_rows), "hnsw")
    blocks = shards(asked.count(), QUERY_BLOCK)
    number = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    each_shard = index.select(F.col("dim").alias("like"), F.col("shard").alias("at"))
    dealt = asked.select(F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    left = index.select("*", number).groupBy("dim", "shard", "block")
    met = dealt.join(each_shard, F.col("dim") == F.col("like"))
    right = met.select("dim", F.col("at").alias("shard"), "block", "vec_id", "v").groupBy("dim", "shard", "block")
    found = left.cogroup(right).applyInPandas(searcher(k, beam), "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", best, "vec_id", "score").filter(F.col("rank") <= k)
