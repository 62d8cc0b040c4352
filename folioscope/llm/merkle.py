"""Merkle manifest of a table: one 16-ary hash tree per source, one over the sources, membership proofs for every row.

H is the lowercase hex sha256 of its inputs concatenated, digests as hex text. A leaf is H of doc_id, source, lang,
n_chars and text, each `-` if null, else its UTF-8 byte count, a colon and the value. Runs of FAN consecutive nodes become
their H until one is left.

Layout: a tree is cut into aligned blocks of LEVELS reductions. A block is one flat array of 32-byte digests in van Emde
Boas order: the upper half of its levels first, then each subtree of the lower half, each laid out by the same rule.
`address` finds any node by arithmetic, for construction and for the siblings of a proof alike. Block roots are the leaves
of the next round of blocks. Proofs go the other way: a block learns the siblings above its root and hands its leaves
theirs, so a row reads one block and one short chain.

Positions: digests are dealt by range, numbered inside their partition, and moved by the counts of the partitions
before; no source is sorted in one task. Only digests are moved; texts are read once.

Tampering lower-cases A-Z of the text where TAMPERED divides the crc32 of the decimal doc_id. A row whose doc_id is null is
not tampered with and comes first in its source; rows that share a doc_id are ordered by their leaf, repeated rows are
leaves of their own. A null source is a source of its own, before all others. Long texts are hashed whole. Other columns
are not read. An empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FAN = 16
LEVELS = 3
TAMPERED = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHAIN = "array<struct<l:string,r:string>>"
BLOCKS = "tree string, block long, total long, doc_ids array<long>, tampered array<binary>, nodes binary, root binary"
CARRIED = "tree string, child long, top binary, chain array<struct<l:string,r:string>>"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- layout -------------------------------------------------------------------------------------------------------

def slots(height):
    return (FAN**height - 1) // (FAN - 1)


def address(height, depth, index):
    """Place of node `index` (a number or an array) of a level, counted from the root, in a block of `height` levels."""
    if height == 1:
        return index * 0
    upper = height // 2
    if depth < upper:
        return address(upper, depth, index)
    lower, below = height - upper, FAN ** (depth - upper)
    return slots(upper) + index // below * slots(lower) + address(lower, depth - upper, index % below)


def reductions(total, most):
    """How often `total` nodes are reduced inside one block of at most `most` reductions."""
    return next(k for k in range(most + 1) if FAN**k >= total or k == most)


def widths(n, levels):
    """Nodes of each depth, root first, above n leaves."""
    return [-(-n // FAN**k) for k in range(levels, -1, -1)]


def lay_out(leaves, levels):
    """Digests of the leaves -> the block's array (n x 32 bytes)."""
    height, width, level = levels + 1, widths(len(leaves), levels), [d.hex() for d in leaves]
    nodes = np.zeros((max(int(np.max(address(height, d, np.arange(w)))) for d, w in enumerate(width)) + 1, 32), "u1")
    for depth in range(levels, -1, -1):
        if depth < levels:
            level = [H("".join(level[k : k + FAN])) for k in range(0, len(level), FAN)]
        nodes[address(height, depth, np.arange(width[depth]))] = np.frombuffer(bytes.fromhex("".join(level)), "u1").reshape(-1, 32)
    return nodes


class Block:
    """A laid-out block, read by address."""

    def __init__(self, payload, n, levels):
        self.nodes, self.height, self.widths = np.frombuffer(payload, "u1").reshape(-1, 32), levels + 1, widths(n, levels)

    def run(self, depth, number):
        """Hex digests of run `number` of a level."""
        at = address(self.height, depth, np.arange(number * FAN, min((number + 1) * FAN, self.widths[depth])))
        text = self.nodes[at].tobytes().hex()
        return [text[k : k + 64] for k in range(0, len(text), 64)]

    def chains(self, above):
        """For every run of leaves: its digests, and the (left, right) siblings of the nodes above, from below upwards."""
        paths = [list(above)]
        for depth in range(1, self.height - 1):
            runs = [self.run(depth, k) for k in range(self.widths[depth - 1])]
            paths = [[("".join(r[:j]), "".join(r[j + 1 :])), *paths[k]] for k, r in enumerate(runs) for j in range(len(r))]
        if self.height == 1:
            return [(self.run(0, 0), None, paths[0])]
        return [(self.run(self.height - 1, k), True, path) for k, path in enumerate(paths)]


# ---- construction -------------------------------------------------------------------------------------------------

def leaf(text):
    parts = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text]
    sized = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*sized), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """Written: tree (its order is that of the sources, null first), doc_id, leaf, tampered (null if the row is not tampered with)."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    tampered = F.when(chosen, leaf(F.translate("text", UPPER, UPPER.lower())))
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    return stored(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")


def placed(rows: DataFrame, *order) -> DataFrame:
    """Add `pos`, the place in its tree by `order`, and `total`, the rows of the tree."""
    by = ["tree", *order]
    dealt = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("spot", F.monotonically_increasing_id()), "merkle-placed")
    dealt = dealt.withColumn("part", F.shiftright("spot", 33))
    counts = dealt.groupBy("tree", "part").agg(F.min("spot").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = counts.select("tree", "part", (earlier - F.col("first")).alias("move"), F.sum("n").over(tree).alias("total"))
    return dealt.join(moved, ["tree", "part"]).withColumn("pos", F.col("spot") + F.col("move")).drop("part", "spot", "move")


def make_block(key, rows, most):
    rows = rows.sort_by("pos")
    total, digests = rows["total"][0].as_py(), rows["digest"].to_pylist()
    nodes = lay_out(digests, reductions(total, most))
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("tampered", pa.list_(pa.binary())), ("nodes", pa.binary()), ("root", pa.binary())])
    made = [key[0].as_py(), key[1].as_py(), total, rows["doc_id"].to_pylist(), rows["tampered"].to_pylist(), nodes.tobytes(), nodes[0].tobytes()]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(made, schema, strict=True)], schema=schema)


def build(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """(tree, pos, total, digest, doc_id, tampered) -> the written blocks of every round, leaves first."""
    rounds, block = [], FAN**levels

    def laid_out(key, rows):
        return make_block(key, rows, levels)

    while True:
        keyed = nodes.withColumn("block", F.floor(F.col("pos") / block))
        rounds.append(stored(keyed.groupBy("tree", "block").applyInArrow(laid_out, BLOCKS), "merkle-blocks"))
        open_ = rounds[-1].filter(F.col("total") > block)
        if open_.isEmpty():
            return rounds
        above = F.ceil(F.col("total") / block)
        nodes = open_.select("tree", F.col("block").alias("pos"), above.alias("total"), F.col("root").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered"))


def roots(rounds, levels) -> DataFrame:
    done = [r.filter(F.col("total") <= FAN**levels).select("tree", F.col("root").alias("digest")) for r in rounds]
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


# ---- proofs -------------------------------------------------------------------------------------------------------

def columns(batch, names):
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def opened(batch, levels, *more):
    """Per block: its first leaf's place, its runs with the siblings above each, and its values of the columns `more`."""
    for block, total, payload, doc_ids, chain, *rest in columns(batch, ["block", "total", "nodes", "doc_ids", "chain", *more]):
        above = [(x["l"], x["r"]) for x in chain]
        yield block * FAN**levels, Block(payload, len(doc_ids), reductions(total, levels)).chains(above), doc_ids, *rest


def carry(levels):
    """Every leaf of a block with the siblings above it."""
    link = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))

    def run_(batches):
        for batch in batches:
            for at, runs, _, tree, top in opened(batch, levels, "tree", "top"):
                for run, inner, path in runs:
                    rows = [[("".join(run[:j]), "".join(run[j + 1 :])), *path] if inner else path for j in range(len(run))]
                    links = pa.array([[{"l": left, "r": right} for left, right in row] for row in rows], link)
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(run)), pa.array(range(at, at + len(run)), pa.int64()), pa.array([top] * len(run), pa.binary()), links], names=["tree", "child", "top", "chain"])
                    at += len(run)

    return run_


def prove(levels):
    """Every row of a bottom block with its proof, folded anew from the leaf as it is now."""
    names = [c.split()[0] for c in PROOFS.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def run_(batches):
        for batch in batches:
            for _, runs, doc_ids, tampered, subroot, root in opened(batch, levels, "tampered", "subroot", "top"):
                subroot, root, out, at = subroot.hex(), root.hex(), [], 0
                for run, inner, path in runs:
                    upper, folded = "".join(left + right for left, right in path), {}
                    for j, digest in enumerate(run):
                        left, right = ("".join(run[:j]), "".join(run[j + 1 :])) if inner else ("", "")
                        now = tampered[at].hex() if tampered[at] is not None else digest
                        up = H(left + now + right) if inner else now
                        if up not in folded:
                            end = up
                            for before, after in path:
                                end = H(before + end + after)
                            folded[up] = end
                        out.append((doc_ids[at], digest, subroot, root, H(left + right + upper), folded[up], folded[up] == root))
                        at += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run_


def descend(rounds, tops: DataFrame, levels: int) -> DataFrame:
    """`tops`: tree, top (a digest to hand down), chain (siblings above the tree's root) -> the bottom blocks with both."""
    handed, block = None, FAN**levels
    for depth in range(len(rounds) - 1, -1, -1):
        whole = rounds[depth].filter(F.col("total") <= block).join(tops, "tree")
        if handed is not None:
            below = rounds[depth].filter(F.col("total") > block)
            whole = whole.unionByName(below.join(handed.withColumnRenamed("child", "block"), ["tree", "block"]))
        if depth:
            handed = whole.mapInArrow(carry(levels), CARRIED)
    return whole


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per row: its leaf, its source's root, the root, the digest of its proof, and the root folded from the row as it is after tampering."""
    trees = build(placed(leaves(docs), "doc_id", "digest", "row"), levels)
    subroots = placed(roots(trees, levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered")), "name")
    subroots = stored(subroots, "merkle-subroots")
    top = build(subroots, levels)
    root = top[-1].select("tree", F.col("root").alias("top"), F.array().cast(CHAIN).alias("chain"))
    ends = descend(top, root, levels).mapInArrow(carry(levels), CARRIED).drop("tree")
    tops = ends.join(subroots.select(F.col("pos").alias("child"), F.col("name").alias("tree"), F.col("digest").alias("subroot")), "child").drop("child")
    tops = stored(tops, "merkle-tops")
    below = descend(trees, tops.drop("subroot"), levels)
    return below.join(tops.select("tree", "subroot"), "tree").mapInArrow(prove(levels), PROOFS)
