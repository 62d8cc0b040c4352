"""Near-duplicates by SimHash fingerprints that differ in few bits.

Fingerprint: A-Z lower-cased, words are runs without ASCII white space, shingles of four words (fewer words: the whole
text as one), XXH64 with seed 42 per shingle, and a bit is set if more than half of the hashes set it. No words: zero.

Search: a fingerprint is eight positional bytes. Two fingerprints that differ in at most four bits share at least
eight minus four of them, so every linked pair meets in the intersection of some four postings of the inverted index
(position, byte). The index is therefore dealt by four postings at a time: a pair that meets has reached the guaranteed
minimum of shared bytes, and its bits are compared. Equal fingerprints are one entry. A bucket gives the edges of a
forest over its entries, never all pairs. A bucket of more than LIMIT entries is dealt once more by four of the eight
nibbles of its other bytes, by the same argument; 48 bits are then equal, so no bucket can hold more than 65,536.

Components contract by random hooks: every fingerprint moves to the neighbour with the smallest hash, edges follow,
until none is left. All of it stays distributed and every round is written to the shared folder.

Null and empty texts have fingerprint zero and are linked like any other. A component's id is its smallest doc_id;
null ids do not count, and a component of null ids only has a null id. Repeated rows are returned once each. Other
columns of the input are not read. An empty table gives an empty result.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import stored

WORDS = 4
SEED = 42
BITS = 4
LIMIT = 1 << 14
SHINGLE_BLOCK = 1 << 16
SUBSETS = [list(s) for s in combinations(range(8), 8 - BITS)]


def fingerprint_of(text) -> int:
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WORDS + 1)
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, n, SHINGLE_BLOCK):
        hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(first[k : k + SHINGLE_BLOCK], last[k : k + SHINGLE_BLOCK], strict=True)])
        total += np.unpackbits(np.frombuffer(hashes, "u1").reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def hex_of(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _batch(**columns):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def post(batches):
    """Each fingerprint under the 70 intersections of four postings: key = subset, four bytes."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        byte = fp.view("u1").reshape(-1, 8).astype("i8")
        for number, (a, b, c, d) in enumerate(SUBSETS):
            key = (number << 32) | (byte[:, a] << 24) | (byte[:, b] << 16) | (byte[:, c] << 8) | byte[:, d]
            yield _batch(key=key, fp=fp)


def post_again(batches):
    """Entries of a large bucket under four of the eight nibbles of the bytes that its key leaves open."""
    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in range(2))
        byte = fp.view("u1").reshape(-1, 8).astype("i8")
        for number in np.unique(key >> 32):
            rows = np.flatnonzero(key >> 32 == number)
            rest = byte[np.ix_(rows, [i for i in range(8) if i not in SUBSETS[number]])]
            nibble = np.concatenate([rest >> 4, rest & 15], axis=1)
            for again, (a, b, c, d) in enumerate(SUBSETS):
                value = (nibble[:, a] << 12) | (nibble[:, b] << 8) | (nibble[:, c] << 4) | nibble[:, d]
                yield _batch(key=(key[rows] << 23) | (again << 16) | value, fp=fp[rows])


def forest(fps):
    """Edges that connect the entries of a bucket wherever a chain of near pairs does."""
    left, near, edges = fps.view("<u8"), [], []
    while len(left):
        if near:
            at = near.pop()
        else:
            at, left = left[0], left[1:]
        close = np.bitwise_count(left ^ at) <= BITS
        near.extend(left[close])
        edges.extend((at, x) for x in left[close])
        left = left[~close]
    return edges


def links(limit):
    """Rows sorted by key -> forest edges (a, b, false); entries of larger buckets come back as (key, fp, true)."""

    def run(batches):
        key, fp, over = np.empty(0, "<i8"), np.empty(0, "<i8"), None
        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in range(2))
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if over is not None:
                same = int(np.searchsorted(key, over, "right"))
                yield _batch(a=key[:same], b=fp[:same], over=np.ones(same, bool))
                key, fp = key[same:], fp[same:]
                over = over if not len(key) else None
            if not len(key):
                continue
            open_ = int(np.searchsorted(key, key[-1], "left"))
            yield from closed(key[:open_], fp[:open_])
            key, fp = key[open_:], fp[open_:]
            if limit and len(key) > limit:
                over = int(key[0])
                yield _batch(a=key, b=fp, over=np.ones(len(key), bool))
                key, fp = key[:0], fp[:0]
        yield from closed(key, fp)

    def closed(key, fp):
        if len(key) < 2:
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a.view("<u8") ^ b.view("<u8")) <= BITS
        yield _batch(a=a[near], b=b[near], over=np.zeros(int(near.sum()), bool))
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if limit and n > limit:
                yield _batch(a=key[s : s + n], b=fp[s : s + n], over=np.ones(n, bool))
                continue
            edges = np.array(forest(np.unique(fp[s : s + n])), dtype="<u8").reshape(-1, 2).view("<i8")
            if len(edges):
                yield _batch(a=edges[:, 0].copy(), b=edges[:, 1].copy(), over=np.zeros(len(edges), bool))

    return run


def bucket_links(posted: DataFrame, limit) -> DataFrame:
    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(links(limit), "a long, b long, over boolean")


def near_pairs(fps: DataFrame, limit=LIMIT) -> DataFrame:
    """Distinct `fp` -> edges (a, b) whose components are those of all pairs that differ in at most BITS bits."""
    found = stored(bucket_links(fps.select("fp").mapInArrow(post, "key long, fp long"), limit), "simhash-links")
    large = found.filter("over").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    edges = found.filter("not over").select("a", "b")
    if not large.isEmpty():
        again = bucket_links(large.mapInArrow(post_again, "key long, fp long"), None)
        edges = edges.union(again.select("a", "b"))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge."""
    edges, hooks, turn = stored(edges, "simhash-edges"), [], 0
    while not edges.isEmpty():
        def first(c, salt=turn):
            return F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("n"))

        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(first("b")).alias("m"))
        hook = stored(nearest.select(F.col("a").alias("node"), F.least(first("a"), F.col("m"))["n"].alias("up")), "simhash-hooks")
        hooks.append(hook)
        left, right = (hook.select(F.col("node").alias(c), F.col("up").alias("u" + c)) for c in "ab")
        moved = edges.join(left, "a").join(right, "b").filter("ua != ub")
        edges = stored(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "simhash-edges")
        turn += 1
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = hooks[0].withColumnRenamed("up", "root")
    for hook in hooks[1:]:
        up = hook.withColumnRenamed("node", "root")
        roots = roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return roots


def classes(marked: DataFrame, limit=LIMIT) -> DataFrame:
    """A table with `doc_id` and `fp` -> one row per fingerprint: fp, root (of its component), component_id."""
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-fps")
    roots = components(near_pairs(fps, limit)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, limit=LIMIT) -> DataFrame:
    marked = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text").alias("fp")), "simhash")
    joined = marked.join(classes(marked, limit), "fp")
    return joined.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, limit=LIMIT) -> DataFrame:
    """The rows of `docs`, all columns, one of each component: the smallest doc_id, null ids last."""
    whole = docs.select(F.struct("*").alias("doc"))
    marked = stored(whole.select("doc", fingerprint("doc.text").alias("fp"), F.monotonically_increasing_id().alias("spot")), "simhash-docs")
    ids = marked.select(F.col("doc.doc_id").alias("doc_id"), "fp", "spot")
    member = ids.join(classes(ids, limit).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "spot")).alias("first")
    kept = member.groupBy("root").agg(first).select(F.col("first.spot").alias("spot"))
    return marked.join(kept, "spot", "left_semi").select("doc.*")
