"""Approximate cosine search: random-projection signatures, then exact scores of the candidates.

A vector's signature has a bit per random direction, the sign of its product with it; two vectors differ in a share of the
bits that follows their angle. The index is a written table of signatures, an eighth to a sixteenth of the vectors. A
request keeps, per part of the index, the vectors whose signatures differ least, then the best `candidates` of all; only
those meet their vectors. Directions follow from the width and the number of bits, so an index needs nothing but its rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import REQUEST_BLOCK
from ..session import written
from .bounded import dealt
from .vectors import PART_VECTORS, cosine, facing, knn_topn

BITS = 256
CANDIDATES = 200
SEED = 17
_FOUND = "query_id long, chunk_id long, apart int"


def sign(vectors: DataFrame, key="chunk_id", bits=BITS) -> DataFrame:
    """(key, signature). Null and zero vectors have none."""

    def run(batches):
        planes = {}
        for b in batches:
            column = b.column(1)
            m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
            if m.shape[1] not in planes:
                planes[m.shape[1]] = np.random.default_rng(SEED).standard_normal((m.shape[1], bits))
            packed = np.packbits(m @ planes[m.shape[1]] > 0, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], names=[key, "signature"])

    some = vectors.filter(F.exists("embedding", lambda x: x != 0)).select(F.col(key).cast("long").alias(key), "embedding")
    return some.mapInArrow(run, f"{key} long, signature binary")


def write_signatures(vectors: DataFrame, bits=BITS) -> DataFrame:
    return written(sign(vectors, bits=bits), "signatures")


def _matrix(column):
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(len(column), -1).view("<u8")


def _least_apart(keep):
    def run(asked, held):
        out, chunk_ids = [], held["chunk_id"].to_numpy()
        if len(asked) and len(held):
            c = _matrix(held["signature"])
            for query, row in zip(asked["query_id"].to_numpy(), _matrix(asked["signature"])):
                apart = np.bitwise_count(c ^ row).sum(axis=1, dtype="i4")
                near = np.flatnonzero(apart <= np.partition(apart, keep - 1)[keep - 1]) if len(apart) > keep else np.arange(len(apart))
                near = near[np.lexsort((chunk_ids[near], apart[near]))[:keep]]
                out.append((np.full(len(near), query), chunk_ids[near], apart[near]))
        q, c, d = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(q, pa.int64()), "chunk_id": pa.array(c, pa.int64()), "apart": pa.array(d, pa.int32())})

    return run


def approximate_topn(queries: DataFrame, vectors: DataFrame, depth: int, signatures: DataFrame = None, candidates=CANDIDATES, block=REQUEST_BLOCK, part=PART_VECTORS) -> DataFrame:
    """(query_id, chunk_id, dist, vec_rank) like the exact search, over the `candidates` of least differing signatures."""
    index = signatures if signatures is not None else write_signatures(vectors)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter(F.col("embedding").isNotNull())
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((asked, block), (index, part)))
    q = facing(sign(asked, "query_id"), "query_id", "block", blocks, "part", parts)
    v = facing(index, "chunk_id", "part", parts, "block", blocks)
    met = dealt(q, "part", "block").groupBy("part", "block").cogroup(dealt(v, "part", "block").groupBy("part", "block"))
    nearest = Window.partitionBy("query_id").orderBy("apart", "chunk_id")
    found = met.applyInArrow(_least_apart(candidates), _FOUND).withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= candidates)
    pairs = found.select("query_id", "chunk_id").join(asked.withColumnRenamed("embedding", "asked"), "query_id")
    scored = pairs.join(vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding"), "chunk_id")
    scored = scored.select("query_id", "chunk_id", F.round(F.lit(1.0) - cosine("asked", "embedding"), 9).alias("dist"))
    best = Window.partitionBy("query_id").orderBy("dist", "chunk_id")
    return scored.withColumn("vec_rank", F.row_number().over(best)).filter(F.col("vec_rank") <= depth)


def recall(queries: DataFrame, vectors: DataFrame, depth: int, **options) -> DataFrame:
    """One row: requests' true nearest, how many of them were found, and their share."""
    exact = knn_topn(queries, vectors, depth).select("query_id", "chunk_id")
    near = approximate_topn(queries, vectors, depth, **options).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "chunk_id"], "left").agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
