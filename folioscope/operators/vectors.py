"""Exact cosine search, embedding jobs and vector hygiene."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from ..params import REQUEST_BLOCK
from .bounded import dealt

PART_VECTORS = 8192
QUERY_ROWS = 256  # requests compared at once inside one group
_SCHEMA = "query_id long, chunk_id long, dist double"


def norm(v):
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v):
    n = norm(v)
    return F.when(n > 0, F.transform(col(v), lambda x: x.cast("double") / n))


def cosine(a, b):
    dot = F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return dot / (norm(a) * norm(b))


def _matrix(column):
    """Rows of unit length; a zero vector stays zero."""
    column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _nearest(depth):
    """Requests and vectors of one (part, block) -> the part's `depth` nearest of every request."""

    def run(asked, held):
        ids, chunk_ids, out = asked["query_id"].to_numpy(), held["chunk_id"].to_numpy(), []
        if len(ids) and len(chunk_ids):
            q, c = _matrix(asked["embedding"]), _matrix(held["embedding"])
            for lo in range(0, len(ids), QUERY_ROWS):
                dist = np.round(1.0 - q[lo : lo + QUERY_ROWS] @ c.T, 9)
                for query, row in zip(ids[lo : lo + QUERY_ROWS], dist):
                    near = np.flatnonzero(row <= np.partition(row, depth - 1)[depth - 1]) if len(row) > depth else np.arange(len(row))
                    near = near[np.lexsort((chunk_ids[near], row[near]))[:depth]]
                    out.append((np.full(len(near), query), chunk_ids[near], row[near]))
        q, c, d = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(q, pa.int64()), "chunk_id": pa.array(c, pa.int64()), "dist": pa.array(d, pa.float64())})

    return run


def facing(rows: DataFrame, key, group, groups, met, others):
    """Rows under their own group number and under every number of the side they meet."""
    own = F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")
    return rows.withColumn(group, own).withColumn(met, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def knn_topn(queries: DataFrame, vectors: DataFrame, depth: int, block: int = REQUEST_BLOCK, part: int = PART_VECTORS) -> DataFrame:
    """(query_id, chunk_id, dist, vec_rank), the `depth` nearest vectors per query, exact. Requests in blocks and vectors
    in parts are both tables; every block meets every part once, in one plan whatever their number."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter(F.col("embedding").isNotNull())
    v = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding").filter(F.col("embedding").isNotNull())
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((q, block), (v, part)))
    q, v = facing(q, "query_id", "block", blocks, "part", parts), facing(v, "chunk_id", "part", parts, "block", blocks)
    q, v = dealt(q, "part", "block"), dealt(v, "part", "block")
    near = q.groupBy("part", "block").cogroup(v.groupBy("part", "block")).applyInArrow(_nearest(depth), _SCHEMA)
    best = Window.partitionBy("query_id").orderBy("dist", "chunk_id")
    return near.withColumn("vec_rank", F.row_number().over(best)).filter(F.col("vec_rank") <= depth)


# ---- embedding jobs --------------------------------------------------------

def hash_encoder(dim):
    """Deterministic feature-hash encoder: one signed bucket per token by the first 32 bits of its MD5, unit length."""
    from hashlib import md5

    def encode(texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.zeros(dim)
            for w in t.lower().split():
                h = int.from_bytes(md5(w.encode(), usedforsecurity=False).digest()[:4])
                v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return texts.map(one)

    return encode


ENCODERS = {"hash": hash_encoder}


def encoder(name, dim):
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name!r}; known: {sorted(ENCODERS)}")
    return ENCODERS[name](dim)


def stale_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def refuse_mixed(wanted: dict, held: dict):
    """Vectors of one space only: a table written with another width, model or provider has to be reset first."""
    changed = {name: (held[name], value) for name, value in wanted.items() if held.get(name) is not None and held[name] != value}
    if changed:
        raise ValueError("the vector table was written with another " + ", ".join(f"{n} ({a!r}, now {b!r})" for n, (a, b) in changed.items()))


def embed(chunks: DataFrame, encode, dim: int, manifest: dict = None, held: dict = None) -> DataFrame:
    """(chunk_id, embedding) for (chunk_id, text). A wrong count or width fails the job; so does, before it starts, a
    vector table whose manifest `held` names another dim, model or provider than `manifest`."""
    refuse_mixed({"dim": dim, **(manifest or {})}, held or {})

    def run(batches):
        for pdf in batches:
            out = encode(pdf["text"])
            if len(out) != len(pdf):
                raise ValueError(f"embedding count mismatch: {len(pdf)} chunks vs {len(out)} vectors")
            wrong = out.map(len) != dim
            if wrong.any():
                raise ValueError(f"embedding for chunk {pdf['chunk_id'][wrong].iloc[0]} is not {dim} wide")
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "embedding": out})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id long, embedding array<float>")


def write_embeddings(stored: DataFrame, fresh: DataFrame, dim: int) -> DataFrame:
    """The vector table after replacing the fresh keys. A vector of another width fails the job."""
    width = F.size("embedding")
    checked = fresh.withColumn(
        "embedding",
        F.when(width == dim, F.col("embedding")).otherwise(
            F.raise_error(F.format_string("embedding for chunk %d is %d wide, expected %d", "chunk_id", width, F.lit(dim)))
        ),
    )
    return stored.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(checked)


def reset_vectors(chunks: DataFrame, vectors: DataFrame):
    """After a width change: no vectors, and every chunk marked as not embedded."""
    return chunks.withColumn("embedded", F.lit(False)), vectors.filter(F.lit(False))


def embedding_status(dim, model, provider, stored_dim, stored_model, stored_provider):
    """unset / dim_changed / model_changed / match, from two manifests."""
    return (
        F.when(stored_dim.isNull(), F.lit("unset"))
        .when(stored_dim != dim, F.lit("dim_changed"))
        .when(stored_model.eqNullSafe(model) & stored_provider.eqNullSafe(provider), F.lit("match"))
        .otherwise(F.lit("model_changed"))
    )
