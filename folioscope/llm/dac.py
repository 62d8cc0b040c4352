"""Token ids in directly addressable codes.

An id is split into chunks of CHUNK bits, lowest first. Level k holds the k-th chunk of every id that reaches it, and a
bitmap that says whether the id goes on; a rank directory (ones before every block of 512 bits) turns a place on one
level into the place on the next. Any token is found by one lookup per level, without decoding what stands around it.

A block is a payload: header, document starts, levels. Blocks are rows of a Parquet table in the shared folder, written
in ascending doc_id order (nulls first, equal ids by text hash). Each block holds whole documents, up to BLOCK_TOKENS
or one longer document. Null and empty texts hold the end id alone; repeated rows are written once each; an empty table
gives no blocks.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder

CHUNK = 8
RANK_BITS = 512
BLOCK_TOKENS = 1 << 20
#: With spaces kept, a word has more forms than without; this job holds nothing else.
CACHE_ENTRIES = 450_000
MAGIC = b"DAC1"
BLOCK_SCHEMA = "part int, block int, start_in_part long, n_tokens long, doc_ids array<long>, payload binary"


def encode(ids: np.ndarray, counts) -> bytes:
    """ids of all documents, one after the other, and how many each document has."""
    starts = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype="<u8"))]).astype("<u8")
    levels, rest = [], np.asarray(ids, dtype="<u4")
    while len(rest):
        higher = rest >> CHUNK
        on = higher > 0
        ones = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype="<u8")
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append((len(rest), (rest & 255).astype("u1").tobytes(), np.packbits(on, bitorder="little").tobytes(), ranks.tobytes()))
        rest = higher[on]
    out = [MAGIC, struct.pack("<IIQ", len(starts) - 1, len(levels), len(ids)), starts.tobytes()]
    for n, chunks, bits, ranks in levels:
        out += [struct.pack("<QQQ", n, len(bits), len(ranks)), chunks, bits, ranks]
    return b"".join(out)


class Reader:
    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        docs, levels, self.n_tokens = struct.unpack_from("<IIQ", payload, 4)
        self.starts = np.frombuffer(payload, "<u8", docs + 1, 20)
        at, self.levels = 20 + 8 * (docs + 1), []
        for _ in range(levels):
            n, bits, ranks = struct.unpack_from("<QQQ", payload, at)
            at += 24
            chunk = np.frombuffer(payload, "u1", n, at)
            bitmap = np.frombuffer(payload, "u1", bits, at + n)
            self.levels.append((chunk, bitmap, np.frombuffer(payload, "<u8", ranks // 8, at + n + bits)))
            at += n + bits + ranks

    def rank(self, k, i):
        """How many of the first i ids of level k go on."""
        _, bitmap, ranks = self.levels[k]
        block = i // RANK_BITS
        bits = int.from_bytes(bitmap[block * RANK_BITS // 8 : -(-i // 8)].tobytes(), "little")
        return int(ranks[block]) + (bits & ((1 << i - block * RANK_BITS) - 1)).bit_count()

    def token(self, i) -> int:
        value = 0
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            value |= int(chunk[i]) << (CHUNK * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(k, i)
        return value

    def tokens(self, start, end) -> np.ndarray:
        """ids start..end-1; on each level only the places they need are read. No id goes on from the last level."""
        value, where = np.zeros(end - start, "<u4"), None
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            if start == end:
                break
            if where is None:
                value[:] = chunk[start:end]
            else:
                value[where] |= chunk[start:end].astype("<u4") << np.uint32(CHUNK * k)
            if k + 1 == len(self.levels):
                break
            low = start & ~7
            on = np.unpackbits(bitmap[low >> 3 : -(-end // 8)], count=end - low, bitorder="little")[start - low :].nonzero()[0]
            where = on if where is None else where[on]
            start = self.rank(k, start)
            end = start + len(where)
        return value

    def document(self, k) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def write_blocks(docs: DataFrame, vocabulary: str, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode (doc_id, text) and write the blocks to the shared folder; returns the written table."""

    def blocks(batches):
        ids_of, end, part = encoder(vocabulary, CACHE_ENTRIES).ids, int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        state = {"block": 0, "start": 0, "held": 0, "ids": [], "docs": []}

        def close():
            ids = np.frombuffer(b"".join(state["ids"]), "<u4")
            payload = encode(ids, [len(x) // 4 for x in state["ids"]])
            row = (part, state["block"], state["start"], len(ids), state["docs"], payload)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            names = ["part", "block", "start_in_part", "n_tokens", "doc_ids", "payload"]
            state.update(block=state["block"] + 1, start=state["start"] + len(ids), held=0, ids=[], docs=[])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "") + end
                if state["docs"] and state["held"] + len(ids) // 4 > block_tokens:
                    yield close()
                state["ids"].append(ids)
                state["docs"].append(doc_id)
                state["held"] += len(ids) // 4
        if state["docs"]:
            yield close()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(blocks, BLOCK_SCHEMA), "dac")


def with_starts(blocks: DataFrame) -> DataFrame:
    """Add `start`: ids of all earlier blocks. One total per written partition is all that is added up in one place."""
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    joined = blocks.join(F.broadcast(offsets), "part")
    return joined.select(*blocks.columns, (F.col("part_start") + F.col("start_in_part")).alias("start"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """One row per document, each read from its block by address: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for doc_ids, payload, start in zip(*(batch.column(i) for i in range(3)), strict=True):
                reader, first = Reader(payload.as_py()), start.as_py()
                sizes = np.diff(reader.starts.astype("i8"))
                crcs = [zlib.crc32(reader.document(k).tobytes()) for k in range(len(sizes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.as_py(), pa.int64()), pa.array(reader.starts[:-1].astype("i8") + first), pa.array(sizes), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return with_starts(blocks).select("doc_ids", "payload", "start").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
