"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often each pair does in the corpus.

A text, one space before it, is encoded by A (byte-level BPE) and by B (pieces, which add that space themselves). Byte
offsets where tokens of both end cut the text into groups, and the two tokens that end there are linked. Both tokenizers
always cut before a lone space, around a lone line feed and between a letter and a mark after it (the pieces are checked
for it), so a text is aligned chunk by chunk, and a chunk only if a bounded cache does not hold it. Strings of special tokens are plain text.

Pair counts: documents are taken in blocks. A block holds, per id pair, a compressed bitmap of its documents with
multiplicity planes: plane k has the documents whose number of such links has bit k set. Planes are lists of 16-bit
places, or bits where a pair is in many documents. OR over a pair's planes and popcount gives documents, popcount of plane
k times 2^k gives links. Counts are added over blocks by pair; postings then return each pair's score to the block's
documents. A pair in every document is one row per block; what is held at once is a block, or the scores of one of
BUCKETS parts of all pairs, of which two vocabularies have boundedly many. Texts are read once.

Null and empty texts, and texts whose tokens do not give back their bytes (a literal U+2581), have no tokens: zeros and an
empty digest. Repeated rows count like any other. Ties for a B id's highest count are all best. A long text is a block of
its own if it fills one. Other columns are not read. An empty table gives an empty result.
"""

import hashlib
import re
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import LONE_SPACE, LONG, ODD_SPACES, Cache, byte_letters

#: Chunks of text per block, documents per block, parts of the pairs, entries of one generation of the chunk cache.
BLOCK_CHUNKS = 1 << 20
BLOCK_DOCS = 1 << 16
BUCKETS = 64
CACHE_ENTRIES = 250_000
MARK = "▁"
AFTER_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?]")
BEFORE_MARK = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?])")

DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
DOC_SQL = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("docs", pa.list_(pa.struct(DOC)))])
BLOCK_SQL = "block long, bucket int, payload binary, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,groups_sha256:string>>"
RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
RESULT_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# ---- one chunk ----------------------------------------------------------------------------------------------------

class Aligner:
    """chunk -> (A tokens, B tokens, groups, groups as text, linked pairs as 64-bit numbers a << 32 | b)."""

    def __init__(self, path_a, path_b, entries=CACHE_ENTRIES):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = byte_level(path_a), SentencePieceProcessor(model_file=path_b)
        self.a_bytes = [len(self.a.decode_single_token_bytes(i)) for i in range(self.a.n_vocab)]
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or "\n" in p or AFTER_LETTER.search(p) for _, p in pieces):
            raise ValueError("a piece crosses the places where texts are cut")
        self.b_bytes = [1 if self.b.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in pieces]
        self.lead = self.b.encode("\n")
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.cache = Cache(entries)

    def chunks(self, text):
        """Cut before every lone space, around lone line feeds, and between a letter and a mark after it."""
        text = " " + text
        odd = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\x01" in text or any(c in text for c in ODD_SPACES)
        if odd:
            return [c for c in LONE_SPACE.split(text) if c]
        return [c for c in BEFORE_MARK.sub("\x01", text).replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01") if c]

    def aligned(self, chunks):
        """One result per chunk; those not seen lately are encoded together."""
        self.cache.make_room()
        young, old, out, new = self.cache.young, self.cache.old, [], []
        for c in chunks:
            known = young.get(c) or old.get(c)
            if known is None:
                new.append(c)
            elif len(c) <= LONG:
                young[c] = known
            out.append(known)
        if new:
            pieces = iter(self.b.encode(["\n" + c for c in new], num_threads=1))
            for k, known in enumerate(out):
                if known is None:
                    c = chunks[k]
                    out[k] = self.align(c, next(pieces))
                    if len(c) <= LONG:
                        young[c] = out[k]
        return out

    def align(self, chunk, b):
        """Both vocabularies give back the bytes of a text without MARK; their sizes are compared all the same."""
        a, lead = self.a.encode_ordinary(chunk), len(self.lead)
        if b[:lead] != self.lead:
            raise ValueError("the leading line feed is not cut off")
        b = b[lead:]
        ends_a = list(accumulate(map(self.a_bytes.__getitem__, a)))
        ends_b = list(accumulate(map(self.b_bytes.__getitem__, b)))
        if not ends_a[-1] == ends_b[-1] == len(chunk.encode()):
            raise ValueError("a tokenizer loses bytes")
        names, groups, links, i, j, n = self.names, [], array("q"), 0, 0, len(a)
        while i < n:
            end_a, end_b = ends_a[i], ends_b[j]
            if end_a == end_b:
                groups.append(f"{names[a[i]]}|{names[b[j]]}")
            else:
                first_a, first_b = i, j
                while end_a != end_b:
                    if end_a < end_b:
                        i += 1
                        end_a = ends_a[i]
                    else:
                        j += 1
                        end_b = ends_b[j]
                groups.append(",".join([names[x] for x in a[first_a : i + 1]]) + "|" + ",".join([names[x] for x in b[first_b : j + 1]]))
            links.append(a[i] << 32 | b[j])
            i, j = i + 1, j + 1
        return (n, len(b), len(groups), ";".join(groups), links.tobytes())


def byte_level(path):
    """The vocabulary of a byte-level BPE file whose merges are ranked by their ids, as an encoder without special tokens."""
    import json

    from public_tokenizers import PATTERN
    from tiktoken import Encoding

    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    back = {letter: byte for byte, letter in byte_letters().items()}
    special = {t["content"] for t in kept["added_tokens"]}
    vocabulary = kept["model"]["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in kept["model"]["merges"]]
    if merged != sorted(merged) or kept["normalizer"] is not None:
        raise ValueError("merges are not ranked by id")
    return Encoding("a", pat_str=PATTERN, mergeable_ranks={bytes(back[x] for x in t): i for t, i in vocabulary.items() if t not in special}, special_tokens={})


_ALIGNERS = {}


def aligner(path_a, path_b) -> Aligner:
    """One per Python worker, reused by its later tasks."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


# ---- bitmaps of a block -------------------------------------------------------------------------------------------

def bucket_of(pairs):
    return ((pairs.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype("i8") % BUCKETS


def runs(keys):
    """Starts and lengths of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, "i8")
    return starts, np.diff(np.append(starts, len(keys)))


def pack(n_docs, pairs, at, docs, times) -> bytes:
    """Entries (pair number, document, links), sorted, as planes. A pair in more than a sixteenth of the documents has bits."""
    in_docs = np.bincount(at, minlength=len(pairs))
    dense = in_docs * 16 > n_docs
    plane_of, pair_of, size_of, places, bits = [], [], [], [], []
    for plane in range(int(times.max()).bit_length()):
        on = (times >> plane) & 1 == 1
        for kind, keep in ((0, on & ~dense[at]), (1, on & dense[at])):
            starts, sizes = runs(at[keep])
            if not len(starts):
                continue
            owners = at[keep][starts]
            plane_of.append(np.full(len(starts), plane, "u1"))
            pair_of.append(owners.astype("<u4"))
            size_of.append(np.where(kind, 0, sizes).astype("<u4"))
            if kind:
                rows = np.zeros((len(starts), n_docs), bool)
                rows[np.repeat(np.arange(len(starts)), sizes), docs[keep]] = True
                bits.append(np.packbits(rows, axis=1))
            else:
                places.append(docs[keep].astype("<u2"))
    parts = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((pair_of, "<u4"), (plane_of, "u1"), (size_of, "<u4"), (places, "<u2"))]
    head = np.array([n_docs, len(pairs), len(parts[0]), len(parts[3])], "<u4")
    return b"".join([head.tobytes(), pairs.astype("<i8").tobytes(), *(p.tobytes() for p in parts), *(x.tobytes() for x in bits)])


class Planes:
    """What `pack` has made: per container its pair number and plane, and its documents."""

    def __init__(self, payload):
        self.n_docs, m, c, s = np.frombuffer(payload, "<u4", 4).tolist()
        self.at = 16

        def take(kind, n):
            out = np.frombuffer(payload, kind, n, self.at)
            self.at += out.nbytes
            return out

        self.pairs, self.pair, self.plane = take("<i8", m), take("<u4", c).astype("i8"), take("u1", c).astype("i8")
        sizes, self.places = take("<u4", c).astype("i8"), take("<u2", s)
        self.sparse = sizes > 0
        self.sizes = sizes[self.sparse]
        self.bits = take("u1", len(payload) - self.at).reshape(c - len(self.sizes), -1) if len(self.sizes) < c else np.empty((0, 0), "u1")

    def popcounts(self):
        out = np.zeros(len(self.pair), "i8")
        out[self.sparse] = self.sizes
        if len(self.bits):
            out[~self.sparse] = np.bitwise_count(self.bits).sum(axis=1, dtype="i8")
        return out

    def links(self):
        """Links of each pair: popcounts weighted by plane."""
        out = np.zeros(len(self.pairs), "i8")
        np.add.at(out, self.pair, self.popcounts() << self.plane)
        return out

    def documents(self):
        """Documents of each pair: popcount of the OR of its planes."""
        out = np.zeros(len(self.pairs), "i8")
        listed = np.unique(np.repeat(self.pair[self.sparse], self.sizes) << 16 | self.places)
        out += np.bincount(listed >> 16, minlength=len(out))
        if len(self.bits):
            order = np.argsort(self.pair[~self.sparse], kind="stable")
            owners = self.pair[~self.sparse][order]
            starts, _ = runs(owners)
            out[owners[starts]] = np.bitwise_count(np.bitwise_or.reduceat(self.bits[order], starts, axis=0)).sum(axis=1, dtype="i8")
        return out

    def add_up(self, values):
        """Per document, the sum of its links' values (one value per pair)."""
        out, weight = np.zeros(self.n_docs, "i8"), values[self.pair] << self.plane
        np.add.at(out, self.places, np.repeat(weight[self.sparse], self.sizes))
        for bits, w in zip(self.bits, weight[~self.sparse].tolist(), strict=True):
            if w:
                out += np.unpackbits(bits, count=self.n_docs).astype("i8") * w
        return out


class BlockBuilder:
    def __init__(self, aligner_):
        self.aligner = aligner_
        self.clear()

    def clear(self):
        self.number, self.text, self.made, self.docs, self.used, self.held = {}, {}, [], [], [], 0

    def add(self, doc_id, text):
        chunks = self.aligner.chunks(text) if text and MARK not in text else []
        new = list(set(chunks).difference(self.number))
        for c, found in zip(new, self.aligner.aligned(new), strict=True):
            self.number[c], self.text[c] = len(self.made), found[3]
            self.made.append(found)
        used = np.fromiter(map(self.number.__getitem__, chunks), "i8", len(chunks))
        digest = hashlib.sha256(";".join(map(self.text.__getitem__, chunks)).encode()).hexdigest() if len(used) else ""
        self.docs.append((doc_id, digest))
        self.used.append(used)
        self.held += len(used)

    @property
    def full(self):
        return self.held >= BLOCK_CHUNKS or len(self.docs) >= BLOCK_DOCS

    def close(self, block):
        """The block's documents, then its planes by bucket."""
        n, lengths = len(self.docs), np.array([len(u) for u in self.used], "i8")
        used, owner = np.concatenate(self.used), np.repeat(np.arange(n), lengths)
        sums = []
        for k in range(3):
            total = np.zeros(n, "i8")
            np.add.at(total, owner, np.array([m[k] for m in self.made], "i8")[used] if len(used) else used)
            sums.append(total.tolist())
        rows = [dict(zip((name for name, _ in DOC), (i, a, b, g, h), strict=True)) for (i, h), a, b, g in zip(self.docs, *sums, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((block, -1, None, rows), BLOCK, strict=True)], schema=BLOCK)
        if len(used):
            yield from self.planes(block, n, used, owner)
        self.clear()

    def planes(self, block, n, used, owner):
        links = [m[4] for m in self.made]
        per_chunk = np.array([len(x) // 8 for x in links], "i8")
        flat = np.frombuffer(b"".join(links), "i8")
        first = np.cumsum(per_chunk) - per_chunk
        pairs = np.unique(flat)
        pairs = pairs[np.argsort(bucket_of(pairs), kind="stable")]
        by_value = np.argsort(pairs)
        at_flat = by_value[np.searchsorted(pairs, flat, sorter=by_value)]
        both, times = np.unique(owner * len(links) + used, return_counts=True)
        doc, chunk = both // len(links), both % len(links)
        many = per_chunk[chunk]
        spot = np.repeat(first[chunk], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        key, weight = at_flat[spot] * n + np.repeat(doc, many), np.repeat(times, many)
        order = np.argsort(key, kind="stable")
        starts, _ = runs(key[order])
        key, weight = key[order][starts], np.add.reduceat(weight[order], starts)
        at, docs = key // n, key % n
        bucket = bucket_of(pairs)
        edges = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        cuts = np.searchsorted(at, edges)
        for k in range(BUCKETS):
            if edges[k] < edges[k + 1]:
                part = slice(cuts[k], cuts[k + 1])
                payload = pack(n, pairs[edges[k] : edges[k + 1]], at[part] - edges[k], docs[part], weight[part])
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((block, k, payload, None), BLOCK, strict=True)], schema=BLOCK)


# ---- jobs ---------------------------------------------------------------------------------------------------------

def index(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Written: per block one row of its documents (bucket -1) and one row of planes per bucket of pairs."""

    def blocks(batches):
        builder, part, count = BlockBuilder(aligner(path_a, path_b)), TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                builder.add(doc_id, text.as_py())
                if builder.full:
                    yield from builder.close(part << 32 | count)
                    count += 1
        if builder.docs:
            yield from builder.close(part << 32 | count)

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(blocks, BLOCK_SQL), "align")


def pair_counts(indexed: DataFrame) -> DataFrame:
    """bucket, pair, a_id, b_id, n_docs, n_links, best: whether no pair of that B id has more links."""

    def counted(batches):
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                planes = Planes(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(planes.pairs), bucket, "i4")), pa.array(planes.pairs), pa.array(planes.documents()), pa.array(planes.links())], names=["bucket", "pair", "n_docs", "n_links"])

    rows = indexed.filter("bucket >= 0").select("bucket", "payload").mapInArrow(counted, "bucket int, pair long, n_docs long, n_links long")
    totals = rows.groupBy("bucket", "pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    ids = totals.select("bucket", "pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n_docs", "n_links")
    highest = F.max("n_links").over(Window.partitionBy("b_id"))
    return ids.withColumn("best", F.col("n_links") == highest)


def scored(indexed: DataFrame, counts: DataFrame) -> DataFrame:
    """Per block and bucket the documents' sums of scores, as arrays: block, n_best, count_sum."""

    def packed(key, rows):
        order = np.argsort(rows["pair"].to_numpy())
        parts = [rows["pair"].to_numpy()[order].astype("<i8"), rows["n_links"].to_numpy()[order].astype("<i8"), rows["best"].to_numpy()[order].astype("<i8")]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "scores": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

    def summed(batches):
        for batch in batches:
            for block, payload, scores in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                planes, table = Planes(payload.as_py()), np.frombuffer(scores.as_py(), "<i8").reshape(3, -1)
                at = np.searchsorted(table[0], planes.pairs)
                sums = [planes.add_up(table[k][at]) for k in (2, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([s.astype("<i8").tobytes()], pa.binary()) for s in sums)], names=["block", "n_best", "count_sum"])

    tables = counts.select("bucket", "pair", "n_links", "best").groupBy("bucket").applyInArrow(packed, "bucket int, scores binary")
    joined = indexed.filter("bucket >= 0").select("bucket", "block", "payload").join(tables, "bucket").select("block", "payload", "scores")
    return joined.mapInArrow(summed, "block long, n_best binary, count_sum binary")


def merge_blocks(batches):
    """Rows sorted by block: documents and partial sums -> one row per document."""
    held = {"block": None, "docs": None, "sums": None}

    def closed():
        if held["docs"]:
            docs, n = held["docs"], len(held["docs"])
            sums = held["sums"] if held["sums"] is not None else np.zeros((2, n), "i8")
            columns = {name: [d[name] for d in docs] for name, _ in DOC}
            columns |= {"n_links": columns["n_groups"], "n_best": sums[0], "count_sum": sums[1]}
            yield pa.RecordBatch.from_arrays([pa.array(columns[c], pa.string() if c == "groups_sha256" else pa.int64()) for c in RESULT], names=RESULT)

    for batch in batches:
        for block, docs, best, total in zip(*(batch.column(i) for i in range(4)), strict=True):
            if block.as_py() != held["block"]:
                yield from closed()
                held.update(block=block.as_py(), docs=None, sums=None)
            if docs.is_valid:
                held["docs"] = docs.as_py()
            else:
                part = np.stack([np.frombuffer(x.as_py(), "<i8") for x in (best, total)])
                held["sums"] = part if held["sums"] is None else held["sums"] + part
    yield from closed()


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row: tokens of both, groups, links, links whose pair is best for its B id, the sum of the links' counts, digest of the groups."""
    indexed = index(docs, path_a, path_b)
    sums = scored(indexed, stored(pair_counts(indexed), "align-pairs"))
    whole = indexed.filter("bucket < 0").select("block", "docs", F.lit(None).cast("binary").alias("n_best"), F.lit(None).cast("binary").alias("count_sum"))
    parts = sums.select("block", F.lit(None).cast(whole.schema["docs"].dataType).alias("docs"), "n_best", "count_sum")
    return whole.union(parts).repartition("block").sortWithinPartitions("block").mapInArrow(merge_blocks, RESULT_SQL)
