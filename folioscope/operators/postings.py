"""A positional inverted index as a table, and BM25 over it for a table of requests.

Chunks are made into parts of at most PART_CHUNKS where their rows are; no text is shuffled for it. The index has one row
per (term, part) with the places of the term, a place being the chunk's number in its part and the position in the chunk,
and one row per part with its chunk ids and lengths. It is written in folders by a hash of the term and sorted by term, so
a search reads the folders of the asked terms and joins their rows by term. Lists of numbers travel and are kept as bytes
(`_packed`).

A search is one plan whatever the number of requests: asked terms meet their postings; those of a single word are its hits,
those of a phrase in a part are intersected to hits; hits are summed to document frequencies; and hits and requests meet by
(group of parts, lane of requests), where each request keeps its best `depth` chunks of those parts before anything is
shuffled again. A request travels as one row of phrase numbers.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder, written
from .bounded import dealt

# Fixed values of the ranking function.
K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6

PART_CHUNKS = 4096
PART_TOKENS = 1 << 22  # a part of longer chunks has fewer of them
# A task of a search holds at most this many blocks of requests and about this many hits, or one part's. Requests are not
# dealt finer than LANE_REQUESTS for the sake of more tasks.
TASK_BLOCKS = 32
TASK_ENTRIES = 1 << 22
LANE_REQUESTS = 2048
BUCKETS = 32
_POSTINGS = "term string, part long, shift int, places binary, chunk_ids array<long>, lengths array<int>"
INDEX = f"bucket int, {_POSTINGS}"
_HITS = "name string, part long, n long, chunks binary, times binary"
_SCORED = "query_id long, chunk_id long, kw_score double"


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _lists(values, offsets, kind):
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _packed(values, offsets, ascending=True):
    """Lists of numbers, none negative, as a column of bytes: seven bits a byte, the low ones first, the last byte below
    128. An ascending list is kept by its steps."""
    steps, offsets = np.asarray(values, "i8"), np.asarray(offsets)
    if ascending and len(steps):
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first, steps = steps[begins], np.diff(steps, prepend=0)
        steps[begins] = first
    sizes = np.ones(len(steps), "i8")
    for k in range(1, 9):
        sizes += steps >> 7 * k > 0
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(ends[-1], "u1")
    for k in range(sizes.max(initial=0)):
        more = np.flatnonzero(sizes > k)
        out[ends[more] + k] = (steps[more] >> 7 * k) & 127 | (sizes[more] > k + 1) << 7
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].astype("i4")), pa.py_buffer(out)])


def _unpacked(column, ascending=True):
    """(values, offsets) of a column made by _packed; null is an empty list."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.binary())
    if not len(column):
        return np.zeros(0, "i8"), np.zeros(1, "i8")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "i4")[column.offset:column.offset + len(column) + 1].astype("i8")
    data = np.frombuffer(data, "u1")[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, "u1")
    closing = np.flatnonzero(data < 128)
    offsets = np.searchsorted(closing, ends - ends[0])
    if not len(closing):
        return np.zeros(0, "i8"), offsets
    begins = np.concatenate([[0], closing[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begins, closing - begins + 1)
    values = np.add.reduceat((data & 127).astype("i8") << 7 * place, begins)
    if ascending:
        values = np.cumsum(values)
        before = np.concatenate([[0], values])[offsets[:-1]]
        values -= np.repeat(before, np.diff(offsets))
    return values, offsets


def _part_rows(part, table):
    """Postings of one part, and its own row."""
    table = table.sort_by("chunk_id")
    lists = table["tokens"].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("i8")
    coded = pc.list_flatten(lists).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    begins, shift = np.cumsum(lengths) - lengths, int(lengths.max()).bit_length()
    places = np.repeat(np.arange(len(lengths)) << shift, lengths) + np.arange(len(codes)) - np.repeat(begins, lengths)
    order = np.argsort(codes, kind="stable")
    n = len(coded.dictionary)
    offsets = np.searchsorted(codes[order], np.arange(n + 1))
    empty = np.zeros(n + 1, "i8")
    rows = pa.table({"term": coded.dictionary.cast(pa.string()), "part": pa.array(np.full(n, part, "i8")), "shift": pa.array(np.full(n, shift, "i4")), "places": _packed(places[order], offsets), "chunk_ids": _lists([], empty, pa.int64()), "lengths": _lists([], empty, pa.int32())})
    own = pa.table({"term": pa.array([None], pa.string()), "part": pa.array([part], pa.int64()), "shift": pa.array([shift], pa.int32()), "places": pa.array([b""], pa.binary()), "chunk_ids": pa.array([table["chunk_id"].to_pylist()], pa.list_(pa.int64())), "lengths": pa.array([lengths.tolist()], pa.list_(pa.int32()))})
    return pa.concat_tables([rows, own])


def _parts(part_chunks):
    """Rows (chunk_id, tokens) of a task -> the postings of its parts."""

    def run(batches):
        part, held, rows, words = TaskContext.get().partitionId(), [], 0, 0

        def closed():
            nonlocal part, rows, words
            made = _part_rows(part, pa.Table.from_batches(held)).combine_chunks().to_batches()
            held.clear()
            part, rows, words = part + (1 << 32), 0, 0
            return made

        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            ends, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
            while lo < len(batch):
                fitting = np.searchsorted(ends, ends[lo] + PART_TOKENS - words, "right") - 1
                hi = min(len(batch), lo + part_chunks - rows, fitting)
                if hi <= lo and held:
                    yield from closed()
                    continue
                hi = max(hi, lo + 1)
                held.append(batch.slice(lo, hi - lo))
                rows, words, lo = rows + hi - lo, words + int(ends[hi] - ends[lo]), hi
        if held:
            yield from closed()

    return run


def write_postings(tokens: DataFrame, part_chunks=PART_CHUNKS) -> DataFrame:
    """(chunk_id, tokens) -> the written index. The order in a task fixes its parts, also when it runs again."""
    placed = tokens.select(F.col("chunk_id").cast("long").alias("chunk_id"), "tokens").sortWithinPartitions("chunk_id")
    rows = placed.mapInArrow(_parts(part_chunks), _POSTINGS)
    folder = new_folder(tokens.sparkSession, "postings")
    keyed = rows.withColumn("bucket", F.when(F.col("term").isNull(), F.lit(-1)).otherwise(bucket_of("term")))
    keyed.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(folder)
    return tokens.sparkSession.read.schema(INDEX).parquet(folder)


def _hit_rows(names, parts, chunks, times, offsets):
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(parts, pa.int64()), pa.array(np.diff(offsets), pa.int64()), _packed(chunks, offsets), _packed(times, offsets, False)],
        names=["name", "part", "n", "chunks", "times"])


def _counted(batches):
    """Rows (part, name, shift, places) of single words -> their hits."""
    for batch in batches:
        places, offsets = _unpacked(batch.column(3))
        row = np.repeat(np.arange(len(batch)), np.diff(offsets))
        chunks = places >> batch.column(2).to_numpy()[row]
        other = np.ones(len(places), bool)
        other[1:] = (np.diff(chunks) != 0) | (np.diff(row) != 0)
        first = np.flatnonzero(other)
        times = np.diff(first, append=len(places))
        yield _hit_rows(batch.column(1), batch.column(0), chunks[first], times, np.searchsorted(first, offsets))


def _intersect(batches):
    """Rows (part, name, j, size, shift, places) sorted by phrase -> the phrase's hits in the part. A phrase occurs where
    every word stands j places after the start; one chunk's places never reach into the next."""
    state = {"key": None, "seen": 0, "at": None, "size": 0, "shift": 0}
    out = []

    def closed():
        if state["key"] is not None and state["seen"] == state["size"] and len(state["at"]):
            chunks, times = np.unique(state["at"] >> state["shift"], return_counts=True)
            out.append((state["key"][1], state["key"][0], len(chunks), chunks, times))

    def batch_of():
        names, parts, n, chunks, times = zip(*out)
        out.clear()
        return _hit_rows(names, parts, np.concatenate(chunks), np.concatenate(times), np.concatenate([[0], np.cumsum(n)]))

    for batch in batches:
        values, offsets = _unpacked(batch.column(5))
        for r, (part, name, j, size, shift) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)))):
            starts = values[offsets[r]:offsets[r + 1]]
            starts = starts[(starts & ((1 << shift) - 1)) >= j] - j
            if (part, name) == state["key"]:
                state.update(seen=state["seen"] + 1, at=np.intersect1d(state["at"], starts, assume_unique=True))
            else:
                closed()
                state.update(key=(part, name), seen=1, at=starts, size=size, shift=shift)
        if len(out) >= 512:
            yield batch_of()
    closed()
    if out:
        yield batch_of()


def phrase_hits(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """Per phrase `name` (its words, joined by spaces) and part: in how many chunks, which, how often."""
    terms = phrases.select("name", "phrase").distinct().select("name", F.size("phrase").alias("size"), F.posexplode("phrase").alias("j", "term"))
    terms = written(terms.withColumn("bucket", bucket_of("term")), "terms")

    def found(some):
        used = [r.bucket for r in some.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        return index.filter(F.col("bucket").isin(used)).select("bucket", "term", "part", "shift", "places").join(some, ["bucket", "term"])

    words = found(terms.filter("size = 1")).select("part", "name", "shift", "places").mapInArrow(_counted, _HITS)
    longer = found(terms.filter("size > 1")).select("part", "name", "j", "size", "shift", "places")
    return words.unionByName(dealt(longer, "part", "name").sortWithinPartitions("part", "name", "j").mapInArrow(_intersect, _HITS))


def _best(ids, scores, depth):
    """Places of the `depth` highest positive scores, ties to the lower id."""
    at = np.flatnonzero(scores > 0)
    if len(at) > depth:
        cut = np.partition(scores[at], len(at) - depth)[len(at) - depth]
        at = at[scores[at] >= cut]
    return at[np.lexsort((ids[at], -scores[at]))[:depth]]


def _score(depth):
    """Hits of some parts, and requests with the numbers and weights of their phrases -> each request's best chunks."""

    def run(hits, asks):
        nothing = pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "kw_score": pa.array([], pa.float64())})
        names, parts = hits["name_id"].to_pylist(), hits["part"].to_pylist()
        own = [k for k, name in enumerate(names) if name is None]
        if not own or not len(asks):
            return nothing
        ids = np.concatenate([hits["ids"][k].values.to_numpy() for k in own])
        lengths = np.concatenate([hits["lengths"][k].values.to_numpy() for k in own]).astype("i8")
        sizes = [len(hits["ids"][k]) for k in own]
        begin = dict(zip((parts[k] for k in own), np.cumsum([0, *sizes])))
        stretch = K1 * (1 - B + B * lengths / max(hits["avg_len"][0].as_py(), 1e-9))
        at, offsets = _unpacked(hits["chunks"])
        tf, n = _unpacked(hits["times"], False)[0], np.diff(offsets)
        at += np.repeat(np.array([begin[part] for part in parts]), n)
        saturated = np.repeat(pc.fill_null(hits["idf"], 0.0).to_numpy(), n) * tf * (K1 + 1) / (tf + stretch[at])
        pieces = {}
        for k, name in enumerate(names):
            if name is not None:
                pieces.setdefault(name, []).append(slice(offsets[k], offsets[k + 1]))
        found = {name: tuple(np.concatenate([x[s] for s in own_pieces]) for x in (at, saturated)) for name, own_pieces in pieces.items()}
        del at, tf, saturated
        asked, offsets = _unpacked(asks["name_ids"])
        out = []
        for k, (query, weights) in enumerate(zip(asks["query_id"].to_pylist(), asks["weights"].to_pylist())):
            held = [(*found[n], w) for n, w in zip(asked[offsets[k]:offsets[k + 1]].tolist(), weights) if n in found]
            if held:
                at = np.concatenate([h[0] for h in held])
                saturated = np.concatenate([h[1] * h[2] for h in held])
                if 4 * len(at) < len(ids):
                    touched, back = np.unique(at, return_inverse=True)
                    total = np.round(np.bincount(back, saturated), 9)
                else:
                    touched, total = slice(None), np.round(np.bincount(at, saturated, len(ids)), 9)
                best = _best(ids[touched], total, depth)
                out.append((np.full(len(best), query), ids[touched][best], total[best]))
        if not out:
            return nothing
        q, c, s = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": pa.array(q, pa.int64()), "chunk_id": pa.array(c, pa.int64()), "kw_score": pa.array(s, pa.float64())})

    return run


def _numbered(batches):
    """Requests with the lists of their phrases' ascending numbers as bytes."""
    for batch in batches:
        lists = batch.column(1)
        ids = _packed(pc.list_flatten(lists).to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, batch.column(2), batch.column(3)], names=["query_id", "name_ids", "weights", "in_lane"])


def layout(parts, entries, requests, asks, tasks, block):
    """(groups of parts, lanes of requests). Every hit is sent to all lanes and every request to all groups; of the numbers
    that make one meeting a task, those are taken that send least, within what a task may hold."""
    balance = round((tasks * asks / max(entries, 1)) ** 0.5)
    lanes = max(1, -(-requests // (block * TASK_BLOCKS)), min(balance, -(-requests // LANE_REQUESTS)))
    return min(max(parts, 1), max(-(-tasks // lanes), -(-entries // TASK_ENTRIES))), lanes


def search(phrases: DataFrame, index: DataFrame, depth: int, block: int) -> DataFrame:
    """(query_id, chunk_id, kw_score): the best `depth` chunks of every request in each group of parts. Phrases: query_id,
    phrase, weight. A task meets groups of parts with lanes of requests (`layout`); phrases travel as numbers."""
    spark = index.sparkSession
    asked = written(phrases.withColumn("name", F.array_join("phrase", " ")), "asked")
    asks, requests = asked.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    hits = written(phrase_hits(asked, index), "hits")
    own = index.filter("bucket = -1").select("part", "chunk_ids", "lengths")
    lengths = own.select(F.size("chunk_ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("t"))
    n_docs, avg_len = lengths.agg(F.sum("n")).scalar(), lengths.agg(F.sum("t") / F.sum("n")).scalar()
    raw = F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rare = hits.groupBy("name").agg(F.sum("n").alias("df")).withColumn("idf", F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR)))
    # numbers ascend with the names, so a request's phrases are added in the order of their names
    names = written(rare.orderBy("name").select("name", "idf", F.monotonically_increasing_id().alias("name_id")), "names")
    entries = hits.agg(F.sum("n")).first()[0] or 0
    groups, lanes = layout(own.count(), entries, requests, asks, int(spark.conf.get("spark.sql.shuffle.partitions")), block)
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    left = hits.join(names, "name").select("part", "name_id", "idf", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("lengths"), "chunks", "times")
    nothing = F.lit(None).cast("binary")
    left = left.unionByName(own.select("part", F.lit(None).cast("long").alias("name_id"), F.lit(None).cast("double").alias("idf"), F.col("chunk_ids").alias("ids"), "lengths", nothing.alias("chunks"), nothing.alias("times")))
    # parts are few: they are numbered in one small window, and dealt to the groups in turn
    turn = own.select("part", F.pmod(F.row_number().over(Window.orderBy("part")), F.lit(groups)).cast("int").alias("group"))
    left = left.join(turn, "part").select("*", lane).withColumn("avg_len", avg_len)
    ordered = F.array_sort(F.collect_list(F.struct("name_id", F.col("weight").cast("double").alias("weight"))))
    known = asked.join(names, "name").groupBy("query_id").agg(ordered.alias("p")).select(
        F.col("query_id").cast("long").alias("query_id"), F.col("p.name_id").alias("name_ids"), F.col("p.weight").alias("weights"), F.pmod(F.xxhash64("query_id"), F.lit(lanes)).cast("int").alias("in_lane"))
    known = known.mapInArrow(_numbered, "query_id long, name_ids binary, weights array<double>, in_lane int")
    right = known.withColumn("in_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    left, right = dealt(left, "group", "lane"), dealt(right, "in_group", "in_lane")
    return left.groupBy("group", "lane").cogroup(right.groupBy("in_group", "in_lane")).applyInArrow(_score(depth), _SCORED)


def top(scored: DataFrame, depth: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("kw_score"), "chunk_id")
    return scored.withColumn("kw_rank", F.row_number().over(best)).filter(F.col("kw_rank") <= depth)
