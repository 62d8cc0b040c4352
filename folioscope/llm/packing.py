"""Best-fit packing of token sequences through a configuration linear program.

The program lives on the histogram of lengths, which has at most `capacity` entries whatever the corpus: lengths are
rounded up to UNITS classes, a configuration says how many pieces of each class share a sequence, and the covering
program "use as few configurations as cover every class" is solved by multiplicative weights. Each step prices the
classes by how badly they are covered so far and finds the dearest configuration by a knapsack dynamic program. The
fractional solution is rounded down. Sequences that waste more than a threshold are opened again, the threshold being
the one that ends with the fewest sequences; open pieces, the small ones among them, go by best-fit decreasing on exact
lengths into the room that is left and into new sequences.

Only the histogram and the plan reach the driver. Pieces get their place by a rank within their length (counted per
bucket, so that a common length is split over tasks) and a join with the plan, whose size is bounded by the histogram.

Null and empty texts are one piece holding the end id alone. Repeated rows are separate pieces. Null ids stay null.
Other columns of the input are not read. An empty table gives an empty result.
"""

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder

UNITS = 256
EPSILON = 0.3
#: Pieces of at most capacity / SMALL fill the room that configurations leave; the program is for the larger ones.
SMALL = 8
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, spot long, ids binary"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece of at most `capacity` ids; `spot` numbers the rows, `ids` are little-endian 32-bit."""

    def cut(batches):
        ids_of, end = encoder(vocabulary).ids, int(end_id).to_bytes(4, "little")
        spot = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), spot, part if with_ids else None))
                    spot += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "spot", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


def dearest(prices, classes, room):
    """The configuration of at most `room` units with the highest total price: class -> how many."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fit = classes[: np.searchsorted(classes, w, "right")]
        best[w], pick[w] = best[w - 1], -1
        if len(fit):
            worth = best[w - fit] + prices[: len(fit)]
            k = int(worth.argmax())
            if worth[k] > best[w]:
                best[w], pick[w] = worth[k], fit[k]
    chosen, w = Counter(), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            chosen[int(pick[w])] += 1
            w -= int(pick[w])
    return chosen


def fractional(demand, room, epsilon=EPSILON):
    """Multiplicative weights for: least total of configurations covering `demand` (class -> count)."""
    classes = np.array(sorted(demand))
    need = np.array([demand[c] for c in classes], dtype=float)
    at = {int(c): i for i, c in enumerate(classes)}
    goal = max(np.log(len(classes) + 1) / epsilon, 1.0)
    covered, used = np.zeros(len(classes)), Counter()
    while covered.min() < goal:
        weight = np.where(covered < goal, (1 - epsilon) ** covered, 0.0)
        config = dearest(weight / need, classes, room)
        step = min(need[at[c]] / m for c, m in config.items())
        for c, m in config.items():
            covered[at[c]] += m * step / need[at[c]]
        used[tuple(sorted(config.items(), reverse=True))] += step
    return {config: amount / covered.min() for config, amount in used.items()}


def rounded(histogram, capacity):
    """Whole sequences from the fractional solution: (lengths, how many), and what is left of the histogram."""
    unit = max(1, -(-capacity // UNITS))
    room, queues, demand = capacity // unit, defaultdict(list), Counter()
    for length in sorted(histogram):
        c = -(-length // unit)
        if c <= room and length * SMALL > capacity:
            queues[c].append([length, histogram[length]])
            demand[c] += histogram[length]
    left, bins = dict(histogram), []
    if not demand:
        return bins, left
    for config, amount in sorted(fractional(demand, room).items(), key=lambda x: (-x[1], x[0])):
        times = int(amount + 1e-9)
        times = min([times, *(demand[c] // m for c, m in config)])
        for c, m in config:
            demand[c] -= m * times
        while times:
            same = min(queues[c][-1][1] // m for c, m in config)
            run, content = max(1, min(times, same)), []
            for c, m in config:
                for _ in range(1 if same else m):
                    head = queues[c][-1]
                    take = m * run if same else 1
                    content += [head[0]] * (m if same else 1)
                    head[1] -= take
                    left[head[0]] -= take
                    if not head[1]:
                        queues[c].pop()
            bins.append((content, run))
            times -= run
    return bins, {n: k for n, k in left.items() if k}


def best_fit(histogram, bins, capacity):
    """Best-fit decreasing by counts, into the room of `bins` and new sequences."""
    by_room, rooms = defaultdict(list), []

    def put(content, count):
        room = capacity - sum(content)
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append((content, count))

    for content, count in bins:
        put(content, count)
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            k = bisect_left(rooms, length)
            room = rooms[k] if k < len(rooms) else capacity
            content, count = by_room[room].pop() if k < len(rooms) else ([], -(-n // (capacity // length)))
            if k < len(rooms) and not by_room[room]:
                rooms.pop(k)
            each = min(room // length, n)
            took = min(count, n // each)
            put(content + [length] * each, took)
            if count > took and content:
                put(content, count - took)
            n -= took * each
    return [x for groups in by_room.values() for x in groups]


def plan(histogram, capacity):
    """Sequences as (lengths, how many)."""
    bins, left = rounded(histogram, capacity)
    waste = [capacity - sum(content) for content, _ in bins]
    best = None
    for most in [capacity, *(capacity >> k for k in range(5, capacity.bit_length())), 0]:
        kept, open_ = [], Counter(left)
        for (content, count), w in zip(bins, waste, strict=True):
            if w <= most:
                kept.append((content, count))
            else:
                for length in content:
                    open_[length] += count
        tried = best_fit(open_, kept, capacity)
        if best is None or sum(n for _, n in tried) < sum(n for _, n in best):
            best = tried
    return best


def places(bins):
    """Rows (length, first, last, sequence, each, offset): ranks first..last of a length fill `each` places per sequence."""
    used, sequence, rows = Counter(), 0, []
    for content, count in bins:
        offset = 0
        for length, each in sorted(Counter(content).items(), reverse=True):
            rows.append((length, used[length], used[length] + each * count - 1, sequence, each, offset))
            used[length] += each * count
            offset += each * length
        sequence += count
    return rows


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to a stored table with the columns `length` (1 to capacity) and `spot` (unique)."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(histogram.values()) // 5_000_000))
    layout = spark.createDataFrame(
        places(plan(histogram, capacity)), "l_length long, first long, last long, sequence long, each long, at long"
    )
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("spot"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("spot"))
    ranked = dealt.withColumn("within", within).join(before, ["length", "bucket"])
    rank = F.col("before") + F.col("within") - 1
    placed = ranked.withColumn("rank", rank).join(
        F.broadcast(layout), (F.col("length") == F.col("l_length")) & F.col("rank").between(F.col("first"), F.col("last"))
    )
    turn = F.col("rank") - F.col("first")
    return placed.select(
        *parts.columns,
        (F.col("sequence") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (turn % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    kept = pieces(docs, vocabulary, capacity, end_id, with_ids)
    return pack(stored(kept if with_ids else kept.drop("ids"), "pieces"), capacity)
