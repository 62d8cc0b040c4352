"""Sliding-window request limiter: a request passes while fewer than `limit` passed in the last `seconds`."""

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS
from ..session import cut

BUCKETS_PER_WINDOW = 64
_OUT = "event_id long, accepted boolean"


def request_window(events: DataFrame, seconds=DEFAULTS.limit_seconds) -> DataFrame:
    """Upper bound of the load: requests of the same key in the window that ends at each request.

    Requests are counted inside (key, time bucket) pieces; those of the last window of a bucket are copied to the next
    one, so a key that holds a large share of all rows is spread over its buckets."""
    us = seconds * 1000000
    size = us * BUCKETS_PER_WINDOW
    at = F.col("at")
    bucket = F.floor(at / size)
    late = (bucket + 1) * size - at <= us
    d = events.withColumn("_b", F.explode(F.when(late, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))))
    w = Window.partitionBy("key", "_b").orderBy("at").rangeBetween(-us, 0)
    return d.withColumn("recent", F.count(F.lit(1)).over(w)).filter(F.col("_b") == bucket).drop("_b")


def quiet_runs(events: DataFrame, seconds) -> DataFrame:
    """Adds `run`: a key's requests up to the next pause longer than the window. Runs are independent of each other.

    Pauses are found inside (key, time bucket) pieces and between the pieces' ends, so a key that holds a large share
    of all rows is never sorted as one group."""
    us = seconds * 1000000
    d = events.withColumn("bucket", F.floor(F.col("at") / (us * BUCKETS_PER_WINDOW)))
    ends = d.groupBy("key", "bucket").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("key").orderBy("bucket")
    ends = ends.withColumn("fresh", F.coalesce(F.col("first") - F.lag("last").over(order) > us, F.lit(True)).cast("int"))
    inside = Window.partitionBy("key", "bucket").orderBy("at", "event_id")
    gap = F.col("at") - F.lag("at").over(inside) > us
    d = d.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int"))
    starts = d.groupBy("key", "bucket").agg(F.sum("gap").alias("gaps")).join(ends, ["key", "bucket"])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("base", F.coalesce(F.sum(F.col("gaps") + F.col("fresh")).over(before), F.lit(0)) + F.col("fresh"))
    d = d.join(starts.select("key", "bucket", "base"), ["key", "bucket"])
    return d.withColumn("run", F.col("base") + F.sum("gap").over(inside)).drop("bucket", "gap", "base")


def overloaded_stretches(events: DataFrame, limit, seconds) -> DataFrame:
    """Adds `run`: the overloaded stretch a request belongs to, null if its verdict needs none.

    A request whose window holds at most `limit` requests, itself included, passes whatever came before. So only
    requests over that bound are undecided; those less than a window apart form a stretch, and what the limiter
    remembers at its start are the requests of the window before, all of them passed and at most `limit`. A stretch
    therefore begins a window early and depends on nothing older. Stretches of a key do not overlap: a request of the
    window before one lies after the last undecided request of the stretch before."""
    us = seconds * 1000000
    size = us * BUCKETS_PER_WINDOW
    d = cut(request_window(events, seconds))
    undecided = quiet_runs(d.filter(F.col("recent") > limit), seconds)
    ends = undecided.groupBy("key", "run").agg((F.min("at") - us).alias("first"), F.max("at").alias("last"))
    bucket = [F.floor(F.col(c) / size) for c in ("first", "last")]
    ends = ends.withColumn("_b", F.explode(F.sequence(*bucket))).withColumnRenamed("key", "_key")
    d = d.withColumn("_b0", F.floor(F.col("at") / size))
    met = (F.col("key") == F.col("_key")) & (F.col("_b0") == F.col("_b")) & F.col("at").between(F.col("first"), F.col("last"))
    return d.join(ends, met, "left").select("event_id", "key", "at", "run")


def limit_requests(events: DataFrame, limit=DEFAULTS.limit_requests, seconds=DEFAULTS.limit_seconds) -> DataFrame:
    """(event_id, accepted) for events (event_id, key, at in microseconds; none of them null).

    Requests outside overloaded stretches pass without being looked at one by one. A task streams its sorted stretches
    and keeps only the accepted times of the current window, at most `limit`. Equal times go by event_id; a limit of
    zero or less passes nothing."""
    us = seconds * 1000000
    if limit <= 0:
        return events.select("event_id", F.lit(False).alias("accepted"))

    def run(batches):
        current, passed = None, deque()
        for pdf in batches:
            out = []
            for key, part, at in zip(pdf["key"], pdf["run"], pdf["at"]):
                if (key, part) != current:
                    current, passed = (key, part), deque()
                while passed and at - passed[0] > us:
                    passed.popleft()
                ok = len(passed) < limit
                if ok:
                    passed.append(at)
                out.append(ok)
            yield pd.DataFrame({"event_id": pdf["event_id"], "accepted": out})

    d = cut(overloaded_stretches(events.select("event_id", "key", "at"), limit, seconds))
    judged = d.filter("run is not null").repartition("key", "run").sortWithinPartitions("key", "run", "at", "event_id").mapInPandas(run, _OUT)
    return judged.unionByName(d.filter("run is null").select("event_id", F.lit(True).alias("accepted")))
