"""Structured Streaming twins of the batch jobs; each ends in the same table."""

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..functions import dating, records
from ..operators import chunking
from ..operators import incremental as inc
from ..params import DEFAULTS
from ..sources import notes
from .deltas import DeltaTable


def read_folder(spark: SparkSession, path: str, schema, files_per_batch=None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def drain(writer, checkpoint: str):
    """Process what is there now and stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


class CorpusTables:
    """The tables an import keeps in step, each keyed by the document that owns its rows."""

    BELIEF = "belief_id string, persona string, state string, subject string, claim string"

    def __init__(self, spark, folder, doc_schema):
        docs = [f for f in doc_schema.fields if f.name not in ("belief", "removed")]
        self.docs = DeltaTable(spark, f"{folder}/docs", StructType(docs), "rel_path")
        self.links = DeltaTable(spark, f"{folder}/links", "src_path string, tgt_raw string, tgt_slug string", "src_path")
        self.supersessions = DeltaTable(spark, f"{folder}/supersessions", "src_path string, tgt_raw string, tgt_slug string", "src_path")
        self.beliefs = DeltaTable(spark, f"{folder}/beliefs", f"rel_path string, {self.BELIEF}", "rel_path")
        self.chunks = DeltaTable(spark, f"{folder}/chunks", "rel_path string, chunk_idx int, text string, token_count int, heading_path string, chunk_hash string", "rel_path")

    def all(self):
        return self.docs, self.links, self.supersessions, self.beliefs, self.chunks


def import_batch(tables: CorpusTables, batch: DataFrame, batch_id: int):
    """One batch of parsed files (and of removals): documents upserted by path, links and chunks rebuilt where the body
    changed, supersessions always, beliefs projected from every file whose metadata can be read. Of several versions of
    a path in one batch the newest counts. Replaying a batch rewrites its own folders with the same rows."""
    latest = Window.partitionBy("rel_path").orderBy(F.desc("mtime"), F.desc("doc_hash"))
    batch = batch.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n").persist()
    try:
        removed, here = batch.filter("removed"), batch.filter("not removed")
        stored = tables.docs.current(batch_id, batch)
        changes = inc.classify_changes(stored, here).persist()
        kept, recut = changes.filter("change <> 'unchanged'"), changes.filter("change in ('new', 'updated')")
        gone, touched = removed.select("rel_path"), recut.select("rel_path")
        owners = touched.union(gone).withColumnRenamed("rel_path", "src_path")
        everyone = batch.select(F.col("rel_path").alias("src_path"))
        readable = here.filter("metadata_ok")
        fresh = readable.filter("belief is not null").select("rel_path", "belief.*").withColumn("_n", F.row_number().over(Window.partitionBy("belief_id").orderBy(F.desc("rel_path"))))
        fresh = fresh.filter("_n = 1").drop("_n")
        elsewhere = tables.beliefs.current(batch_id).join(fresh.select("belief_id"), "belief_id", "left_semi").select("rel_path")
        kept.count()  # fills the cache once for all that follows
        writes = (
            (tables.docs, kept, kept.select("rel_path").union(gone)),
            (tables.links, notes.links(recut), owners),  # one row a path, whose links are distinct
            (tables.supersessions, notes.supersessions(here).dropDuplicates(["src_path", "tgt_raw"]), everyone),
            (tables.beliefs, fresh, readable.select("rel_path").union(gone).union(elsewhere)),
            (tables.chunks, chunking.chunk_documents(recut), touched.union(gone)),
        )
        with ThreadPoolExecutor(len(writes)) as pool:  # five jobs that do not wait for each other
            list(pool.map(lambda w: w[0].write(batch_id, *w[1:]), writes))
        changes.unpersist()
    finally:
        batch.unpersist()


def maintain_corpus(stream: DataFrame, tables: CorpusTables, checkpoint: str):
    drain(stream.writeStream.foreachBatch(lambda batch, n: import_batch(tables, batch, n)), checkpoint)


def capture_once(stream: DataFrame, table: DeltaTable, checkpoint: str, delay="1 hour"):
    """Append each distinct payload once. Records sent again soon after are dropped by state, which forgets them `delay`
    after their arrival; payloads captured before are found by their hashes alone, in the buckets of the batch's hashes.
    Equal payloads that arrive together are one capture, under the smallest record_id. `table` is keyed by source_hash."""
    arrived = hashed(stream).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay)
    fresh = arrived.dropDuplicatesWithinWatermark(["source_hash", "record_id"])

    def step(batch, batch_id):
        batch = batch.persist()
        one = batch.groupBy("source_hash").agg(F.min_by("payload", "record_id").alias("payload"), F.min("record_id").alias("record_id"))
        used = [r.bucket for r in table.bucketed(batch.select("source_hash")).select("bucket").distinct().collect()]
        held = table.history(batch_id).filter(F.col("bucket").isin(used)).select("source_hash")
        table.append(batch_id, one.join(held, "source_hash", "left_anti"))
        batch.unpersist()

    drain(fresh.writeStream.foreachBatch(step), checkpoint)


class Limiter(StatefulProcessor):
    """One key's requests in event time. A request waits until the watermark has passed it, so requests are judged in the
    order (at, event_id) whatever the order they arrive in; a key without waiting requests loses its state when its last
    passed one leaves the window. State per key: the requests of the watermark's delay and at most `limit` times."""

    def __init__(self, limit, seconds):
        self.limit, self.us = limit, seconds * 1_000_000

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long")
        self.passed = handle.getValueState("passed", "times array<long>")

    def handleInputRows(self, key, rows, timerValues):
        fresh = [(int(a), int(e)) for pdf in rows for a, e in zip(pdf["at"], pdf["event_id"], strict=True)]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(fresh)[0] // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((w[0], w[1]) for w in self.waiting.get()) if self.waiting.exists() else []
        due = [w for w in waiting if w[0] <= mark]
        passed = list(self.passed.get()[0]) if self.passed.exists() else []
        out = []
        for at, _ in due:
            passed = [x for x in passed if at - x <= self.us]
            out.append(len(passed) < self.limit)
            if out[-1]:
                passed.append(at)
        left = waiting[len(due) :]
        if due:
            self.waiting.put(left) if left else self.waiting.clear()
        if left:
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        if passed and (left or passed[-1] + self.us >= mark):
            self.passed.update((passed,))
            if not left:
                self.handle.registerTimer((passed[-1] + self.us) // 1000 + 1)
        else:
            self.passed.clear()
        if due:
            yield pd.DataFrame({"event_id": [e for _, e in due], "accepted": out})

    def close(self):
        pass


def limit_stream(events: DataFrame, limit=DEFAULTS.limit_requests, seconds=DEFAULTS.limit_seconds, delay="1 hour") -> DataFrame:
    """(event_id, accepted) of arriving events (event_id, key, at in microseconds), by event time.

    A request is judged when the watermark, the latest time seen less `delay`, has passed it. One that arrives when the
    watermark has already passed it gets no verdict and takes no place in the window; Spark counts such rows in
    numRowsDroppedByWatermark. Rows without an event_id (heartbeats of a source) only move the watermark."""
    timed = events.withColumn("seen", F.timestamp_micros("at")).withWatermark("seen", delay)
    real = timed.filter("event_id is not null or seen is null")  # names `seen`, so that it stays above the watermark
    return real.groupBy("key").transformWithStateInPandas(
        Limiter(limit, seconds), "event_id long, accepted boolean", "Append", "eventTime"
    )


@contextmanager
def keyed_state(spark):
    """The state store that list state and timers need, for queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staleness_stream(files: DataFrame, today: str) -> DataFrame:
    """Verify-by date passed, open state and claim date of arriving files; no state."""
    claim = dating.claim_date("text", "rel_path", dating.epoch_to_iso("mtime"))
    return files.select(
        "rel_path", dating.expired("text", today).alias("expired"), dating.volatility("text").alias("volatility"),
        claim["label"].alias("label"), claim["date"].alias("claimed"),
    )


def hashed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("source_hash", records.source_hash("payload"))
