"""Streams: event time, replays, deltas."""

import hashlib
import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.plans import q_ingest
from folioscope.session import new_folder
from folioscope.streaming import jobs
from folioscope.streaming.deltas import DeltaTable

EVENT = "event_id long, key long, at long"
SECOND = 1_000_000


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def verdicts(events, limit, seconds):
    passed, out = defaultdict(list), []
    for i, k, at in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        passed[k] = [x for x in passed[k] if at - x <= seconds * SECOND]
        out.append((i, len(passed[k]) < limit))
        if out[-1][1]:
            passed[k].append(at)
    return sorted(out)


def bytes_in(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names if f.endswith(".parquet"))


def test_limiter_judges_by_event_time_and_forgets(spark):
    draw = random.Random(3)
    events = [(i, draw.choice([1, 1, 2, 3]), draw.randrange(1000 * SECOND, 4000 * SECOND)) for i in range(300)]
    halves = [e for e in events if e[2] < 2400 * SECOND], [e for e in events if e[2] >= 2200 * SECOND]
    early = [e for e in halves[0] if e[2] < 2200 * SECOND or e[0] % 2]  # half of the overlap comes with the second wave
    waves = [early, [e for e in events if e not in early], [(None, None, 5000 * SECOND)], [(9001, 1, 4000 * SECOND), (9002, 7, 4900 * SECOND)], [(None, None, 9000 * SECOND)]]
    inbox, out, mark = new_folder(spark, "in"), new_folder(spark, "out"), new_folder(spark, "mark")
    with jobs.keyed_state(spark):
        for wave in waves:
            draw.shuffle(wave)
            spark.createDataFrame(wave, EVENT).coalesce(1).write.mode("append").parquet(inbox)
            stream = jobs.limit_stream(jobs.read_folder(spark, inbox, EVENT), 3, 60, "300 seconds")
            jobs.drain(stream.writeStream.format("parquet").option("path", out), mark)
    got = rows(spark.read.parquet(out))
    # 9001 came after the watermark had passed it: no verdict; 9002 was in time
    assert got == sorted([*verdicts(events, 3, 60), (9002, True)], key=repr)
    left = [spark.read.format("statestore").option("path", mark).option("stateVarName", v).load().count() for v in ("waiting", "passed")]
    assert left == [0, 0]


def test_delta_table_merges_owners_and_survives_replays(spark):
    t = DeltaTable(spark, new_folder(spark, "delta"), "k string, v long", "k")
    owner = "k string"

    def put(batch, values, owners):
        t.write(batch, spark.createDataFrame(values, "k string, v long"), spark.createDataFrame([(o,) for o in owners], owner))

    put(0, [(f"k{i}", i) for i in range(500)] + [("two", 1), ("two", 2)], [f"k{i}" for i in range(500)] + ["two"])
    for _ in range(2):  # the second time is a replay
        put(1, [("k1", -1), ("two", 3)], ["k1", "k2", "two"])
    want = sorted([(f"k{i}", i) for i in range(500) if i not in (1, 2)] + [("k1", -1), ("two", 3)], key=repr)
    assert rows(t.current()) == want
    assert len(t.current(1).collect()) == 502
    keys = spark.createDataFrame([("k1",), ("k2",), ("k7",), ("none",)], owner)
    assert rows(t.current(keys=keys)) == [("k1", -1), ("k7", 7)]
    assert bytes_in(f"{t.folder}/delta/batch=1") < bytes_in(f"{t.folder}/delta/batch=0") / 2
    t.compact()
    assert rows(t.current()) == want and t.batches("base") == [1]
    put(2, [], ["k7"])
    assert rows(t.current()) == [r for r in want if r[0] != "k7"]
    plan = t.current(keys=keys)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")


def test_delta_table_sends_no_wide_row_to_write_it_and_reads_a_digest_instead(spark):
    t = DeltaTable(spark, new_folder(spark, "wide"), "k string, v string", "k")
    t.append(0, spark.range(0, 400, 1, 3).select(F.concat(F.lit("k"), "id").alias("k"), F.repeat(F.lit("x"), 100).alias("v")))
    files = [f for f in t.history().inputFiles() if "bucket=5" in f]
    assert len(files) == 3  # each of the three tasks wrote its own; one task per bucket before
    digests = t.current(digest=F.sha1(F.encode("v", "UTF-8"))).select("k", "digest")
    assert digests.distinct().count() == 400 and {r.digest for r in digests.collect()} == {hashlib.sha1(b"x" * 100).hexdigest()}
    plan = digests._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Window")] + plan[plan.index("Window") :].splitlines()[1]  # down to what the window is fed with
    assert "digest#" in above and not re.search(r"\[k#\d+, v#", above)


@pytest.fixture(scope="module")
def wave(spark, sf):
    return q_ingest.import_waves(spark, sf)[0].limit(60).cache()


def belief(path, name, state):
    return F.when(F.col("rel_path") == path, F.struct(F.lit(name).alias("belief_id"), F.lit("p").alias("persona"), F.lit(state).alias("state"), F.lit("s").alias("subject"), F.lit("c").alias("claim"))).otherwise(F.col("belief"))


def snapshot(tables):
    return [rows(t.current().select(*[c for c in t.columns if c not in ("mtime",)])) for t in tables.all()]


def test_import_moves_beliefs_replays_and_writes_what_changed(spark, wave):
    tables = jobs.CorpusTables(spark, new_folder(spark, "corpus"), wave.schema)
    first, second = (r.rel_path for r in wave.filter("belief is null").orderBy("rel_path").limit(2).collect())
    jobs.import_batch(tables, wave.withColumn("belief", belief(first, "held", "draft")), 0)
    chunks = rows(tables.chunks.current().select("rel_path"))
    assert len({c[0] for c in chunks}) == 60
    # the belief is found under another path; the file that held it is not in the batch
    moved = wave.filter(F.col("rel_path") == second).withColumn("belief", belief(second, "held", "promoted"))
    for _ in range(2):
        jobs.import_batch(tables, moved, 1)
        assert [(r.rel_path, r.state) for r in tables.beliefs.current().filter("belief_id = 'held'").collect()] == [(second, "promoted")]
    before = snapshot(tables)
    # unreadable: keeps its state; two versions in one batch: the newest counts; a removal takes everything along
    unread = moved.withColumn("metadata_ok", F.lit(False)).withColumn("belief", F.lit(None).cast(wave.schema["belief"].dataType))
    jobs.import_batch(tables, unread, 2)
    assert snapshot(tables) == before
    edited = wave.filter(F.col("rel_path") == first).withColumns({"body": F.lit("# New\nSee [[order-9]]."), "doc_hash": F.lit("x"), "mtime": F.col("mtime") + 1})
    gone = wave.filter(F.col("rel_path") == second).withColumn("removed", F.lit(True))
    jobs.import_batch(tables, edited.union(wave.filter(F.col("rel_path") == first)).union(gone), 3)
    assert [r.tgt_raw for r in tables.links.current().filter(F.col("src_path") == first).collect()] == ["order-9"]
    assert all(not [r for r in part if second in r[:2]] for part in snapshot(tables))
    assert [bytes_in(f"{t.folder}/delta/batch=3") < bytes_in(f"{t.folder}/delta/batch=0") for t in tables.all()] == [True] * 5
    after = snapshot(tables)
    for t in tables.all():
        t.compact()
    assert snapshot(tables) == after


def test_capture_writes_a_payload_once(spark):
    d = "record_id long, payload string"
    t = DeltaTable(spark, new_folder(spark, "cap"), f"{d}, source_hash string", "source_hash")
    inbox, mark = new_folder(spark, "in"), new_folder(spark, "mark")
    for wave_rows in ([(5, "a"), (2, "a"), (3, "b")], [(5, "a"), (1, "a"), (4, "c")], [(4, "c"), (4, "c")]):
        spark.createDataFrame(wave_rows, d).coalesce(1).write.mode("append").parquet(inbox)
        jobs.capture_once(jobs.read_folder(spark, inbox, d), t, mark)
    assert rows(t.current().select("record_id", "payload")) == [(2, "a"), (3, "b"), (4, "c")]
    assert rows(t.history().groupBy("payload").count()) == [("a", 1), ("b", 1), ("c", 1)]
