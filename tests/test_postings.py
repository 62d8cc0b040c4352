"""The inverted index, and requests that meet it as tables."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.operators import postings as po
from folioscope.operators import textindex as ti
from folioscope.operators import vectors as vx


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    return [(k * 3, None if k % 17 == 5 else " ".join(draw.choices(words, weights=range(30, 0, -1), k=draw.randint(0, 25)))) for k in range(n)]


def brute_force(chunks, requests, depth):
    """BM25 over words and short phrases, best first, ties to the lower id."""
    tokens = {i: (t or "").split() for i, t in chunks}
    mean = sum(map(len, tokens.values())) / len(tokens)
    count = {}

    def times(i, phrase):
        if (i, phrase) not in count:
            t, m = tokens[i], len(phrase)
            count[i, phrase] = sum(tuple(t[k : k + m]) == phrase for k in range(len(t) - m + 1))
        return count[i, phrase]

    out = []
    for query, text in requests:
        words = text.split()
        asked = Counter([(w,) for w in words] + ([tuple(words)] if 2 <= len(words) <= 6 else []))
        scores = {}
        for phrase, weight in asked.items():
            df = sum(times(i, phrase) > 0 for i in tokens)
            raw = math.log((len(tokens) - df + 0.5) / (df + 0.5))
            for i, t in tokens.items():
                if tf := times(i, phrase):
                    scores[i] = scores.get(i, 0) + weight * (raw if raw > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        best = sorted((-round(s, 9), i) for i, s in scores.items())[:depth]
        out += [(query, i, k + 1) for k, (_, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("part", "block"), [(4096, 2048), (20, 3)])
def test_scores_by_brute_force_at_every_size_of_parts_and_blocks(spark, part, block):
    chunks = corpus(4, 150)
    draw = random.Random(1)
    requests = [(100 + k, " ".join(f"w{draw.randrange(32)}" for _ in range(1 + k % 4))) for k in range(20)]
    index = po.write_postings(ti.tokenise(spark.createDataFrame(chunks, "chunk_id long, text string")), part)
    found = ti.bm25_topn(spark.createDataFrame(requests, "query_id long, query string"), index, 6, block)
    assert sorted(map(tuple, found.select("query_id", "chunk_id", "kw_rank").collect())) == brute_force(chunks, requests, 6)


def test_hits_meet_many_blocks_at_once(spark, monkeypatch):
    chunks, requests = corpus(4, 150), [(k, f"w{k % 7} w{k % 11} w{k % 5}") for k in range(40)]
    index = po.write_postings(ti.tokenise(spark.createDataFrame(chunks, "chunk_id long, text string")), 16)
    lefts, dealt = [], po.dealt
    monkeypatch.setattr(po, "dealt", lambda d, *keys: (lefts.append((keys, d)), dealt(d, *keys))[1])
    for blocks, entries in ((po.TASK_BLOCKS, po.TASK_ENTRIES), (1, 1)):
        monkeypatch.setattr(po, "TASK_BLOCKS", blocks)
        monkeypatch.setattr(po, "TASK_ENTRIES", entries)
        found = ti.bm25_topn(spark.createDataFrame(requests, "query_id long, query string"), index, 6, 4)
        assert sorted(map(tuple, found.select("query_id", "chunk_id", "kw_rank").collect())) == brute_force(chunks, requests, 6)
    ten = [d.count() for keys, d in lefts if keys[0] == "group"]
    assert ten[1] == 10 * ten[0]  # one block a task deals the hits ten times, 32 blocks once


def test_only_folders_of_the_asked_terms_are_read(spark):
    index = po.write_postings(ti.tokenise(spark.createDataFrame(corpus(2, 60), "chunk_id long, text string")))
    phrases = ti.query_phrases(spark.createDataFrame([(1, "w3 w4")], "query_id long, query string"))
    hits = po.phrase_hits(phrases.withColumn("name", F.array_join("phrase", " ")), index)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    buckets = [r.b for r in spark.createDataFrame([("w3",), ("w4",)], "t string").select(po.bucket_of("t").alias("b")).collect()]
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "bucket" in line]
    assert any(all(str(b) in line for b in buckets) for line in filters)
    assert "chunk_ids" not in "".join(line for line in plan.splitlines() if "ReadSchema" in line)
    assert {r.name for r in hits.collect()} <= {"w3", "w4", "w3 w4"}


def test_requests_never_pass_through_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_, **__):
        raise AssertionError("rows on the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    asked = spark.range(50).selectExpr("id AS query_id", "concat('w', id % 30) AS query", "array(float(id % 7), float(1)) AS embedding")
    held = spark.range(400).selectExpr("id AS chunk_id", "concat('w', id % 30) AS text", "array(float(id % 11), float(1)) AS embedding")
    assert ti.bm25_topn(asked, ti.tokenise(held), 3, 7).count() == 150
    assert vx.knn_topn(asked, held, 3, 7, 30).count() == 150


def test_nothing_asked_or_nothing_held(spark):
    none = spark.createDataFrame([], "chunk_id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "w1", [1.0, 0.0]), (2, "", None)], "query_id long, query string, embedding array<float>")
    one = spark.createDataFrame([(5, "w1", [0.0, 1.0])], "chunk_id long, text string, embedding array<float>")
    assert ti.bm25_topn(asked, ti.tokenise(none), 3).count() == 0 and vx.knn_topn(asked, none, 3).count() == 0
    assert ti.bm25_topn(asked.limit(0), ti.tokenise(one), 3).count() == 0 and vx.knn_topn(asked.limit(0), one, 3).count() == 0
    assert [tuple(r) for r in vx.knn_topn(asked, one, 3).collect()] == [(1, 5, 1.0, 1)]


def test_lists_of_numbers_as_bytes():
    lists = [[], [0, 1, 127, 128, 1 << 50], [5], [], [3, 3, 1 << 62]]
    offsets = [0, 0, 5, 6, 6, 9]
    for ascending in (True, False):
        column = po._packed([x for one in lists for x in one], offsets, ascending)
        values, ends = po._unpacked(column.slice(1, 4), ascending)
        assert [values[a:b].tolist() for a, b in zip(ends, ends[1:])] == lists[1:]
    assert po._packed(range(0, 600, 3), [0, 200]).nbytes < 250


def test_texts_are_not_shuffled_for_the_index(spark, monkeypatch):
    """every token was dealt to its part as a string of its own, and places travelled as eight bytes each."""
    held = spark.range(0, 300, 1, 3).selectExpr("id AS chunk_id", "concat('w', id % 30, repeat(' w7', int(id % 9) * 20)) AS text")
    monkeypatch.setattr(po, "dealt", lambda *_: pytest.fail("texts are dealt"))
    index = po.write_postings(ti.tokenise(held), 40)
    own = index.filter("bucket = -1").collect()
    assert sorted(len(r.chunk_ids) for r in own) == [20] * 3 + [40] * 6 and len({r.part for r in own}) == 9
    assert sorted(i for r in own for i in r.chunk_ids) == list(range(300))
    places = index.filter("term = 'w7'").selectExpr("sum(octet_length(places))").first()[0]
    assert places < 1.5 * held.selectExpr("sum(int(id % 9) * 20)".replace("id", "chunk_id")).first()[0]


def test_a_part_of_long_chunks_has_fewer(spark, monkeypatch):
    chunks = corpus(8, 80)
    held = spark.createDataFrame(chunks, "chunk_id long, text string").coalesce(1)
    monkeypatch.setattr(po, "PART_TOKENS", 30)
    index = po.write_postings(ti.tokenise(held))
    own = index.filter("bucket = -1").collect()
    assert len(own) > 20 and all(len(r.lengths) == 1 or sum(r.lengths) <= 30 for r in own)
    asked = [(k, f"w{k} w{k + 1}") for k in range(6)]
    found = ti.bm25_topn(spark.createDataFrame(asked, "query_id long, query string"), index, 5)
    assert sorted(map(tuple, found.select("query_id", "chunk_id", "kw_rank").collect())) == brute_force(chunks, asked, 5)


@pytest.mark.parametrize("times", [1, 10])
def test_what_requests_and_hits_send_grows_with_both(times):
    """every request was sent to every part of the chunks, 147 times for 600,000 chunks."""
    groups, lanes = po.layout(147 * times, 90_000_000 * times, 200_000 * times, 17_500_000 * times, 200, 2048)
    assert groups * lanes >= 200 and groups <= 40 * times and lanes <= 10 * times
    assert 90_000_000 * times / groups <= po.TASK_ENTRIES
    assert po.layout(0, 0, 0, 0, 4, 2048) == (1, 1) and po.layout(3, 10, 5, 10, 8, 2048) == (3, 1)
