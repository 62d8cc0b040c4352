import random
import zlib

import numpy as np
import pytest

from folioscope.llm import grams, langid, toxicity

from .helpers import DOCS, awkward, doc, documents

SYLLABLES = {"en": "th ing ed er the and on", "fr": "eau ou que tre les é", "de": "sch ung ich keit der ü"}


def is_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n=240):
    draw, rows = random.Random(5), []
    for i in range(n):
        lang = draw.choice(sorted(SYLLABLES))
        parts = SYLLABLES[lang].split()
        rows.append(doc(i, " ".join("".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(draw.randint(5, 60))), lang))
    return rows


@pytest.fixture(scope="module")
def identified(spark):
    rows = corpus()
    return rows, {r["doc_id"]: r for r in langid.identify(documents(spark, rows)).collect()}


def test_language_of_held_out_rows(identified):
    rows, got = identified
    held = [(r[2], got[r[0]]) for r in rows if is_held(r[0])]
    assert held and all(g["held_out"] for _, g in held)
    assert sum(lang == g["lang_pred"] for lang, g in held) >= 0.95 * len(held)
    assert all(0 <= g["score"] <= 1 for g in got.values())


def test_language_learns_nothing_from_held_out_rows(spark, identified):
    rows, got = identified
    swapped = [(*r[:2], "xx", "other", 0) if is_held(r[0]) else r for r in rows]
    again = {r["doc_id"]: r for r in langid.identify(documents(spark, swapped)).collect()}
    assert again == got


def test_language_of_awkward_rows(spark):
    rows = [tuple(r) for r in awkward(spark).collect()]
    docs = documents(spark, corpus(60) + [(2000 + i if r[0] is None else 1000 + r[0], *r[1:]) for i, r in enumerate(rows)])
    got = langid.identify(docs.withColumnRenamed("n_chars", "score")).collect()
    assert len(got) == 60 + len(rows)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1003, 1004, 1005, 1008))
    kept = langid.keep_identified(docs.withColumnRenamed("source", "doc"))
    assert kept.columns == ["doc_id", "text", "lang", "doc", "n_chars"]
    assert not {1003, 1004, 1005, 1008} & {r["doc_id"] for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], DOCS)
    assert langid.identify(empty).count() == 0
    got = langid.identify(documents(spark, [doc(1, "some text", None), doc(2, None, "en")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, labels).count() == 0
    assert [r["predicted"] for r in toxicity.score(documents(spark, [doc(1, "x"), doc(2, None)]), labels).collect()] == [0, 0]


def labelled(spark, n=240):
    draw, rows = random.Random(9), []
    for doc_id, text, lang, source, _ in corpus(n):
        toxic = draw.random() < 0.3
        if toxic:
            words = text.split()
            words.insert(draw.randrange(len(words)), draw.choice(["nastyword", "vileword"]))
            text = " ".join(words)
        rows.append((doc(doc_id, text, lang, source), int(toxic)))
    return documents(spark, [r for r, _ in rows]), spark.createDataFrame([(r[0], None, t) for r, t in rows], "doc_id long, quality int, toxic int"), rows


def test_toxicity_of_held_out_rows(spark):
    docs, labels, rows = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [(t, got[r[0]]) for r, t in rows if is_held(r[0])]
    low = max(g["score"] for t, g in held if not t)
    assert np.mean([g["score"] > low for t, g in held if t]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r for r in toxicity.score(docs, other).collect()}
    assert again == got


def test_toxicity_of_awkward_rows(spark):
    docs, labels, _ = labelled(spark, 60)
    more = labels.union(spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 0, 7), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs.union(awkward(spark)).withColumnRenamed("lang", "toxic").withColumnRenamed("source", "score"), more).collect()
    assert len(got) == 60 + awkward(spark).count() and all(0 <= r["score"] <= 1 for r in got)


def test_blocks_of_a_long_text_count_like_the_whole(monkeypatch):
    text = "abcdé " * 700
    whole = grams.gram_counts(text, 1, 3, 12)
    monkeypatch.setattr(grams, "BLOCK", 97)
    parts = grams.gram_counts(text, 1, 3, 12)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_penalty_makes_weights_sparse():
    draw = np.random.default_rng(0)
    examples = [(np.array([k, 2 + int(draw.integers(50))]), np.ones(2), k) for k in [0, 1] * 60]
    weights = grams.Ftrl(60, 2, l1=2.0).fit(examples, 2)
    assert (weights[2:52] == 0).mean() > 0.8 and weights[0, 0] > weights[0, 1]
