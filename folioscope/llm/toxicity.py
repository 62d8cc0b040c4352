"""Toxicity: a linear classifier on character 3- to 5-grams scaled by naive Bayes log-count ratios.

Log-count ratios come from the document frequencies of all labelled training rows. A feature is the presence of an
n-gram, its value the ratio; n-grams seen in fewer than LEAST labelled texts or with a ratio near zero are left out. The
logistic regression on these values is trained on a bounded sample, about SAMPLE rows of each label chosen by a hash of
the id, and its intercept is moved back to the frequency of the labels in all training rows.

Training rows: labelled 0 or 1 (a doc_id labelled more than once is toxic if any label says so) and not excluded by
`held_out`. Null and empty texts are scored like any text without n-grams. Without rows of both labels every score is the
share of toxic rows (0 if there are none). Repeated rows score alike; other columns are not read.
"""

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored
from .grams import Ftrl, gram_set

LOW, HIGH, BITS = 3, 5, 18
SAMPLE = 2000
LEAST = 6
RATIO = 2.0
EPOCHS = 6
THRESHOLD = 0.3


def label_frequencies(train: DataFrame) -> DataFrame:
    """(bucket, texts of label 0 that hold it, of label 1) over all rows; bucket -1 counts the texts."""

    def count(batches):
        total = np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[toxic, gram_set(text, LOW, HIGH, BITS)] += 1
                total[toxic, -1] += 1
        found = np.flatnonzero(total.any(axis=0))
        buckets = np.where(found == 1 << BITS, -1, found)
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(total[0, found]), pa.array(total[1, found])], names=["bucket", "n0", "n1"])

    counted = train.select("text", "toxic").mapInArrow(count, "bucket long, n0 long, n1 long")
    return counted.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= LEAST)


def ratios(buckets, n0, n1, all0, all1):
    """Log-count ratio per bucket; zero where it says little."""
    r = np.zeros(1 << BITS)
    r[buckets] = np.log((n1 + 0.5) / (all1 + 1)) - np.log((n0 + 0.5) / (all0 + 1))
    r[np.abs(r) < RATIO] = 0
    return r


def features(text, r):
    found = gram_set(text, LOW, HIGH, BITS, r != 0)
    return found, r[found]


def trainer(r):
    def train(rows):
        rows = rows.sort_values(["h", "toxic", "text"], kind="stable")
        examples = [(*features(t, r), int(y)) for t, y in zip(rows["text"], rows["toxic"], strict=True)]
        weights = Ftrl(1 << BITS, 2, alpha=0.05, l1=0.05, l2=1.0).fit(examples, EPOCHS)
        ones = int(rows["toxic"].sum())
        return pd.DataFrame({"model": [(weights[:, 1] - weights[:, 0]).astype(np.float32).tobytes()], "ones": [ones], "zeros": [len(rows) - ones]})

    return train


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model: value of each bucket (ratio times weight) and the intercept."""
    marks = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.filter(~held_out("doc_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train = stored(texts.join(marks.hint("merge"), "doc_id"), "toxicity-train")  # both sides grow: one plan at every size
    counted = label_frequencies(train).toPandas()
    totals = counted[counted["bucket"] < 0]
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    all0, all1 = sizes.get(0, 0), sizes.get(1, 0)
    if not (all0 and all1 and len(totals)):
        share = all1 / max(1, all0 + all1)
        return np.zeros(1 << BITS), -50.0 if share == 0 else 50.0 if share == 1 else float(np.log(share / (1 - share)))
    rows = counted[counted["bucket"] >= 0]
    r = ratios(rows["bucket"].to_numpy(), rows["n0"].to_numpy(), rows["n1"].to_numpy(), all0, all1)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / all1)).otherwise(min(1.0, sample / all0))
    drawn = train.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))).filter(F.col("h") < share * (1 << 30))
    got = drawn.groupBy().applyInPandas(trainer(r), "model binary, ones long, zeros long").collect()
    if not got or not got[0]["ones"] or not got[0]["zeros"]:
        return np.zeros(1 << BITS), float(np.log(all1 / all0))
    weights = np.frombuffer(got[0]["model"], np.float32).astype(float)
    shift = np.log(all1 / all0) - np.log(got[0]["ones"] / got[0]["zeros"])
    return weights[:-1] * r, float(weights[-1] + shift)


def score_of(text, values, intercept, wanted):
    total = values[gram_set(text, LOW, HIGH, BITS, wanted)].sum() + intercept
    return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    values, intercept = learn(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast((values.astype(np.float32), intercept, values != 0))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([score_of(t, *shared.value) for t in texts], dtype="float64")

    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), run("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
