"""Language identification: sparse multinomial logistic regression on TF-IDF of character 1- to 3-grams.

Document frequencies are counted over all training rows. The regression is trained with follow-the-regularised-leader
and elastic-net penalties on a bounded sample, about SAMPLE rows of each language chosen by a hash of the id; a fifth of
it is held back and sets the temperature of the scores. Training rows: those that `held_out` does not exclude, with a
language and text.

Null texts and texts without a letter are `und` with score 0; so is everything if there is nothing to learn from.
Repeated rows are scored alike, other columns of the input are passed on or not read, and a very long text is read in
blocks. An empty table gives an empty result.
"""

import io
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .grams import Ftrl, gram_counts, logits, softmax, temperature

LOW, HIGH, BITS = 1, 3, 14
SAMPLE = 1000
EPOCHS = 3
UND = "und"
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text):
    return text is not None and LETTER.search(text) is not None


def tf_idf(text, idf):
    found, counts = gram_counts(text, LOW, HIGH, BITS)
    values = (1 + np.log(counts)) * idf[found]
    return found, values / max(float(np.sqrt(values @ values)), 1e-12)


def document_frequencies(train: DataFrame):
    """(bucket, number of texts that hold it) over all rows; bucket -1 has the number of texts."""

    def count(batches):
        total, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[gram_counts(text, LOW, HIGH, BITS)[0]] += 1
                n += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], n))], names=["bucket", "n"])

    return train.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def trainer(langs, idf):
    def train(rows):
        rows = rows.sort_values(["h", "lang", "text"], kind="stable")
        examples = [(*tf_idf(t, idf), langs.index(lang)) for t, lang in zip(rows["text"], rows["lang"], strict=True)]
        held = examples[::5] if len(examples) >= 5 * len(langs) else []
        used = [x for k, x in enumerate(examples) if k % 5] if held else examples
        weights = Ftrl(1 << BITS, len(langs)).fit(used, EPOCHS)
        t = temperature([logits(weights, r, v) for r, v, _ in held], [y for _, _, y in held])
        out = io.BytesIO()
        np.savez_compressed(out, weights=weights.astype(np.float32), t=t)
        return pd.DataFrame({"model": [out.getvalue()]})

    return train


def learn(docs: DataFrame, sample: int = SAMPLE):
    """The model (languages, idf, weights, temperature) or None if no row can be learned from."""
    train = docs.filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    df = {r["bucket"]: r["n"] for r in document_frequencies(train).collect()}
    n = df.pop(-1)
    idf = np.zeros(1 << BITS)
    idf[list(df)] = np.log((1 + n) / (1 + np.array(list(df.values())))) + 0.05
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    drawn = train.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))).filter(F.col("h") < share[F.col("lang")] * (1 << 30))
    blob = drawn.groupBy().applyInPandas(trainer(langs, idf), "model binary").collect()
    if not blob:
        return None
    got = np.load(io.BytesIO(blob[0]["model"]))
    return langs, idf, got["weights"].astype(float), float(got["t"])


def predict(text, model):
    if model is None or not has_letter(text):
        return UND, 0.0
    langs, idf, weights, t = model
    p = softmax(logits(weights, *tf_idf(text, idf)) / t)
    k = int(p.argmax())
    return langs[k], float(p[k])


def predictor(spark, model):
    """A column function: text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, shared.value) for t in texts], columns=["lang_pred", "score"])

    return run


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    run = predictor(docs.sparkSession, learn(docs, sample))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), run("text").alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows, all columns, whose language is known: a text with letters and a score of `least` or more."""
    run = predictor(docs.sparkSession, learn(docs, sample))
    scored = docs.select(F.struct("*").alias("doc")).select("doc", run("doc.text").alias("p"))
    return scored.filter((F.col("p.lang_pred") != UND) & (F.col("p.score") >= least)).select("doc.*")
