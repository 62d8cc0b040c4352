"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of `docs`.

Every stage works on all rows that its predecessor kept. Rows of unknown language, all but one row of each group of near
duplicates, and rows that contain a benchmark item go; values that look like live secrets are replaced; what is left is
packed.
"""

from . import decontaminate, langid, secrets, simhash
from .common import table
from .packing import pack_documents
from .tokens import vocabulary


def identified(spark, docs, sf_dir):
    return langid.keep_identified(docs)


def deduplicated(spark, docs, sf_dir):
    return simhash.keep_one(docs)


def decontaminated(spark, docs, sf_dir):
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark, docs, sf_dir):
    return secrets.redact(docs)


def packed(spark, docs, sf_dir):
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), 2048, 0, with_ids=False).drop("spot")


STAGES = [
    ("language_id", identified), ("simhash_near_dedup", deduplicated), ("benchmark_decontamination", decontaminated),
    ("secret_scan", redacted), ("best_fit_packing", packed),
]
