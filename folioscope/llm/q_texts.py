"""Registered queries of the text classifiers and of near-duplicate detection."""

from . import langid, ngram_join, simhash, toxicity
from .common import table


def op7_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


QUERIES = {"op7_toxicity": op7_toxicity, "op8_language_id": op8_language_id, "op10_simhash_near_dedup": op10_simhash_near_dedup, "op11_ngram_jaccard_join": op11_ngram_jaccard_join}
ORACLES = {}
