"""Queries and SQL of the subpackage."""

from . import q_filters, q_manifest, q_records, q_texts, q_tokens

QUERIES, ORACLES = {}, {}
for module in (q_filters, q_manifest, q_records, q_texts, q_tokens):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
