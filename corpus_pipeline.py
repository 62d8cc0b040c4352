"""The corpus pipeline: each stage's rows are written and read again as the next stage's documents."""

from folioscope.llm import stages
from folioscope.llm.common import stored, table

STAGES = stages.STAGES

#: Language models, token ids and the packing plan have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
