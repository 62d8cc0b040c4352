"""The searchable corpus over the given tables: document texts under the note paths, with their vectors."""

from pyspark.sql import functions as F

from ..functions import disclosure as dis
from ..functions import text as t
from ..plans.catalog import table
from ..plans.search import Corpus
from . import notes as src


def chunks(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    paths = src.notes(spark, sf_dir).select(F.col("k").alias("chunk_id"), "rel_path")
    return texts.join(paths, "chunk_id").select(
        "chunk_id", "rel_path", F.lit(0).alias("chunk_idx"), "text", F.lit("").alias("heading_path"), F.lit("").alias("context")
    )


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def corpus(spark, sf_dir):
    docs = src.docs(spark, sf_dir)
    return Corpus(
        chunks(spark, sf_dir), vectors(spark, sf_dir), docs, src.links(docs), src.supersessions(docs),
        src.beliefs(spark, sf_dir).select("rel_path", "persona", "state"),
    )


def requests(spark, sf_dir):
    """One request per benchmark text; the eight kinds differ in filter, persona and envelope."""
    item = F.col("item_id")
    kind = item % 8
    q = table(spark, sf_dir, "benchmark").join(
        table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id", "left"
    )
    seal = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("order-"), i.cast("string"))), " ")
    none = F.lit(None).cast("string")
    types = F.array(F.lit("reference"), F.lit("user"), F.lit("belief"))
    q = q.select(
        item.alias("query_id"), F.col("text").alias("query"), "embedding", F.lit(10).alias("k"),
        F.when((kind == 1) | (item % 16 == 7), F.lit("project")).otherwise(none).alias("doc_type"),
        (kind == 2).alias("priority_only"), (kind == 3).alias("recency"),
        F.when(kind.isin(4, 5), F.concat(F.lit("p"), F.floor(item / 8).cast("string"))).otherwise(F.lit("")).alias("persona"),
        F.when(kind == 5, F.lit("independent")).when(kind == 6, F.lit("adversarial")).when(kind == 7, F.lit("collaborative")).otherwise(none).alias("ceiling_mode"),
        F.when(kind == 6, seal).otherwise(none).alias("ceiling_seal"),
        none.alias("requested_mode"), none.alias("requested_seal"),
        F.when(kind == 7, types).otherwise(t.no_strings()).alias("allowed_doc_types"),
        F.when(kind == 7, F.array(F.lit("furniture/"), F.lit("building/"), F.lit("000-"))).otherwise(t.no_strings()).alias("allowed_path_prefixes"),
        F.lit(False).alias("force_priority_only"),
        F.when(kind == 5, F.lit("artifact")).otherwise(F.lit("")).alias("default_class"),
    )
    return dis.resolve_envelope(q).select(
        "query_id", "query", "embedding", "k", "doc_type", "priority_only", "recency", "persona", "envelope"
    )


def lines(spark, sf_dir):
    """One chunk per document line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return d.select((F.col("doc_id") * (1 << 20) + F.col("line")).alias("chunk_id"), "doc_id", "line", "text")


def sentences(spark, sf_dir):
    """Every sentence of every benchmark text as its own query."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.\n]+")).alias("i", "query"))
    return b.select((F.col("item_id") * 1000 + F.col("i")).alias("query_id"), "query")
