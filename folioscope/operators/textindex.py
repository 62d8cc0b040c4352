"""BM25 keyword retrieval for many queries at once."""


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.admission import match_phrases
from ..functions.porter import stem
from ..functions.text import col, strip_accents
from ..params import REQUEST_BLOCK
from . import postings
from .postings import IDF_FLOOR


def tokens(text):
    return F.regexp_extract_all(strip_accents(F.lower(col(text))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokenise(chunks: DataFrame, text="text", stemming=False) -> DataFrame:
    """The index table: chunk_id, tokens. Write it once when many searches follow."""
    index = chunks.select("chunk_id", tokens(text).alias("tokens"))
    return stemmed(index, "tokens") if stemming else index


def stemmed(df: DataFrame, column: str) -> DataFrame:
    """Every word of an array column by its stem. Each distinct word of a batch is stemmed once; nothing is shuffled."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            lists = b.column(at)
            words = pc.list_flatten(lists).dictionary_encode()
            stems = pa.array([w if w is None else stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield b.set_column(at, b.schema.field(at), pa.ListArray.from_arrays(offsets, stems).cast(b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def query_phrases(queries: DataFrame, query="query", stemming=False) -> DataFrame:
    """(query_id, phrase ARRAY, weight): what each query scores; a repeated term weighs more."""
    split = F.transform(match_phrases(query), lambda ph: F.split(F.lower(F.array_join(ph, "_")), "_"))
    clean = F.transform(split, lambda ph: F.filter(ph, lambda w: w != ""))
    phrases = queries.select("query_id", F.explode(clean).alias("phrase")).filter(F.size("phrase") > 0)
    phrases = stemmed(phrases, "phrase") if stemming else phrases
    return phrases.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("weight"))


def bm25_topn(queries: DataFrame, index: DataFrame, depth: int, block: int = REQUEST_BLOCK, stemming=False) -> DataFrame:
    """(query_id, chunk_id, kw_score, kw_rank), the best `depth` chunks per query, best first. `index` is a written
    inverted index, or the tokens (chunk_id, tokens) to make one of; `stemming` must be that of the index."""
    if "tokens" in index.columns:
        index = postings.write_postings(index)
    return postings.top(postings.search(query_phrases(queries, stemming=stemming), index, depth, block), depth)


def corpus_statistics(index: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length."""
    return index.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))


def document_frequency(index: DataFrame) -> DataFrame:
    return (
        index.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )


def idf(n_docs, df):
    raw = F.ln((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


