"""Hybrid and keyword-only retrieval for a table of requests."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import disclosure as dis
from ..functions.text import basename_slug
from ..operators import rank as R
from ..operators.bounded import restrict
from ..operators.rules import suggest, worth_saving
from ..operators.postings import write_postings
from ..operators.textindex import bm25_topn, tokenise
from ..operators.vectors import knn_topn
from ..params import DEFAULTS, REQUEST_BLOCK
from ..session import cut

REQUEST_DEFAULTS = {
    "k": 10, "doc_type": None, "priority_only": False, "recency": False, "persona": "",
}
DOC_COLUMNS = ["rel_path", "title", "doc_type", "is_priority", "mtime", "evidence", "claim_date", "disclosure"]


@dataclass
class Corpus:
    """The tables a search reads."""

    chunks: DataFrame  # chunk_id, rel_path, chunk_idx, text, heading_path
    vectors: DataFrame  # chunk_id, embedding
    docs: DataFrame
    links: DataFrame
    supersessions: DataFrame
    beliefs: DataFrame  # rel_path, persona, state
    index: DataFrame = None  # a written inverted index; built from the chunks when absent
    stemming: bool = False  # Porter stems on both sides of keyword search

    def postings(self):
        """The inverted index; written once per search unless the corpus brings one."""
        return self.index if self.index is not None else write_postings(tokenise(self.chunks, stemming=self.stemming))


def complete(requests: DataFrame) -> DataFrame:
    """Fill in the request columns a caller left out."""
    for name, value in REQUEST_DEFAULTS.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(value).cast("string") if value is None else F.lit(value))
    if "envelope" not in requests.columns:
        bare = requests.withColumns({c: F.lit(None).cast("string") for c in ("ceiling_mode", "ceiling_seal", "requested_mode", "requested_seal", "default_class")})
        bare = bare.withColumns({"allowed_doc_types": F.array().cast("array<string>"), "allowed_path_prefixes": F.array().cast("array<string>"), "force_priority_only": F.lit(False)})
        requests = dis.resolve_envelope(bare).select(*requests.columns, "envelope")
    return requests


def refuse_out_of_scope(requests: DataFrame):
    """(requests that may run, withheld rows of the refused ones). A refused request counts exactly one."""
    doc_type_ok = F.when(F.col("envelope").isNull(), F.lit(True)).otherwise(dis.in_scope("doc_type", F.col("envelope")))
    refused = requests.filter(~doc_type_ok).select("query_id", F.lit("out-of-scope").alias("reason"), F.lit(1).cast("long").alias("n"))
    return requests.filter(doc_type_ok), refused


def _depth(requests, p):
    ks = requests.select(F.max("k")).collect()[0][0]
    return p.over_fetch(ks or 1)


def _attach(cand, corpus, requests):
    """Chunk and document columns for the candidates, without the texts."""
    d = corpus.chunks.drop("text").join(cand, "chunk_id")
    asked = requests.drop("embedding").withColumnRenamed("doc_type", "asked_type")
    return corpus.docs.select(*DOC_COLUMNS).join(d, "rel_path").join(asked, "query_id").withColumns({
        "slug": basename_slug("rel_path"), "boosts": F.create_map().cast("map<string,double>"),
    })


def _with_text(hits, corpus):
    """Texts of the hits that are left; they are never part of a candidate join."""
    return hits.join(corpus.chunks.select("chunk_id", "text"), "chunk_id")


def _reranked(hits, corpus, scorer, p):
    head = _with_text(hits.filter(F.col("pos") <= p.rerank_head).select("query_id", "chunk_id"), corpus)
    scored = R.rerank(hits.join(head, ["query_id", "chunk_id"], "left"), scorer, p.rerank_head, p.priority_boost)
    return scored.drop("text")


def hybrid_search(requests: DataFrame, corpus: Corpus, now: float, p=DEFAULTS, scorer=None, block=REQUEST_BLOCK):
    """(hits, withheld). Requests: query_id, query, embedding, and optionally k, doc_type, priority_only, recency,
    persona, envelope. The order of the steps is the meaning: candidates are cut before anything filters them."""
    requests, refused = refuse_out_of_scope(cut(complete(requests)))
    deepest = _depth(requests, p)
    vec = knn_topn(requests, corpus.vectors, deepest, block)
    kw = bm25_topn(requests, corpus.postings(), deepest, block, corpus.stemming)
    per_query = requests.select("query_id", F.greatest(F.col("k") * 4, F.lit(40)).alias("n"))
    if p.abstraction_topk_cap >= 0:
        per_query = per_query.withColumn("n", F.col("n") * 2)
    vec = vec.join(per_query, "query_id").filter("vec_rank <= n")
    kw = kw.join(per_query, "query_id").filter("kw_rank <= n")
    cand = _attach(R.fuse(vec, kw, p.rrf_k), corpus, requests)
    cand = cut(cand.filter(
        (F.col("asked_type").isNull() | (F.col("asked_type") == F.col("doc_type")))
        & (~F.col("priority_only") | F.col("is_priority"))
    ))
    hits = R.apply_priority(cand, p)
    hits = R.belief_visibility(hits, restrict(corpus.beliefs, cand, "rel_path"), True, p.supersede_penalty)
    hits, withheld = R.disclose(hits)
    slugs = cand.select("slug")
    counts = R.inbound_links(restrict(corpus.links.withColumn("slug", F.col("tgt_slug")), slugs, "slug"))
    hits = R.link_lift(hits, counts, p)
    if p.supersede_aware:
        gone = restrict(R.superseded_slugs(corpus.supersessions), slugs, "slug")
        hits = R.bury_superseded(hits, gone, p.supersede_penalty)
    hits = R.order_hits(R.apply_recency(hits, now, p))
    if scorer is not None:
        hits = _reranked(hits, corpus, scorer, p)
    return _with_text(R.assemble(hits, p), corpus), withheld.unionByName(refused)


def keyword_search(requests: DataFrame, corpus: Corpus, p=DEFAULTS, block=REQUEST_BLOCK):
    """(hits, withheld) by keyword relevance alone: the same visibility rules, marks instead of penalties."""
    has_envelope = "envelope" in requests.columns
    requests = cut(complete(requests))
    deeper = has_envelope or not corpus.beliefs.isEmpty()
    k = requests.select(F.max("k")).collect()[0][0] or 1
    times = 4 if deeper else 1
    kw = bm25_topn(requests, corpus.postings(), k * times, block, corpus.stemming)
    cand = _attach(
        kw.withColumns({"vec_rank": F.lit(None).cast("int"), "score": F.col("kw_score"), "keyword_score": F.col("kw_score")}),
        corpus, requests,
    )
    cand = cut(cand.filter(F.col("kw_rank") <= F.col("k") * times))
    slugs = cand.select("slug")
    hits = R.bury_superseded(cand, restrict(R.superseded_slugs(corpus.supersessions), slugs, "slug"), 1.0)
    hits = R.belief_visibility(hits, restrict(corpus.beliefs, cand, "rel_path"), rank=False)
    hits, withheld = R.disclose(hits)
    hits = R.order_hits(hits).withColumnRenamed("pos", "rank")
    return _with_text(hits.filter(F.col("rank") <= F.col("k")), corpus), withheld


def suggest_by_search(texts: DataFrame, corpus: Corpus, k=3, p=DEFAULTS):
    """create or amend, per text worth saving (query_id, text): the notes are those that keyword search finds for it."""
    texts = cut(worth_saving(texts))  # nothing is searched for the others
    asked = texts.select("query_id", F.col("text").alias("query"), F.lit(k).alias("k"))
    hits, _ = keyword_search(asked, corpus, p)
    return suggest(texts, hits.select("query_id", "rank", "rel_path", "title"))


def unknown_personas(requests: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Requests whose persona has written no belief although others have; matching is exact."""
    known = beliefs.filter("persona <> ''").select("persona").distinct()
    named = requests.filter("coalesce(persona, '') <> ''").select("query_id", "persona")
    any_known = known.select(F.count(F.lit(1)) > 0).scalar()
    return named.join(known, "persona", "left_anti").filter(any_known)
