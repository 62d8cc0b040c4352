"""Fusion of ranked lists, ranking signals, visibility and final assembly."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import disclosure as dis
from ..functions.text import basename_slug, blank, is_abstraction
from ..functions.admission import is_temporal
from ..params import DEFAULTS


def _tie_order():
    return [F.asc_nulls_last("vec_rank"), F.asc_nulls_last("kw_rank")]


def boosts(*pairs):
    """MAP of the named factors that apply: (name, condition, value)."""
    entries = [
        F.when(cond, F.struct((F.lit(name) if isinstance(name, str) else name).alias("key"), value.cast("double").alias("value")))
        for name, cond, value in pairs
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def fuse(vec: DataFrame, kw: DataFrame, rrf_k=DEFAULTS.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, vec_rank) and (query_id, chunk_id, kw_rank)."""
    both = vec.select("query_id", "chunk_id", "vec_rank").join(
        kw.select("query_id", "chunk_id", "kw_rank"), ["query_id", "chunk_id"], "full_outer"
    )

    def part(rank):
        return F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(rank)), F.lit(0.0))

    return both.withColumns({"vector_score": part("vec_rank"), "keyword_score": part("kw_rank")}).withColumn(
        "score", F.col("vector_score") + F.col("keyword_score")
    )


def apply_priority(hits: DataFrame, p=DEFAULTS) -> DataFrame:
    up = F.col("is_priority")
    return hits.withColumns({
        "score": F.when(up, F.col("score") * p.priority_boost).otherwise(F.col("score")),
        "boosts": F.map_concat("boosts", boosts(("priority", up, F.lit(p.priority_boost)))),
    })


def belief_visibility(hits: DataFrame, states: DataFrame, rank=True, penalty=DEFAULTS.supersede_penalty) -> DataFrame:
    """Drops drafts of other personas, buries withdrawn records, marks the rest. Needs `persona` on each hit."""
    d = hits.join(states.select("rel_path", F.col("persona").alias("_author"), F.col("state").alias("belief_state")), "rel_path", "left")
    state = F.coalesce("belief_state", F.lit(""))
    own = (F.coalesce("persona", F.lit("")) != "") & (F.col("_author") == F.col("persona"))
    factor = F.lit(penalty if rank else 1.0)
    d = d.filter((state != "draft") | own)
    return d.withColumns({
        "score": F.when(state == "retracted", F.col("score") * factor).otherwise(F.col("score")),
        "boosts": F.map_concat("boosts", boosts(
            ("draft", state == "draft", F.lit(1.0)), ("retracted", state == "retracted", factor),
            ("needs_review", state == "needs_review", F.lit(1.0)), ("belief", state == "promoted", F.lit(1.0)),
        )),
    }).drop("_author")


def withheld_reason(env):
    """'' when the record passes its request's envelope, else why it does not."""
    slug = basename_slug("rel_path")
    cls = dis.disclosure_class("disclosure", "belief_state", env["default_class"], "doc_type", "rel_path")
    sealed = F.coalesce(F.array_contains(env["sealed"], slug), F.lit(False))
    return (
        F.when(~dis.permitted("rel_path", "doc_type", "is_priority", env), F.lit("out-of-scope"))
        .when(env["mode"] == "full", F.lit(""))
        .when(env["mode"] == "adversarial", F.when(sealed, F.lit("")).otherwise(F.lit("not sealed")))
        .when(dis.admits(env["mode"], cls), F.lit(""))
        .otherwise(F.when(cls == "", F.lit("unclassified")).otherwise(cls))
    )


def disclose(hits: DataFrame):
    """(kept, withheld). Needs `envelope`, `disclosure` and `belief_state` on each hit."""
    env = F.col("envelope")
    judged = hits.withColumn("_reason", F.when(env.isNull(), F.lit("")).otherwise(withheld_reason(env)))
    cls = dis.disclosure_class("disclosure", "belief_state", env["default_class"], "doc_type", "rel_path")
    marked = judged.filter("_reason = ''").withColumn("boosts", F.map_concat("boosts", boosts(
        ("sealed", F.coalesce(env["mode"] == "adversarial", F.lit(False)), F.lit(1.0)),
        (F.concat(F.lit("disclosed:"), F.when(cls == "", F.lit("unclassified")).otherwise(cls)),
         F.coalesce(env["mode"].isin("independent", "collaborative"), F.lit(False)), F.lit(1.0)),
    )))
    withheld = judged.filter("_reason <> ''").groupBy("query_id", F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return marked.drop("_reason"), withheld


def inbound_links(links: DataFrame) -> DataFrame:
    """Edges per canonical target; two spellings from one source count twice, self-links count."""
    return links.filter("tgt_slug <> ''").groupBy(F.col("tgt_slug").alias("slug")).agg(F.count(F.lit(1)).alias("inbound"))


def link_lift(hits: DataFrame, counts: DataFrame, p=DEFAULTS) -> DataFrame:
    d = hits.join(counts, "slug", "left")
    linked = F.coalesce(F.col("inbound") > 0, F.lit(False))
    lift = F.lit(1.0) + F.lit(p.link_step) * F.least("inbound", F.lit(p.link_cap))
    return d.withColumns({
        "score": F.when(linked, F.col("score") * lift).otherwise(F.col("score")),
        "boosts": F.map_concat("boosts", boosts(("wikilink_inbound", linked, lift))),
    }).drop("inbound")


def superseded_slugs(supersessions: DataFrame) -> DataFrame:
    return supersessions.filter("tgt_slug <> ''").select(F.col("tgt_slug").alias("slug")).distinct()


def bury_superseded(hits: DataFrame, slugs: DataFrame, factor=DEFAULTS.supersede_penalty) -> DataFrame:
    """factor=1.0 marks without re-scoring."""
    d = hits.join(slugs.withColumn("_gone", F.lit(True)), "slug", "left")
    gone = F.coalesce("_gone", F.lit(False))
    return d.withColumns({
        "score": F.when(gone, F.col("score") * F.lit(factor)).otherwise(F.col("score")),
        "boosts": F.map_concat("boosts", boosts(("superseded", gone, F.lit(factor)))),
    }).drop("_gone")


def recency_factor(mtime, now, p=DEFAULTS):
    known = F.when(F.coalesce(mtime, F.lit(0.0)) == 0, F.lit(now)).otherwise(mtime)
    age = F.greatest(F.lit(now) - known, F.lit(0.0))
    fresh = F.pow(F.lit(0.5), age / F.lit(p.recency_half_life_days * 86400.0))
    return F.lit(1.0) + F.lit(p.recency_amplitude) * (fresh - F.lit(0.5))


def apply_recency(hits: DataFrame, now: float, p=DEFAULTS) -> DataFrame:
    use = F.col("recency") & ~F.col("is_priority") & ~is_abstraction("doc_type", "rel_path")
    factor = recency_factor(F.col("mtime"), now, p)
    return hits.withColumns({
        "score": F.when(use, F.col("score") * factor).otherwise(F.col("score")),
        "boosts": F.map_concat("boosts", boosts(("recency", use, F.round(factor, 3)))),
    })


def order_hits(hits: DataFrame) -> DataFrame:
    """Adds `pos`: best score first, ties in vector then keyword order."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), *_tie_order())
    return hits.withColumn("pos", F.row_number().over(w))


def rerank(hits: DataFrame, scorer, top_n=DEFAULTS.rerank_head, priority_boost=DEFAULTS.priority_boost) -> DataFrame:
    """Re-scores the first `top_n` by a pair scorer (query, text) -> Series; the tail keeps its order."""
    head = F.col("pos") <= top_n

    @F.pandas_udf("double")
    def head_only(query: pd.Series, text: pd.Series) -> pd.Series:
        asked = query.notna()
        out = pd.Series(float("nan"), index=query.index)
        if asked.any():
            out[asked] = scorer(query[asked], text[asked]).to_numpy()
        return out

    raw = head_only(F.when(head, blank("query")), F.when(head, blank("text")))  # rows below the head send nothing
    rel = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_raw")))
    boosted = F.when(F.col("is_priority"), rel * priority_boost).otherwise(rel)
    d = hits.withColumn("_raw", raw).withColumns({
        "score": F.when(head, boosted).otherwise(F.col("score")),
        "boosts": F.map_concat("boosts", boosts(("rerank", head, F.round("_raw", 3)))),
    })
    w = Window.partitionBy("query_id").orderBy(F.col("pos") > top_n, F.when(head, -F.round("score", 12)), "pos")
    return d.withColumn("_new", F.row_number().over(w)).drop("pos", "_raw").withColumnRenamed("_new", "pos")


def term_overlap(query, text):
    """Built-in pair scorer: shared terms minus one."""
    def one(q, t):
        return float(len(set(q.lower().split()) & set(t.lower().split())) - 1)

    return pd.Series([one(q, t) for q, t in zip(query, text)])


def assemble(hits: DataFrame, p=DEFAULTS, evidence_tiebreak=False) -> DataFrame:
    """Temporal queries put syntheses below sources; at most `abstraction_topk_cap` syntheses; then the first k."""
    made = is_abstraction("doc_type", "rel_path")
    guard = F.lit(p.abstraction_recency_guard) & (F.col("recency") | is_temporal("query"))
    d = hits.withColumns({"_made": made, "_below": guard & made})
    d = d.withColumn("boosts", F.map_concat("boosts", boosts(("recency_guard", F.col("_below"), F.lit(0.0)))))
    order = [F.col("_below").asc()]
    if evidence_tiebreak:
        from ..functions.grading import credibility

        order += [F.desc(F.round("score", 6)), credibility("evidence").asc()]
    w = Window.partitionBy("query_id").orderBy(*order, "pos")
    if p.abstraction_topk_cap >= 0:
        seen = F.sum(F.col("_made").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        d = d.withColumn("_seen", seen).filter(~F.col("_made") | (F.col("_seen") <= p.abstraction_topk_cap)).drop("_seen")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("k")).drop("_made", "_below", "pos")
