"""From ranked hits to served records: excerpt, verdict, header, budget, notices."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import admission as adm
from ..functions import dating, grading
from ..functions import serving as sv
from ..functions.text import blank, is_abstraction, let, pin
from ..params import DEFAULTS
from .excerpt import excerpts

# The wording a reader sees.
DRAFT_NOTE = "DRAFT — your own prior output, NOT evidence"
REVIEW_NOTE = "NEEDS-REVIEW — evidence beneath this was withdrawn"
GATE_NOTICE = (
    "⚠ ambiguity-dense retrieval: %d of %d served records are near-domain WITHOUT binding this query's specifics — "
    "values in them may belong to sibling entities. Check each record's attribution header before citing a value."
)


def running(column, partition="query_id", order="rank"):
    return F.sum(column).over(Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def within_budget(hits: DataFrame, length, budget: int) -> DataFrame:
    """The leading records of each query whose lengths add up to at most `budget`; always at least one; 0 keeps all."""
    d = hits.withColumn("used", running(length))
    return d if not budget else d.filter((F.col("used") <= budget) | (F.col("rank") == 1))


def preview_budget(hits: DataFrame, p=DEFAULTS) -> DataFrame:
    return within_budget(hits, F.least(F.length(dating.strip("text")), F.lit(p.preview_chars)), p.budget_chars)


def _header():
    def has(name):
        return F.map_contains_key("boosts", name)

    verdict, when = F.col("verdict.verdict"), F.col("_dates.when")
    parts = F.concat_ws(
        " · ",
        F.concat(F.lit("src: "), "_shown_path"),
        F.concat(F.lit("chunk "), F.col("chunk_idx").cast("string")),
        F.when(F.col("doc_type").isin(*sv.SHOWN_DOC_TYPES), F.concat(F.lit("type="), "doc_type")),
        F.when(F.col("_shown_date") != "", F.concat(when["label"], F.lit(" "), "_shown_date")),
        F.when(grading.is_graded("evidence"), F.concat("evidence", F.lit(" ("), grading.grade_pair("evidence"), F.lit(")"))),
        F.nullif("_dates.marker", F.lit("")),
        F.when(has("superseded"), F.lit("SUPERSEDED")),
        F.when(has("draft"), F.lit(DRAFT_NOTE)).when(has("retracted"), F.lit("RETRACTED"))
        .when(has("needs_review"), F.lit(REVIEW_NOTE)).when(has("belief"), F.lit("belief (promoted)")),
        F.when(F.col("_dates.made"), F.lit("abstraction")),
        F.when(verdict == adm.ADMISSIBLE, F.lit("binds")).when(verdict == adm.NEAR, F.lit("near-miss")),
    )
    star = F.when(F.col("is_priority"), F.lit("★ ")).otherwise(F.lit(""))
    return F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), star, "_shown_title",
        F.format_string("  (score=%.3f)\n    ", "score"), parts,
    )


def serve(hits: DataFrame, today: str, p=DEFAULTS) -> DataFrame:
    """One row per kept record with excerpt, verdict, header, block and `used` characters. Hits carry query_id, query,
    rank, score, boosts and the document columns. Verdicts are judged on the exact excerpt served."""
    d = excerpts(hits, ["query_id", "rank"], "text", adm.terms("query"), p.serve_chunk_chars)
    d = adm.judge(d, "query", "excerpt", p.near_threshold, p.specific_threshold)
    d = d.withColumn("verdict", F.when(adm.is_question("query"), F.col("verdict")))
    where = ("text", "heading_path", "rel_path", "doc_type", "mtime", "claim_date")
    dates = let(is_abstraction("doc_type", "rel_path"), lambda made: let(dating.record_date(*where, made), lambda when: F.struct(
        when.alias("when"), dating.stale_marker(*where, today, when).alias("marker"), made.alias("made"))))
    d = pin(d, _dates=dates).withColumns({
        "_shown_date": sv.sanitize_field("_dates.when.date", 40), "_shown_path": sv.sanitize_field("rel_path", 160),
        "_shown_title": sv.sanitize_field("title", 100),
    })
    block = let(_header(), lambda head: F.struct(head.alias("header"), F.concat(head, F.lit("\n"), sv.fence_block("excerpt")).alias("block")))
    d = d.select("*", F.inline(F.array(block))).drop("_dates", "_shown_date", "_shown_path", "_shown_title")
    return within_budget(d, F.length("block"), p.budget_chars)


def notices(served: DataFrame, p=DEFAULTS) -> DataFrame:
    """Per query: kept and near-miss records, whether the ambiguity notice fires, and its text."""
    near = F.count_if(F.col("verdict.verdict") == adm.NEAR)
    kept = F.count(F.lit(1))
    g = served.groupBy("query_id").agg(kept.alias("kept"), near.alias("near"))
    fires = (F.col("near") >= p.gate_min_near) & (F.col("near") / F.col("kept") >= p.gate_density)
    return g.withColumn("gate", fires).withColumn(
        "notice", F.when(fires, F.format_string(GATE_NOTICE, "near", "kept")).otherwise(F.lit(""))
    )


def binding_table(served: DataFrame, p=DEFAULTS, per_record=3, per_query=10) -> DataFrame:
    """Possible values, only when the notice fires on a quantity or date question and only from admissible records."""
    gated = notices(served, p).filter("gate").select("query_id")
    ok = served.join(gated, "query_id", "left_semi").filter(
        (F.col("verdict.verdict") == adm.ADMISSIBLE) & F.col("verdict.kind").isin("quantity", "date")
    )
    values = adm.clean_candidates(F.col("verdict.bound"), F.col("verdict.kind"), lambda c: sv.sanitize_folded(c, 40))
    rows = ok.select("query_id", "rank", "title", F.posexplode(F.slice(values, 1, per_record)).alias("pos", "value"))
    w = Window.partitionBy("query_id").orderBy("rank", "pos")
    return rows.withColumn("row", F.row_number().over(w)).filter(F.col("row") <= per_query).select(
        "query_id", "row", "value", sv.sanitize_field("title", 60).alias("title")
    )


def provenance(hits: DataFrame, served: DataFrame, p=DEFAULTS) -> DataFrame:
    """Per query: kept of total, distinct sources, used characters, score range, and the footer line."""
    total = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    kept = served.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("kept"), F.countDistinct("rel_path").alias("sources"), F.max("used").alias("used"),
        F.min("score").alias("low"), F.max("score").alias("high"),
    )
    return total.join(kept, "query_id", "left").withColumn("footer", F.format_string(
        "injected %d/%d hits from %d source(s) · budget %d/" + str(p.budget_chars) + " chars · score %.3f–%.3f",
        "kept", "total", "sources", "used", "low", "high",
    ))


def blinding_notices(requests: DataFrame, withheld: DataFrame) -> DataFrame:
    """Per request how many records its envelope withheld and why; a request that lost everything still gets a row."""
    per = withheld.groupBy("query_id").agg(
        F.sum("n").alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason"))),
                                 lambda r: F.concat((-r["m"]).cast("string"), F.lit(" "), r["reason"])), ", ").alias("detail"),
    )
    return requests.select("query_id").join(per, "query_id", "left").select(
        "query_id", F.coalesce("total", F.lit(0)).alias("total"), blank("detail").alias("detail")
    )
