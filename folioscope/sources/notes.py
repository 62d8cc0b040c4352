"""Note corpus derived from the order tables: one note per order, with links, supersessions and beliefs.

Every view grows with the tables it reads. `TODAY` is the day after the last order date.
"""

from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.catalog import table

TODAY = "2001-08-02"
NOW = 996710400.0  # 2001-08-02T00:00:00Z
ROOT = "/corpus/"


def _s(c):
    return c.cast("string")


def _line(cond, *parts):
    return F.when(cond, F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]))


def orders_with_count(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("urgency"),
    )
    total = table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    return o.withColumn("n", total)


def note_rows(spark, sf_dir):
    """What the notes are written from, and their paths: one narrow row per order."""
    seg = F.col("c_mktsegment")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), seg.alias("seg"), F.lower(seg).alias("low_seg"))
    o = orders_with_count(spark, sf_dir).join(c, "custkey")
    k, iso = F.col("k"), _s(F.col("day"))
    folder = (
        F.when(F.col("urgency") == "1-URGENT", F.concat(F.lit("000-PRIORITY-"), F.col("seg")))
        .when(F.col("urgency") == "5-LOW", F.lit("_archive"))
        .otherwise(F.col("low_seg"))
    )
    file = (
        F.when(k % 11 == 0, F.concat(F.lit("order-"), _s(k), F.lit("/LAIR.md")))
        .when(k % 13 == 0, F.concat(F.lit("abstraction-order-"), _s(k), F.lit(".md")))
        .when(k % 7 == 0, F.concat(F.lit("order-"), _s(k), F.lit("-"), iso, F.lit(".md")))
        .otherwise(F.concat(F.lit("order-"), _s(k), F.lit(".md")))
    )
    return o.withColumn("rel_path", F.concat(folder, F.lit("/"), file))


def notes(spark, sf_dir):
    return as_notes(note_rows(spark, sf_dir))


def as_notes(rows, *more):
    """The notes of rows from `note_rows`, and further columns of theirs."""
    k, day, n = F.col("k"), F.col("day"), F.col("n")
    iso = _s(day)
    kinds = F.array(*[F.lit(x) for x in ("feedback", "project", "reference", "user", "", "belief")])
    doc_type = F.when((k % 13 == 0) & (k % 2 == 0), F.lit("abstraction")).otherwise(
        F.element_at(kinds, (k % 6 + 1).cast("int"))
    )
    classes = F.array(*[F.lit(x) for x in ("artifact", "proposal", "private", "public", "")])
    grades = F.array(*[F.lit(x) for x in ("observed", "sourced", "synthesized", "guess")])
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# Order "), _s(k)),
        _line(k % 4 == 0, "**Last Updated**: ", iso),
        F.when(F.col("status") == "O", F.lit("**Status**: ⏳ **PENDING** payment"))
        .when(F.col("status") == "P", F.lit("| shipment | ⚠️ **IN PROGRESS** |"))
        .otherwise(F.lit("All lines delivered.")),
        _line(k % 9 == 0, "Counted as of ", _s(F.date_add(day, 10)), ", before that as of ", iso, "."),
        _line(k % 10 == 0, "verify_by: ", _s(F.date_add(day, 365))),
        _line(k % 12 == 0, "volatile: false"),
        F.concat(F.lit("The order-"), _s(k), F.lit(" invoice recorded "), F.format_string("%.2f", "price"), F.lit(" units.")),
        _line(k > 0, "Follows [[order-", _s(k - 1), "]]."),
        F.concat(F.lit("See [[../../x/order-"), _s((k * 7) % n), F.lit("/LAIR]] and [[order-"), _s(k % 50), F.lit("|hub]].")),
        _line((k % 8 == 0) & (k >= 8), "**Supersedes:** [[order-", _s(k - 8), "]]"),
        _line(k % 8 == 4, "**Supersedes**: nothing · **Superseded by**: [[order-", _s(k + 4), "]]"),
    )
    return rows.select(
        k, n, "custkey", "status", "price", day,
        "rel_path",
        F.concat(F.lit(ROOT), "rel_path").alias("abs_path"),
        doc_type.alias("doc_type"),
        F.element_at(classes, (k % 5 + 1).cast("int")).alias("disclosure_raw"),
        F.element_at(grades, (k % 4 + 1).cast("int")).alias("evidence_raw"),
        F.when(k % 3 == 0, iso).otherwise(F.lit("")).alias("claim_date"),
        ((F.datediff(day, F.lit("1970-01-01").cast("date")) + 30) * F.lit(86400.0)).alias("mtime"),
        body.alias("body"), *more,
    )


def docs(spark, sf_dir):
    """The notes as parsed documents."""
    return as_docs(notes(spark, sf_dir))


def as_docs(notes_df, *more):
    return notes_df.select(
        "k", "rel_path", "abs_path", "body", "mtime", "doc_type", "claim_date",
        t.title(F.lit(""), "body", "rel_path").alias("title"),
        t.doc_hash("body").alias("doc_hash"),
        t.is_priority_path("rel_path").alias("is_priority"),
        t.known_or_blank("disclosure_raw", t.DISCLOSURE_CLASSES).alias("disclosure"),
        t.known_or_blank("evidence_raw", t.EVIDENCE_CLASSES).alias("evidence"),
        t.basename_slug("rel_path").alias("slug"),
        metadata_json().alias("metadata"), *more,
    )


def metadata_json():
    return F.to_json(
        F.struct(
            F.col("claim_date").alias("date"), F.col("disclosure_raw").alias("disclosure"),
            F.col("evidence_raw").alias("evidence"), F.col("doc_type").alias("type"),
        )
    )


def raw_files(spark, sf_dir):
    """Whole file text, with the metadata block in front of the body."""
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("type: '"), F.col("doc_type"), F.lit("'")),
        F.when(F.col("claim_date") != "", F.concat(F.lit("date: "), F.col("claim_date"))),
        F.concat(F.lit("metadata: {disclosure: '"), F.col("disclosure_raw"), F.lit("', evidence: "), F.col("evidence_raw"),
                 F.lit(", type: '"), F.col("doc_type"), F.lit("'}")),
        F.lit("---"),
    )
    return notes(spark, sf_dir).select("k", "rel_path", "mtime", F.concat_ws("\n", head, F.lit(""), F.col("body")).alias("text"))


def links(docs_df):
    return docs_df.select(F.col("rel_path").alias("src_path"), F.explode(t.wikilinks("body")).alias("tgt_raw")).withColumn(
        "tgt_slug", t.canonical_slug("tgt_raw")
    )


def supersessions(docs_df):
    return docs_df.select(F.col("rel_path").alias("src_path"), F.explode(t.supersedes("body")).alias("tgt_raw")).withColumn(
        "tgt_slug", t.canonical_slug("tgt_raw")
    )


def beliefs(spark, sf_dir):
    k, day = F.col("k"), F.col("day")
    states = F.array(*[F.lit(x) for x in ("draft", "promoted", "promoted", "retracted", "needs_review")])
    return notes(spark, sf_dir).filter("doc_type = 'belief'").select(
        t.basename_slug("rel_path").alias("belief_id"),
        "rel_path",
        F.concat(F.lit("p"), _s(k % 4)).alias("persona"),
        F.element_at(states, (F.floor(k / 6) % 5 + 1).cast("int")).alias("state"),
        F.concat(F.lit("s"), _s(F.col("custkey"))).alias("subject"),
        F.concat(F.lit("The order-"), _s(k), F.lit(" invoice recorded "), F.format_string("%.2f", "price"), F.lit(" units.")).alias("claim"),
        F.when(k % 7 == 1, F.lit("high")).otherwise(F.lit("medium")).alias("confidence"),
        F.when(k % 17 == 0, F.lit("action")).otherwise(F.lit("analysis")).alias("impact"),
        _s(day).alias("created"),
        F.lit("").alias("promoted_at"),
        _s(F.date_add(day, (F.lit(365) * (k % 9)).cast("int"))).alias("verify_by"),
        F.when(k % 2 == 1, F.concat(F.lit("p"), _s((k + 1) % 4))).otherwise(F.lit("")).alias("countersigned_by"),
        "k",
    )


def belief_evidence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_suppkey", "l_partkey", "l_quantity"
    )
    b = beliefs(spark, sf_dir).select("k", "belief_id")
    total = table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    external = F.col("l_suppkey") % 5 == 0
    ref = (
        F.when(external, F.concat(F.lit("https://ex.test/"), _s(F.col("l_suppkey"))))
        .when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("order-"), _s(F.greatest(F.col("k") - 12, F.lit(0)))))
        .otherwise(F.concat(F.lit("order-"), _s((F.col("l_partkey") * 5 + 1) % F.col("n"))))
    )
    return (
        b.join(li, "k").withColumn("n", total)
        .select(
            "belief_id", ref.alias("ref"),
            F.when(external, F.lit("external")).otherwise(F.lit("link")).alias("kind"),
            F.when(external, F.col("l_quantity") > 25).otherwise(F.lit(True)).alias("verified"),
        )
        .groupBy("belief_id", "ref").agg(F.max("kind").alias("kind"), F.max("verified").alias("verified"))
        .withColumn("slug", F.when(F.col("kind") == "link", t.link_slug("ref")).otherwise(F.lit("")))
    )
