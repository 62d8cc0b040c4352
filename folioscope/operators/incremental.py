"""Keeping the derived tables in step with their sources.

Every function takes tables and returns the next version; callers write it to a new folder. Running a step twice
gives the same table.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename_slug, is_backup_path
from ..params import DEFAULTS

METADATA_COLUMNS = ("title", "doc_type", "disclosure", "evidence", "claim_date", "is_priority", "metadata")
CHANGED, METADATA, UNINDEXED, ORPHANED, UNREACHABLE, UNCHECKED, CURRENT = (
    "CHANGED", "METADATA", "UNINDEXED", "ORPHANED", "UNREACHABLE", "UNCHECKED", "CURRENT"
)


def upsert(stored: DataFrame, fresh: DataFrame, key) -> DataFrame:
    """Stored rows with every fresh key overwritten."""
    key = [key] if isinstance(key, str) else key
    return stored.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def metadata_differs(old: str, new: str):
    """Whether any front-matter column differs between two aliased rows."""
    out = F.lit(False)
    for c in METADATA_COLUMNS:
        out = out | ~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    return out


def classify_changes(stored: DataFrame, fresh: DataFrame, rechunk=False) -> DataFrame:
    """Fresh documents with `change`: new, updated, meta, unchanged. With `rechunk` nothing counts as unchanged."""
    o, n = stored.alias("o"), fresh.alias("n")
    same = (F.col("o.doc_hash") == F.col("n.doc_hash")) & ~F.lit(rechunk)
    return n.join(o, F.col("n.rel_path") == F.col("o.rel_path"), "left").select(
        "n.*",
        F.when(F.col("o.rel_path").isNull(), F.lit("new")).when(~same, F.lit("updated"))
        .when(metadata_differs("o", "n"), F.lit("meta")).otherwise(F.lit("unchanged")).alias("change"),
    )


def import_counters(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def delete_doc_chunks(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("rel_path"), "rel_path", "left_anti")


def replace_edges(stored: DataFrame, docs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges of the given documents rebuilt, repeats of one (source, target) ignored."""
    kept = stored.join(docs.select(F.col("rel_path").alias("src_path")), "src_path", "left_anti")
    return kept.unionByName(fresh.dropDuplicates(["src_path", "tgt_raw"]))


def prunable(docs: DataFrame, present: DataFrame) -> DataFrame:
    """Documents whose file is gone or has become excluded. `present` holds abs_path of existing files."""
    gone = docs.join(present.select("abs_path").distinct(), "abs_path", "left_anti")
    excluded = docs.join(present.select("abs_path").distinct(), "abs_path", "left_semi").filter(is_backup_path("abs_path"))
    return gone.select("rel_path").unionByName(excluded.select("rel_path"))


def prune_missing(docs: DataFrame, present: DataFrame, missing_roots=(), max_fraction=DEFAULTS.prune_max_fraction, force=False) -> DataFrame:
    """rel_path of the documents to drop. Nothing when a source root is missing; refuses to drop too large a share."""
    gone = prunable(docs, present)
    if missing_roots:
        return gone.filter(F.lit(False))
    if not force:
        n_gone, n_all = gone.count(), docs.count()
        if n_all and n_gone / n_all > max_fraction:
            raise RuntimeError(f"prune would remove {n_gone}/{n_all} documents, more than {max_fraction:.0%}")
    return gone


# ---- beliefs ---------------------------------------------------------------

def replace_beliefs(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert by belief_id; a renamed belief first gives up the path it held."""
    kept = stored.join(fresh.select("belief_id"), "belief_id", "left_anti")
    kept = kept.join(fresh.select("rel_path"), "rel_path", "left_anti")
    latest = Window.partitionBy("belief_id").orderBy(F.desc("rel_path"))
    one = fresh.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")
    return kept.select(*stored.columns).unionByName(one.select(*stored.columns))


def replace_evidence(stored: DataFrame, beliefs: DataFrame, fresh: DataFrame) -> DataFrame:
    kept = stored.join(beliefs.select("belief_id"), "belief_id", "left_anti")
    return kept.unionByName(fresh.dropDuplicates(["belief_id", "ref"]).select(*stored.columns))


def project_beliefs(stored: DataFrame, docs: DataFrame, fresh: DataFrame) -> DataFrame:
    """Belief table after importing `docs` (rel_path, metadata_ok). A document that stopped being a belief loses its
    row; one whose metadata cannot be read keeps its last known state."""
    readable = docs.filter("metadata_ok").select("rel_path")
    kept = stored.join(readable, "rel_path", "left_anti").select(*stored.columns)
    readable_fresh = fresh.join(readable, "rel_path", "left_semi").select(*stored.columns)
    return replace_beliefs(kept, readable_fresh)


# ---- index currency --------------------------------------------------------

def survey(stored: DataFrame, offered: DataFrame, existing: DataFrame, missing_roots=()) -> DataFrame:
    """(rel_path, state) for every stored or offered document. `offered` is what the configured sources yield now,
    `existing` lists abs_path of files still on disk."""
    o = stored.select("rel_path", "abs_path", "doc_hash", *METADATA_COLUMNS).alias("o")
    n = offered.select("rel_path", "doc_hash", *METADATA_COLUMNS).alias("n")
    on_disk = existing.select("abs_path").distinct().withColumn("_exists", F.lit(True)).alias("e")
    unmounted = F.lit(False)
    for root in missing_roots:
        unmounted = unmounted | F.startswith(F.col("o.abs_path"), F.lit(root.rstrip("/") + "/"))
    j = o.join(n, F.col("o.rel_path") == F.col("n.rel_path"), "full_outer").join(
        on_disk, F.col("o.abs_path") == F.col("e.abs_path"), "left"
    )
    not_offered = F.col("n.rel_path").isNull()
    return j.select(
        F.coalesce("o.rel_path", "n.rel_path").alias("rel_path"),
        F.when(F.col("o.rel_path").isNull(), F.lit(UNINDEXED))
        .when(not_offered & unmounted, F.lit(UNCHECKED))
        .when(not_offered & (F.col("e._exists").isNull() | is_backup_path("o.abs_path")), F.lit(ORPHANED))
        .when(not_offered, F.lit(UNREACHABLE))
        .when(F.col("o.doc_hash") != F.col("n.doc_hash"), F.lit(CHANGED))
        .when(metadata_differs("o", "n"), F.lit(METADATA))
        .otherwise(F.lit(CURRENT)).alias("state"),
    )


def survey_summary(currency: DataFrame, roots_missing=0) -> DataFrame:
    """One row: counts by state, divergent total, and whether everything was checked and nothing diverged."""
    def n(state):
        return F.count_if(F.col("state") == state)

    divergent = n(CHANGED) + n(METADATA) + n(UNINDEXED) + n(ORPHANED)
    return currency.agg(
        *[n(s).alias(s.lower()) for s in (CHANGED, METADATA, UNINDEXED, ORPHANED, UNREACHABLE, UNCHECKED, CURRENT)],
        divergent.alias("divergent"),
        ((divergent == 0) & (n(UNCHECKED) == 0) & F.lit(roots_missing == 0)).alias("is_current"),
    )


def uncovered_roots(configured, imported):
    """Configured roots an import did not visit; the chunker fingerprint is stamped only when there are none."""
    return F.array_except(configured, imported)


def chunker_fingerprint(version, tokens, overlap, contextual, counter="words"):
    """Identity of the code and settings that cut an index; compared exactly."""
    return F.concat_ws(":", version, tokens, overlap, contextual.cast("int"), F.lit(counter))


def chunker_drift(live, stored):
    return (
        F.when(stored.isNull(), F.lit("unset")).when(stored == live, F.lit("match"))
        .otherwise(F.concat(stored, F.lit(" != "), live))
    )


def corpus_stats(docs, chunks, vectors, links, archives) -> DataFrame:
    """One row. `embedded` counts chunks that really have a vector; `embedded_flagged` believes the flag."""
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if("embedded").alias("embedded_flagged"))
    covered = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_semi").agg(F.count(F.lit(1)).alias("embedded"))
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if("is_priority").alias("priority_docs")).select(
        "docs", "priority_docs",
        c.select("chunks").scalar().alias("chunks"), c.select("embedded_flagged").scalar().alias("embedded_flagged"),
        covered.scalar().alias("embedded"), links.agg(F.count(F.lit(1))).scalar().alias("links"),
        archives.agg(F.count_if(~F.col("shredded"))).scalar().alias("archives"),
    ).withColumn("coverage_pct", F.round(F.col("embedded") * 100.0 / F.greatest("chunks", F.lit(1)), 6))


def resolution_rate(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of link targets that name a document."""
    slugs = docs.select(basename_slug("rel_path").alias("tgt_slug")).distinct().withColumn("hit", F.lit(1))
    return links.join(slugs, "tgt_slug", "left").agg(
        F.count(F.lit(1)).alias("links"), F.count("hit").alias("resolved"),
        F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("rate"),
    )
