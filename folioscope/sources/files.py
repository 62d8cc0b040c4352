"""Reading note files: scan, front matter, document columns; and plain sinks."""

import json
import re

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dating
from ..functions import text as t

_FENCE = re.compile(r"^-{3,}\s*$", re.M)
_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
_PARSED = (
    "rel_path string, mtime double, body string, metadata string, metadata_ok boolean, name string, description string, "
    "doc_type string, disclosure_raw string, evidence_raw string, date_raw string, declared_supersedes array<string>"
)


def scan_files(spark: SparkSession, roots) -> DataFrame:
    """(rel_path, abs_path, text, mtime) of every .md file below each root, backups left out. A path that leaves its
    root is refused; a missing root yields nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = None
    for root in roots:
        base = hadoop.Path(root)
        fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(base):
            continue
        real = fs.resolvePath(base).toUri().getPath().rstrip("/")
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
            .withColumn("abs_path", F.regexp_replace("path", r"\A[a-z]+:/*", "/"))
            .filter(F.startswith("abs_path", F.lit(real + "/")) & ~F.contains("abs_path", F.lit("/../")))
            .filter(~t.is_backup_path("abs_path"))
            .select(
                F.substring("abs_path", F.lit(len(real) + 2), F.length("abs_path")).alias("rel_path"), "abs_path",
                F.decode("content", "UTF-8").alias("text"), F.unix_micros("modificationTime").alias("us"),
            )
            .withColumn("mtime", F.col("us") / 1e6).drop("us")
        )
        out = files if out is None else out.unionByName(files)
    return out if out is not None else spark.createDataFrame([], "rel_path string, abs_path string, text string, mtime double")


def _plain(value):
    return "" if value is None else str(value)


def _texted(value):
    """Metadata with text keys at every level, so that it can be sorted and written."""
    if isinstance(value, dict):
        return {_plain(k): _texted(v) for k, v in value.items()}
    return [_texted(v) for v in value] if isinstance(value, (list, tuple, set)) else value


def parse_one(text):
    """Body and metadata of one file; unreadable metadata keeps the whole text as the body and says so."""
    stripped = text.strip()
    if not _FENCE.match(stripped):
        return stripped, {}, True
    parts = _FENCE.split(stripped, 2)
    if len(parts) < 3:
        return stripped, {}, True
    try:
        meta = _texted(yaml.load(parts[1], Loader=_LOADER))
    except Exception:  # whatever is wrong with one file's metadata, the document stays
        return text, {}, False
    return parts[2].strip(), meta if isinstance(meta, dict) else {}, True


def _row(path, mtime, text):
    body, meta, ok = parse_one(text)
    nested = meta.get("metadata") if isinstance(meta.get("metadata"), dict) else None
    inner = nested or {}
    sup = meta.get("supersedes")
    links = re.findall(t.WIKILINK, sup) if isinstance(sup, str) else []
    declared = (links or [sup]) if isinstance(sup, str) else [str(x) for x in sup] if isinstance(sup, list) else []
    desc = meta.get("description")
    nested_date = _plain(inner.get("date"))
    return (
        path, mtime, body, json.dumps(meta, default=str, sort_keys=True), ok, _plain(meta.get("name")),
        desc if isinstance(desc, str) else "",
        _plain(inner.get("type", "")) if nested is not None else _plain(meta.get("type")),
        _plain(inner.get("disclosure")) or _plain(meta.get("disclosure")),
        _plain(inner.get("evidence")) or _plain(meta.get("evidence")),
        nested_date if re.match(r"\s*['\"]?\d{4}-\d{2}-\d{2}", nested_date) else _plain(meta.get("date")), declared,
    )


def parse_documents(files: DataFrame) -> DataFrame:
    """Document rows from (rel_path, mtime, text). No row is dropped, whatever its metadata look like."""
    names = [c.strip().split(" ")[0] for c in _PARSED.split(",")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([_row(*r) for r in zip(pdf["rel_path"], pdf["mtime"], pdf["text"])], columns=names)

    d = files.select("rel_path", F.col("mtime").cast("double").alias("mtime"), "text").mapInPandas(run, _PARSED)
    return d.select(
        "rel_path", "mtime", "body", "metadata", "metadata_ok", "doc_type", "description",
        t.title("name", "body", "rel_path").alias("title"), t.name_slug("name", "rel_path").alias("name_slug"),
        t.basename_slug("rel_path").alias("slug"), t.doc_hash("body").alias("doc_hash"),
        t.is_priority_path("rel_path").alias("is_priority"),
        t.known_or_blank("disclosure_raw", t.DISCLOSURE_CLASSES).alias("disclosure"),
        t.known_or_blank("evidence_raw", t.EVIDENCE_CLASSES).alias("evidence"),
        dating.normalize_claim_date("date_raw").alias("claim_date"),
        t.wikilinks("body").alias("wikilinks"), t.supersedes("body", "declared_supersedes").alias("supersedes"),
    )


def write_report(df: DataFrame, path: str):
    df.write.mode("errorifexists").json(path)


def write_version(df: DataFrame, path: str):
    """A new version of a table goes to a new folder; readers switch once it is complete."""
    df.write.mode("errorifexists").parquet(path)
