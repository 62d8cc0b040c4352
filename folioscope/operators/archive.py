"""Archive catalogue: capture once, encrypt per record, recall, shred; and the name registry."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as r
from ..functions.text import blank

AUTHORITY_MODE = "address-derived"


def live(archives: DataFrame, namespace=None) -> DataFrame:
    d = archives.filter(~F.col("shredded"))
    return d.filter(F.col("namespace") == namespace) if namespace else d


def capture(archives: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records (record_id, payload, ...) not yet held live, one per distinct payload. Copies are reduced to
    their lowest id before the shuffle."""
    hashed = incoming.withColumn("source_hash", r.source_hash("payload"))
    first = hashed.groupBy("source_hash").agg(F.min("record_id").alias("record_id"))
    fresh = first.join(live(archives).select("source_hash").distinct(), "source_hash", "left_anti")
    return hashed.join(fresh.select("record_id"), "record_id", "left_semi")


def upsert_archives(archives: DataFrame, fresh: DataFrame) -> DataFrame:
    """Catalogue after writing `fresh`: the newest row per txid wins and is live and not yet embedded again."""
    latest = Window.partitionBy("txid").orderBy(F.desc("created"))
    new = fresh.withColumns({"shredded": F.lit(False), "embedded": F.lit(False)})
    new = new.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")
    return archives.join(new.select("txid"), "txid", "left_anti").unionByName(new.select(*archives.columns))


def new_keys(ids: DataFrame) -> DataFrame:
    """A random 256-bit key per id. Write the result before using it: a key computed twice would differ."""
    return ids.select("txid", F.unhex(F.sha2(F.concat(F.uuid(), F.uuid(), F.uuid()), 256)).alias("key"))


def encrypt(payloads: DataFrame, keys: DataFrame) -> DataFrame:
    """payloads: txid, payload. AES-GCM; each record has its own key and each write its own nonce."""
    return payloads.join(keys, "txid").select("txid", F.aes_encrypt(F.encode("payload", "UTF-8"), F.col("key"), F.lit("GCM")).alias("sealed"))


def retrieve(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """(txid, status, payload): ok, tampered, or no key."""
    d = sealed.join(keys, "txid", "left").withColumn("payload", F.decode(F.try_aes_decrypt("sealed", "key", F.lit("GCM")), "UTF-8"))
    status = F.when(F.col("key").isNull(), F.lit("no key")).when(F.col("payload").isNull(), F.lit("tampered")).otherwise(F.lit("ok"))
    return d.select("txid", status.alias("status"), "payload")


def shred(archives: DataFrame, keys: DataFrame, asked: DataFrame, hard=True):
    """(archives, keys) after destroying the keys of the asked ids; `hard` also blanks what could be read."""
    ids = asked.select("txid").distinct()
    d = archives.join(ids.withColumn("_gone", F.lit(True)), "txid", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    d = d.withColumn("shredded", F.col("shredded") | F.col("_gone"))
    if hard:
        gone = F.col("_gone")
        d = d.withColumns({
            "snapshot": F.when(gone, F.lit("")).otherwise(F.col("snapshot")),
            "tags": F.when(gone, F.lit("{}")).otherwise(F.col("tags")),
            "embedded": F.col("embedded") & ~gone,
        })
    return d.select(*archives.columns), keys.join(ids, "txid", "left_anti")


def unrecoverable(archives: DataFrame, keys: DataFrame) -> DataFrame:
    return archives.join(keys.select("txid"), "txid", "left_anti")


def listing(archives: DataFrame, namespace=None) -> DataFrame:
    d = archives.filter(F.col("namespace") == namespace) if namespace else archives
    return d.orderBy(F.desc("created"), "txid")


def live_ratio(archives: DataFrame) -> DataFrame:
    return archives.agg(F.count_if(~F.col("shredded")).alias("live"), F.round(F.count_if(~F.col("shredded")) / F.count(F.lit(1)), 6).alias("ratio"))


def recall(near: DataFrame, archives: DataFrame, k=5, namespace=None) -> DataFrame:
    """First k live archives per query out of the nearest max(3k, 15); the filter stays above the cut.
    near: query_id, chunk_id, dist, vec_rank; archives carry chunk_id."""
    d = near.filter(F.col("vec_rank") <= max(3 * k, 15)).join(live(archives, namespace), "chunk_id")
    w = Window.partitionBy("query_id").orderBy("vec_rank")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---- registry --------------------------------------------------------------

def authority(pointers: DataFrame, operator: str) -> DataFrame:
    """(name, authority_txid, target, refused): the operator's newest pointer per name. The owner address is derived
    from the key, never read. Several unmined pointers without a mined one cannot be ordered and are refused."""
    own = pointers.filter((r.owner_address("owner_key") == operator) & (blank("target") != ""))
    mined = F.col("height").isNotNull()
    g = own.groupBy("name").agg(
        F.count_if(mined).alias("mined"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(mined, F.struct("height", "txid", "target"))).alias("newest"), F.max(F.struct("txid", "target")).alias("only"),
    )
    return g.select(
        "name",
        F.when(F.col("mined") > 0, F.col("newest.txid")).otherwise(F.col("only.txid")).alias("authority_txid"),
        F.when(F.col("mined") > 0, F.col("newest.target")).otherwise(F.col("only.target")).alias("target"),
        ((F.col("mined") == 0) & (F.col("n") > 1)).alias("refused"),
    )


def name_candidates(registry: DataFrame) -> DataFrame:
    """(name, candidates, txid): how many records of the best tier claim a name (hashed payload, payload, anything)
    and the lowest of them."""
    tier = F.when(F.col("is_sidecar"), 2).when(F.lower(F.trim(blank("expected"))) != "", 0).otherwise(1)
    t = registry.withColumn("tier", tier)
    best = t.groupBy("name").agg(F.min("tier").alias("tier"))
    return t.join(best, ["name", "tier"]).groupBy("name").agg(F.count(F.lit(1)).alias("candidates"), F.min("txid").alias("txid"))


def resolve_names(asked: DataFrame, registry: DataFrame, pointers: DataFrame, operator: str) -> DataFrame:
    """(name, txid, authority_txid, status): resolved, ambiguous, unordered authority, dangling pointer, unknown,
    or not a name."""
    a = authority(pointers, operator)
    known = registry.select(F.col("txid").alias("target"), F.lit(True).alias("_known")).distinct()
    d = asked.select("name").distinct().join(name_candidates(registry), "name", "left").join(a, "name", "left").join(known, "target", "left")
    has = F.col("authority_txid").isNotNull()
    status = (
        F.when(r.name_parts("name").isNull(), F.lit("not a name"))
        .when(F.col("candidates").isNull(), F.lit("unknown"))
        .when(F.coalesce("refused", F.lit(False)), F.lit("unordered authority"))
        .when(has & F.col("_known").isNull(), F.lit("dangling pointer"))
        .when(has | (F.col("candidates") == 1), F.lit("resolved"))
        .otherwise(F.lit("ambiguous"))
    )
    d = d.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return d.select(
        "name", F.when(ok, F.coalesce("target", "txid")).alias("txid"), F.when(ok, F.col("authority_txid")).alias("authority_txid"), "status"
    )


def verified_content(records: DataFrame) -> DataFrame:
    """(txid, status, content): the bytes are released only when their hash matches the recorded one.
    records: txid, content, expected, authority_mode."""
    status = r.hash_status("expected", r.source_hash("content"), "authority_mode")
    return records.select("txid", status.alias("status"), F.when(F.startswith(status, F.lit("VERIFIED")), F.col("content")).alias("content"))
