"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Words are runs of letters and digits of the lower-cased text, shingles are five words (an item of fewer words is one
shingle of all its words). A document contains an item if it holds at least THRESHOLD percent of the item's distinct
shingles. Items are partitioned by size (powers of two of their shingle count). An item's MinHash sketch is its k
smallest shingle hashes, where k, set per partition, is one more than the largest number of shingles that an item of the
partition may lose: a document that contains the item must hold one of the k, and a document with fewer shingles than
the item must keep is passed over. The search joins the hashes of all documents with the sketches; the pairs it finds are
verified on the shingles themselves, so a hash collision cannot make a pair.

DataFrame functions only. The benchmark side is broadcast up to a checked number of rows and shuffled beyond it.

Null, empty and wordless texts and items match nothing. A null id is an id of its own. Rows that share a doc_id are
judged one by one, and a (doc_id, item_id) pair is returned once with the largest share. Items that share an item_id are
judged one by one likewise. Other columns are not read. Empty tables give an empty result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pin
from .common import blank, stored

WIDTH = 5
THRESHOLD = 80
BROADCAST_ROWS = 500_000


def words(c):
    return F.array_remove(F.split(F.lower(blank(c)), r"[^\p{L}\p{N}]+"), "")


def window(w, i, width):
    return [w] + [F.get("words", i + k) for k in range(1, width)]


def each_window(width, combine):
    """`combine` over every run of `width` neighbours of the pinned column `words`."""
    made = F.transform("words", lambda w, i: combine(*window(w, i, width)))
    return F.slice(made, 1, F.greatest(F.size("words") - (width - 1), F.lit(0)))


def with_windows(df, text, width, combine, name):
    """`name`: the distinct windows of `text`; each intermediate array is computed once per row."""
    worded = pin(df, words=words(text)).filter(F.size("words") >= width)
    return pin(worded, **{name: F.array_distinct(each_window(width, combine))}).drop("words")


def spaced(*c):
    return F.concat_ws(" ", *c)


def small_side(df):
    """Broadcast if it has few rows, else leave the join to the optimizer."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sketches(items: DataFrame, width: int) -> DataFrame:
    """(item, hash, n, least): the k smallest shingle hashes of each item, k by size partition."""
    hashed = with_windows(items, "text", width, F.xxhash64, "hashes")
    n = F.size("hashes")
    upper = (F.pow(F.lit(2), F.length(F.bin(n))) - 1).cast("int")
    least = F.floor((upper * THRESHOLD + 99) / 100).cast("int")
    sized = hashed.withColumn("n", n).withColumn("k", upper - least + 1)
    kept = F.slice(F.sort_array("hashes"), 1, F.least("k", "n"))
    return sized.select("item", "n", F.floor((F.col("n") * THRESHOLD + 99) / 100).cast("int").alias("least"), F.explode(kept).alias("hash"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text")


def search(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Candidate pairs (doc_id, body, item)."""
    sketch = stored(sketches(items, width), "sketches")
    hashed = with_windows(keyed(docs), "text", width, F.xxhash64, "hashes").select("doc_id", "body", "hashes")
    rows = hashed.select("doc_id", "body", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    hits = rows.join(small_side(sketch), "hash").filter(F.col("size") >= F.col("least"))
    return hits.select("doc_id", "body", "item").distinct()


def verify(docs: DataFrame, items: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """Pairs among the candidates whose shingles reach the threshold: doc_id, body, item, n_shingles, n_shared."""
    found = small_side(candidates.select("doc_id", "body").distinct().withColumnsRenamed({"doc_id": "d", "body": "b"}))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b"))
    read = keyed(docs).join(found, same, "left_semi").distinct()
    left = with_windows(read, "text", width, spaced, "shingles").select("doc_id", "body", F.explode("shingles").alias("shingle"))
    own = with_windows(items, "text", width, spaced, "shingles")
    right = own.select("item", F.size("shingles").alias("n_shingles"), F.explode("shingles").alias("shingle"))
    shared = left.join(small_side(stored(right, "item-shingles")), "shingle").groupBy("doc_id", "body", "item", "n_shingles").agg(F.count("*").alias("n_shared"))
    pairs = candidates.withColumnsRenamed({"doc_id": "d", "body": "b", "item": "i"})
    asked = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")) & (F.col("item") == F.col("i"))
    enough = F.col("n_shared") * 100 >= F.col("n_shingles") * THRESHOLD
    return shared.filter(enough).join(pairs, asked, "left_semi")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, body (text hash), item_id, n_shingles, n_shared for every row that contains an item."""
    items = benchmark.select(F.struct("item_id", F.xxhash64("text").alias("body")).alias("item"), "text").distinct()
    sized = stored(items.withColumn("width", F.least(F.size(words("text")), F.lit(WIDTH))).filter("width > 0"), "items")
    widths = sorted(r["width"] for r in sized.select("width").distinct().collect())
    found = None
    for width in widths or [WIDTH]:
        some = sized.filter(F.col("width") == width).select("item", "text")
        candidates = stored(search(docs, some, width), "candidates")
        pairs = verify(docs, some, candidates, width)
        found = pairs if found is None else found.union(pairs)
    return found.select("doc_id", "body", F.col("item.item_id").alias("item_id"), "n_shingles", "n_shared")


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (doc_id, item_id): n_shingles of the item, n_shared, containment."""
    share = F.col("n_shared") / F.col("n_shingles")
    best = F.max(F.struct(share.alias("containment"), "n_shingles", "n_shared")).alias("best")
    pairs = leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(best)
    return pairs.select("doc_id", "item_id", F.col("best.n_shingles").cast("long").alias("n_shingles"), F.col("best.n_shared").alias("n_shared"), F.col("best.containment").alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, all columns, that contain no item."""
    bad = stored(leaks(docs, benchmark).select(F.col("doc_id").alias("d"), F.col("body").alias("b")).distinct(), "contaminated")
    whole = docs.select(F.struct("*").alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("doc.text") == F.col("b"))
    return whole.join(small_side(bad), same, "left_anti").select("doc.*")
