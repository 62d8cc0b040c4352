"""A table as delta folders, one per batch, merged when it is read.

Rows belong to an owner (the key). A batch writes the new rows of every owner it touches and a marker row per owner; an
owner's rows are those of the newest batch that touched it, so an owner with only a marker has none. A batch writes what it
changes and nothing else, and writing it again overwrites its own folder. Folders are partitioned by a hash of the key, so a
look-up reads only the buckets of the keys it asks for. Compaction writes the merged rows beside the deltas; readers then
start from there.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class DeltaTable:
    def __init__(self, spark: SparkSession, folder: str, schema, key: str, buckets=BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.names
        self.kept = StructType(self.schema.fields[:]).add("gone", "boolean").add("batch", "long").add("bucket", "integer")

    def batches(self, kind):
        """Numbers of the finished folders of a kind, in one listing."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found or [])

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def history(self, before=None) -> DataFrame:
        """All rows and markers that a reader of batch `before` has to merge, with `batch` and `bucket`."""
        limit = 1 << 62 if before is None else before
        base = [b for b in self.batches("base") if b < limit][-1:]
        deltas = [b for b in self.batches("delta") if b < limit and (not base or b > base[0])]
        out = self.spark.createDataFrame([], self.kept)
        for kind, numbers in (("base", base), ("delta", deltas)):
            if numbers:
                paths = [f"{self.folder}/{kind}/batch={n}" for n in numbers]
                out = out.unionByName(self.spark.read.schema(self.kept).option("basePath", f"{self.folder}/{kind}").parquet(*paths))
        return out

    def current(self, before=None, keys: DataFrame | None = None, **derived) -> DataFrame:
        """The table as of the batches below `before`; with `keys`, only the rows of those owners. `derived` columns are
        computed where a row is read: a reader that takes a digest of a wide column does not send the column itself."""
        rows = self.history(before).withColumns(derived)
        if keys is not None:
            keys = keys.select(self.key).distinct()
            used = [r.bucket for r in self.bucketed(keys).select("bucket").distinct().collect()]  # at most `buckets` numbers
            rows = rows.filter(F.col("bucket").isin(used)).join(keys, self.key, "left_semi")
        newest = rows.withColumn("newest", F.max("batch").over(Window.partitionBy(self.key)))
        return newest.filter("batch = newest and not gone").select(*self.columns, *derived)

    def write(self, batch, rows: DataFrame, owners: DataFrame):
        """New rows of the owners that the batch touches. An owner without rows is emptied."""
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != self.key]
        markers = owners.select(self.key).distinct().select(self.key, *blank, F.lit(True).alias("gone"))
        both = rows.select(*self.columns, F.lit(False).alias("gone")).unionByName(markers)
        self.put("delta", batch, both)

    def append(self, batch, rows: DataFrame):
        """Rows of owners that no earlier batch has."""
        self.put("delta", batch, rows.select(*self.columns, F.lit(False).alias("gone")))

    def put(self, kind, batch, rows):
        """Every task writes its rows into the buckets where they are: no row is sent once more, none waits in a bucket's sort."""
        self.bucketed(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{kind}/batch={batch}")

    def compact(self):
        """Write what a reader now sees as one folder, from which later readers start."""
        done = self.batches("delta")
        if done:
            self.put("base", done[-1], self.current().withColumn("gone", F.lit(False)))
