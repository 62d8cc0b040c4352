"""Session settings the jobs rely on, and the shared folder for checkpoints."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="folioscope", master=None, shuffle_partitions=None, extra=None):
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach. A cluster names it in spark.checkpoint.dir; only a local session
    without that setting gets a temporary one."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not configured:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="folioscope-")
            spark.conf.set("spark.checkpoint.dir", configured)
        sc.setCheckpointDir(configured)
    return configured or current


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; written once and never reused."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as Parquet in the shared folder, to be read more than once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise to the shared folder, so the plan is short and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
