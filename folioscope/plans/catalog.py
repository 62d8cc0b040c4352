"""Registry of runnable queries and the SQL each one is checked against."""

import os

QUERIES = {}
ORACLES = {}

WIDE = ("orders", "documents", "conversations", "lineitem")


def query(name, sql=None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def spread(df):
    """Use every core on a scan that yields fewer splits than cores (one small file); a large scan is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fan_out(df):
    """Give row-heavy work every core after a join whose small output was merged into few partitions."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def table(spark, sf_dir, name):
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in WIDE else df
