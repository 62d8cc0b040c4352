"""Cutting a table to the keys that are asked for, and dealing out groups of heavy work."""

from pyspark.sql import DataFrame


def restrict(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows of `df` whose key occurs in `keys`."""
    return df.join(keys.select(*([on] if isinstance(on, str) else on)).distinct(), on, "left_semi")


def dealt(df: DataFrame, *keys) -> DataFrame:
    """Hash partitions of the session's number. Groups that are small in bytes but take long to work on would otherwise be
    merged into a few tasks by adaptive execution."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
