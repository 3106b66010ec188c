"""Readers for the driver tables (parquet) with declared column subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
# Tables whose rows carry whole texts: the row-local work on them (regex token
# counts, line truncation) is CPU-heavy enough to deserve every core.
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least as many partitions as the session has cores.

    A small file with a single row group is read by one task, and the
    row-local work before the first shuffle (regex token counts, explodes,
    partial aggregation) would run on one core. Large inputs already arrive in
    many splits and are left untouched (no shuffle is added for them). The
    partition count comes from file metadata; no job runs.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no RDD view
        return df
    return df.repartition(target) if n < target else df


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read one driver table; selecting ``cols`` right away keeps the scan pruned."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*cols) if cols else df
    return spread(df) if name in TEXT_TABLES else df
