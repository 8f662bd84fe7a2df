"""Partition layout helpers for CPU-heavy stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread an under-partitioned input across the cluster's cores.

    Text scoring is CPU-bound and narrow. A large table arrives in many splits
    and is left alone (no shuffle); an input whose rows lie in fewer splits than
    there are cores, or mostly in one, is redistributed by ``keys`` so every core
    scores a share, and a later join or aggregation on the same keys can reuse
    the partitioning. Splits are counted by their rows (from the footers of
    Parquet files): a large file of one row group is cut into many splits, of
    which one holds every row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores and _evenly_held(df, cores):
        return df
    n = max(cores, splits)
    return df.repartition(n, *keys) if keys else df.repartition(n)


def _evenly_held(df: DataFrame, cores: int) -> bool:
    """Whether as many splits as ``cores`` hold rows, none more than twice a core's share."""
    held = df.select(F.spark_partition_id().alias("split")).groupBy("split").count()
    filled, most, rows = held.agg(F.count(F.lit(1)), F.max("count"), F.sum("count")).first()
    return filled >= cores and most * cores <= 2 * rows
