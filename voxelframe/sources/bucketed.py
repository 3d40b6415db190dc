"""Voxel tables in hash buckets of their series, so that joins and groupings by series move no voxel."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def write_bucketed(voxels: DataFrame, table: str, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("z", "y", "x"), buckets: int = 200, path: str | None = None) -> DataFrame:
    """A table of the session's catalog, one sorted file a bucket; with path its files lie there. Tables that are to be joined need the same keys and number of buckets.

    A series is one bucket. Where one holds a large share of all voxels, bucket by ("series_id", "z"):
    joins of voxels still move nothing, groupings by series then move their partial results.
    """
    writer = voxels.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *[c for c in order if c not in keys])
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return voxels.sparkSession.table(table)


@contextlib.contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Joins that are executed inside the block on more columns than the bucket's (series and place) use the buckets as they are."""
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)
