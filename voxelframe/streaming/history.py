"""Which ids were written before, without reading what was written.

Beside the batches of a folder lies `_index`: a 64-bit fingerprint of each id and the batch that
wrote it, in hash buckets, 8 bytes an id before compression. FAN parts of one level are merged to one of the
next, so a new batch reads a number of parts that grows with the logarithm of the number of
batches. A fingerprint that was seen only names the batch to look into: the ids themselves decide.

A batch's fingerprints are written before its rows. If it fails between the two, they point to a
batch that has no such id, which changes nothing; a merge that fails leaves the same fingerprints twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.workers import remove_folder

BUCKETS, FAN = 16, 8
ENTRY = "fp long, at string, bucket int"


def finished(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Folders below path that match the pattern and were written to their end: one name each."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(path, f"{pattern}/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    return sorted(f.getPath().getParent().toString() for f in found)


def _entries(ids: DataFrame, sop: str, at: str) -> DataFrame:
    fp = F.xxhash64(sop)
    return ids.where(F.col(sop).isNotNull()).select(fp.alias("fp"), F.lit(at).alias("at"), F.pmod(fp, F.lit(BUCKETS)).cast("int").alias("bucket"))


def _write(entries: DataFrame, folder: str) -> None:
    entries.hint("rebalance", "bucket").sortWithinPartitions("bucket", "fp").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def parts(spark: SparkSession, path: str) -> list[str]:
    """The parts of the index that a batch reads."""
    return finished(spark, f"{path}/_index", "level=*/part=*")


def _own(at: str) -> str:
    return "level=0/part=" + at.replace("/", "-").replace("=", "-")


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """The entries of parts of the index; a part of a batch without ids has no file."""
    return spark.read.schema(f"{ENTRY}, level int, part string").option("basePath", f"{path}/_index").parquet(*folders).select("fp", "at", "bucket")


def rebuild(spark: SparkSession, path: str, sop: str, kind: str) -> None:
    """An index for batches that were written without one."""
    for folder in finished(spark, path, "run=*/batch=*"):
        add(spark.read.schema(f"`{sop}` {kind}").parquet(folder), path, sop, "/".join(folder.split("/")[-2:]))
        compact(spark, path)


def suspects(ids: DataFrame, path: str, sop: str, own: str) -> list[str]:
    """Other finished batches, as run=/batch= below path, that may hold one of the ids."""
    spark = ids.sparkSession
    read = [p for p in parts(spark, path) if not p.endswith(_own(own))]
    if not read:
        return []
    mine = _entries(ids, sop, own).select("bucket", "fp").distinct()
    here = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # at most BUCKETS
    known = _read(spark, path, read).where(F.col("bucket").isin(here) & (F.col("at") != own))
    hit = {r["at"] for r in known.join(mine, ["bucket", "fp"], "left_semi").select("at").distinct().collect()}  # names of batches
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(a for a in hit if store.exists(spark._jvm.org.apache.hadoop.fs.Path(path, f"{a}/_SUCCESS")))


def unseen(batch: DataFrame, path: str, sop: str, own: str) -> DataFrame:
    """Rows of the batch whose id no other batch below path has; null ids are not compared."""
    if not (look := suspects(batch, path, sop, own)):
        return batch
    earlier = batch.sparkSession.read.schema(f"`{sop}` {batch.schema[sop].dataType.simpleString()}").parquet(*[f"{path}/{a}" for a in look])
    return batch.join(earlier.where(F.col(sop).isNotNull()), sop, "left_anti").select(*batch.columns)


def add(ids: DataFrame, path: str, sop: str, at: str) -> None:
    """Enter the ids of the batch `at` (run=/batch=), before its rows are written."""
    _write(_entries(ids, sop, at), f"{path}/_index/{_own(at)}")


def compact(spark: SparkSession, path: str) -> None:
    """Merge every level that has FAN parts, lowest first."""
    level = 0
    while True:
        found = finished(spark, f"{path}/_index", f"level={level}/part=*")
        if len(found) >= FAN:
            _write(_read(spark, path, found).distinct(), f"{path}/_index/level={level + 1}/part={os.urandom(8).hex()}")
            for f in found:
                remove_folder(spark, f)
        elif not finished(spark, f"{path}/_index", f"level={level + 1}/part=*"):
            return
        level += 1
