"""What Python workers need to run this package's functions, and the folder that they share with the driver."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of the applications of this process, and those whose session names none.
_SCRATCH: dict[str, str] = {}
RECORDS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def share_package(spark: SparkSession) -> None:
    """Local Python workers learn where this package lies; on a cluster it is shipped with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; all of them go when the application ends.

    A temporary folder serves only where driver and executors are one process and the setting is
    missing; on a cluster without the setting this raises.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="voxelframe-")
        path = spark._jvm.org.apache.hadoop.fs.Path(base, f"voxelframe-{app}")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        whole = store.makeQualified(path)  # the default file system's scheme, if base has none
        store.mkdirs(whole)
        store.deleteOnExit(whole)
        _SCRATCH[app] = re.sub(r"^file:/+", "file:///", whole.toString())
    return f"{_SCRATCH[app]}/{name}-{os.urandom(8).hex()}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of shared_folder() that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, records: int, megabytes: int) -> Iterator[None]:
    """Bound the Arrow batches of what runs inside the block; the session's own settings come back after it."""
    share_package(spark)
    before = {k: spark.conf.get(k) for k in (RECORDS, BYTES)}
    try:
        spark.conf.set(RECORDS, str(min(records, int(before[RECORDS]) if int(before[RECORDS]) > 0 else records)))
        spark.conf.set(BYTES, str(megabytes << 20))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
