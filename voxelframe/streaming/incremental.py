"""Running statistics and ingestion of slices as they arrive, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelframe.functions.workers import remove_folder
from voxelframe.streaming import history


def streaming_global_stats(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Running keys, min, max, mean, std: one row of state a key, for output mode complete or update."""
    v = F.col(value).cast("double")
    sums = stream.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return sums


def new_slices(stream: DataFrame, sop: str, time: str, watermark: str) -> DataFrame:
    """Slices once per SOP id within the watermark, which bounds the state."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([sop])


def query_id(spark: SparkSession) -> str:
    """Inside foreachBatch: the id of the running query, the same after a restart from its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def written_before(spark: SparkSession, path: str) -> list[str]:
    """The finished batch folders below path."""
    return history.finished(spark, path, "run=*/batch=*")


def ingest(batch: DataFrame, done: DataFrame, sop: str, path: str, run: str, number: int) -> None:
    """Write the rows of a batch whose ids are neither in done nor in any other batch below path, and enter them in the index."""
    spark, own, came = batch.sparkSession, f"run={run}/batch={number}", f"{path}/_incoming/{run}-{number}"
    batch.join(done.select(sop), sop, "left_anti").select(*batch.columns).write.mode("overwrite").parquet(came)  # the stream's state is asked once
    if not history.parts(spark, path):
        history.rebuild(spark, path, sop, batch.schema[sop].dataType.simpleString())
    fresh = history.unseen(spark.read.schema(batch.schema).parquet(came), path, sop, own)
    history.add(fresh, path, sop, own)
    fresh.write.mode("overwrite").parquet(f"{path}/{own}")
    history.compact(spark, path)
    remove_folder(spark, came)


def streaming_ingest_slices(stream: DataFrame, done: Callable[[], DataFrame], sop: str, time: str, watermark: str, path: str, checkpoint: str, trigger_now: bool = True) -> StreamingQuery:
    """Appends slices that are neither repeated nor in done() (read anew for each batch) to a Parquet folder.

    A batch writes to the folder of its query and number, so one that is run again replaces itself
    and nothing else; a query with a new checkpoint is another query and adds its own folders. Ids
    that any earlier batch of any query wrote do not come again, however late they are repeated:
    an index of fingerprints beside the batches (history.py) tells which of them to look into.
    Two queries may not write to one folder at the same time.
    """
    def put(batch: DataFrame, number: int) -> None:
        ingest(batch, done(), sop, path, query_id(batch.sparkSession), number)

    writer = new_slices(stream, sop, time, watermark).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_now else writer).start()
