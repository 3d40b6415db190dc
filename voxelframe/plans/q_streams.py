"""Queries of the streaming operators: the events table read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.workers import shared_folder
from voxelframe.plans.views import table
from voxelframe.streaming import incremental as T
from voxelframe.streaming import ledger as L


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


def t1_streaming_global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "t1")
    stats = T.streaming_global_stats(_stream(spark, sf_dir), ["event_type"], "value")
    put = lambda df, number: df.write.mode("overwrite").parquet(f"{out}/result")
    stats.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/result").select("event_type", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")])


def t2_streaming_ingest_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "t2")
    sop = F.concat_ws(":", "user_id", "event_type").alias("sop")
    done = lambda: table(spark, sf_dir, "events").where("event_id % 40 = 0").select(sop)
    T.streaming_ingest_slices(_stream(spark, sf_dir).select(sop, F.col("ts").cast("timestamp").alias("ts")), done, "sop", "ts", "60 days", f"{out}/result", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/result").select("sop")


def t1_ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of each user's values comes by stream, the rest as a batch run of the same version."""
    out = shared_folder(spark, "t1_ledger")
    keys, path = ["event_type", "user_id"], f"{out}/ledger"
    L.stream_into(_stream(spark, sf_dir).where("event_id % 3 <> 0"), keys, "value", path, f"{out}/checkpoint").awaitTermination()
    L.record(L.partials(table(spark, sf_dir, "events").where("event_id % 3 = 0"), keys, "value"), path, "batch")
    rows = L.ledger(spark, path, "event_type string, user_id long")
    return L.merged(L.current(rows, keys), ["event_type"]).select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")])


def a2_ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders recorded with wrong values and replaced, late ones, and retracted ones."""
    path, keys = shared_folder(spark, "a2_ledger"), ["l_orderkey"]
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("v"))
    k = F.col("l_orderkey") % 3
    L.record(L.partials(t.where(k < 2).withColumn("v", F.col("v") * (k + 1)), keys, "v"), path, "first")
    L.record(L.partials(t.where(k == 2), keys, "v"), path, "late")
    L.record(L.partials(t.where(k == 1), keys, "v", 2), path, "again")
    L.record(L.retraction(t.where("l_orderkey % 7 = 0"), keys, 3), path, "gone")
    rows = L.ledger(spark, path, f"l_orderkey {t.schema['l_orderkey'].dataType.simpleString()}")
    return L.merged(L.current(rows, keys)).select("n", *[F.round(c, 3).alias(c) for c in ("min", "max", "mean", "std")])


QUERIES = {f.__name__: f for f in (t1_streaming_global_stats, t2_streaming_ingest_slices, t1_ledger_stream, a2_ledger_stats)}

ORACLE = {
    "t1_ledger_stream": "SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1",
    "a2_ledger_stats": "SELECT count(*) AS n, round(min(l_extendedprice), 3) AS min, round(max(l_extendedprice), 3) AS max, round(avg(l_extendedprice), 3) AS mean, round(stddev_pop(l_extendedprice), 3) AS std FROM lineitem WHERE l_orderkey % 7 <> 0",
    "t1_streaming_global_stats": "SELECT event_type, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1",
    "t2_streaming_ingest_slices": "SELECT DISTINCT user_id || ':' || event_type AS sop FROM events WHERE user_id || ':' || event_type NOT IN (SELECT user_id || ':' || event_type FROM events WHERE event_id % 40 = 0)",
}
