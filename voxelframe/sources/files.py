"""Listing, reading and writing of files and metadata tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelframe.sources.listing import list_files as list_files


def read_metadata_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Chosen columns of a CSV with a header and a declared schema; malformed rows fail.

    Large files are split over tasks. multi_line: quoted fields may hold line ends; a file is one
    task then. Without it a quoted line end is a malformed row.
    """
    df = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", multiLine=multi_line, escape='"')
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def flatten_json_map(df: DataFrame, json_col: str, levels: int) -> DataFrame:
    """Nested JSON maps as rows: level_1 .. level_n and value; a value that is no map of that depth gives no row."""
    kind: T.DataType = T.StringType()
    for _ in range(levels):
        kind = T.MapType(T.StringType(), kind)
    out = df.withColumn("__m", F.from_json(json_col, kind))
    for i in range(1, levels + 1):
        out = out.select("*", F.explode("__m").alias(f"level_{i}", "__v")).drop("__m").withColumnRenamed("__v", "__m")
    return out.withColumnRenamed("__m", "value").drop(json_col)


def write_report(df: DataFrame, path: str, fmt: str = "json", partition_by: Sequence[str] | None = None) -> None:
    """A result table as JSON, CSV or Parquet files, a folder per partition value."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_split_layout(samples: DataFrame, path: str) -> None:
    """Samples by split and a hash bucket of the series: files stay few when series are many, and a large bucket is written by several tasks; series_id remains a column."""
    bucketed = samples.withColumn("series_bucket", F.pmod(F.xxhash64("series_id"), F.lit(256)).cast("int"))
    bucketed.hint("rebalance", "split", "series_bucket").write.mode("overwrite").partitionBy("split", "series_bucket").parquet(path)


def read_split_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("series_bucket")


def write_patches(patches: DataFrame, path: str, buckets: int = 64) -> None:
    """Patch rows in folders by a hash bucket of the series; a large bucket is written by several tasks."""
    out = patches.withColumn("series_bucket", F.pmod(F.xxhash64("series_id"), F.lit(buckets)).cast("int"))
    out.hint("rebalance", "series_bucket").write.mode("overwrite").partitionBy("series_bucket").parquet(path)


def pending_tasks(tasks: DataFrame, done: DataFrame, keys: Sequence[str], label: str | None = None) -> DataFrame:
    """Tasks without finished output. With `label`: a task that has a label needs done.has_label too."""
    if label is None:
        return tasks.join(done, list(keys), "left_anti")
    marked = tasks.withColumn("__need", F.col(label).isNotNull())
    both = done.select(*keys, F.coalesce("has_label", F.lit(False)).alias("__has")).groupBy(*keys).agg(F.bool_or("__has").alias("__has"))
    return marked.join(both, list(keys), "left").where(F.col("__has").isNull() | (F.col("__need") & ~F.col("__has"))).drop("__need", "__has")


def run_log(results: DataFrame, params: Mapping[str, str], error: str = "error", date: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(per-sample rows with status, one header row: date, params, n_ok, n_error)."""
    rows = results.withColumn("status", F.when(F.col(error).isNull(), "ok").otherwise("error"))
    pairs = F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv]) if params else F.create_map().cast("map<string,string>")
    head = rows.agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"))
    return rows, head.select((date if date is not None else F.current_date()).alias("date"), pairs.alias("params"), "n_ok", "n_error")
