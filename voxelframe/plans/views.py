"""The driver's tables seen as the library's domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as voxels: series = order, z = line, y = part % 16, x = supplier % 16, hu = quantity, labels from the two flags."""
    t = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
    return t.select(F.col("l_orderkey").alias("series_id"), F.col("l_linenumber").alias("z"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_suppkey") % 16).cast("int").alias("x"),
                    F.col("l_quantity").alias("hu"), label.alias("label"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("label2"), F.col("l_extendedprice").alias("price"))


VOXELS = """(SELECT l_orderkey AS series_id, l_linenumber AS z, CAST(l_partkey % 16 AS INTEGER) AS y, CAST(l_suppkey % 16 AS INTEGER) AS x, l_quantity AS hu,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS label, CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END AS label2, l_extendedprice AS price FROM lineitem)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 slices: one row per pixel, class = label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "value"))
    return e.select(F.col("vec_id").alias("series_id"), F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), F.col("value").cast("double").alias("value"), "label")


PIXELS = """(SELECT vec_id AS series_id, CAST((pos - 1) // 8 AS INTEGER) AS y, CAST((pos - 1) % 8 AS INTEGER) AS x, CAST(embedding[pos] AS DOUBLE) AS value, label
  FROM embeddings, range(1, 65) r(pos))"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer as modality -> dataset -> case; slices are the orders of a customer."""
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("r_name").alias("modality"), F.col("n_name").alias("dataset"), F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("direction"), F.col("o_orderkey").alias("slice_idx"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("channel"), F.col("o_orderstatus").alias("status"))


CASES = """(SELECT r_name AS modality, n_name AS dataset, c_custkey AS case_id, c_mktsegment AS direction, o_orderkey AS slice_idx, o_totalprice AS value, o_orderpriority AS channel, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as scans: patient = conversation, phase from its number, slices are turns, y = length of the text, the label sits on the longest turn."""
    t = table(spark, sf_dir, "conversations")
    g = t.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n_img"), F.max_by("turn", F.struct(F.length("text"), -F.col("turn"))).cast("int").alias("longest"), F.max(F.length("text")).cast("double").alias("label_y"))
    phase = F.element_at(F.array(*map(F.lit, ["N", "A", "PV", "V", "D"])), (F.col("conv_id") % 5 + 1).cast("int"))
    return g.select(F.col("conv_id").alias("patient"), phase.alias("phase"), "n_img", F.when(F.col("conv_id") % 3 != 0, F.col("longest")).alias("label_index"), F.when(F.col("conv_id") % 3 != 0, F.col("label_y")).alias("label_y"),
                    F.when(F.col("conv_id") % 7 == 0, "img_only").otherwise("normal").alias("status"))


PHASES = """(SELECT conv_id AS patient, (['N', 'A', 'PV', 'V', 'D'])[CAST(conv_id % 5 AS INTEGER) + 1] AS phase, CAST(count(*) AS INTEGER) AS n_img,
  CASE WHEN conv_id % 3 <> 0 THEN CAST(arg_max(turn, (length(text), -turn)) AS INTEGER) END AS label_index, CASE WHEN conv_id % 3 <> 0 THEN CAST(max(length(text)) AS DOUBLE) END AS label_y,
  CASE WHEN conv_id % 7 = 0 THEN 'img_only' ELSE 'normal' END AS status FROM conversations GROUP BY conv_id)"""
