"""Ordering of slices in a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_distance(orientation: Column, position: Column) -> Column:
    """(row x column direction) . position."""
    o = [orientation[i] for i in range(6)]
    normal = [o[1] * o[5] - o[2] * o[4], o[2] * o[3] - o[0] * o[5], o[0] * o[4] - o[1] * o[3]]
    return normal[0] * position[0] + normal[1] * position[1] + normal[2] * position[2]


def order_dicom_slices(slices: DataFrame, series: str, sop: str, distance: Column, first: Sequence[str] = ("path",)) -> DataFrame:
    """(series, sop, distance, position from 0): repeated SOP ids keep their first row, then ascending distance (ties: SOP id)."""
    once = slices.select(series, sop, *first, distance.alias("distance")).groupBy(series, sop).agg(F.min_by("distance", F.struct(*first, "distance")).alias("distance"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy(series).orderBy("distance", sop)) - 1)


def order_slices_by_position(slices: DataFrame, series: str, path: str, position: str) -> DataFrame:
    """(series, path, position, place from 0) by descending position; a series with a null position is rejected whole (place null)."""
    by = Window.partitionBy(series)
    missing = F.count_if(F.col(position).isNull()).over(by) > 0
    return slices.select(series, path, position, missing.alias("rejected")).withColumn("place", F.when(~F.col("rejected"), F.row_number().over(by.orderBy(F.desc(position), path)) - 1))


def foreground_span(voxels: DataFrame, series: str, z: str, label: str, n: int, depth: str | None = None) -> DataFrame:
    """(series, first, last, start_min, start_max): non-empty slices, and the starts of n-slice crops that touch them.

    A single foreground slice ends where it begins. Series without foreground have nulls.
    """
    fg = F.when(F.col(label) > 0, F.col(z))
    size = F.max(depth) if depth else F.max(z) + 1
    g = voxels.groupBy(series).agg(F.min(fg).alias("first"), F.max(fg).alias("last"), size.alias("depth"))
    last = F.when(F.col("last") > F.col("first"), F.col("last") - 1).otherwise(F.col("first"))
    zero = F.lit(0)
    return g.select(series, "first", "last", F.when(F.col("first").isNotNull(), F.greatest(zero, F.col("first") - n + 1)).alias("start_min"), F.when(F.col("first").isNotNull(), F.greatest(zero, F.least(last, F.col("depth") - n))).alias("start_max"))
