"""Intensity windows and normalisation of voxel and pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.columns import clip, safe_div


def _window(col: str, location: int, width: int) -> tuple[Column, int]:
    low = location - width // 2
    return clip(F.col(col).cast("double"), float(low), float(location + width // 2)), low


def with_group(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """df with aggregates of its group: partial sums and a join, so a large group is not sorted in one task."""
    return df.join(df.groupBy(*by).agg(*[c.alias(k) for k, c in aggregates.items()]), list(by))


def window_norm(df: DataFrame, col: str, location: int, width: int) -> DataFrame:
    """(clipped to the window - its low end) / width."""
    c, low = _window(col, location, width)
    return df.withColumn(col, (c - low) / width)


def window_minmax(df: DataFrame, col: str, by: Sequence[str], location: int, width: int, out_max: float = 1.0) -> DataFrame:
    """Clipped to the window, then minus the group's least and over its largest value, times out_max; a constant group becomes 0."""
    c, _ = _window(col, location, width)
    g = with_group(df.withColumn(col, c), by, __lo=F.min(col), __hi=F.max(col))
    return g.withColumn(col, F.when(F.col(col).isNotNull(), F.coalesce(safe_div(F.col(col) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0)) * out_max)).select(*df.columns)


def rescale_hu(df: DataFrame, col: str, slope: str, intercept: str) -> DataFrame:
    """col * slope + intercept where both exist, else col."""
    return df.withColumn(col, F.coalesce(F.col(col) * F.col(slope) + F.col(intercept), F.col(col).cast("double")))


def range_clip_norm(df: DataFrame, col: str, by: Sequence[str], method: str = "const", mean: float = 0.0, std: float = 1.0, lo: float = -1024.0, hi: float = 4096.0) -> DataFrame:
    """Clipped to [lo, hi], then (x - mean) / std with given figures (const) or the group's own (inst; constant groups become 0)."""
    c = df.withColumn(col, clip(F.col(col).cast("double"), lo, hi))
    if method == "const":
        return c.withColumn(col, (F.col(col) - mean) / std)
    g = with_group(c, by, __m=F.avg(col), __s=F.stddev_pop(col))
    return g.withColumn(col, F.when(F.col(col).isNotNull(), F.coalesce(safe_div(F.col(col) - F.col("__m"), F.col("__s")), F.lit(0.0)))).select(*df.columns)


def instance_norm(df: DataFrame, col: str, by: Sequence[str], eps: float = 1e-6, as_integer: bool = False) -> DataFrame:
    """(x - least) / (std + eps) of each sample; as_integer truncates the result."""
    g = with_group(df, by, __lo=F.min(col).cast("double"), __s=F.stddev_pop(F.col(col).cast("double")))
    v = (F.col(col) - F.col("__lo")) / (F.col("__s") + eps)
    return g.withColumn(col, v.cast("int") if as_integer else v).select(*df.columns)


def dataset_norm(df: DataFrame, col: str, stats: DataFrame, keys: Sequence[str], mode: str = "multi") -> DataFrame:
    """With stats (keys, mean, std): x / std for single slices, (x - mean) / std for several; rows without stats are null."""
    g = df.join(stats.select(*keys, F.col("mean").alias("__m"), F.col("std").alias("__s")), list(keys), "left")
    x = F.col(col).cast("double")
    return g.withColumn(col, safe_div(x if mode == "single" else x - F.col("__m"), F.col("__s"))).select(*df.columns)


def roi_norm(df: DataFrame, col: str, by: Sequence[str], h: int, w: int) -> DataFrame:
    """x / std of the central half [h/4, 3h/4) x [w/4, 3w/4)."""
    inside = (F.col("y") >= h // 4) & (F.col("y") < 3 * h // 4) & (F.col("x") >= w // 4) & (F.col("x") < 3 * w // 4)
    g = with_group(df, by, __s=F.stddev_pop(F.when(inside, F.col(col).cast("double"))))
    return g.withColumn(col, safe_div(F.col(col), F.col("__s"))).select(*df.columns)


def fixed_norm(df: DataFrame, col: str, channel: str, means: Sequence[float], stds: Sequence[float]) -> DataFrame:
    """(x - mean) / std with the figures of the row's channel (from 0)."""
    at = lambda xs: F.try_element_at(F.array(*[F.lit(float(x)) for x in xs]), (F.col(channel) + 1).cast("int"))
    return df.withColumn(col, (F.col(col) - at(means)) / at(stds))


def hist_equalize(pixels: DataFrame, col: str, by: Sequence[str], cy: float, cx: float, radius: float, bins: int = 256) -> DataFrame:
    """Values through the cumulative histogram of an inner circle, linear between bin centres; [0, 1].

    Only bins are ordered: a group has at most `bins` of them.
    """
    from pyspark.sql import Window

    v = F.col(col).cast("double")
    inside = F.pow(F.col("y") - cy, 2) + F.pow(F.col("x") - cx, 2) <= radius * radius
    ends = pixels.where(inside).groupBy(*by).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count(v).alias("__n"))
    g = pixels.join(ends, list(by), "left")
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins)
    binned = g.where(inside & v.isNotNull()).select(*by, F.coalesce(F.least(F.floor((v - F.col("__lo")) / width), F.lit(bins - 1)), F.lit(0)).cast("int").alias("b"), "__n")
    counts = binned.groupBy(*by, "b", "__n").agg(F.count(F.lit(1)).alias("k"))
    cdf = counts.withColumn("c", F.sum("k").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) / F.col("__n"))
    # the whole curve of a group in one array: the share up to each bin
    curve = cdf.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("b", "c"))).alias("s"))
    held = F.transform("s", lambda z, i: F.array_repeat(z["c"], F.coalesce(F.get("s", i + 1)["b"], F.lit(bins)) - z["b"]))  # up to the next bin that occurs
    full = F.flatten(F.concat(F.array(F.array_repeat(F.lit(0.0), F.get("s", F.lit(0))["b"])), held))
    out = g.join(curve.select(*by, full.alias("__f")), list(by), "left")
    place = F.greatest(F.lit(0.0), F.least((v - F.col("__lo")) / width - 0.5, F.lit(bins - 1.0)))
    low = F.floor(place).cast("int")
    high = F.least(low + 1, F.lit(bins - 1))
    at = lambda i: F.get("__f", i)
    return out.withColumn(col, F.when(v.isNotNull(), F.coalesce(at(low) + (at(high) - at(low)) * (place - low), F.when(F.col("__lo").isNotNull(), F.lit(1.0))))).select(*pixels.columns)


def low_value_clip(pixels: DataFrame, col: str, by: Sequence[str], ratio: float) -> DataFrame:
    """Per image: values below the one at rank int(n_distinct ratio) of the sorted distinct values are raised to it, then 0 .. 255 by the maximum.

    Ratio 0 only scales by the maximum, without subtraction.
    """
    v = F.col(col).cast("double")
    if ratio == 0:
        g = with_group(pixels.withColumn(col, v), by, __hi=F.max(col))
        return g.withColumn(col, F.coalesce(safe_div(F.col(col), F.col("__hi")), F.when(F.col(col).isNotNull(), 0.0)) * 255).select(*pixels.columns)
    values = pixels.where(v.isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_set(v)).alias("__d"), F.max(v).alias("__hi"))
    low = values.select(*by, "__hi", F.get("__d", F.least(F.floor(F.size("__d") * ratio), F.size("__d") - 1).cast("int")).alias("__lo"))
    g = pixels.join(low, list(by), "left")
    return g.withColumn(col, F.when(v.isNotNull(), F.coalesce(safe_div(F.greatest(v, F.col("__lo")) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0)) * 255)).select(*pixels.columns)
