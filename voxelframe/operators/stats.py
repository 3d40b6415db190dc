"""Intensity, class and distribution statistics over voxel, pixel and slice tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.columns import md5_order
from voxelframe.functions.workers import written
from voxelframe.operators.selection import counted, group_stats

QUANTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _values(voxels: DataFrame, value: str) -> DataFrame:
    """Voxels with a value `v`."""
    return voxels.where(F.col(value).isNotNull()).withColumn("v", F.col(value).cast("double"))


def series_stats(voxels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per series: min, max, mean, std (population), percentiles with linear interpolation, sum, n, sum_sq. Nulls do not count.

    Values are counted and the counts written; a series of any number of distinct values spreads over tasks (selection.py).
    """
    out = group_stats(written(counted(_values(voxels, value), keys), "counts"), keys, QUANTILES)
    return out.select(*keys, "min", "max", "mean", "std", *[F.col("q")[i].alias(k) for i, k in enumerate(QUANTILES)], "sum", "n", "sum_sq")


def global_stats(stats: DataFrame) -> DataFrame:
    """min, max, mean, std of everything, merged from series_stats() rows without another scan: deviations inside and between the series."""
    whole = stats.agg((F.sum("sum") / F.sum("n")).alias("__m"))  # one row
    apart = F.col("mean") - F.col("__m")
    spread = F.sum(F.col("n") * (F.col("std") * F.col("std") + apart * apart)) / F.sum("n")
    return stats.crossJoin(F.broadcast(whole)).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.max("__m").alias("mean"), F.sqrt(spread).alias("std"))


def class_stats(voxels: DataFrame, series: str, label: str, value: str, whole: str = "whole") -> DataFrame:
    """Per series and present class, and for the whole series: mean, std, min, max, count, p5, p95, and the class's rank by mean."""
    labelled = _values(voxels.where(F.col(label).isNotNull()), value).select(series, F.col(label).cast("string").alias("class"), "v")
    counts = written(counted(labelled, [series, "class"]), "counts")
    out = group_stats(written(counts.unionByName(counts.groupBy(series, "v").agg(F.sum("n").alias("n")).withColumn("class", F.lit(whole))), "counts"), [series, "class"], [0.05, 0.95]).withColumnRenamed("n", "count")
    rank = F.when(F.col("class") != whole, F.row_number().over(Window.partitionBy(series, F.col("class") == whole).orderBy("mean", "class")))
    return out.select(series, "class", "mean", "std", "min", "max", "count", F.col("q")[0].alias("lower_bound"), F.col("q")[1].alias("upper_bound"), rank.alias("mean_rank"))


def class_mean_wide(stats: DataFrame, meta: DataFrame, series: str, classes: Sequence[str]) -> DataFrame:
    """meta with a column mean_<class> for each of a known list of classes; null where the class is absent."""
    wide = stats.where(F.col("class").isin(*classes)).groupBy(series).agg(*[F.max(F.when(F.col("class") == c, F.col("mean"))).alias(f"mean_{c}") for c in classes])
    return meta.join(wide, series, "left")


def hierarchical_distribution(pixels: DataFrame, dataset: str, case: str, slice_: str, channel: str | None, value: str, max_cases: int = 100, max_slices: int = 50, seed: int = 0, index: DataFrame | None = None) -> DataFrame:
    """slice -> case -> dataset per channel: min, max, mean of means, mean of stds, over a seeded choice of at most max_cases and max_slices (the operator's sampling).

    index: a table of the slices (dataset, case, slice), if there is one; else the pixels are read once more for it.
    """
    chan = [channel] if channel else []
    listed = (pixels if index is None else index).select(dataset, case, slice_).distinct()
    listed = written(listed, "slices") if index is None else listed
    cases = listed.select(dataset, case).distinct()
    cases = cases.withColumn("r", F.row_number().over(Window.partitionBy(dataset).orderBy(md5_order([case], seed), case))).where(F.col("r") <= max_cases).drop("r")
    slices = listed.join(cases, [dataset, case])
    slices = slices.withColumn("r", F.row_number().over(Window.partitionBy(dataset, case).orderBy(md5_order([slice_], seed), slice_))).where(F.col("r") <= max_slices).drop("r")
    chosen = pixels.join(slices, [dataset, case, slice_], "left_semi")
    v = F.col(value).cast("double")
    per_slice = chosen.groupBy(dataset, case, slice_, *chan).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    up = lambda df, keys: df.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.avg("mean").alias("mean"), F.avg("std").alias("std"))
    return up(up(per_slice, [dataset, case, *chan]), [dataset, *chan])


def label_presence(pixels: DataFrame, dataset: str, slice_: str, label: str, cap: int | None = None, seed: int = 0) -> DataFrame:
    """Per dataset and label, the number of mask slices that hold it; `cap` slices a dataset at most, chosen by seed."""
    seen = pixels.where(F.col(label).isNotNull()).select(dataset, slice_, label).distinct()
    if cap is not None:
        kept = seen.select(dataset, slice_).distinct().withColumn("r", F.row_number().over(Window.partitionBy(dataset).orderBy(md5_order([slice_], seed), slice_))).where(F.col("r") <= cap)
        seen = seen.join(kept, [dataset, slice_], "left_semi")
    return seen.groupBy(dataset, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_slices"))


def existing_classes(pixels: DataFrame, class_map: DataFrame, dataset: str, label: str, offset: int = 1, background: int = 0) -> DataFrame:
    """class_map (dataset, class_name, class_id) restricted to ids seen in masks (seen id = map id + offset); background always stays."""
    seen = pixels.where(F.col(label).isNotNull()).select(dataset, (F.col(label) - offset).alias("class_id")).distinct()
    return class_map.join(seen, [dataset, "class_id"], "left_semi").unionByName(class_map.where(F.col("class_id") == background)).select(dataset, "class_name", "class_id").distinct()


def slice_counts(slices: DataFrame, modality: str, dataset: str) -> DataFrame:
    """Slices per dataset, per modality and overall; level 0 dataset, 1 modality, 2 all."""
    return slices.rollup(modality, dataset).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")).select(modality, dataset, F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).otherwise(2).alias("level"), "n")


def case_counts(slices: DataFrame, modality: str, dataset: str, case: Sequence[str]) -> DataFrame:
    """Per dataset the number of cases and slices per case (2 digits); dataset null: the modality's sum and mean of averages."""
    per = slices.groupBy(modality, dataset).agg(F.count_distinct(F.struct(*case)).alias("n_cases"), F.count(F.lit(1)).alias("n")).select(modality, dataset, "n_cases", F.round(F.col("n") / F.col("n_cases"), 2).alias("avg_slices"))
    total = per.groupBy(modality).agg(F.sum("n_cases").alias("n_cases"), F.avg("avg_slices").alias("avg_slices"))
    return per.unionByName(total.withColumn(dataset, F.lit(None).cast("string")))


def case_slice_map(slices: DataFrame, keys: Sequence[str], slice_: str) -> DataFrame:
    """Sorted distinct slice indexes of each (dataset, case, direction)."""
    return slices.groupBy(*keys).agg(F.sort_array(F.collect_set(slice_)).alias("slice_list"))


def registry_summary(patient_phase: DataFrame, statuses: Sequence[str], phases: Sequence[str] = ("N", "A", "PV", "V")) -> DataFrame:
    """One row: images (of the given phases), patients, labels, and a count for every status, zero included."""
    counted = [F.count_distinct(F.when(F.col("status") == s, F.col("patient"))).alias(f"n_{s}") for s in statuses]
    return patient_phase.agg(F.coalesce(F.sum(F.when(F.col("phase").isin(*phases), F.col("n_img"))), F.lit(0)).alias("num_img"), F.count_distinct("patient").alias("num_patient"), F.count("label_index").alias("num_label"), *counted)


def patient_sample_counts(patient_phase: DataFrame, n_pos: int, n_neg: int, gap: int, pretrain: bool = False) -> DataFrame:
    """Per patient: samples (images, or n_pos + n_neg for each labelled phase), labels, and whether the images suffice."""
    per = F.col("n_img") if pretrain else F.when(F.col("label_index").isNotNull(), F.lit(n_pos + n_neg)).otherwise(0)
    enough = F.lit(True) if pretrain else F.coalesce(F.bool_and(F.when(F.col("label_index").isNotNull(), F.lit(n_pos + n_neg + 2 * gap) <= F.col("n_img"))), F.lit(True))
    return patient_phase.groupBy("patient").agg(F.sum(per).alias("n_samples"), F.count("label_index").alias("n_label"), enough.alias("ok"))


def phase_slice_index(slices: DataFrame, patient: str = "patient", phase: str = "phase", name: str = "file", y: str = "y", many: int = 1000) -> DataFrame:
    """Per (patient, phase) the map of slice index to Y with least and largest Y; the index is the last 3 digits of the name's number, 4 in series of more than `many` files."""
    counted = slices.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(patient, phase)))
    digits = F.regexp_extract(F.col(name), r"(\d+)\D*$", 1)
    counted = counted.withColumn("idx", F.when(F.col("__n") > many, F.right(digits, F.lit(4))).otherwise(F.right(digits, F.lit(3))).try_cast("int"))
    one = counted.where(F.col("idx").isNotNull()).groupBy(patient, phase, "idx").agg(F.min(y).alias("y"))
    return one.groupBy(patient, phase).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("idx", "y")))).alias("idx_to_y"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def crop_summary(patches: DataFrame, series: str = "series_id", patch: str = "patch_id", classes: str = "classes") -> DataFrame:
    """Per series: number of patches, whether any is annotated, the classes seen in them."""
    return patches.groupBy(series).agg(F.count(patch).alias("num_patches"), F.bool_or(F.col(classes).isNotNull()).alias("anno_available"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.coalesce(classes, F.array().cast("array<int>")))))).alias("classes"))


def crop_totals(summary: DataFrame) -> DataFrame:
    """num_series, num_patches and number of annotated series of crop_summary()."""
    return summary.agg(F.count(F.lit(1)).alias("num_series"), F.sum("num_patches").alias("num_patches"), F.count_if("anno_available").alias("num_annotated"))


def class_histogram(voxels: DataFrame, label: str, value: str, bins: int = 100, scale: float = 1.0) -> DataFrame:
    """Per class, counts in equal-width bins between its least and largest value, also scaled; empty bins have no row."""
    v = F.col(value).cast("double")
    counted = voxels.where(F.col(label).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(label).alias("class"), v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counted.groupBy("class").agg(F.min("v").alias("lo0"), F.max("v").alias("hi0"))
    width = (F.col("hi0") - F.col("lo0")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo0")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0).cast("int")
    binned = counted.join(ends, "class").withColumn("bin", at).groupBy("class", "bin", "lo0", "hi0").agg(F.sum("n").alias("n"))
    return binned.select("class", "bin", (F.col("lo0") + F.col("bin") * width).alias("lo"), (F.col("lo0") + (F.col("bin") + 1) * width).alias("hi"), "n", (F.col("n") * scale).alias("scaled"))


def _by(df: DataFrame, aggregated: list[Column], by: Sequence[str]) -> DataFrame:
    """df with group aggregates attached; without `by` a single row is broadcast."""
    if not by:
        return df.join(F.broadcast(df.agg(*aggregated)), how="cross")
    return df.join(df.groupBy(*by).agg(*aggregated), list(by))


def impute_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Nulls and NaN of numeric features become the column's mean, of their own group if `by` is given; an all-null column stays null."""
    clean = df.select(*[(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) if c in cols else F.col(c)).alias(c) for c in df.columns])
    return _by(clean, [F.avg(c).alias(f"__{c}") for c in cols], by).select(*[F.coalesce(c, f"__{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def minmax_scale(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Features to [0, 1] by the column's (group's) ends; a constant column becomes 0, nulls stay."""
    joined = _by(df, [f(F.col(c).cast("double")).alias(f"__{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max))], by)
    one = lambda c: F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))).when(F.col(c).isNotNull(), 0.0)
    return joined.select(*[one(c).alias(c) if c in cols else F.col(c) for c in df.columns])
