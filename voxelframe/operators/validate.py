"""Filters and validation: what is kept, and rows that tell why the rest is not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_attr(df: DataFrame, attr: str, value: Any, columns: Sequence[str]) -> DataFrame:
    return df.where(F.col(attr) == value).select(*columns)


def min_slices(slices: DataFrame, series_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(slices of series with at least n of them, one row with the number of rejected series)."""
    counts = slices.groupBy(series_col).agg(F.count(F.lit(1)).alias("__n"))
    kept = slices.join(counts.where(F.col("__n") >= n).select(series_col), series_col, "left_semi")
    return kept, counts.agg(F.count_if(F.col("__n") < n).alias("rejected"))


def valid_scan_length(df: DataFrame, start_col: str, end_col: str, min_len: float = 1) -> DataFrame:
    return df.where(F.col(start_col) - F.col(end_col) >= min_len)


def min_volume_size(volumes: DataFrame, shape_col: str, crop: Sequence[int], cut_edge: int = 0) -> DataFrame:
    """volumes with kept and, if not, the axes that are too short (0-based) as reason."""
    need = F.array(*[F.lit(c + 2 * cut_edge) for c in crop])
    short = F.filter(F.transform(F.arrays_zip(F.col(shape_col).alias("s"), need.alias("n")), lambda z, i: F.when(F.coalesce(z["s"] < z["n"], F.lit(True)), i)), lambda i: i.isNotNull())
    return volumes.select("*", (F.size(short) == 0).alias("kept"), F.when(F.size(short) > 0, F.concat(F.lit("short axes "), F.array_join(short.cast("array<string>"), ","))).alias("reason"))


def foreground_ratio(voxels: DataFrame, keys: Sequence[str], label: str, ratio: float) -> DataFrame:
    """Slices whose foreground (label > 0) is more than `ratio` of their voxels: keys, fg, area."""
    return voxels.groupBy(*keys).agg(F.count_if(F.col(label) > 0).alias("fg"), F.count(F.lit(1)).alias("area")).where(F.col("fg") > ratio * F.col("area"))


def integrity_report(artefacts: DataFrame, id_col: str, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(id, failed_rule, detail) for every rule (condition to hold, detail to show) that an artefact fails; null fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("failed_rule"), detail.cast("string").alias("detail"))) for name, (ok, detail) in rules.items()]))
    return artefacts.select(F.col(id_col).alias("id"), F.explode(failed).alias("f")).select("id", "f.failed_rule", "f.detail")


def corrupted_name(name: Column, failed: Column) -> Column:
    return F.when(failed & ~name.startswith("CORRUPTED_"), F.concat(F.lit("CORRUPTED_"), name)).otherwise(name)


def class_filter(voxels: DataFrame, label_col: str, max_label: int) -> DataFrame:
    """Labels above max_label become background."""
    return voxels.withColumn(label_col, F.when(F.col(label_col) > max_label, 0).otherwise(F.col(label_col)))


def pair_geometry_check(images: DataFrame, labels: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, image_value, label_value) where image and label of a series disagree; nulls differ from values."""
    i, lab = images.select(key, *[F.col(f).alias(f"i_{f}") for f in fields]), labels.select(key, *[F.col(f).alias(f"l_{f}") for f in fields])
    rows = F.array_compact(F.array(*[F.when(~F.col(f"i_{f}").eqNullSafe(F.col(f"l_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"i_{f}").cast("string").alias("image_value"), F.col(f"l_{f}").cast("string").alias("label_value"))) for f in fields]))
    return i.join(lab, key).select(key, F.explode(rows).alias("r")).select(key, "r.*")


def round_consistency(runs: DataFrame, run_keys: Sequence[str] = ("exp", "round", "model")) -> DataFrame:
    """Per experiment: its data sets and files, and what breaks the rule of one data set and one file a run."""
    per_run = runs.groupBy(*run_keys, "modality", "dataset").agg(F.count_distinct("file").alias("files"))
    per_run = per_run.groupBy(*run_keys).agg(F.collect_set(F.struct("modality", "dataset")).alias("sets"), F.sum("files").alias("files"))
    out = per_run.groupBy(run_keys[0]).agg(F.size(F.array_distinct(F.flatten(F.collect_list("sets")))).cast("long").alias("n_datasets"), F.sum("files").alias("n_files"), F.max("files").alias("most"))
    return out.select(run_keys[0], "n_datasets", "n_files", F.when(F.col("n_datasets") > 1, "several data sets").when(F.col("most") > 1, "several files in a run").alias("violation"))
