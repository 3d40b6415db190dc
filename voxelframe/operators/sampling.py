"""Choice of slices around annotated slices, and windows of slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.columns import md5_order

KEYS = ("patient", "phase")


def _slices(phases: DataFrame) -> DataFrame:
    return phases.where(F.col("n_img") > 0).withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n_img") - 1)))


def positive_negative_slices(phases: DataFrame, n_pos: int, n_neg: int, gap: int, seed: int) -> DataFrame:
    """(patient, phase, idx, is_positive) around the annotated slice c of normal scans.

    n_pos (odd) contiguous positives centred on c, those inside the scan; n_neg (even) negatives
    farther than gap from c, a seeded choice.
    """
    if n_pos % 2 == 0 or n_neg % 2 or gap < 1:
        raise ValueError("n_pos odd, n_neg even, gap at least 1")
    s = _slices(phases.where((F.col("status") == "normal") & F.col("label_index").isNotNull())).withColumn("d", F.abs(F.col("idx") - F.col("label_index")))
    pos = s.where(F.col("d") <= n_pos // 2).select(*KEYS, "idx", F.lit(True).alias("is_positive"))
    far = s.where((F.col("d") > gap) & (F.col("d") > n_pos // 2))
    neg = far.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(md5_order([*KEYS, "idx"], seed), "idx"))).where(F.col("r") <= n_neg).select(*KEYS, "idx", F.lit(False).alias("is_positive"))
    return pos.unionByName(neg)


def serial_window(phases: DataFrame, slices_per_sample: int, gap: int) -> DataFrame:
    """(patient, phase, center, idx_list): slices every `gap` on both sides of the annotated one; windows that leave the scan go."""
    reach = slices_per_sample // 2 * gap
    c = F.col("label_index")
    return phases.where(c.isNotNull() & (c - reach >= 0) & (c + reach < F.col("n_img"))).select(*KEYS, c.alias("center"), F.sequence(c - reach, c + reach, F.lit(gap)).alias("idx_list"))


def sliding_slice_windows(slices: DataFrame, series: str, idx: str, n_images: int, n_labels: int, stride: int, gap: int = 1, test: bool = False) -> DataFrame:
    """(series, center, image_idx, label_idx): centred windows of n_images and n_labels (odd) slices, `gap` apart, at every stride (1 in tests)."""
    if n_images % 2 == 0 or n_labels % 2 == 0 or stride < 1 or gap < 1:
        raise ValueError("odd window sizes, stride and gap at least 1")
    half = (max(n_images, n_labels) // 2) * gap
    by = Window.partitionBy(series)
    order = by.orderBy(idx)
    placed = slices.select(series, idx).distinct().withColumn("pos", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    near = F.collect_list(idx).over(order.rowsBetween(-half, half))
    pick = lambda k: F.filter("near", lambda _, i: ((i - half) % gap == 0) & (F.abs(i - half) <= k // 2 * gap))
    centers = placed.withColumn("near", near).where((F.col("pos") >= half) & (F.col("pos") <= F.col("n") - half - 1) & ((F.col("pos") - half) % (1 if test else stride) == 0))
    return centers.select(series, F.col(idx).alias("center"), pick(n_images).alias("image_idx"), pick(n_labels).alias("label_idx"))


def random_slices_per_scan(phases: DataFrame, k: int, seed: int) -> DataFrame:
    """k seeded slices (fewer if there are no more) of each normal, annotated scan, with its annotated slice."""
    s = _slices(phases.where((F.col("status") == "normal") & F.col("label_index").isNotNull()))
    return s.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(md5_order([*KEYS, "idx"], seed), "idx"))).where(F.col("r") <= k).select(*KEYS, "idx", "label_index")


def relative_index_target(samples: DataFrame, kind: str = "normal", clip: int | None = None) -> DataFrame:
    """target = idx - annotated index, its absolute value (abs) or its sign (binary); clipped to +-(clip - 1)."""
    d = F.col("idx") - F.col("label_index")
    t = {"normal": d, "abs": F.abs(d), "binary": F.signum(d).cast("int")}[kind]
    return samples.withColumn("target", t if clip is None else F.greatest(F.least(t, F.lit(clip - 1)), F.lit(1 - clip)))


def relative_y_target(slices: DataFrame, phases: DataFrame, lo: float, hi: float, k: int, seed: int) -> DataFrame:
    """(patient, phase, idx, target): k seeded slices of a scan whose Y minus the label's lies in [lo, hi]; target = int(residual + series minimum + 1)."""
    ends = slices.groupBy(*KEYS).agg(F.min("y").alias("y_min"))
    s = slices.join(phases.where(F.col("label_y").isNotNull()).select(*KEYS, "label_y"), list(KEYS)).join(ends, list(KEYS)).withColumn("res", F.col("y") - F.col("label_y")).where(F.col("res").between(lo, hi))
    chosen = s.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(md5_order([*KEYS, "idx"], seed), "idx"))).where(F.col("r") <= k)
    return chosen.select(*KEYS, "idx", (F.col("res") + F.col("y_min") + 1).cast("int").alias("target"))


def relative_position_label(df: DataFrame, start: str, slice_: str, end: str) -> DataFrame:
    """label = (start - slice) / ((slice - end) + 1) / 10; invalid (label null) if start = end or the divisor is 0."""
    s, x, e = F.col(start), F.col(slice_), F.col(end)
    valid = F.coalesce((s != e) & (x - e + 1 != 0), F.lit(False))
    return df.select("*", F.when(valid, (s - x).cast("double") / (x - e + 1) / 10).alias("label"), valid.alias("valid"))
