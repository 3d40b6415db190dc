"""Segmentation, counting and regression metrics, and experiment reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.columns import safe_div

METRICS = ("IoU", "Acc", "Dice", "Fscore", "Precision", "Recall")


def segmentation_areas(voxels: DataFrame, gt: str, pred: str, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, class, intersect, union, pred_area, label_area); every class of the list for every `by`, zeros included.

    Voxels are first counted by (by, gt, pred), so hot classes combine before the shuffle.
    """
    counted = voxels.where(F.col(gt).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(gt).alias("__g"), F.col(pred).alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    each = counted.withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    g, p = F.col("__g") == F.col("class"), F.col("__p") == F.col("class")
    return each.groupBy(*by, "class").agg(s(g & p).alias("intersect"), s(g | p).alias("union"), s(p).alias("pred_area"), s(g).alias("label_area"))


def _metric_columns(beta: float) -> dict[str, Column]:
    i, u, p, g = (F.col(c) for c in ("intersect", "union", "pred_area", "label_area"))
    b2 = beta * beta
    return {"IoU": 100 * safe_div(i, u), "Acc": 100 * safe_div(i, g), "Dice": 100 * safe_div(2 * i, p + g), "Fscore": 100 * safe_div((1 + b2) * i, b2 * g + p), "Precision": 100 * safe_div(i, p), "Recall": 100 * safe_div(i, g)}


def segmentation_metrics(areas: DataFrame, beta: float = 1.0) -> DataFrame:
    """Per class, in percent: IoU, Acc, Dice, Fscore, Precision, Recall of summed areas; null where undefined."""
    total = areas.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("intersect", "union", "pred_area", "label_area")])
    return total.select("class", *[c.alias(k) for k, c in _metric_columns(beta).items()])


def mean_metrics(areas: DataFrame, beta: float = 1.0, digits: int = 2) -> DataFrame:
    """One row: aAcc over all classes, and the mean m<metric> of the classes where it is defined, rounded."""
    total = areas.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("intersect", "union", "pred_area", "label_area")])
    return total.agg(F.round(100 * safe_div(F.sum("intersect"), F.sum("label_area")), digits).alias("aAcc"), *[F.round(F.avg(c), digits).alias(f"m{k}") for k, c in _metric_columns(beta).items()])


def valid_class_metrics(areas: DataFrame, valid: str | Sequence[int] = "dynamic", beta: float = 1.0) -> DataFrame:
    """segmentation_metrics() over the classes that occur in the truth, or over a given list."""
    out = segmentation_metrics(areas, beta)
    if valid == "dynamic":
        return out.join(areas.groupBy("class").agg(F.sum("label_area").alias("a")).where("a > 0").select("class"), "class", "left_semi")
    return out.where(F.col("class").isin(*valid))


def per_class_report(metrics: DataFrame, digits: int = 2) -> DataFrame:
    """Class rows and a row `mean` (nulls and NaN left out), rounded."""
    cols = [c for c in metrics.columns if c != "class"]
    rows = metrics.select(F.col("class").cast("string").alias("class"), *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in cols])
    mean = rows.agg(*[F.avg(c).alias(c) for c in cols]).select(F.lit("mean").alias("class"), *cols)
    return rows.unionByName(mean).select("class", *[F.round(c, digits).alias(c) for c in cols])


def dice_accuracy_in_range(voxels: DataFrame, ranges: DataFrame, series: str, z: str, gt: str, pred: str, classes: Sequence[int], eps: float = 1.0, full_label: int = 4, shapes: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """One row: mean (1 - dice) over cases, slices and classes inside each series' slice range, and accuracy correct / (n + 1).

    ranges: (series, start, end) counted from the top slice; shapes, dense: as slice_range_filter() takes them.
    Cases whose largest true label is not full_label are skipped.
    """
    from voxelframe.operators.spatial import slice_range_filter

    inside = slice_range_filter(voxels, ranges, series, z, "drop", shapes=shapes, dense=dense).where(F.col(gt).isNotNull() & F.col(pred).isNotNull())
    counted = inside.groupBy(series, z, F.col(gt).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    full = counted.groupBy(series).agg(F.max("g").alias("m")).where(F.col("m") == full_label).select(series)
    counted = counted.join(full, series, "left_semi")
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    cls = counted.withColumn("class", F.explode(F.array(*map(F.lit, classes)))).groupBy(series, z, "class").agg(s((F.col("g") == F.col("class")) & (F.col("p") == F.col("class"))).alias("i"), s(F.col("g") == F.col("class")).alias("a"), s(F.col("p") == F.col("class")).alias("b"))
    loss = cls.select(series, (1 - (2 * F.col("i") + eps) / (F.col("a") + F.col("b") + eps)).alias("l")).groupBy(series).agg(F.avg("l").alias("l"))
    acc = counted.groupBy(series).agg((s(F.col("g") == F.col("p")) / (F.sum("n") + 1)).alias("c"))
    return loss.join(acc, series).agg(F.avg("l").alias("dice_loss"), F.avg("c").alias("accuracy"))


def count_metrics(counts: DataFrame, threshold: float = 10, abs_err: float = 3, rel_err: float = 0.3) -> DataFrame:
    """One row: MAE, MAPE (percent, of non-zero truths) and the share of patches within abs_err (truth below threshold) or rel_err."""
    d, g = F.abs(F.col("pred") - F.col("gt")), F.col("gt")
    met = F.when(g < threshold, d <= abs_err).otherwise(d <= rel_err * g)
    return counts.agg(F.avg(d).alias("mae"), (100 * F.avg(safe_div(d, g))).alias("mape"), F.avg(met.cast("double")).alias("product_met"))


def relative_position_error(df: DataFrame, pred: str, gt: str, kind: str = "l1") -> DataFrame:
    d = F.col(pred) - F.col(gt)
    return df.agg(F.avg(F.abs(d) if kind == "l1" else d * d).alias("error"))


def round_average(results: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(exp, model, class, metric, value): means over rounds; rows of a precomputed mean (class null) are left out."""
    long = results.where(F.col("class").isNotNull()).select("exp", "model", "class", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias("value")) for m in metrics])).alias("r"))
    return long.groupBy("exp", "model", "class", "r.metric").agg(F.avg("r.value").alias("value"))


def detail_pivot(avg: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(exp, model, metric) by a known list of `modality-dataset-class` columns."""
    return avg.groupBy("exp", "model", "metric").pivot("column", list(columns)).agg(F.avg("value"))


def experiment_compare(avg: DataFrame, models: Sequence[str], metrics: Sequence[str] = ("Dice", "Precision", "Recall")) -> DataFrame:
    """(modality, dataset, exp) by model_metric: class averages, null for a model that did not run."""
    cells = [F.avg(F.when((F.col("model") == m) & (F.col("metric") == k), F.col("value"))).alias(f"{m}_{k}") for m in models for k in metrics]
    return avg.groupBy("modality", "dataset", "exp").agg(*cells)


def overlap_average(patch_scores: DataFrame) -> DataFrame:
    """Patch scores (series_id, z0, y0, x0, z, y, x, class, score), coordinates within the patch, averaged per voxel and class of the volume."""
    at = [(F.col(f"{a}0") + F.col(a)).alias(a) for a in ("z", "y", "x")]
    return patch_scores.select("series_id", "class", *at, "score").groupBy("series_id", "class", "z", "y", "x").agg(F.avg("score").alias("score"))


def uncovered(scores: DataFrame, shapes: DataFrame) -> DataFrame:
    """(series_id, uncovered): voxels of the volume (series_id, depth, height, width) without a score."""
    seen = scores.select("series_id", "z", "y", "x").distinct().groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return shapes.join(seen, "series_id", "left").select("series_id", (F.col("depth").cast("long") * F.col("height") * F.col("width") - F.coalesce("n", F.lit(0))).alias("uncovered"))


def argmax_class(scores: DataFrame, keys: Sequence[str], background: int | None = None, threshold: float | None = None) -> DataFrame:
    """(keys, label): the class of the largest score, the lowest class on ties.

    With `background`: where no score is positive, that label. With `threshold` (one sigmoid
    channel): 1 above it, else 0.
    """
    if threshold is not None:
        return scores.groupBy(*keys).agg(F.max("score").alias("s")).select(*keys, F.when(F.col("s") > threshold, 1).otherwise(0).alias("label"))
    best = scores.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("class")).alias("c"))).alias("b"))
    label = -F.col("b")["c"]
    return best.select(*keys, (label if background is None else F.when(F.col("b")["score"] > 0, label).otherwise(background)).alias("label"))


def subgroup_accuracy(preds: DataFrame, group: str, gt: str, pred: str) -> DataFrame:
    """(group, acc); rows without a group or truth are skipped."""
    return preds.where(F.col(group).isNotNull() & F.col(gt).isNotNull()).groupBy(group).agg(F.avg((F.col(gt) == F.col(pred)).cast("double")).alias("acc"))


def subgroup_mean(acc: DataFrame) -> DataFrame:
    """Unweighted mean over groups."""
    return acc.agg(F.avg("acc").alias("avg"))


def position_accuracy(preds: DataFrame, group: str, label_idx: str, gt: str, pred: str) -> DataFrame:
    """(group, label_idx, class_acc)."""
    return preds.where(F.col(group).isNotNull() & F.col(gt).isNotNull()).groupBy(group, label_idx).agg(F.avg((F.col(gt) == F.col(pred)).cast("double")).alias("class_acc"))


def reconstruction_error(voxels: DataFrame, sample: str, gt: str, pred: str, eps: float = 1e-6) -> DataFrame:
    """One row: per-sample mean |d| and |d| / (gt + eps), averaged over samples; a zero divisor is left out."""
    d = F.abs(F.col(pred) - F.col(gt))
    per = voxels.groupBy(sample).agg(F.avg(d).alias("a"), F.avg(safe_div(d, F.col(gt) + eps)).alias("p"))
    return per.agg(F.avg("a").alias("mae"), F.avg("p").alias("mape"))
