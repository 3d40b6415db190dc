"""Volume kernels: numpy inside mapInPandas, one volume a row, for what needs a neighbourhood or random access.

A volume row has series_id, shape (d, h, w), voxels (flat, z-y-x order), and what the kernel needs besides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.workers import share_package


def _one_at_a_time(df: DataFrame) -> DataFrame:
    """A volume may have 10**8 voxels: Spark ends an Arrow batch at spark.sql.execution.arrow.maxBytesPerBatch (64 MB), so large ones come alone."""
    share_package(df.sparkSession)
    return df


def resample_image_linear(volumes: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Trilinear to a target spacing: series_id, shape, spacing, voxels; new size int(size spacing / new) - 1, at least 1.

    Rows with null or mismatched voxels give null voxels.
    """
    target = np.asarray(spacing, float)

    def one(shape, old, voxels):
        shape, old = np.asarray(shape, int), np.asarray(old, float)
        size = np.maximum(1, (shape * old / target).astype(int) - 1)
        if voxels is None or len(voxels) != shape.prod():
            return size, None
        v = np.asarray(voxels, float).reshape(shape)
        for axis in range(3):
            at = np.minimum(np.arange(size[axis]) * target[axis] / old[axis], shape[axis] - 1)
            lo = at.astype(int)
            hi = np.minimum(lo + 1, shape[axis] - 1)
            part = (at - lo).reshape([-1 if a == axis else 1 for a in range(3)])
            v = v.take(lo, axis) * (1 - part) + v.take(hi, axis) * part
        return size, v.ravel()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [one(s, p, v) for s, p, v in zip(pdf["shape"], pdf["spacing"], pdf["voxels"])]
            yield pd.DataFrame({"series_id": pdf["series_id"], "shape": [s.astype(np.int32) for s, _ in done], "spacing": [target] * len(done), "voxels": [v for _, v in done]})

    kind = volumes.schema["series_id"].dataType.simpleString()
    return _one_at_a_time(volumes.select("series_id", "shape", "spacing", "voxels")).mapInPandas(run, f"series_id {kind}, shape array<int>, spacing array<double>, voxels array<double>")


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x * x) / (2 * sigma * sigma))
    return k / k.sum()


def _blur(grid: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    half = len(kernel) // 2
    for axis in range(2):
        wide = np.pad(grid, [(half, half) if a == axis else (0, 0) for a in range(2)], mode="reflect" if grid.shape[axis] > half else "symmetric")
        grid = sum(k * wide.take(np.arange(i, i + grid.shape[axis]), axis) for i, k in enumerate(kernel))
    return grid


def gaussian_blur(grids: DataFrame, key: str, kernel: int, sigma: float, amplify: float = 1.0) -> DataFrame:
    """(key, height, width, grid) blurred by a separable Gaussian (odd kernel, borders mirrored without repeating the edge) and amplified."""
    k = gaussian_kernel(kernel, sigma)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["grid"] = [None if g is None else (_blur(np.asarray(g, float).reshape(h, w), k) * amplify).ravel() for g, h, w in zip(pdf["grid"], pdf["height"], pdf["width"])]
            yield pdf

    kind = grids.schema[key].dataType.simpleString()
    return _one_at_a_time(grids.select(key, "height", "width", "grid")).mapInPandas(run, f"{key} {kind}, height int, width int, grid array<double>")


def _draw(seed: int, *keys) -> float:
    return int(hashlib.md5("|".join(map(str, [*keys, seed])).encode()).hexdigest()[:12], 16) / float(1 << 48)


def random_crops(volumes: DataFrame, crop: Sequence[int], ratio: float, cat_max: float, std_min: float, ensure: Sequence[int] = (), seed: int = 0, tries: int = 32, invert: bool = False) -> DataFrame:
    """Seeded crops of volumes (series_id, shape, voxels, labels): int(prod(shape) / prod(crop) ratio) a volume.

    A box is drawn again, `tries` times at most, while one class has more than cat_max of it or its
    standard deviation is below std_min; the last draw stays. Crops without any class of `ensure`
    are left out (`invert`: those with one). Volumes smaller than the crop give none; null labels
    give null label and classes.
    """
    box = np.asarray(crop, int)

    def crops(series, shape, voxels, labels):
        shape = np.asarray(shape, int)
        if voxels is None or (shape < box).any():
            return
        img = np.asarray(voxels, float).reshape(shape)
        lab = None if labels is None else np.asarray(labels, int).reshape(shape)
        for i in range(int(shape.prod() / box.prod() * ratio)):
            for t in range(tries):
                at = np.array([int(_draw(seed, series, i, t, a) * (shape[a] - box[a] + 1)) for a in range(3)])
                cut = tuple(slice(b, b + s) for b, s in zip(at, box))
                part, mask = img[cut], None if lab is None else lab[cut]
                share = 0 if mask is None else np.unique(mask, return_counts=True)[1].max() / mask.size
                if share <= cat_max and part.std() >= std_min:
                    break
            classes = None if mask is None else np.unique(mask)
            if ensure and classes is not None and bool(np.isin(classes, list(ensure)).any()) == invert:
                continue
            yield i, [int(x) for pair in zip(at, at + box) for x in pair], part.ravel(), None if mask is None else mask.ravel(), classes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows = list(crops(r.series_id, r.shape, r.voxels, r.labels))
                if rows:
                    i, b, v, m, c = zip(*rows)
                    yield pd.DataFrame({"series_id": [r.series_id] * len(rows), "patch_id": i, "bbox": b, "img": v, "label": m, "classes": c})

    kind = volumes.schema["series_id"].dataType.simpleString()
    return _one_at_a_time(volumes.select("series_id", "shape", "voxels", "labels")).mapInPandas(run, f"series_id {kind}, patch_id int, bbox array<int>, img array<double>, label array<int>, classes array<int>")


def two_means(values: np.ndarray, counts: np.ndarray) -> float | None:
    """The cut (last value of the lower cluster) of the best two clusters of counted sorted values; None for a single value.

    Costs of cuts that tie differ by rounding alone: terms are added in the order of the query's SQL, so that both pick the same cut; equal sums go to the lower one.
    """
    if len(values) < 2:
        return None
    n, s, q = np.cumsum(counts), np.cumsum(values * counts), np.cumsum(values * values * counts)
    ln, ls, lq, rn, rs = n[:-1], s[:-1], q[:-1], n[-1] - n[:-1], s[-1] - s[:-1]
    cost = lq - ls * ls / ln + q[-1] - lq - rs * rs / rn
    return float(values[int(np.argmin(cost))])


def muscle_fat_split(voxels: DataFrame, classes: Sequence[int] = (1, 2), lo: float = -190, hi: float = -30, hu: str = "hu", label: str = "label") -> DataFrame:
    """2-means on the HU of a class per series; voxels of the lower cluster with lo < HU <= hi become class 5 (from the first class), 6 (from the second).

    The exact optimum on the histogram (series, class, hu, count); a class of one voxel or one value stays as it is.
    """
    share_package(voxels.sparkSession)
    counted = voxels.where(F.col(label).isin(*classes) & F.col(hu).isNotNull()).groupBy("series_id", F.col(label).alias("c"), F.col(hu).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        at = two_means(pdf["v"].to_numpy(), pdf["n"].to_numpy(float))
        return pdf.head(1)[["series_id", "c"]].assign(cut=at) if at is not None else pdf.head(0)[["series_id", "c"]].assign(cut=0.0)

    kind, ckind = voxels.schema["series_id"].dataType.simpleString(), voxels.schema[label].dataType.simpleString()
    cuts = counted.groupBy("series_id", "c").applyInPandas(cut, f"series_id {kind}, c {ckind}, cut double")
    out = voxels.join(cuts.withColumnRenamed("c", "__c"), (voxels["series_id"] == cuts["series_id"]) & (F.col(label) == F.col("__c")), "left").drop(cuts["series_id"])
    fat = F.coalesce((F.col(hu) <= F.col("cut")) & (F.col(hu) > lo) & (F.col(hu) <= hi), F.lit(False))
    new = F.when(fat & (F.col(label) == classes[0]), 5).when(fat, 6).otherwise(F.col(label))
    return out.withColumn(label, new).select(*voxels.columns)
