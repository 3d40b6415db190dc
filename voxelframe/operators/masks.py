"""Label masks: merging, splitting, remapping and class maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.columns import map_of

VOXEL = ("series_id", "z", "y", "x")


def mask_overlap(mask_rows: DataFrame) -> DataFrame:
    """Per voxel of sparse class masks (series_id, z, y, x, class_name): how many classes cover it, and which."""
    return mask_rows.groupBy(*VOXEL).agg(F.array_sort(F.collect_set("class_name")).alias("classes")).select(*VOXEL, F.size("classes").alias("n_classes"), "classes")


def merge_class_masks(mask_rows: DataFrame, class_map: DataFrame, order_key: str, value: str | None = None) -> DataFrame:
    """Sparse class masks to one index per voxel: of several the last by (order_key, class_id) wins. Voxels of unknown classes are left out; see unknown_classes()."""
    rows = mask_rows if value is None else mask_rows.where(F.col(value) == 1)
    return rows.join(class_map, "class_name").groupBy(*VOXEL).agg(F.max_by("class_id", F.struct(order_key, "class_id")).alias("label"))


def unknown_classes(mask_rows: DataFrame, class_map: DataFrame) -> DataFrame:
    return mask_rows.select("class_name").distinct().join(class_map, "class_name", "left_anti")


def fill_background(labels: DataFrame, grid: DataFrame, keys: Sequence[str] = VOXEL) -> DataFrame:
    """All voxels of a grid, background 0 where there is no label."""
    return grid.join(labels, list(keys), "left").select(*keys, F.coalesce("label", F.lit(0)).alias("label"))


def split_class_masks(voxels: DataFrame, classes: Sequence[int], label: str = "label") -> DataFrame:
    """One binary mask per foreground class: channel i (from 0) is 1 where the label is classes[i]; every voxel in every channel."""
    channels = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.lit(c).alias("c")) for i, c in enumerate(classes)]))
    return voxels.withColumn("__k", channels).select("series_id", F.col("__k.channel").alias("channel"), "z", "y", "x", F.when(F.col(label) == F.col("__k.c"), 1).otherwise(0).alias("value"))


def instances_to_segmentation(instance_rows: DataFrame, slice_keys: Sequence[str], order_key: str, offset: int = 1) -> DataFrame:
    """Instance masks of a slice to class_instance + offset per pixel; the later instance wins."""
    return instance_rows.groupBy(*slice_keys, "y", "x").agg((F.max_by("class_instance", F.struct(order_key, "class_instance")) + offset).alias("label"))


def tissue_regions(voxels: DataFrame, tissues: Mapping[int, str], label: str = "label") -> DataFrame:
    """(series_id, z, tissue, n, points): pixel count and sorted coordinates of each tissue on a slice; slices with a null label are left out."""
    bad = voxels.where(F.col(label).isNull()).select("series_id", "z").distinct()
    named = voxels.withColumn("tissue", F.try_element_at(map_of(tissues), F.col(label))).where(F.col("tissue").isNotNull()).join(bad, ["series_id", "z"], "left_anti")
    return named.groupBy("series_id", "z", "tissue").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("y", "x"))).alias("points"))


def point_heatmap(points: DataFrame, patches: DataFrame) -> DataFrame:
    """Sparse counts (patch, y, x, n) of points (patch, x, y) that lie inside their patch (patch, height, width)."""
    inside = points.join(patches, "patch").where("x >= 0 and y >= 0 and x < width and y < height")
    return inside.groupBy("patch", "y", "x").agg(F.count(F.lit(1)).alias("n"))


def heatmap_total(heatmap: DataFrame) -> DataFrame:
    return heatmap.groupBy("patch").agg(F.sum("n").alias("total"))


def remap_labels(df: DataFrame, label_col: str, mapping: Mapping[int, int]) -> DataFrame:
    """Labels old -> new, all at once; others stay."""
    return df.withColumn(label_col, F.coalesce(F.try_element_at(map_of(mapping), F.col(label_col)), F.col(label_col))) if mapping else df


def class_subset_map(class_map: Mapping[str, int], subset: Sequence[str]) -> list[tuple[int, int, str]]:
    """(old_id, new_id, class_name): a class list's order gives the new ids, from 0; a class map is a small dictionary."""
    return [(class_map[c], i, c) for i, c in enumerate(subset)]


def union_atom_map(class_map: DataFrame) -> DataFrame:
    """(dataset, old_id, new_id, class_name): `union_` classes go to the atom class their name holds most often (first id on ties), atoms to contiguous ids.

    Atoms whose id does not change are not listed. Class maps are a few hundred rows a data set.
    """
    union = F.col("class_name").startswith("union_")
    atoms = class_map.where(~union).withColumn("new_id", F.row_number().over(Window.partitionBy("dataset").orderBy("class_id", "class_name")) - 1)
    pairs = class_map.where(union).join(atoms.select("dataset", F.col("class_name").alias("atom"), F.col("class_id").alias("atom_id"), "new_id"), "dataset")
    times = (F.length("class_name") - F.length(F.replace("class_name", "atom", F.lit("")))) / F.length("atom")
    best = pairs.withColumn("times", times).withColumn("r", F.row_number().over(Window.partitionBy("dataset", "class_id", "class_name").orderBy(F.desc("times"), "atom_id", "atom"))).where((F.col("r") == 1) & (F.col("times") > 0))
    return best.select("dataset", F.col("class_id").alias("old_id"), "new_id", "class_name").unionByName(atoms.where("class_id <> new_id").select("dataset", F.col("class_id").alias("old_id"), "new_id", "class_name"))


def class_rectify(voxels: DataFrame, mapping: DataFrame, dataset: str, label: str) -> DataFrame:
    """Applies union_atom_map() to (dataset, label) voxels, all at once."""
    m = mapping.groupBy(F.col("dataset").alias("__d"), F.col("old_id").alias("__o")).agg(F.min("new_id").alias("__n"))
    return voxels.join(m, (F.col(dataset) == F.col("__d")) & (F.col(label) == F.col("__o")), "left").withColumn(label, F.coalesce("__n", label)).drop("__d", "__o", "__n")


def rectify_violations(voxels: DataFrame, max_ids: DataFrame, dataset: str, label: str) -> DataFrame:
    """(dataset, label, n) of labels above the data set's last atom id (dataset, max_id)."""
    counts = voxels.groupBy(dataset, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(max_ids, dataset).where(F.col(label) > F.col("max_id")).select(dataset, label, "n")


def one_hot(df: DataFrame, label_col: str, n_classes: int, ignore: int | None = None, out: str = "one_hot") -> DataFrame:
    """Array of n_classes zeros with a one at the label; rows of the ignored label go; a null label gives zeros."""
    rows = df if ignore is None else df.where(F.col(label_col).isNull() | (F.col(label_col) != ignore))
    return rows.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: F.when(i == F.col(label_col), 1).otherwise(0)))
