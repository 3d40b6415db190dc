"""Voxel joins, slice lookups and grid geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.columns import md5_order
from voxelframe.functions.workers import written

VOXEL = ("series_id", "z", "y", "x")
AXES = ("z", "y", "x")


def slice_range_filter(voxels: DataFrame, ranges: DataFrame, series: str, z: str, mode: str = "drop", value: str = "label", shapes: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """Voxels inside the interval start <= n - 1 - z < end, counted from the top of an n-slice series; others go (drop) or become 0 (zero).

    n comes from shapes (series, depth), so masks may be sparse; a series without a shape has no
    row. dense: there are no shapes, and the last slice that occurs is the last of its series.
    A null or missing range leaves the series untouched.
    """
    if shapes is None and not dense:
        raise ValueError("slice_range_filter needs the depth of each series, or dense=True")
    depth = voxels.groupBy(series).agg((F.max(z) + 1).alias("__n")) if shapes is None else shapes.select(series, F.col("depth").alias("__n"))
    r = depth.join(ranges.select(series, F.col("start").alias("__s"), F.col("end").alias("__e")), series, "left")
    top = F.col("__n") - 1 - F.col(z)
    inside = F.coalesce((top >= F.col("__s")) & (top < F.col("__e")), F.lit(True))
    out = voxels.join(r, series)
    out = out.where(inside) if mode == "drop" else out.withColumn(value, F.when(inside, F.col(value)).otherwise(0))
    return out.drop("__n", "__s", "__e")


def nearest_within(targets: DataFrame, slices: DataFrame, by: Sequence[str], target: str, y: str, idx: str, tol: float) -> DataFrame:
    """(by, target, slice_idx, dy): the slice of the same group nearest to the target and closer than tol (ties: lower index); targets without one have no row.

    The lookup joins on cells of width tol, so a long scan is not paired with all its targets.
    """
    cell = lambda c: F.floor(c / F.lit(float(tol)))
    t = targets.select(*by, F.col(target).alias("__t")).distinct().withColumn("__c", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell(F.col("__t")) + d)))
    s = slices.select(*by, F.col(y).alias("__y"), F.col(idx).alias("__i"), cell(F.col(y)).alias("__c"))
    near = t.join(s, [*by, "__c"]).withColumn("dy", F.abs(F.col("__y") - F.col("__t"))).where(F.col("dy") < tol)
    best = near.groupBy(*by, "__t").agg(F.min(F.struct("dy", "__i")).alias("b"))
    return best.select(*by, F.col("__t").alias(target), F.col("b")["__i"].alias("slice_idx"), F.col("b")["dy"].alias("dy"))


def nearest_slice(targets: DataFrame, slices: DataFrame, by: Sequence[str], target: str, z: str, idx: str, ranges: int | None = None) -> DataFrame:
    """(by, target, slice_idx): the nearest slice of the same group, whatever its distance (ties: lower index).

    Both sides lie in ranges of (group, z), so a group of any size spreads over tasks; inside a range
    each target looks at the last slice before and the first after it. Groups that several ranges
    share get the nearest slices of the ranges before and after, at most two rows a range. The
    number of ranges follows the size of the tables unless given.
    Slices without an index or a place cannot be found and do not count; targets without a place or
    without a slice in their group have a null index.
    """
    t = targets.select(*by, F.col(target).cast("double").alias("__z"), F.lit(None).cast("long").alias("__i"), F.lit(True).alias("__t"))
    s = slices.where(F.col(idx).isNotNull() & F.col(z).isNotNull()).select(*by, F.col(z).cast("double").alias("__z"), F.col(idx).cast("long").alias("__i"), F.lit(False).alias("__t"))
    order = [*by, "__z"]
    both = t.unionByName(s)
    spread = both.repartitionByRange(ranges, *order) if ranges else both.repartitionByRange(*order)
    dealt = written(spread.withColumn("__r", F.spark_partition_id()), "nearest")  # equal places lie in one range
    places = dealt.repartition("__r", *by).groupBy("__r", *order).agg(F.min("__i").alias("__i"), F.bool_or("__t").alias("__t"))
    p = F.when(F.col("__i").isNotNull(), F.struct("__z", "__i"))
    per = places.groupBy("__r", *by).agg(F.min(p).alias("__first"), F.max(p).alias("__last"))
    g = Window.partitionBy(*by).orderBy("__r")  # a row for each range of a group
    carried = per.select("__r", *by, F.last("__last", True).over(g.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("__first", True).over(g.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    carried = carried.where(F.col("__before").isNotNull() | F.col("__after").isNotNull()).select(F.col("__r").alias("__k"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], "__before", "__after")
    w = Window.partitionBy("__r", *by).orderBy("__z")
    near = places.withColumn("__lo", F.last(p, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__hi", F.first(p, True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("__t")
    same = F.col("__r") == F.col("__k")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = near.join(F.broadcast(carried), same, "left")  # at most two rows a range
    lo, hi = F.coalesce("__lo", "__before"), F.coalesce("__hi", "__after")
    one = F.array_min(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.abs(c["__z"] - F.col("__z")).alias("d"), c["__i"].alias("i"))) for c in (lo, hi)])))
    return out.select(*by, F.col("__z").alias(target), F.when(F.col("__z").isNotNull(), one["i"]).alias("slice_idx"))


def align_image_label(image_voxels: DataFrame, label_voxels: DataFrame, value: str = "hu", label: str = "label") -> DataFrame:
    return image_voxels.select(*VOXEL, value).join(label_voxels.select(*VOXEL, label), list(VOXEL))


def label_difference(mask1: DataFrame, mask2: DataFrame, label: str = "label") -> DataFrame:
    """Per voxel and class of either mask: code 1 both, 2 only the first, 3 only the second. Background (0) and code 0 have no rows."""
    rows = mask1.select(*VOXEL, F.col(label).alias("class"), F.lit(1).alias("m")).unionByName(mask2.select(*VOXEL, F.col(label).alias("class"), F.lit(2).alias("m"))).where("class <> 0")
    codes = rows.groupBy(*VOXEL, "class").agg(F.bit_or("m").alias("m"))
    return codes.select("series_id", "class", "z", "y", "x", F.when(F.col("m") == 3, 1).when(F.col("m") == 1, 2).otherwise(3).alias("code"))


def difference_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("series_id", "class", "code").agg(F.count(F.lit(1)).alias("n"))


def resample_geometry(volumes: DataFrame, shape: str = "shape", spacing: str = "spacing", new_spacing: Sequence[float] | None = None, new_size: Sequence[int] | None = None) -> DataFrame:
    """new_size and new_spacing: by spacing int(size spacing / new) - 1, at least 1, as the resampled image has; by size spacing size / new_size."""
    s, p = F.col(shape), F.col(spacing)
    if new_spacing is not None:
        target = F.array(*[F.lit(float(x)) for x in new_spacing])
        size = F.transform(F.arrays_zip(s.alias("s"), p.alias("p"), target.alias("t")), lambda z: F.greatest(F.lit(1), F.floor(z["s"] * z["p"] / z["t"]).cast("int") - 1))
        return volumes.select("*", size.alias("new_size"), target.alias("new_spacing"))
    target = F.array(*[F.lit(int(x)) for x in new_size])
    return volumes.select("*", target.alias("new_size"), F.transform(F.arrays_zip(s.alias("s"), p.alias("p"), target.alias("t")), lambda z: z["p"] * z["s"] / z["t"]).alias("new_spacing"))


def resample_labels_nn(voxels: DataFrame, geometry: DataFrame, label: str = "label") -> DataFrame:
    """Nearest neighbour to the grid of geometry (series_id, old_d, old_h, old_w, new_d, new_h, new_w): source index floor(i old / new + 0.5), inside the volume.

    Each source voxel is sent to the targets that it serves, so only voxels move and no empty grid is built.
    """
    out = voxels.join(geometry, "series_id")
    for a, o, n in zip(AXES, ("old_d", "old_h", "old_w"), ("new_d", "new_h", "new_w")):
        i, old, new = F.col(a), F.col(o), F.col(n)
        # targets t with min(floor(t old / new + 0.5), old - 1) = i
        lo = F.greatest(F.lit(0), F.ceil((i - 0.5) * new / old).cast("int"))
        hi = F.when(i == old - 1, new - 1).otherwise(F.least(new - 1, F.ceil((i + 0.5) * new / old).cast("int") - 1))
        out = out.withColumn(f"__{a}", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    return out.select("series_id", *[F.col(f"__{a}").alias(a) for a in AXES], label)


def pad_to_size(voxels: DataFrame, shapes: DataFrame, size: Sequence[int], pad: float, value: str = "hu") -> tuple[DataFrame, DataFrame]:
    """(all voxels of the padded volumes, their shapes): symmetric padding, the smaller half in front; shapes: series_id, depth, height, width."""
    names = ("depth", "height", "width")
    left = [F.greatest(F.lit(0), F.floor((F.lit(s) - F.col(n)) / 2)).cast("int") for s, n in zip(size, names)]
    grown = shapes.select("series_id", *[F.greatest(F.col(n), F.lit(s)).alias(n) for s, n in zip(size, names)])
    moved = voxels.join(shapes, "series_id").select("series_id", *[(F.col(a) + p).cast("int").alias(a) for a, p in zip(AXES, left)], value)
    grid = grown
    for a, n in zip(AXES, names):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    return grid.select(*VOXEL).join(moved, list(VOXEL), "left").select(*VOXEL, F.coalesce(value, F.lit(pad)).alias(value)), grown


def center_crop(voxels: DataFrame, shapes: DataFrame, size: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(voxels of the centre box, shifted to 0; shapes): from centre - size // 2 on each axis; volumes smaller than the box keep their extent."""
    names = ("depth", "height", "width")
    lo = [F.greatest(F.lit(0), F.floor(F.col(n) / 2).cast("int") - s // 2) for s, n in zip(size, names)]
    out = voxels.join(shapes, "series_id")
    keep = F.lit(True)
    for a, s, b in zip(AXES, size, lo):
        keep = keep & (F.col(a) >= b) & (F.col(a) < b + s)
    moved = out.where(keep).select("series_id", *[(F.col(a) - b).cast("int").alias(a) for a, b in zip(AXES, lo)], *[c for c in voxels.columns if c not in VOXEL])
    return moved, shapes.select("series_id", *[F.least(F.col(n), F.lit(s)).alias(n) for s, n in zip(size, names)])


def cut_edge(voxels: DataFrame, shapes: DataFrame, c: int) -> tuple[DataFrame, DataFrame]:
    """c voxels less at both ends of every axis."""
    names = ("depth", "height", "width")
    keep = F.lit(True)
    for a, n in zip(AXES, names):
        keep = keep & (F.col(a) >= c) & (F.col(a) < F.col(n) - c)
    moved = voxels.join(shapes, "series_id").where(keep).select("series_id", *[(F.col(a) - c).alias(a) for a in AXES], *[x for x in voxels.columns if x not in VOXEL])
    return moved, shapes.select("series_id", *[F.greatest(F.col(n) - 2 * c, F.lit(0)).alias(n) for n in names])


def patch_grid(shapes: DataFrame, crop: Sequence[int], stride: Sequence[int]) -> DataFrame:
    """(series_id, patch_id, z1, z2, y1, y2, x1, x2): a sliding grid over (series_id, depth, height, width); the last patch is moved back inside."""
    out = shapes
    for a, n, c, s in zip(AXES, ("depth", "height", "width"), crop, stride):
        count = F.floor(F.greatest(F.col(n) - c + s - 1, F.lit(0)) / s).cast("int") + 1
        out = out.withColumn(f"{a}n", count).withColumn(f"{a}i", F.explode(F.sequence(F.lit(0), count - 1)))
        end = F.least(F.col(f"{a}i") * s + c, F.col(n))
        out = out.withColumn(f"{a}2", end).withColumn(f"{a}1", F.greatest(end - c, F.lit(0)))
    place = (F.col("zi") * F.col("yn") + F.col("yi")) * F.col("xn") + F.col("xi")
    return out.select("series_id", place.alias("patch_id"), "z1", "z2", "y1", "y2", "x1", "x2")


def _chance(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) from the keys' md5."""
    return F.conv(F.substring(md5_order(keys, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def flip(voxels: DataFrame, shapes: DataFrame, axis: str, prob: float = 1.0, seed: int = 0) -> DataFrame:
    """Mirrors an axis of the samples that the seed picks."""
    size = {"z": "depth", "y": "height", "x": "width"}[axis]
    hit = _chance(["series_id"], seed) < prob
    return voxels.join(shapes.select("series_id", F.col(size).alias("__n")), "series_id").withColumn(axis, F.when(hit, F.col("__n") - 1 - F.col(axis)).otherwise(F.col(axis))).select(*voxels.columns)


def roll(voxels: DataFrame, shapes: DataFrame, axis: str, gap: int, erase: float | None = None, value: str = "hu", prob: float = 1.0, seed: int = 0) -> DataFrame:
    """Moves an axis by gap, around the end; with `erase`, what came around gets that value."""
    size = {"z": "depth", "y": "height", "x": "width"}[axis]
    hit = _chance(["series_id"], seed) < prob
    to = F.pmod(F.col(axis) + gap, F.col("__n"))
    around = (F.col(axis) + gap < 0) | (F.col(axis) + gap >= F.col("__n"))
    out = voxels.join(shapes.select("series_id", F.col(size).alias("__n")), "series_id")
    if erase is not None:
        out = out.withColumn(value, F.when(hit & around, F.lit(erase)).otherwise(F.col(value)))
    return out.withColumn(axis, F.when(hit, to).otherwise(F.col(axis))).select(*voxels.columns)


def swap_axes(voxels: DataFrame, a: str, b: str, prob: float = 1.0, seed: int = 0) -> DataFrame:
    hit = _chance(["series_id"], seed) < prob
    return voxels.select(*[(F.when(hit, F.col(b if c == a else a)).otherwise(F.col(c)).alias(c) if c in (a, b) else F.col(c)) for c in voxels.columns])


def _box(size: Sequence[int], seed: int, tag: str = "") -> list[Column]:
    """Start of a seeded box on each axis, inside the volume."""
    return [F.floor(_chance(["series_id"], f"{seed}{tag}{a}") * F.greatest(F.col(n) - s + 1, F.lit(1))).cast("int") for a, n, s in zip(AXES, ("depth", "height", "width"), size)]


def erase_box(voxels: DataFrame, shapes: DataFrame, size: Sequence[int], pad: float, seed: int, value: str = "hu") -> DataFrame:
    """A seeded box of each volume filled with pad; erase_mask tells where."""
    inside = F.lit(True)
    for a, b, s in zip(AXES, _box(size, seed), size):
        inside = inside & (F.col(a) >= b) & (F.col(a) < b + s)
    out = voxels.join(shapes, "series_id").withColumn("erase_mask", inside)
    return out.withColumn(value, F.when(F.col("erase_mask"), F.lit(pad)).otherwise(F.col(value))).select(*voxels.columns, "erase_mask")


def erase_voxels(voxels: DataFrame, ratio: float, pad: float, seed: int, value: str = "hu") -> DataFrame:
    """Exactly int(n ratio) seeded voxels of each volume filled with pad; erase_mask tells which.

    The rank of a voxel is found in two steps, inside 64 hash ranges of a series and over them, so a large volume is spread over tasks.
    """
    h = md5_order(["series_id", "z", "y", "x"], seed)
    marked = voxels.withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(252)))
    inside = marked.withColumn("__r", F.row_number().over(Window.partitionBy("series_id", "__b").orderBy("__h", *AXES)))
    sizes = marked.groupBy("series_id", "__b").agg(F.count(F.lit(1)).alias("__k"))
    by = Window.partitionBy("series_id")
    before = sizes.select("series_id", "__b", F.coalesce(F.sum("__k").over(by.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"), F.floor(F.sum("__k").over(by) * ratio).alias("__m"))
    out = inside.join(before, ["series_id", "__b"]).withColumn("erase_mask", F.col("__r") + F.col("__o") <= F.col("__m"))
    return out.withColumn(value, F.when(F.col("erase_mask"), F.lit(pad)).otherwise(F.col(value))).select(*voxels.columns, "erase_mask")


def swap_boxes(voxels: DataFrame, shapes: DataFrame, size: Sequence[int], seed: int, value: str = "hu") -> DataFrame:
    """Exchanges the contents of two seeded boxes of each volume; boxes that overlap leave the volume as it is."""
    out = voxels.join(shapes, "series_id")
    a, b = _box(size, seed, "a"), _box(size, seed, "b")
    apart = F.lit(False)
    in_a, in_b = F.lit(True), F.lit(True)
    for ax, p, q, s in zip(AXES, a, b, size):
        apart = apart | (F.abs(p - q) >= s)
        in_a, in_b = in_a & (F.col(ax) >= p) & (F.col(ax) < p + s), in_b & (F.col(ax) >= q) & (F.col(ax) < q + s)
    to = [F.when(apart & in_a, F.col(ax) - p + q).when(apart & in_b, F.col(ax) - q + p).otherwise(F.col(ax)).alias(ax) for ax, p, q in zip(AXES, a, b)]
    return out.select("series_id", *to, *[c for c in voxels.columns if c not in VOXEL]).select(*voxels.columns)


def remove_scan_table(pixels: DataFrame, tags: DataFrame, key: str, radius: float = 600, pad: float = -1024, value: str = "hu") -> DataFrame:
    """Pixels farther than radius (mm) from the reconstruction centre become pad; tags: key, cx, cy, sx, sy (centre in pixels, pixel size). Pixels without tags stay."""
    d = F.pow((F.col("x") - F.col("cx")) * F.col("sx"), 2) + F.pow((F.col("y") - F.col("cy")) * F.col("sy"), 2)
    out = pixels.join(tags.select(key, "cx", "cy", "sx", "sy"), key, "left")
    return out.withColumn(value, F.when(d > radius * radius, F.lit(pad)).otherwise(F.col(value))).select(*pixels.columns)


def split_to_slices(voxels: DataFrame, value: str = "hu", label: str = "label") -> DataFrame:
    """(series_id, z, image, label): a row per slice, its pixels in row order."""
    px = F.sort_array(F.collect_list(F.struct("y", "x", F.col(value).alias("v"), F.col(label).alias("l"))))
    return voxels.groupBy("series_id", "z").agg(px.alias("p")).select("series_id", "z", F.col("p.v").alias("image"), F.col("p.l").alias("label"))
