"""Random crops from bricks by summed-volume tables.

All draws of all crops are made at once. In each brick that a draw touches, eight lookups in the
brick's prefix sums give the box's sum, squared deviations and voxels of each class; the parts of a
draw are added, the first draw that passes stays, and only its voxels are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.workers import share_package, written
from voxelframe.operators.bricks import EDGE, KEYS, ORIGIN, PLACE, SIZE, _cell, _column, _kind, _Parts, parts_of

STARTS, ENDS = ("z1", "y1", "x1"), ("z2", "y2", "x2")


def draws(volumes: DataFrame, crop: Sequence[int], ratio: float, seed: int, tries: int) -> DataFrame:
    """series_id, patch_id, t, z1, y1, x1: every draw of volumes (series_id, shape); the start on axis a is the md5 of series, crop, try, axis and seed."""
    shape = [F.col("shape")[a] for a in range(3)]
    number = F.floor((shape[0] * shape[1] * shape[2]).cast("double") / F.lit(float(np.prod(crop))) * F.lit(float(ratio))).cast("int")
    fits = (shape[0] >= crop[0]) & (shape[1] >= crop[1]) & (shape[2] >= crop[2]) & (number > 0)

    def start(a: int) -> Column:
        digest = F.md5(F.concat_ws("|", F.col("series_id").cast("string"), "patch_id", "t", F.lit(str(a)), F.lit(str(seed))).cast("binary"))
        return F.floor(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48)) * (shape[a] - crop[a] + 1)).cast("int")

    each = volumes.where(fits).select("series_id", "shape", F.explode(F.sequence(F.lit(0), number - 1)).alias("patch_id"))
    return each.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t")).select("series_id", "patch_id", "t", *[start(a).alias(n) for a, n in enumerate(STARTS)])


def _touched(boxes: DataFrame, crop: Sequence[int], edge: int) -> DataFrame:
    """A row for each brick that a box touches."""
    for s, p, n in zip(STARTS, PLACE, crop):
        boxes = boxes.withColumn(p, F.explode(F.sequence(F.floor(F.col(s) / edge).cast("int"), F.floor((F.col(s) + n - 1) / edge).cast("int"))))
    return boxes


def _summed(cube: np.ndarray) -> np.ndarray:
    """Prefix sums along all axes, with a plane of zeros in front of each."""
    return np.pad(cube, [(1, 0)] * 3).cumsum(0).cumsum(1).cumsum(2)


def _boxes(table: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of the boxes [lo, hi): eight lookups each."""
    out = 0
    for corner in np.ndindex(2, 2, 2):
        at = tuple(np.where(c, hi[:, a], lo[:, a]) for a, c in enumerate(corner))
        out = out + (1 if sum(corner) % 2 else -1) * table[at]
    return out


def box_sums(bricks: DataFrame, boxes: DataFrame, crop: Sequence[int], edge: int = EDGE) -> DataFrame:
    """series_id, patch_id, t, cls, n, s, q of each box and brick: with a null cls voxels, sum and squares about the series' mean; else the voxels of the class."""
    share_package(bricks.sparkSession)
    center = bricks.groupBy("series_id").agg((F.sum(F.aggregate("voxels", F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size("voxels"))).alias("center"))
    near = _touched(boxes.join(center, "series_id"), crop, edge).groupBy(*KEYS, "center").agg(F.collect_list(F.struct("patch_id", "t", *STARTS)).alias("box"))
    both = bricks.join(near, list(KEYS)).select("series_id", "shape", *PLACE, "voxels", "labels", "center", "box")
    size = np.asarray(crop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes, places, centers = _column(b, "shape").to_pylist(), list(zip(*(_column(b, p).to_pylist() for p in PLACE))), _column(b, "center").to_pylist()
            out: list[tuple] = []

            def batch() -> pa.RecordBatch:
                lines, patch, t, cls, n, s, q = zip(*out)
                series = _column(b, "series_id").take(pa.array(np.repeat([i for i, _ in lines], [k for _, k in lines])))
                kinds = pa.array(np.repeat([c or 0 for c in cls], [k for _, k in lines]), pa.int32(), mask=np.repeat([c is None for c in cls], [k for _, k in lines]))
                return pa.RecordBatch.from_arrays([series, pa.array(np.concatenate(patch), pa.int32()), pa.array(np.concatenate(t), pa.int32()), kinds, pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(s)), pa.array(np.concatenate(q))], ["series_id", "patch_id", "t", "cls", "n", "s", "q"])

            for i, (shape, place, center) in enumerate(zip(shapes, places, centers)):
                place = np.array(place)
                own = np.minimum(edge, np.array(shape) - place * edge)
                box = _column(b, "box")[i].values
                patch, t = box.field("patch_id").to_numpy(), box.field("t").to_numpy()
                starts = np.stack([box.field(n).to_numpy() for n in STARTS], 1) - place * edge
                lo, hi = np.clip(starts, 0, own), np.clip(starts + size, 0, own)
                cube, mask = _cell(b, "voxels", i).reshape(own) - center, _cell(b, "labels", i)
                out.append(((i, len(t)), patch, t, None, (hi - lo).prod(1), _boxes(_summed(cube), lo, hi), _boxes(_summed(cube * cube), lo, hi)))
                if mask is not None:
                    mask = mask.reshape(own)
                    for c in np.unique(mask):
                        n = _boxes(_summed((mask == c).astype(np.int64)), lo, hi)
                        seen = n > 0
                        out.append(((i, int(seen.sum())), patch[seen], t[seen], int(c), n[seen], np.zeros(seen.sum()), np.zeros(seen.sum())))
                if len(out) >= 1000:
                    yield batch()
                    out = []
            if out:
                yield batch()

    return both.mapInArrow(run, f"series_id {_kind(bricks)}, patch_id int, t int, cls int, n long, s double, q double")


def random_crops(bricks: DataFrame, volumes: DataFrame, crop: Sequence[int], ratio: float, cat_max: float, std_min: float, ensure: Sequence[int] = (), seed: int = 0, tries: int = 32, invert: bool = False, edge: int = EDGE) -> DataFrame:
    """Seeded crops of bricks (with labels, flat like voxels, or null): int(prod(shape) / prod(crop) ratio) a volume of volumes (series_id, shape).

    A box is drawn again, `tries` times at most, while one class has more than cat_max of it or its
    standard deviation is below std_min; the last draw stays. Crops without any class of `ensure`
    are left out (`invert`: those with one). Volumes smaller than the crop give none; null labels
    give null label and classes. Every brick of a volume must be there: volumes with a missing one
    give no crop that touches it. A row that moves is a part of a crop inside a brick.
    """
    full = int(np.prod(crop))
    every = written(draws(volumes, crop, ratio, seed, tries), "draws")
    parts = box_sums(bricks, every, crop, edge).groupBy("series_id", "patch_id", "t", "cls").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    own = F.col("cls").isNull()
    judged = parts.groupBy("series_id", "patch_id", "t").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.col("s"))).alias("s"), F.max(F.when(own, F.col("q"))).alias("q"), F.coalesce(F.max(F.when(~own, F.col("n"))), F.lit(0)).alias("top"),
                                                             F.sort_array(F.collect_set("cls")).alias("classes"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / full - F.col("s") * F.col("s") / (full * full)))
    good = (F.col("top") / full <= cat_max) & (spread >= std_min)
    rated = judged.where(F.col("n") == full).select("series_id", "patch_id", "t", F.when(F.size("classes") > 0, F.col("classes")).alias("classes"), good.alias("good"))
    chosen = rated.groupBy("series_id", "patch_id").agg(F.min(F.when(F.col("good"), F.col("t"))).alias("first"), F.max_by("classes", "t").alias("last_classes"), F.min_by("classes", F.when(F.col("good"), F.col("t"))).alias("first_classes"))
    kept = chosen.select("series_id", "patch_id", F.coalesce("first", F.lit(tries - 1)).alias("t"), F.when(F.col("first").isNull(), F.col("last_classes")).otherwise(F.col("first_classes")).alias("classes"))
    if ensure:
        has = F.arrays_overlap("classes", F.array(*[F.lit(int(c)) for c in ensure]))
        kept = kept.where(F.col("classes").isNull() | (has != F.lit(invert)))
    return cut(bricks, every.join(kept, ["series_id", "patch_id", "t"]).drop("t"), crop, edge)


def cut(bricks: DataFrame, boxes: DataFrame, crop: Sequence[int], edge: int = EDGE) -> DataFrame:
    """series_id, patch_id, bbox (z1, z2, y1, y2, x1, x2), img, label, classes of boxes (series_id, patch_id, z1, y1, x1, classes)."""
    share_package(bricks.sparkSession)
    size = np.asarray(crop)
    both = bricks.select("series_id", "shape", *PLACE, "voxels", "labels").join(_touched(boxes, crop, edge), list(KEYS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _Parts(b, ("series_id", "patch_id", *STARTS, "classes"), ("img", "label"))
            columns = [_column(b, n).to_pylist() for n in ("shape", *PLACE, *STARTS)]
            for i, (shape, *at) in enumerate(zip(*columns)):
                place = np.array(at[:3])
                own, start = np.minimum(edge, np.array(shape) - place * edge), np.array(at[3:]) - place * edge
                lo, hi = np.clip(start, 0, own), np.clip(start + size, 0, own)
                inside = tuple(slice(a, z) for a, z in zip(lo, hi))
                cells = [_cell(b, n, i) for n in ("voxels", "labels")]
                out.add(i, [None if x is None else x.reshape(own)[inside] for x in cells], [*(lo - start).tolist(), *(hi - lo).tolist()])
                if out.full():
                    yield out.batch((*ORIGIN, *SIZE))
            if out.rows:
                yield out.batch((*ORIGIN, *SIZE))

    def join(t: pa.Table) -> pa.Table:
        made = {}
        for name, kind in (("img", np.float64), ("label", np.int32)):
            made[name] = np.zeros(size, kind)
            for part, o, n in parts_of(t, name):
                if part is not None:
                    made[name][tuple(slice(x, x + k) for x, k in zip(o, n))] = part.reshape(n)
        bbox = [x for s, k in zip((t[c][0].as_py() for c in STARTS), crop) for x in (s, s + k)]
        lists = lambda x: pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel()))
        return pa.table({"series_id": t["series_id"].slice(0, 1), "patch_id": t["patch_id"].slice(0, 1), "bbox": pa.array([bbox], pa.list_(pa.int32())), "img": lists(made["img"]),
                         "label": lists(made["label"]) if t["label"][0].is_valid else pa.nulls(1, pa.list_(pa.int32())), "classes": t["classes"].slice(0, 1)})

    kind = _kind(bricks)
    parts = both.mapInArrow(send, f"series_id {kind}, patch_id int, z1 int, y1 int, x1 int, classes array<int>, img array<double>, label array<int>, " + ", ".join(f"{x} int" for x in (*ORIGIN, *SIZE)))
    return parts.groupBy("series_id", "patch_id").applyInArrow(join, f"series_id {kind}, patch_id int, bbox array<int>, img array<double>, label array<int>, classes array<int>")
