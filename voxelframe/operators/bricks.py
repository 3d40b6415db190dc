"""Volumes as bricks: a row holds a cube of voxels, so a volume of any size spreads over tasks.

A brick row has series_id, shape and spacing of the whole volume (z, y, x), the brick's place bz,
by, bx (its first voxel divided by the edge) and voxels, flat in z-y-x order; bricks at the end of a
volume are smaller. A kernel that looks beyond a brick's border gets what it needs by an exchange:
each brick sends to every target brick the part that this one reads, and nothing else moves.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.workers import share_package
from voxelframe.operators.kernels import gaussian_kernel

EDGE = 64
AXES = ("z", "y", "x")
PLACE = ("bz", "by", "bx")
KEYS = ("series_id", *PLACE)
ORIGIN, SIZE = ("oz", "oy", "ox"), ("nz", "ny", "nx")
#: For each target brick of an axis: its first target, one past its last, and the range of sources that it reads.
Reads = list[tuple[int, int, int, int]]


def _kind(df: DataFrame) -> str:
    return df.schema["series_id"].dataType.simpleString()


def _schema(df: DataFrame) -> str:
    return f"series_id {_kind(df)}, shape array<int>, spacing array<double>, bz int, by int, bx int, voxels array<double>"


def _column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def _rows(series: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """rows: (number in series, shape, spacing, bz, by, bx, voxels)."""
    at, shape, spacing, bz, by, bx, voxels = zip(*rows)
    flat = lambda xs, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate(xs).astype(kind)))
    names = ["series_id", "shape", "spacing", *PLACE, "voxels"]
    return pa.RecordBatch.from_arrays([series.take(pa.array(at)), flat(shape, np.int32), flat(spacing, np.float64), *[pa.array(x, pa.int32()) for x in (bz, by, bx)], flat(voxels, np.float64)], names)


def from_volumes(volumes: DataFrame, edge: int = EDGE) -> DataFrame:
    """Bricks of volume rows (series_id, shape, spacing, voxels) that fit a row; rows with null or mismatched voxels have none."""
    share_package(volumes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes, spacings, rows, values = _column(b, "shape").to_pylist(), _column(b, "spacing").to_pylist(), [], 0
            for i, (shape, spacing) in enumerate(zip(shapes, spacings)):
                voxels = _cell(b, "voxels", i)
                if shape is None or voxels is None or int(np.prod(shape)) != len(voxels):
                    continue
                cube = voxels.astype(np.float64).reshape(shape)
                for place in np.ndindex(*(-(-n // edge) for n in cube.shape)):
                    part = cube[tuple(slice(p * edge, (p + 1) * edge) for p in place)]
                    rows.append((i, shape, spacing or [], *place, part.ravel()))
                    values += part.size
                    if values > 1 << 20:
                        yield _rows(_column(b, "series_id"), rows)
                        rows, values = [], 0
            if rows:
                yield _rows(_column(b, "series_id"), rows)

    return volumes.select("series_id", F.col("shape").cast("array<int>"), F.col("spacing").cast("array<double>"), F.col("voxels").cast("array<double>")).mapInArrow(run, _schema(volumes))


def from_voxels(voxels: DataFrame, shapes: DataFrame, value: str = "hu", edge: int = EDGE, fill: float = 0.0) -> DataFrame:
    """Bricks of a voxel table (series_id, z, y, x, value) with shapes (series_id, depth, height, width).

    Voxels without a row are `fill`; bricks without any voxel have no row. Voxels outside their
    shape, of a series without one, with a null place or value do not count; of repeated voxels the
    largest counts. A group is one brick, so it is bounded.
    """
    share_package(voxels.sparkSession)
    inside = [F.col(a).between(0, F.col(n) - 1) for a, n in zip(AXES, ("depth", "height", "width"))]
    known = voxels.join(shapes.select("series_id", "depth", "height", "width"), "series_id").where(inside[0] & inside[1] & inside[2] & F.col(value).isNotNull())
    placed = known.select("series_id", F.array("depth", "height", "width").cast("array<int>").alias("shape"), *[F.floor(F.col(a) / edge).cast("int").alias(p) for a, p in zip(AXES, PLACE)], *[(F.col(a) % edge).cast("int").alias(a) for a in AXES], F.col(value).cast("double").alias("v"))

    def build(t: pa.Table) -> pa.Table:
        shape, place = t["shape"][0].as_py(), [t[p][0].as_py() for p in PLACE]
        size = [min(edge, n - p * edge) for n, p in zip(shape, place)]
        cube = np.full(size, -np.inf)
        np.maximum.at(cube, tuple(t[a].to_numpy() for a in AXES), t["v"].to_numpy())
        seen = np.zeros(size, bool)
        seen[tuple(t[a].to_numpy() for a in AXES)] = True
        return pa.Table.from_batches([_rows(t["series_id"].combine_chunks().slice(0, 1), [(0, shape, [], *place, np.where(seen, cube, fill).ravel())])])

    return placed.groupBy(*KEYS).applyInArrow(build, _schema(voxels))


def with_labels(bricks: DataFrame, masks: DataFrame) -> DataFrame:
    """bricks with a column labels: the voxels of masks' bricks of the same place as integers, null where there is none."""
    own = masks.select(*KEYS, F.transform("voxels", lambda x: x.cast("int")).alias("labels"))
    return bricks.join(own, list(KEYS), "left")


def to_voxels(bricks: DataFrame, edge: int = EDGE, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """series_id, the columns to keep, z, y, x, value of every voxel of every brick."""
    size = [F.least(F.lit(edge), F.col("shape")[i] - F.col(p) * edge) for i, p in enumerate(PLACE)]
    pos = bricks.select("series_id", *keep, *PLACE, *[s.alias(f"s{i}") for i, s in enumerate(size)], F.posexplode("voxels").alias("pos", value))
    at = [F.floor(F.col("pos") / (F.col("s1") * F.col("s2"))), F.floor(F.col("pos") / F.col("s2")) % F.col("s1"), F.col("pos") % F.col("s2")]
    return pos.select("series_id", *keep, *[(F.col(p) * edge + x).cast("int").alias(a) for p, x, a in zip(PLACE, at, AXES)], value)


class _Parts:
    """Rows to send: columns of the row that each came from, arrays, and integers; gathered up to a few million values a batch."""

    def __init__(self, b: pa.RecordBatch, keep: Sequence[str], names: Sequence[str]):
        self.b, self.keep, self.names, self.rows = b, keep, names, []
        self.values = 0

    def add(self, i: int, arrays: list, numbers: list) -> None:
        self.rows.append((i, arrays, numbers))
        self.values += sum(x.size for x in arrays if x is not None)

    def full(self) -> bool:
        return self.values > 1 << 20 or len(self.rows) >= 5000

    def batch(self, numbers: Sequence[str]) -> pa.RecordBatch:
        at = pa.array([i for i, _, _ in self.rows])
        out = [_column(self.b, n).take(at) for n in self.keep]
        for k in range(len(self.names)):
            cells = [x[k] for _, x, _ in self.rows]
            flat = [x.ravel() for x in cells if x is not None] or [np.zeros(0)]
            ends = np.cumsum([0, *(0 if x is None else x.size for x in cells)])
            gone = np.array([x is None for x in cells])
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)), mask=pa.array(gone)))
        out += [pa.array(x, pa.int32()) for x in zip(*(n for _, _, n in self.rows))]
        self.rows, self.values = [], 0
        return pa.RecordBatch.from_arrays(out, [*self.keep, *self.names, *numbers])


def _cell(b: pa.RecordBatch, name: str, i: int) -> np.ndarray | None:
    cell = _column(b, name)[i]
    return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else None


def parts_of(t: pa.Table, name: str) -> Iterator[tuple[np.ndarray | None, list[int], list[int]]]:
    """(values, origin, size) of the parts that a group received."""
    places = list(zip(*(t[c].to_pylist() for c in (*ORIGIN, *SIZE))))
    cells = (x for chunk in t[name].chunks for x in chunk)
    for cell, p in zip(cells, places):
        yield cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else None, p[:3], p[3:]


def exchange(bricks: DataFrame, edge: int, reads: Callable[[Sequence[int], Sequence[float]], list[Reads]], kernel: Callable, fill: float = 0.0) -> DataFrame:
    """Target bricks, each made from the parts of the source bricks that it reads.

    reads(shape, spacing) gives the target bricks of each axis; kernel(block, at, targets, shape,
    spacing) gets the block of sources that a target brick reads, the block's first source on each
    axis and the targets' ranges, and returns (voxels, new shape, new spacing). Sources without a
    brick are `fill`. A shuffled row is a part of a brick, a group is what one target brick reads.
    """
    share_package(bricks.sparkSession)
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            out = _Parts(b, ("series_id", "shape", "spacing"), ("part",))
            shapes, spacings, places = _column(b, "shape").to_pylist(), _column(b, "spacing").to_pylist(), list(zip(*(_column(b, p).to_pylist() for p in PLACE)))
            for i, (shape, spacing, place) in enumerate(zip(shapes, spacings, places)):
                size = [min(edge, n - p * edge) for n, p in zip(shape, place)]
                cube = _cell(b, "voxels", i).reshape(size)
                if (key := (*shape, *spacing)) not in known:
                    known = {key: reads(shape, spacing)}  # rows of a series come together
                served = [[(k, max(lo, p * edge), min(hi, p * edge + s)) for k, (_, _, lo, hi) in enumerate(axis) if lo < p * edge + s and hi > p * edge] for axis, p, s in zip(known[key], place, size)]
                for to in itertools.product(*served):
                    lo, hi = [x[1] for x in to], [x[2] for x in to]
                    cut = cube[tuple(slice(a - p * edge, z - p * edge) for a, z, p in zip(lo, hi, place))]
                    out.add(i, [cut], [*(x[0] for x in to), *lo, *cut.shape])
                    if out.full():
                        yield out.batch((*PLACE, *ORIGIN, *SIZE))
            if out.rows:
                yield out.batch((*PLACE, *ORIGIN, *SIZE))

    def make(t: pa.Table) -> pa.Table:
        shape, spacing, place = t["shape"][0].as_py(), t["spacing"][0].as_py(), [t[p][0].as_py() for p in PLACE]
        ranges = [axis[p] for axis, p in zip(reads(shape, spacing), place)]
        at = [lo for _, _, lo, _ in ranges]
        block = np.full([hi - lo for _, _, lo, hi in ranges], float(fill))
        for part, o, n in parts_of(t, "part"):
            block[tuple(slice(x - a, x - a + s) for x, a, s in zip(o, at, n))] = part.reshape(n)
        voxels, new, step = kernel(block, at, [r[:2] for r in ranges], shape, spacing)
        return pa.Table.from_batches([_rows(t["series_id"].combine_chunks().slice(0, 1), [(0, new, step, *place, voxels.ravel())])])

    parts = bricks.select(*[f for f in ("series_id", "shape", "spacing", *PLACE, "voxels")]).mapInArrow(send, f"series_id {_kind(bricks)}, shape array<int>, spacing array<double>, part array<double>, {", ".join(f"{x} int" for x in (*PLACE, *ORIGIN, *SIZE))}")
    return parts.groupBy(*KEYS).applyInArrow(make, _schema(bricks))


def _steps(n: int, size: int, new: float, old: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower source, upper source and the upper one's share of n targets at distance new on an axis of sources at distance old."""
    at = np.minimum(np.arange(n) * new / old, size - 1)
    lo = at.astype(int)
    return lo, np.minimum(lo + 1, size - 1), at - lo


def resample_linear(bricks: DataFrame, spacing: Sequence[float], edge: int = EDGE, fill: float = 0.0) -> DataFrame:
    """Trilinear to a target spacing, brick by brick; the new size is int(size spacing / new) - 1, at least 1, as for volume rows.

    Bricks of the result have the same edge. A missing brick counts as `fill`; where all of a
    target's sources are missing it has no brick. Rows without a spacing are an error.
    """
    target = [float(x) for x in spacing]

    def size(shape, old):
        if len(old) != 3:
            raise ValueError("resample_linear needs the spacing of every volume")
        return np.maximum(1, (np.asarray(shape) * np.asarray(old, float) / np.asarray(target)).astype(int) - 1)

    def reads(shape, old):
        out = []
        for new, n, t, o in zip(size(shape, old), shape, target, old):
            lo, hi, _ = _steps(new, n, t, o)
            out.append([(a, min(a + edge, new), int(lo[a]), int(hi[min(a + edge, new) - 1]) + 1) for a in range(0, int(new), edge)])
        return out

    def kernel(block, at, targets, shape, old):
        new = size(shape, old)
        for axis, ((a, z), first) in enumerate(zip(targets, at)):
            lo, hi, part = (x[a:z] for x in _steps(new[axis], shape[axis], target[axis], old[axis]))
            part = part.reshape([-1 if i == axis else 1 for i in range(3)])
            block = block.take(lo - first, axis) * (1 - part) + block.take(hi - first, axis) * part
        return block, new.tolist(), target

    return exchange(bricks, edge, reads, kernel, fill)


def gaussian_blur(bricks: DataFrame, kernel: int, sigma: float, amplify: float = 1.0, axes: Sequence[str] = ("y", "x"), edge: int = EDGE, fill: float = 0.0) -> DataFrame:
    """Separable Gaussian (odd kernel) along the axes, then amplified, brick by brick.

    Borders are mirrored without repeating the edge, and with it where an axis is not longer than
    half the kernel, as for grid rows. A missing brick counts as `fill`.
    """
    k, half = gaussian_kernel(kernel, sigma), kernel // 2
    along = [a in axes for a in AXES]

    def reads(shape, spacing):
        wide = [half if on else 0 for on in along]
        return [[(a, min(a + edge, n), max(0, a - w), min(n, a + edge + w)) for a in range(0, n, edge)] for n, w in zip(shape, wide)]

    def blur(block, at, targets, shape, spacing):
        for axis, ((a, z), first, n, on) in enumerate(zip(targets, at, shape, along)):
            if on:
                mirrored = np.pad(np.arange(n), half, mode="reflect" if n > half else "symmetric")  # source of each place from -half on
                block = sum(w * block.take(mirrored[a + i : z + i] - first, axis) for i, w in enumerate(k))
            else:
                block = block.take(np.arange(a, z) - first, axis)
        return block * amplify, shape, spacing

    return exchange(bricks, edge, reads, blur, fill)
