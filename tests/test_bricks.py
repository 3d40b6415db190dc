"""Brick kernels against the kernels on whole volumes: borders that cut a blur, a trilinear cell and a crop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import bricks as B
from voxelframe.operators import crops as C
from voxelframe.operators import kernels as K

SHAPES = [(5, 7, 6), (1, 9, 4), (8, 3, 3), (4, 4, 4), (1, 1, 1)]


@pytest.fixture(scope="module")
def volumes(spark):
    r = np.random.default_rng(0)
    rows = []
    for i, s in enumerate(SHAPES):
        v = r.normal(50, 20, s).round(3)
        rows.append((f"s{i}", list(s), [1.0, 0.7 + i / 10, 2.0], v.ravel().tolist(), r.integers(0, 3, int(np.prod(s))).tolist()))
    rows += [("null", [2, 2, 2], [1.0, 1.0, 1.0], None, None), ("short", [2, 2, 2], [1.0, 1.0, 1.0], [1.0], None), (None, [2, 2, 2], [1.0, 1.0, 1.0], [float(x) for x in range(8)], None)]
    return spark.createDataFrame(rows, "series_id string, shape array<int>, spacing array<double>, voxels array<double>, labels array<int>")


def cube_of(bricks, edge):
    out = {}
    for r in bricks.collect():
        cube = out.setdefault(r["series_id"], np.full(r["shape"], np.nan))
        size = [min(edge, n - p * edge) for n, p in zip(r["shape"], (r["bz"], r["by"], r["bx"]))]
        cube[tuple(slice(p * edge, p * edge + s) for p, s in zip((r["bz"], r["by"], r["bx"]), size))] = np.reshape(r["voxels"], size)
    return out


def whole(df):
    return {r["series_id"]: np.reshape(r["voxels"], r["shape"]) for r in df.collect() if r["voxels"] is not None}


@pytest.mark.parametrize("edge", [1, 2, 3, 64])
def test_there_and_back(spark, volumes, edge):
    bricks = B.from_volumes(volumes, edge)
    got, want = cube_of(bricks, edge), {r["series_id"]: np.reshape(r["voxels"], r["shape"]) for r in volumes.collect() if r["series_id"] not in ("null", "short")}
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
    assert bricks.agg(F.max(F.size("voxels"))).first()[0] <= edge**3
    voxels = B.to_voxels(bricks, edge, "hu")
    shapes = volumes.select("series_id", *[F.col("shape")[i].alias(n) for i, n in enumerate(("depth", "height", "width"))])
    outside = spark.createDataFrame([("s0", 99, 0, 0, 1.0), ("s0", None, 0, 0, 1.0), ("s0", 0, 0, 0, None), ("zz", 0, 0, 0, 1.0), ("s0", 0, 0, 0, -1e9)], "series_id string, z int, y int, x int, hu double")
    back = cube_of(B.from_voxels(voxels.unionByName(outside), shapes, "hu", edge), edge)
    assert all(np.array_equal(back[k], want[k]) for k in want if k is not None) and None not in back
    sparse = cube_of(B.from_voxels(voxels.where("series_id = 's0' and x < 2"), shapes, "hu", edge, fill=-7.0), edge)["s0"]
    assert np.array_equal(sparse[..., :2], want["s0"][..., :2]) and set(np.unique(sparse[..., 2:][~np.isnan(sparse[..., 2:])])) <= {-7.0}


@pytest.mark.parametrize("edge,spacing", [(2, [0.6, 0.9, 1.3]), (3, [2.5, 0.35, 2.0]), (64, [0.6, 0.9, 1.3]), (4, [1.0, 1.0, 2.0])])
def test_resampling_equals_that_of_whole_volumes(volumes, edge, spacing):
    got, want = cube_of(B.resample_linear(B.from_volumes(volumes, edge), spacing, edge), edge), whole(K.resample_image_linear(volumes, spacing))
    assert got.keys() == want.keys() and all(got[k].shape == want[k].shape and np.allclose(got[k], want[k], rtol=1e-12, atol=0) for k in want)


@pytest.mark.parametrize("edge,kernel", [(2, 3), (3, 5), (4, 7), (64, 3), (1, 3)])
def test_blur_equals_that_of_whole_grids(spark, volumes, edge, kernel):
    flat = volumes.where("shape[0] = 1")
    grids = flat.select("series_id", F.col("shape")[1].alias("height"), F.col("shape")[2].alias("width"), F.col("voxels").alias("grid"))
    want = {r["series_id"]: np.reshape(r["grid"], (1, r["height"], r["width"])) for r in K.gaussian_blur(grids, "series_id", kernel, 1.3, 2.0).collect()}
    got = cube_of(B.gaussian_blur(B.from_volumes(flat, edge), kernel, 1.3, 2.0, edge=edge), edge)
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)


def test_blur_along_all_axes_and_missing_bricks(volumes):
    full = cube_of(B.gaussian_blur(B.from_volumes(volumes, 64), 3, 1.0, axes=("z", "y", "x")), 64)["s0"]
    cut = cube_of(B.gaussian_blur(B.from_volumes(volumes, 2), 3, 1.0, axes=("z", "y", "x"), edge=2), 2)["s0"]
    assert np.allclose(full, cut, rtol=1e-12)
    some = B.from_volumes(volumes.where("series_id = 's0'"), 2).where("bx < 2")
    out = cube_of(B.gaussian_blur(some, 3, 1.0, edge=2, fill=0.0), 2)["s0"]
    want = np.array(volumes.where("series_id = 's0'").first()["voxels"]).reshape(SHAPES[0])
    want[..., 4:] = 0
    k = K.gaussian_kernel(3, 1.0)
    assert np.allclose(out[..., :4], np.stack([K._blur(p, k) for p in want])[..., :4])


@pytest.mark.parametrize("edge", [2, 3, 64])
def test_crops_equal_those_of_whole_volumes(volumes, edge):
    plain = volumes.where("labels is not null or series_id is null")
    bricks = B.with_labels(B.from_volumes(plain, edge), B.from_volumes(plain.withColumn("voxels", F.col("labels")), edge))
    for o in ({"cat_max": 1.0, "std_min": 0.0}, {"cat_max": 0.5, "std_min": 18.0, "tries": 5}, {"cat_max": 0.4, "std_min": 0.0, "ensure": [2], "tries": 3}, {"cat_max": 1.0, "std_min": 0.0, "ensure": [7], "invert": True}):
        want = K.random_crops(plain.where("series_id is not null"), [2, 3, 2], 1.7, seed=4, **o)
        got = C.random_crops(bricks, plain, [2, 3, 2], 1.7, seed=4, edge=edge, **o)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    assert C.random_crops(bricks.limit(0), plain.limit(0), [2, 2, 2], 1.0, 1.0, 0.0, edge=edge).count() == 0


def test_crops_without_labels(volumes):
    bricks = B.from_volumes(volumes, 3).withColumn("labels", F.lit(None).cast("array<int>"))
    got = C.random_crops(bricks, volumes, [2, 2, 2], 1.0, 0.0, 0.0, ensure=[1], seed=2, edge=3).collect()
    assert got and all(r["label"] is None and r["classes"] is None and len(r["img"]) == 8 for r in got)


def test_large_means_do_not_cancel(spark):
    v = (1e9 + np.random.default_rng(1).normal(0, 1, 512)).tolist()
    vol = spark.createDataFrame([("a", [8, 8, 8], [1.0] * 3, v, [0] * 512)], "series_id string, shape array<int>, spacing array<double>, voxels array<double>, labels array<int>")
    bricks = B.with_labels(B.from_volumes(vol, 5), B.from_volumes(vol.withColumn("voxels", F.col("labels")), 5))
    o = {"cat_max": 1.0, "std_min": 1.0, "seed": 1}
    assert sorted(map(str, C.random_crops(bricks, vol, [4, 4, 4], 1.0, edge=5, **o).collect())) == sorted(map(str, K.random_crops(vol, [4, 4, 4], 1.0, **o).collect()))
