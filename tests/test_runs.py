"""Runs against voxels: converters, set operations and mask operators; nearest slices over several ranges."""

import random

import pytest
from pyspark.sql import functions as F

from voxelframe.operators import masks, runs, spatial, validate

PLACE = "series_id long, z int, y int, x int"


def _mask(spark, seed, width=200, classes=(0, 1, 2)):
    r = random.Random(seed)
    rows = {(s, z, y, x): r.choice(classes) for s in (1, 2) for z in (0, 1) for y in (0, 1) for x in range(-5, width) if r.random() < 0.9}
    return spark.createDataFrame([(*k, (c + k[3] // 40) % 3) for k, c in rows.items()], PLACE + ", label int")


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_round_trip_over_words_repeats_and_nulls(spark):
    full = spark.createDataFrame([(1, 0, 0, x, 1) for x in range(-70, 300)] + [(1, 0, 0, 5, 1), (1, 0, 0, 400, 1), (1, 0, 0, None, 1), (1, 0, 0, 9, None), (None, 0, 0, 9, 1), (1, 0, 0, 63, 2)], PLACE + ", label int")
    r = runs.from_voxels(full)
    assert _rows(r, "x1", "x2", "class") == sorted([(-70, 300, 1), (400, 401, 1), (63, 64, 2)], key=str)
    assert _rows(runs.to_voxels(r), *"series_id z y x class".split()) == _rows(full.dropna().distinct(), *"series_id z y x label".split())
    assert runs.from_voxels(full.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_set_operations_equal_those_of_voxels(spark, seed):
    a, b = (_mask(spark, seed + i) for i in (0, 10))
    v = [m.select("series_id", "z", "y", "x", F.col("label").alias("class")) for m in (a, b)]
    ra, rb = runs.from_voxels(a), runs.from_voxels(b)
    cols = "series_id z y x class".split()
    assert _rows(runs.to_voxels(runs.union(ra, rb)), *cols) == _rows(v[0].union(v[1]).distinct(), *cols)
    assert _rows(runs.to_voxels(runs.intersection(ra, rb)), *cols) == _rows(v[0].intersect(v[1]), *cols)
    both = runs.difference(ra, rb)
    assert _rows(runs.to_voxels(both), *cols) == _rows(v[0].exceptAll(v[1]), *cols)
    touching = both.alias("p").join(both.alias("q"), (F.col("p.x2") == F.col("q.x1")) & F.expr("p.series_id = q.series_id and p.z = q.z and p.y = q.y and p.class = q.class"))
    assert touching.count() == 0
    cols = "series_id class z y x code".split()
    assert _rows(runs.to_voxels(runs.label_difference(ra, rb)), *cols) == _rows(spatial.label_difference(a, b), *cols)


def test_mask_operators_equal_those_of_voxels(spark):
    a, b = (_mask(spark, i, 90).where("label > 0") for i in (3, 4))
    sparse = a.unionByName(b.withColumn("label", F.col("label") + 1)).select("series_id", "z", "y", "x", F.concat(F.lit("c"), "label").alias("class_name"), F.col("label").alias("k")).distinct()
    r = runs.from_voxels(sparse, "class_name").withColumn("k", F.substring("class", 2, 1).cast("int"))
    cols = "series_id z y x n_classes classes".split()
    assert _rows(runs.to_voxels(runs.mask_overlap(r)), *cols) == _rows(masks.mask_overlap(sparse), *cols)
    known = spark.createDataFrame([("c1", 7), ("c3", 4)], "class_name string, class_id int")
    assert _rows(runs.to_voxels(runs.merge_class_masks(r, known, "k")), "series_id", "z", "y", "x", "class") == _rows(masks.merge_class_masks(sparse, known, "k"), "series_id", "z", "y", "x", "label")
    full = _mask(spark, 8)
    assert _rows(runs.foreground_ratio(runs.from_voxels(full), ["series_id", "z"], 0.6), "series_id", "z", "fg", "area") == _rows(validate.foreground_ratio(full, ["series_id", "z"], "label", 0.6), "series_id", "z", "fg", "area")


def test_what_moves_is_words(spark):
    plan = runs.from_voxels(spark.range(1000).selectExpr("1L as series_id", "0 as z", "0 as y", "cast(id as int) as x", "1 as label"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange"):]
    assert "partial_bit_or" in below


@pytest.mark.parametrize("ranges", [None, 1, 5, 40])
def test_nearest_slice_over_ranges(spark, ranges):
    r = random.Random(5)
    groups = [None, 1, 1, 1, 1, 1, 2, 3]
    slices = [(r.choice(groups), round(r.uniform(0, 50), 1), i if i % 9 else None) for i in range(150)] + [(1, None, 999)]
    targets = [(r.choice([*groups, 4]), round(r.uniform(-5, 55), 1)) for _ in range(150)] + [(1, None), (1, 7.0), (1, 7.0)]
    want = set()
    for g, t in targets:
        near = [(abs(z - t), i) for h, z, i in slices if h == g and z is not None and i is not None] if t is not None else []
        want.add((g, t, min(near)[1] if near else None))
    s = spark.createDataFrame(slices, "g int, pos double, i long")
    got = spatial.nearest_slice(spark.createDataFrame(targets, "g int, t double"), s, ["g"], "t", "pos", "i", ranges)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
