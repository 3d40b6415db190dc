"""Queries of evaluation, mask, spatial, intensity and kernel operators."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from voxelframe.functions.workers import shared_folder, written
from voxelframe.operators import bricks as B
from voxelframe.operators import crops as C
from voxelframe.operators import evaluate as E
from voxelframe.operators import intensity as I
from voxelframe.operators import kernels as K
from voxelframe.operators import masks as M
from voxelframe.operators import runs as R
from voxelframe.operators import spatial as S
from voxelframe.plans.views import PIXELS, VOXELS, pixels, table, voxels
from voxelframe.sources.bucketed import co_located, write_bucketed

T = table


def _grid(s, d):
    """One voxel per (series, z, y, x): the least part of it."""
    return voxels(s, d).groupBy("series_id", "z", "y", "x").agg(F.min("hu").alias("hu"), F.max("label").alias("label"), F.max("label2").alias("label2"))


GRID = f"(SELECT series_id, z, y, x, min(hu) AS hu, max(label) AS label, max(label2) AS label2 FROM {VOXELS} GROUP BY ALL)"


def _shapes(s, d):
    return T(s, d, "orders").select(F.col("o_orderkey").alias("series_id"), (F.col("o_orderkey") % 7 + 9).cast("int").alias("depth"), F.lit(16).alias("height"), F.lit(16).alias("width"))


SHAPES = "(SELECT o_orderkey AS series_id, CAST(o_orderkey % 7 + 9 AS INTEGER) AS depth, 16 AS height, 16 AS width FROM orders)"


def _seg(s, d):
    """Truth: label; prediction: threshold of the value."""
    return pixels(s, d).select("series_id", "y", "x", F.when(F.col("label") < 5, F.when(F.col("value") > 0, 1).otherwise(0)).otherwise(2).alias("gt"), F.when(F.col("value") > 0.05, 1).when(F.col("value") < -0.15, 2).otherwise(0).alias("pred"), "value")


SEG = f"(SELECT series_id, y, x, CASE WHEN label < 5 THEN CASE WHEN value > 0 THEN 1 ELSE 0 END ELSE 2 END AS gt, CASE WHEN value > 0.05::DOUBLE THEN 1 WHEN value < -0.15::DOUBLE THEN 2 ELSE 0 END AS pred, value FROM {PIXELS})"
AREAS = f"(SELECT class, count(*) FILTER (gt = class AND pred = class) AS i, count(*) FILTER (gt = class OR pred = class) AS u, count(*) FILTER (pred = class) AS p, count(*) FILTER (gt = class) AS g FROM {SEG}, (SELECT unnest([0, 1, 2]) AS class) GROUP BY class)"
RATIOS = "round(100.0 * i / u, 6) AS \"IoU\", round(100.0 * i / g, 6) AS \"Acc\", round(200.0 * i / (p + g), 6) AS \"Dice\", round(200.0 * i / (p + g), 6) AS \"Fscore\", round(100.0 * i / p, 6) AS \"Precision\", round(100.0 * i / g, 6) AS \"Recall\""


def _areas(s, d, by=()):
    return E.segmentation_areas(_seg(s, d), "gt", "pred", [0, 1, 2], by)


def _six(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _results(s, d):
    return T(s, d, "events").select((F.col("user_id") % 4).alias("exp"), F.dayofmonth("ts").alias("round"), F.col("event_type").alias("model"), F.lit("ct").alias("modality"), (F.col("user_id") % 3).cast("string").alias("dataset"),
                                    F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 3).cast("string")).alias("class"), F.col("value").alias("Dice"), (F.col("value") * 2).alias("Precision"), (F.col("value") + 1).alias("Recall"))


RESULTS = "(SELECT user_id % 4 AS exp, event_type AS model, 'ct' AS modality, (user_id % 3)::VARCHAR AS dataset, CASE WHEN event_id % 7 <> 0 THEN (event_id % 3)::VARCHAR END AS class, value AS \"Dice\", value * 2 AS \"Precision\", value + 1 AS \"Recall\" FROM events)"


def _long(s, d):
    r = _results(s, d).where("class is not null")
    return r.select("exp", "model", "modality", "dataset", "class", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("Dice", "Precision", "Recall")])).alias("r")).select("exp", "model", "modality", "dataset", F.concat_ws("-", "modality", "dataset", "class").alias("column"), "r.metric", "r.value")


def _sparse(s, d):
    """Class masks: the voxels of each ship flag, ordered by supplier."""
    v = _grid(s, d)
    a = v.where("label > 0").select("series_id", "z", "y", "x", F.concat(F.lit("c"), "label").alias("class_name"), F.col("label").alias("k"))
    return a.unionByName(v.where("label2 > 0").select("series_id", "z", "y", "x", F.lit("d").alias("class_name"), F.lit(9).alias("k")))


SPARSE = f"(SELECT series_id, z, y, x, 'c' || label AS class_name, label AS k FROM {GRID} WHERE label > 0 UNION ALL SELECT series_id, z, y, x, 'd', 9 FROM {GRID} WHERE label2 > 0)"


def _instances(s, d):
    return T(s, d, "lineitem").select(F.col("l_orderkey").alias("slice"), F.col("l_linenumber").alias("y"), (F.col("l_suppkey") % 4).cast("int").alias("x"), (F.col("l_partkey") % 6).cast("int").alias("class_instance"), F.col("l_partkey").alias("instance"))


def _patch_scores(s, d):
    p = pixels(s, d)
    return p.select("series_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("x0"), "y", "x", "value").select("series_id", F.lit(0).alias("z0"), F.lit(0).alias("y0"), "x0", F.lit(0).alias("z"), "y", "x", (F.col("x") % 3).alias("class"), (F.col("value") * (F.col("x0") + 1)).alias("score"))


PATCH_SCORES = f"(SELECT series_id, 0 AS z, y, x + x0 AS x, x % 3 AS class, value * (x0 + 1) AS score FROM {PIXELS}, (SELECT unnest([0, 2]) AS x0))"


def _class_map(s, d):
    p = T(s, d, "part")
    brand = F.substring_index("p_brand", "#", -1).cast("int")
    name = F.when(brand % 4 == 0, F.concat(F.lit("union_"), F.substring_index("p_type", " ", 1), F.lit("_"), F.substring_index("p_type", " ", -1))).otherwise(F.substring_index("p_type", " ", -1))
    return p.select((F.col("p_size") % 5).alias("dataset"), name.alias("class_name"), brand.alias("class_id")).groupBy("dataset", "class_name").agg(F.min("class_id").alias("class_id"))


CLASS_MAP = "(SELECT p_size % 5 AS dataset, CASE WHEN b % 4 = 0 THEN 'union_' || split_part(p_type, ' ', 1) || '_' || split_part(p_type, ' ', -1) ELSE split_part(p_type, ' ', -1) END AS class_name, min(b) AS class_id FROM (SELECT *, split_part(p_brand, '#', -1)::INTEGER AS b FROM part) GROUP BY 1, 2)"
UNION_MAP = f"""(WITH m AS (SELECT * FROM {CLASS_MAP}), a AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset ORDER BY class_id, class_name) - 1 AS INTEGER) AS new_id FROM m WHERE NOT starts_with(class_name, 'union_')),
p AS (SELECT m.dataset, m.class_id AS old_id, a.new_id, m.class_name, (length(m.class_name) - length(replace(m.class_name, a.class_name, ''))) / length(a.class_name) AS t, a.class_id AS aid, a.class_name AS atom FROM m JOIN a USING (dataset) WHERE starts_with(m.class_name, 'union_'))
SELECT dataset, old_id, new_id, class_name FROM p WHERE t > 0 QUALIFY row_number() OVER (PARTITION BY dataset, old_id, class_name ORDER BY t DESC, aid, atom) = 1
UNION ALL SELECT dataset, class_id, new_id, class_name FROM a WHERE class_id <> new_id)"""


def _ranges(s, d):
    return T(s, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("series_id"), (F.col("o_orderkey") % 4).cast("int").alias("start"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 4 + 3).cast("int")).alias("end"))


RANGED = f"""(SELECT v.*, coalesce(n - 1 - z >= o_orderkey % 4 AND n - 1 - z < CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 + 3 END, true) AS ok
  FROM (SELECT *, max(z) OVER (PARTITION BY series_id) + 1 AS n FROM {GRID}) v LEFT JOIN orders ON o_orderkey = series_id AND o_orderkey % 3 <> 0)"""


#: Voxels with a label only; the depth of a series is that of its shape.
RANGED_SPARSE = f"""(SELECT v.*, coalesce(depth - 1 - z >= o_orderkey % 4 AND depth - 1 - z < CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 + 3 END, true) AS ok
  FROM {GRID} v JOIN {SHAPES} h USING (series_id) LEFT JOIN orders ON o_orderkey = series_id AND o_orderkey % 3 <> 0 WHERE label > 0)"""


def _targets(s, d):
    return T(s, d, "orders").select(F.col("o_orderkey").alias("series_id"), (F.col("o_totalprice") % 50).alias("t"))


def _two_masks(s, d):
    g = _grid(s, d)
    return g.select("series_id", "z", "y", "x", "label"), g.select("series_id", "z", "y", "x", F.col("label2").alias("label"))


def _mask_runs(s, d):
    """_sparse() as runs, with the order of the classes."""
    return R.from_voxels(_sparse(s, d), "class_name").withColumn("k", F.when(F.col("class") == "d", 9).otherwise(F.substring("class", 2, 9).cast("int")))


def _two_runs(s, d):
    return tuple(R.from_voxels(m) for m in _two_masks(s, d))


def _geometry(s, d):
    return T(s, d, "part").select("p_partkey", F.array(F.col("p_size"), F.col("p_size") + 10, F.lit(64)).alias("shape"), F.array(F.lit(2.5), F.col("p_retailprice") / 1000, F.lit(0.75)).alias("spacing"))


def _volumes(s, d):
    """embeddings as 4 x 4 x 4 volumes."""
    e = T(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("series_id"), F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"), F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0)).alias("spacing"), F.col("embedding").cast("array<double>").alias("voxels"), F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)).alias("labels"))


def _bricks(volumes, edge, masks=None):
    b = B.from_volumes(volumes, edge)
    return b if masks is None else B.with_labels(b, B.from_volumes(volumes.withColumn("voxels", F.col(masks)), edge))


def _resampled(s, d):
    """Bricks of edge 3, so that every cell of 4 x 4 x 4 volumes is cut somewhere."""
    v = B.to_voxels(B.resample_linear(_bricks(_volumes(s, d), 3), [0.5, 1.5, 1.0], 3), 3, keep=["shape"])
    pos = (F.col("z") * F.col("shape")[1] + F.col("y")) * F.col("shape")[2] + F.col("x")
    return v.select("series_id", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), pos.alias("pos"), F.round("value", 5).alias("value"))


def _crops(s, d):
    v = _volumes(s, d)
    c = C.random_crops(_bricks(v, 3, "labels"), v, [2, 2, 2], 0.5, 0.9, 0.01, seed=3, edge=3)
    return c.select("series_id", "patch_id", *[F.col("bbox")[2 * i].alias(n) for i, n in enumerate(("z1", "y1", "x1"))], F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"), F.posexplode(F.arrays_zip("img", "label")).alias("pos", "cell")).select("series_id", "patch_id", "z1", "y1", "x1", "classes", "pos", F.round("cell.img", 6).alias("value"), "cell.label")


def _blurred(s, d):
    """8 x 8 grids in bricks of edge 5."""
    g = T(s, d, "embeddings").select(F.col("vec_id").alias("series_id"), F.array(F.lit(1), F.lit(8), F.lit(8)).alias("shape"), F.lit(None).cast("array<double>").alias("spacing"), F.col("embedding").alias("voxels"))
    return B.to_voxels(B.gaussian_blur(_bricks(g, 5), 3, 1.0, 2.0, edge=5), 5).select(F.col("series_id").alias("vec_id"), "y", "x", F.round("value", 5).alias("value"))


def _hu(s, d):
    """pixels with values as HU and label 1 or 2."""
    return pixels(s, d).select("series_id", "y", "x", F.bround(F.col("value") * 600 - 60, 0).cast("int").alias("hu"), (F.col("x") % 3).cast("int").alias("label"))


def _through_buckets(s, job, *tables):
    """job over bucketed copies of the tables, its result written while they stand."""
    names = [f"voxels_{os.urandom(8).hex()}" for _ in tables]
    try:
        with co_located(s):
            return written(job(*[write_bucketed(t, n, buckets=16, path=shared_folder(s, n)) for n, t in zip(names, tables)]), "joined")
    finally:
        for n in names:
            s.sql(f"DROP TABLE IF EXISTS {n}")


def _aligned(s, d):
    g = _grid(s, d)
    return _through_buckets(s, S.align_image_label, g.select("series_id", "z", "y", "x", "hu"), g.where("label > 0").select("series_id", "z", "y", "x", "label"))


def _areas_bucketed(s, d):
    p = _seg(s, d).withColumn("z", F.lit(0))
    at = ["series_id", "z", "y", "x"]
    return _through_buckets(s, lambda a, b: E.segmentation_areas(a.join(b, at), "gt", "pred", [0, 1, 2], ["series_id"]), p.select(*at, "gt"), p.select(*at, "pred"))


QUERIES = {
    "a15_areas_bucketed": _areas_bucketed,
    "j13_align_bucketed": _aligned,
    "a15_segmentation_areas": lambda s, d: _areas(s, d, ["series_id"]),
    "a16_segmentation_metrics": lambda s, d: _six(E.segmentation_metrics(_areas(s, d))),
    "a16_mean_metrics": lambda s, d: E.mean_metrics(_areas(s, d)).select("aAcc", "mIoU", "mDice", "mPrecision", "mRecall"),
    "a17_valid_class_metrics": lambda s, d: _six(E.valid_class_metrics(_areas(s, d), [1, 2])),
    "a18_per_class_report": lambda s, d: _six(E.per_class_report(E.segmentation_metrics(_areas(s, d)), 4).select("class", "IoU", "Dice")),
    "a19_dice_accuracy_in_range": lambda s, d: _six(E.dice_accuracy_in_range(_grid(s, d), _ranges(s, d), "series_id", "z", "label", "label2", [1, 2], 1.0, 2, dense=True)),
    "a19_dice_accuracy_sparse": lambda s, d: _six(E.dice_accuracy_in_range(_grid(s, d).where("label > 0"), _ranges(s, d), "series_id", "z", "label", "label2", [1, 2], 1.0, 2, shapes=_shapes(s, d))),
    "a20_count_metrics": lambda s, d: _six(E.count_metrics(T(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").cast("double").alias("gt"), F.sum(F.col("l_quantity") / 8).alias("pred")))),
    "a21_relative_position_error": lambda s, d: _six(E.relative_position_error(T(s, d, "events").withColumn("g", F.get_json_object("props", "$.k").cast("double")), "value", "g", "l2")),
    "a22_round_average": lambda s, d: _six(E.round_average(_results(s, d), ["Dice", "Precision", "Recall"])),
    "a23_detail_pivot": lambda s, d: _six(E.detail_pivot(_long(s, d), ["ct-0-0", "ct-1-1", "ct-2-2"])),
    "a24_experiment_compare": lambda s, d: _six(E.experiment_compare(_long(s, d), ["click", "view"])),
    "a25_mask_overlap": lambda s, d: M.mask_overlap(_sparse(s, d)).withColumn("classes", F.array_join("classes", ",")),
    "a26_merge_class_masks": lambda s, d: M.merge_class_masks(_sparse(s, d), s.createDataFrame([("c1", 1), ("d", 5)], "class_name string, class_id int"), "k"),
    "a26_unknown_classes": lambda s, d: M.unknown_classes(_sparse(s, d), s.createDataFrame([("c1", 1), ("d", 5)], "class_name string, class_id int")),
    "a26_fill_background": lambda s, d: M.fill_background(M.merge_class_masks(_sparse(s, d), s.createDataFrame([("c1", 1), ("d", 5)], "class_name string, class_id int"), "k"), _grid(s, d).select("series_id", "z", "y", "x")),
    "a25_mask_runs": lambda s, d: _mask_runs(s, d).select("series_id", "z", "y", "x1", "x2", "class"),
    "a25_mask_overlap_runs": lambda s, d: R.to_voxels(R.mask_overlap(_mask_runs(s, d))).withColumn("classes", F.array_join("classes", ",")),
    "a26_merge_class_runs": lambda s, d: R.to_voxels(R.merge_class_masks(_mask_runs(s, d), s.createDataFrame([("c1", 1), ("d", 5)], "class_name string, class_id int"), "k")).withColumnRenamed("class", "label"),
    "f5_foreground_ratio_runs": lambda s, d: R.foreground_ratio(R.from_voxels(_grid(s, d)), ["series_id", "z"], 0.3),
    "j14_label_difference_runs": lambda s, d: R.to_voxels(R.label_difference(*_two_runs(s, d))),
    "j14_run_intersection": lambda s, d: R.intersection(*_two_runs(s, d)),
    "j14_run_difference": lambda s, d: R.difference(*_two_runs(s, d)),
    "j14_run_union": lambda s, d: R.union(*_two_runs(s, d)),
    "a27_split_class_masks": lambda s, d: M.split_class_masks(_grid(s, d), [1, 2]),
    "a28_instances_to_segmentation": lambda s, d: M.instances_to_segmentation(_instances(s, d), ["slice"], "instance"),
    "a29_point_heatmap": lambda s, d: M.point_heatmap(T(s, d, "events").select((F.col("user_id") % 20).alias("patch"), F.bround(F.col("value") / 10, 0).cast("int").alias("x"), (F.col("event_id") % 13 - 1).cast("int").alias("y")), T(s, d, "events").select((F.col("user_id") % 20).alias("patch"), F.lit(10).alias("height"), F.lit(8).alias("width")).distinct()),
    "a31_overlap_average": lambda s, d: _six(E.overlap_average(_patch_scores(s, d))),
    "a31_uncovered": lambda s, d: E.uncovered(E.overlap_average(_patch_scores(s, d)), T(s, d, "embeddings").select(F.col("vec_id").alias("series_id"), F.lit(1).alias("depth"), F.lit(8).alias("height"), F.lit(12).alias("width"))),
    "a32_argmax_class": lambda s, d: E.argmax_class(E.overlap_average(_patch_scores(s, d)), ["series_id", "z", "y", "x"], 0),
    "a33_tissue_regions": lambda s, d: M.tissue_regions(_grid(s, d), {1: "muscle", 2: "fat"}).select("series_id", "z", "tissue", "n", F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["y"], p["x"])), ",").alias("points")),
    "a37_subgroup_accuracy": lambda s, d: _six(E.subgroup_accuracy(_seg(s, d).withColumn("g", F.col("series_id") % 7), "g", "gt", "pred")),
    "a37_position_accuracy": lambda s, d: _six(E.position_accuracy(_seg(s, d).withColumn("g", F.col("series_id") % 7), "g", "x", "gt", "pred")),
    "a38_reconstruction_error": lambda s, d: _six(E.reconstruction_error(voxels(s, d), "series_id", "hu", "label")),
    "j8_slice_range_drop": lambda s, d: S.slice_range_filter(_grid(s, d), _ranges(s, d), "series_id", "z", "drop", dense=True).select("series_id", "z", "y", "x", "label"),
    "j8_slice_range_zero": lambda s, d: S.slice_range_filter(_grid(s, d), _ranges(s, d), "series_id", "z", "zero", dense=True).select("series_id", "z", "y", "x", "label"),
    "j8_slice_range_sparse": lambda s, d: S.slice_range_filter(_grid(s, d).where("label > 0"), _ranges(s, d), "series_id", "z", "drop", shapes=_shapes(s, d)).select("series_id", "z", "y", "x", "label"),
    "j9_nearest_within": lambda s, d: _six(S.nearest_within(_targets(s, d), voxels(s, d), ["series_id"], "t", "hu", "z", 3.0)),
    "j10_nearest_slice": lambda s, d: _six(S.nearest_slice(_targets(s, d), voxels(s, d), ["series_id"], "t", "hu", "z")),
    "j13_align_image_label": lambda s, d: S.align_image_label(_grid(s, d), _grid(s, d).where("label > 0")),
    "j14_label_difference": lambda s, d: S.label_difference(*_two_masks(s, d)),
    "j14_difference_summary": lambda s, d: S.difference_summary(S.label_difference(*_two_masks(s, d))),
    "m1_window_norm": lambda s, d: I.window_norm(_grid(s, d), "hu", 25, 31).select("series_id", "z", "y", "x", F.round("hu", 6).alias("hu")),
    "m2_window_minmax": lambda s, d: I.window_minmax(_grid(s, d), "hu", ["series_id"], 25, 40, 255.0).select("series_id", "z", "y", "x", F.round("hu", 6).alias("hu")),
    "m3_rescale_hu": lambda s, d: I.rescale_hu(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount")).alias("slope"), F.col("l_tax").alias("icept")), "l_quantity", "slope", "icept").select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 6).alias("v")),
    "m4_range_clip_norm": lambda s, d: I.range_clip_norm(_grid(s, d), "hu", ["series_id"], "inst", lo=5.0, hi=40.0).select("series_id", "z", "y", "x", F.round("hu", 7).alias("hu")),
    "m5_instance_norm": lambda s, d: _six(I.instance_norm(pixels(s, d), "value", ["series_id"]).select("series_id", "y", "x", "value")),
    "m6_dataset_norm": lambda s, d: _six(I.dataset_norm(pixels(s, d), "value", pixels(s, d).groupBy("label").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")), ["label"]).select("series_id", "y", "x", "value")),
    "m6_roi_norm": lambda s, d: _six(I.roi_norm(pixels(s, d), "value", ["series_id"], 8, 8).select("series_id", "y", "x", "value")),
    "m6_fixed_norm": lambda s, d: _six(I.fixed_norm(_grid(s, d), "hu", "label", [10, 20, 30], [2, 4, 5]).select("series_id", "z", "y", "x", "hu")),
    "m7_hist_equalize": lambda s, d: I.hist_equalize(pixels(s, d), "value", ["series_id"], 3.5, 3.5, 3.0, 16).select("series_id", "y", "x", F.round("value", 6).alias("value")),
    "m8_remap_labels": lambda s, d: M.remap_labels(_grid(s, d), "label", {1: 2, 2: 1}).select("series_id", "z", "y", "x", "label"),
    "m9_class_subset": lambda s, d: M.remap_labels(_grid(s, d), "label", {o: n for o, n, _ in M.class_subset_map({"bg": 0, "a": 1, "r": 2}, ["bg", "r"])}).select("series_id", "z", "y", "x", "label"),
    "m11_union_atom_map": lambda s, d: M.union_atom_map(_class_map(s, d)),
    "m12_class_rectify": lambda s, d: M.class_rectify(T(s, d, "part").select("p_partkey", (F.col("p_size") % 5).alias("dataset"), F.substring_index("p_brand", "#", -1).cast("int").alias("label")), M.union_atom_map(_class_map(s, d)), "dataset", "label"),
    "m12_rectify_violations": lambda s, d: M.rectify_violations(T(s, d, "part").select((F.col("p_size") % 5).alias("dataset"), F.substring_index("p_brand", "#", -1).cast("int").alias("label")), s.range(5).select(F.col("id").cast("int").alias("dataset"), (F.col("id") * 8 + 10).cast("int").alias("max_id")), "dataset", "label"),
    "m13_one_hot": lambda s, d: M.one_hot(_grid(s, d), "label", 3, 0).select("series_id", "z", "y", "x", F.array_join(F.col("one_hot").cast("array<string>"), "").alias("one_hot")),
    "m14_resample_geometry": lambda s, d: S.resample_geometry(_geometry(s, d), new_spacing=[2.0, 1.0, 1.5]).select("p_partkey", F.array_join(F.col("new_size").cast("array<string>"), ",").alias("new_size")),
    "m15_resample_labels_nn": lambda s, d: S.resample_labels_nn(pixels(s, d).select("series_id", F.lit(0).alias("z"), "y", "x", (F.col("y") * 8 + F.col("x")).alias("label")), T(s, d, "embeddings").select(F.col("vec_id").alias("series_id"), F.lit(1).alias("old_d"), F.lit(8).alias("old_h"), F.lit(8).alias("old_w"), F.lit(1).alias("new_d"), F.lit(5).alias("new_h"), F.lit(13).alias("new_w"))),
    "m16_resample_image_linear": _resampled,
    "m17_pad_to_size": lambda s, d: _six(S.pad_to_size(pixels(s, d).select("series_id", F.lit(0).alias("z"), "y", "x", F.col("value").alias("hu")), T(s, d, "embeddings").select(F.col("vec_id").alias("series_id"), F.lit(1).alias("depth"), F.lit(8).alias("height"), F.lit(8).alias("width")), [2, 11, 8], -1.0)[0]),
    "m17_center_crop": lambda s, d: S.center_crop(_grid(s, d), _shapes(s, d), [4, 8, 8])[0].select("series_id", "z", "y", "x", "hu"),
    "m17_cut_edge": lambda s, d: S.cut_edge(_grid(s, d), _shapes(s, d), 2)[0].select("series_id", "z", "y", "x", "hu"),
    "m19_patch_grid": lambda s, d: S.patch_grid(_shapes(s, d), [4, 8, 16], [3, 5, 8]),
    "m20_random_crops": _crops,
    "m21_flip": lambda s, d: S.flip(_grid(s, d), _shapes(s, d), "y").select("series_id", "z", "y", "x", "hu"),
    "m21_roll": lambda s, d: S.roll(_grid(s, d), _shapes(s, d), "x", 3, -1.0).select("series_id", "z", "y", "x", "hu"),
    "m21_swap_axes": lambda s, d: S.swap_axes(_grid(s, d), "y", "x").select("series_id", "z", "y", "x", "hu"),
    "m22_erase_voxels": lambda s, d: S.erase_voxels(_grid(s, d), 0.4, -9.0, 5).select("series_id", "z", "y", "x", "hu", "erase_mask"),
    "m22_erase_box": lambda s, d: S.erase_box(_grid(s, d), _shapes(s, d), [3, 6, 6], -9.0, 5).select("series_id", "z", "y", "x", "hu", "erase_mask"),
    "m22_swap_boxes": lambda s, d: S.swap_boxes(_grid(s, d), _shapes(s, d), [3, 6, 6], 5).select("series_id", "z", "y", "x", "hu"),
    "m23_gaussian_blur": _blurred,
    "m24_remove_scan_table": lambda s, d: S.remove_scan_table(_grid(s, d), T(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("series_id"), F.lit(8.0).alias("cx"), F.lit(7.0).alias("cy"), F.lit(1.0).alias("sx"), F.lit(2.0).alias("sy")), "series_id", 9, -1024.0).select("series_id", "z", "y", "x", "hu"),
    "m28_muscle_fat_split": lambda s, d: K.muscle_fat_split(_hu(s, d)),
    "m29_split_to_slices": lambda s, d: S.split_to_slices(_grid(s, d)).select("series_id", "z", F.array_join(F.transform("image", lambda v: v.cast("int").cast("string")), ",").alias("image"), F.array_join(F.col("label").cast("array<string>"), ",").alias("label")),
    "m31_low_value_clip": lambda s, d: I.low_value_clip(_grid(s, d), "hu", ["series_id"], 0.25).select("series_id", "z", "y", "x", F.round("hu", 6).alias("hu")),
}

V4 = "series_id, z, y, x"


def _start(tag, axis, size, extent):
    """The seeded start of a box on an axis, as the operators draw it."""
    return f"CAST(floor(('0x' || substr(md5(series_id || '|5{tag}{axis}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * greatest({extent} - {size} + 1, 1)) AS INTEGER)"


def _starts(tag):
    return ", ".join(f"{_start(tag, a, n, e)} AS s{tag or 'b'}{a}" for a, n, e in (("z", 3, "depth"), ("y", 6, "height"), ("x", 6, "width")))


def _in(tag):
    return " AND ".join(f"{a} >= s{tag}{a} AND {a} < s{tag}{a} + {n}" for a, n in (("z", 3), ("y", 6), ("x", 6)))


def _islands(voxels):
    """Runs of (series_id, z, y, x, class) rows."""
    return f"SELECT series_id, z, y, class, CAST(min(x) AS INTEGER) AS x1, CAST(max(x) + 1 AS INTEGER) AS x2 FROM (SELECT *, x - row_number() OVER (PARTITION BY series_id, z, y, class ORDER BY x) AS island FROM (SELECT DISTINCT series_id, z, y, x, class FROM ({voxels}))) GROUP BY series_id, z, y, class, island"


LABELS = [f"SELECT series_id, z, y, x, {c} AS class FROM {GRID}" for c in ("label", "label2")]
HU = f"(SELECT series_id, y, x, CAST(round_even(value * 600 - 60, 0) AS INTEGER) AS hu, CAST(x % 3 AS INTEGER) AS label FROM {PIXELS})"
ORACLE = {
    "a15_segmentation_areas": f"SELECT series_id, class, count(*) FILTER (gt = class AND pred = class) AS intersect, count(*) FILTER (gt = class OR pred = class) AS union, count(*) FILTER (pred = class) AS pred_area, count(*) FILTER (gt = class) AS label_area FROM {SEG}, (SELECT unnest([0, 1, 2]) AS class) GROUP BY ALL",
    "a16_segmentation_metrics": f"SELECT class, {RATIOS} FROM {AREAS}",
    "a16_mean_metrics": f"SELECT round(100.0 * sum(i) / sum(g), 2) AS \"aAcc\", round(avg(100.0 * i / u), 2) AS \"mIoU\", round(avg(200.0 * i / (p + g)), 2) AS \"mDice\", round(avg(100.0 * i / p), 2) AS \"mPrecision\", round(avg(100.0 * i / g), 2) AS \"mRecall\" FROM {AREAS}",
    "a17_valid_class_metrics": f"SELECT class, {RATIOS} FROM {AREAS} WHERE class IN (1, 2)",
    "a18_per_class_report": f"SELECT class::VARCHAR AS class, round(100.0 * i / u, 4) AS \"IoU\", round(200.0 * i / (p + g), 4) AS \"Dice\" FROM {AREAS} UNION ALL SELECT 'mean', round(avg(100.0 * i / u), 4), round(avg(200.0 * i / (p + g)), 4) FROM {AREAS}",
    "a19_dice_accuracy_in_range": f"""WITH v AS (SELECT * FROM {RANGED} WHERE ok), f AS (SELECT series_id FROM v GROUP BY 1 HAVING max(label) = 2), k AS (SELECT * FROM v SEMI JOIN f USING (series_id)),
c AS (SELECT series_id, z, class, count(*) FILTER (label = class AND label2 = class) AS i, count(*) FILTER (label = class) AS a, count(*) FILTER (label2 = class) AS b FROM k, (SELECT unnest([1, 2]) AS class) GROUP BY ALL),
l AS (SELECT series_id, avg(1 - (2 * i + 1.0::DOUBLE) / (a + b + 1)) AS l FROM c GROUP BY 1), s AS (SELECT series_id, count(*) FILTER (label = label2) / (count(*) + 1)::DOUBLE AS c FROM k GROUP BY 1)
SELECT round(avg(l), 6) AS dice_loss, round(avg(c), 6) AS accuracy FROM l JOIN s USING (series_id)""",
    "a19_dice_accuracy_sparse": f"""WITH v AS (SELECT * FROM {RANGED_SPARSE} WHERE ok), f AS (SELECT series_id FROM v GROUP BY 1 HAVING max(label) = 2), k AS (SELECT * FROM v SEMI JOIN f USING (series_id)),
c AS (SELECT series_id, z, class, count(*) FILTER (label = class AND label2 = class) AS i, count(*) FILTER (label = class) AS a, count(*) FILTER (label2 = class) AS b FROM k, (SELECT unnest([1, 2]) AS class) GROUP BY ALL),
l AS (SELECT series_id, avg(1 - (2 * i + 1.0::DOUBLE) / (a + b + 1)) AS l FROM c GROUP BY 1), s AS (SELECT series_id, count(*) FILTER (label = label2) / (count(*) + 1)::DOUBLE AS c FROM k GROUP BY 1)
SELECT round(avg(l), 6) AS dice_loss, round(avg(c), 6) AS accuracy FROM l JOIN s USING (series_id)""",
    "a20_count_metrics": "WITH c AS (SELECT sum(l_linenumber)::DOUBLE AS gt, sum(l_quantity / 8) AS pred FROM lineitem GROUP BY l_orderkey) SELECT round(avg(abs(pred - gt)), 6) AS mae, round(100 * avg(abs(pred - gt) / gt), 6) AS mape, round(avg(CASE WHEN (CASE WHEN gt < 10 THEN abs(pred - gt) <= 3 ELSE abs(pred - gt) <= 0.3::DOUBLE * gt END) THEN 1.0 ELSE 0.0 END), 6) AS product_met FROM c",
    "a21_relative_position_error": "SELECT round(avg(pow(value - CAST(json_extract(props, '$.k') AS DOUBLE), 2)), 6) AS error FROM events",
    "a22_round_average": f"SELECT exp, model, class, metric, round(avg(value), 6) AS value FROM (SELECT exp, model, class, unnest(['Dice', 'Precision', 'Recall']) AS metric, unnest([\"Dice\", \"Precision\", \"Recall\"]) AS value FROM {RESULTS} WHERE class IS NOT NULL) GROUP BY ALL",
    "a23_detail_pivot": f"SELECT exp, model, metric, round(avg(value) FILTER (c = 'ct-0-0'), 6) AS \"ct-0-0\", round(avg(value) FILTER (c = 'ct-1-1'), 6) AS \"ct-1-1\", round(avg(value) FILTER (c = 'ct-2-2'), 6) AS \"ct-2-2\" FROM (SELECT exp, model, 'ct-' || dataset || '-' || class AS c, unnest(['Dice', 'Precision', 'Recall']) AS metric, unnest([\"Dice\", \"Precision\", \"Recall\"]) AS value FROM {RESULTS} WHERE class IS NOT NULL) GROUP BY ALL",
    "a24_experiment_compare": "SELECT modality, dataset, exp, " + ", ".join(f"round(avg(\"{k}\") FILTER (model = '{m}'), 6) AS \"{m}_{k}\"" for m in ("click", "view") for k in ("Dice", "Precision", "Recall")) + f" FROM {RESULTS} WHERE class IS NOT NULL GROUP BY ALL",
    "a25_mask_overlap": f"SELECT {V4}, CAST(count(DISTINCT class_name) AS INTEGER) AS n_classes, string_agg(DISTINCT class_name, ',' ORDER BY class_name) AS classes FROM {SPARSE} GROUP BY ALL",
    "a26_merge_class_masks": f"SELECT {V4}, CASE WHEN max(k) = 9 THEN 5 ELSE 1 END AS label FROM {SPARSE} WHERE class_name IN ('c1', 'd') GROUP BY ALL",
    "a26_unknown_classes": f"SELECT DISTINCT class_name FROM {SPARSE} WHERE class_name NOT IN ('c1', 'd')",
    "a26_fill_background": f"SELECT {V4}, CASE WHEN label2 > 0 THEN 5 WHEN label = 1 THEN 1 ELSE 0 END AS label FROM {GRID}",
    "a27_split_class_masks": f"SELECT series_id, c - 1 AS channel, z, y, x, CASE WHEN label = c THEN 1 ELSE 0 END AS value FROM {GRID}, (SELECT unnest([1, 2]) AS c)",
    "a28_instances_to_segmentation": "SELECT l_orderkey AS slice, l_linenumber AS y, CAST(l_suppkey % 4 AS INTEGER) AS x, CAST(arg_max(l_partkey % 6, l_partkey) + 1 AS INTEGER) AS label FROM lineitem GROUP BY ALL",
    "a29_point_heatmap": "SELECT user_id % 20 AS patch, CAST(event_id % 13 - 1 AS INTEGER) AS y, CAST(round_even(value / 10, 0) AS INTEGER) AS x, count(*) AS n FROM events WHERE event_id % 13 - 1 BETWEEN 0 AND 9 AND round_even(value / 10, 0) BETWEEN 0 AND 7 GROUP BY ALL",
    "a31_overlap_average": f"SELECT series_id, class, z, y, x, round(avg(score), 6) AS score FROM {PATCH_SCORES} GROUP BY ALL",
    "a31_uncovered": f"SELECT series_id, 96 - count(DISTINCT (y, x)) AS uncovered FROM {PATCH_SCORES} GROUP BY 1",
    "a32_argmax_class": f"WITH s AS (SELECT series_id, class, z, y, x, avg(score) AS score FROM {PATCH_SCORES} GROUP BY ALL) SELECT {V4}, CAST(CASE WHEN max(score) > 0 THEN arg_max(class, (score, -class)) ELSE 0 END AS INTEGER) AS label FROM s GROUP BY ALL",
    "a33_tissue_regions": f"SELECT series_id, z, CASE label WHEN 1 THEN 'muscle' ELSE 'fat' END AS tissue, count(*) AS n, string_agg(y || ':' || x, ',' ORDER BY y, x) AS points FROM {GRID} WHERE label IN (1, 2) GROUP BY ALL",
    "a37_subgroup_accuracy": f"SELECT series_id % 7 AS g, round(avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END), 6) AS acc FROM {SEG} GROUP BY 1",
    "a37_position_accuracy": f"SELECT series_id % 7 AS g, x, round(avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END), 6) AS class_acc FROM {SEG} GROUP BY 1, 2",
    "a38_reconstruction_error": f"SELECT round(avg(a), 6) AS mae, round(avg(p), 6) AS mape FROM (SELECT avg(abs(label - hu)) AS a, avg(abs(label - hu) / (hu + 1e-6)) AS p FROM {VOXELS} GROUP BY series_id)",
    "j8_slice_range_drop": f"SELECT {V4}, label FROM {RANGED} WHERE ok",
    "j8_slice_range_sparse": f"SELECT {V4}, label FROM {RANGED_SPARSE} WHERE ok",
    "m16_resample_image_linear": """WITH p AS (SELECT axis, i, least(i * t / o, 3) AS p FROM (VALUES ('z', 7, 0.5::DOUBLE, 1.0::DOUBLE), ('y', 4, 1.5, 2.0), ('x', 3, 1.0, 1.0)) a(axis, n, t, o), range(0, 7) r(i) WHERE i < n),
w AS (SELECT axis, i, CAST(floor(p) AS INTEGER) AS c, 1 - (p - floor(p)) AS u FROM p UNION ALL SELECT axis, i, CAST(least(floor(p) + 1, 3) AS INTEGER), p - floor(p) FROM p),
g AS (SELECT CAST(z.i * 12 + y.i * 3 + x.i AS INTEGER) AS pos, z.c * 16 + y.c * 4 + x.c + 1 AS spot, z.u * y.u * x.u AS u FROM w z, w y, w x WHERE z.axis = 'z' AND y.axis = 'y' AND x.axis = 'x')
SELECT vec_id AS series_id, '7,4,3' AS shape, pos, round(sum(CAST(embedding[spot] AS DOUBLE) * u), 5) AS value FROM embeddings, g GROUP BY vec_id, pos""",
    "j8_slice_range_zero": f"SELECT {V4}, CASE WHEN ok THEN label ELSE 0 END AS label FROM {RANGED}",
    "j9_nearest_within": f"SELECT o_orderkey AS series_id, round(o_totalprice % 50, 6) AS t, arg_min(z, (abs(hu - o_totalprice % 50), z)) AS slice_idx, round(min(abs(hu - o_totalprice % 50)), 6) AS dy FROM orders JOIN {VOXELS} v ON v.series_id = o_orderkey WHERE abs(hu - o_totalprice % 50) < 3 GROUP BY o_orderkey, o_totalprice",
    "j10_nearest_slice": f"SELECT o_orderkey AS series_id, round(o_totalprice % 50, 6) AS t, CAST(arg_min(z, (abs(hu - o_totalprice % 50), z)) AS BIGINT) AS slice_idx FROM orders LEFT JOIN {VOXELS} v ON v.series_id = o_orderkey GROUP BY o_orderkey, o_totalprice",
    "j13_align_image_label": f"SELECT {V4}, hu, label FROM {GRID} WHERE label > 0",
    "j14_label_difference": f"WITH a AS (SELECT {V4}, label AS class FROM {GRID} WHERE label > 0), b AS (SELECT {V4}, label2 AS class FROM {GRID} WHERE label2 > 0) SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.class, b.class) AS class, coalesce(a.z, b.z) AS z, coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, CASE WHEN a.z IS NULL THEN 3 WHEN b.z IS NULL THEN 2 ELSE 1 END AS code FROM a FULL JOIN b ON a.series_id = b.series_id AND a.z = b.z AND a.y = b.y AND a.x = b.x AND a.class = b.class",
    "j14_difference_summary": f"SELECT series_id, class, code, count(*) AS n FROM (SELECT series_id, unnest(CASE WHEN label = label2 THEN [label] ELSE [label, label2] END) AS class, unnest(CASE WHEN label = label2 THEN [1] ELSE [2, 3] END) AS code FROM {GRID}) WHERE class > 0 GROUP BY ALL",
    "m1_window_norm": f"SELECT {V4}, round((greatest(least(hu, 40), 10) - 10) / 31, 6) AS hu FROM {GRID}",
    "m2_window_minmax": f"WITH c AS (SELECT {V4}, greatest(least(hu, 45), 5) AS h FROM {GRID}), g AS (SELECT *, min(h) OVER (PARTITION BY series_id) AS lo, max(h) OVER (PARTITION BY series_id) AS hi FROM c) SELECT {V4}, round(coalesce((h - lo) / nullif(hi - lo, 0), 0) * 255, 6) AS hu FROM g",
    "m3_rescale_hu": "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_partkey % 3 <> 0 THEN l_quantity * l_discount + l_tax ELSE l_quantity END, 6) AS v FROM lineitem",
    "m4_range_clip_norm": f"WITH c AS (SELECT {V4}, greatest(least(hu, 40), 5)::DOUBLE AS h FROM {GRID}), g AS (SELECT *, avg(h) OVER (PARTITION BY series_id) AS m, stddev_pop(h) OVER (PARTITION BY series_id) AS s FROM c) SELECT {V4}, round(coalesce((h - m) / nullif(s, 0), 0), 7) AS hu FROM g",
    "m5_instance_norm": f"WITH g AS (SELECT *, min(value) OVER (PARTITION BY series_id) AS lo, stddev_pop(value) OVER (PARTITION BY series_id) AS s FROM {PIXELS}) SELECT series_id, y, x, round((value - lo) / (s + 1e-6), 6) AS value FROM g",
    "m6_dataset_norm": f"WITH g AS (SELECT *, avg(value) OVER (PARTITION BY label) AS m, stddev_pop(value) OVER (PARTITION BY label) AS s FROM {PIXELS}) SELECT series_id, y, x, round((value - m) / s, 6) AS value FROM g",
    "m6_roi_norm": f"WITH g AS (SELECT *, stddev_pop(CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 THEN value END) OVER (PARTITION BY series_id) AS s FROM {PIXELS}) SELECT series_id, y, x, round(value / s, 6) AS value FROM g",
    "m6_fixed_norm": f"SELECT {V4}, round((hu - ([10.0, 20.0, 30.0])[label + 1]::DOUBLE) / ([2.0, 4.0, 5.0])[label + 1]::DOUBLE, 6) AS hu FROM {GRID}",
    "m8_remap_labels": f"SELECT {V4}, CASE label WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE label END AS label FROM {GRID}",
    "m9_class_subset": f"SELECT {V4}, CASE label WHEN 2 THEN 1 ELSE label END AS label FROM {GRID}",
    "m11_union_atom_map": f"SELECT * FROM {UNION_MAP}",
    "m12_class_rectify": f"WITH m AS (SELECT dataset, old_id, min(new_id) AS n FROM {UNION_MAP} GROUP BY ALL) SELECT p_partkey, p_size % 5 AS dataset, coalesce(n, split_part(p_brand, '#', -1)::INTEGER) AS label FROM part LEFT JOIN m ON m.dataset = p_size % 5 AND m.old_id = split_part(p_brand, '#', -1)::INTEGER",
    "m12_rectify_violations": "SELECT p_size % 5 AS dataset, split_part(p_brand, '#', -1)::INTEGER AS label, count(*) AS n FROM part WHERE split_part(p_brand, '#', -1)::INTEGER > (p_size % 5) * 8 + 10 GROUP BY ALL",
    "m13_one_hot": f"SELECT {V4}, CASE label WHEN 1 THEN '010' ELSE '001' END AS one_hot FROM {GRID} WHERE label <> 0",
    "m14_resample_geometry": "SELECT p_partkey, greatest(1, floor(p_size * 2.5::DOUBLE / 2.0)::INTEGER - 1) || ',' || greatest(1, floor((p_size + 10) * (p_retailprice / 1000) / 1.0)::INTEGER - 1) || ',' || greatest(1, floor(64 * 0.75::DOUBLE / 1.5)::INTEGER - 1) AS new_size FROM part",
    "m15_resample_labels_nn": "SELECT vec_id AS series_id, 0 AS z, CAST(t AS INTEGER) AS y, CAST(u AS INTEGER) AS x, CAST(least(floor(t * 8 / 5.0 + 0.5), 7) * 8 + least(floor(u * 8 / 13.0 + 0.5), 7) AS INTEGER) AS label FROM embeddings, range(0, 5) a(t), range(0, 13) b(u)",
    "m17_pad_to_size": f"SELECT e.vec_id AS series_id, CAST(g.z AS INTEGER) AS z, CAST(h.y AS INTEGER) AS y, CAST(w.x AS INTEGER) AS x, round(CASE WHEN g.z = 0 AND h.y BETWEEN 1 AND 8 THEN embedding[CAST((h.y - 1) * 8 + w.x + 1 AS INTEGER)]::DOUBLE ELSE -1 END, 6) AS hu FROM embeddings e, range(0, 2) g(z), range(0, 11) h(y), range(0, 8) w(x)",
    "m17_center_crop": f"SELECT series_id, CAST(z - (depth // 2 - 2) AS INTEGER) AS z, y - 4 AS y, x - 4 AS x, hu FROM {GRID} JOIN {SHAPES} USING (series_id) WHERE z - (depth // 2 - 2) BETWEEN 0 AND 3 AND y BETWEEN 4 AND 11 AND x BETWEEN 4 AND 11",
    "m17_cut_edge": f"SELECT series_id, z - 2 AS z, y - 2 AS y, x - 2 AS x, hu FROM {GRID} JOIN {SHAPES} USING (series_id) WHERE z >= 2 AND z < depth - 2 AND y BETWEEN 2 AND 13 AND x BETWEEN 2 AND 13",
    "m19_patch_grid": f"""WITH g AS (SELECT *, greatest(depth - 4 + 2, 0) // 3 + 1 AS zn, greatest(height - 8 + 4, 0) // 5 + 1 AS yn, greatest(width - 16 + 7, 0) // 8 + 1 AS xn FROM {SHAPES})
SELECT series_id, CAST((zi * yn + yi) * xn + xi AS INTEGER) AS patch_id, CAST(greatest(least(zi * 3 + 4, depth) - 4, 0) AS INTEGER) AS z1, CAST(least(zi * 3 + 4, depth) AS INTEGER) AS z2, CAST(greatest(least(yi * 5 + 8, height) - 8, 0) AS INTEGER) AS y1, CAST(least(yi * 5 + 8, height) AS INTEGER) AS y2, CAST(greatest(least(xi * 8 + 16, width) - 16, 0) AS INTEGER) AS x1, CAST(least(xi * 8 + 16, width) AS INTEGER) AS x2
FROM g, range(0, 20) a(zi), range(0, 20) b(yi), range(0, 20) c(xi) WHERE zi < zn AND yi < yn AND xi < xn""",
    "m21_flip": f"SELECT series_id, z, 15 - y AS y, x, hu FROM {GRID}",
    "m21_roll": f"SELECT series_id, z, y, (x + 3) % 16 AS x, CASE WHEN x + 3 >= 16 THEN -1.0 ELSE hu END AS hu FROM {GRID}",
    "m21_swap_axes": f"SELECT series_id, z, x AS y, y AS x, hu FROM {GRID}",
    "m22_erase_voxels": f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY md5(concat_ws('|', series_id, z, y, x, '5')), z, y, x) <= floor(count(*) OVER (PARTITION BY series_id) * 0.4::DOUBLE) AS erase_mask FROM {GRID}) SELECT {V4}, CASE WHEN erase_mask THEN -9.0 ELSE hu END AS hu, erase_mask FROM r",
    "m7_hist_equalize": f"""WITH p AS (SELECT *, pow(y - 3.5::DOUBLE, 2) + pow(x - 3.5::DOUBLE, 2) <= 9 AS inside FROM {PIXELS}),
e AS (SELECT series_id, min(value) AS lo, (max(value) - min(value)) / 16 AS w, count(*) AS n FROM p WHERE inside GROUP BY 1),
c AS (SELECT series_id, b, (SELECT count(*) FROM p WHERE p.series_id = e.series_id AND inside AND least(floor((value - lo) / w), 15) <= b) / n::DOUBLE AS c FROM e, range(0, 16) r(b)),
q AS (SELECT p.series_id, y, x, greatest(0, least((value - lo) / w - 0.5::DOUBLE, 15)) AS place FROM p JOIN e USING (series_id))
SELECT q.series_id, y, x, round(l.c + (h.c - l.c) * (place - floor(place)), 6) AS value FROM q JOIN c l ON l.series_id = q.series_id AND l.b = floor(place) JOIN c h ON h.series_id = q.series_id AND h.b = least(floor(place) + 1, 15)""",
    "m22_erase_box": f"WITH b AS (SELECT series_id, {_starts('')} FROM {SHAPES}), v AS (SELECT g.*, {_in('b')} AS erase_mask FROM {GRID} g JOIN b USING (series_id)) SELECT {V4}, CASE WHEN erase_mask THEN -9.0 ELSE hu END AS hu, erase_mask FROM v",
    "m22_swap_boxes": f"WITH b AS (SELECT series_id, {_starts('a')}, {_starts('b')} FROM {SHAPES}), v AS (SELECT g.*, b.* EXCLUDE series_id, abs(saz - sbz) >= 3 OR abs(say - sby) >= 6 OR abs(sax - sbx) >= 6 AS apart, {_in('a')} AS in_a, {_in('b')} AS in_b FROM {GRID} g JOIN b USING (series_id)) SELECT series_id, " + ", ".join(f"CASE WHEN apart AND in_a THEN {a} - sa{a} + sb{a} WHEN apart AND in_b THEN {a} - sb{a} + sa{a} ELSE {a} END AS {a}" for a in "zyx") + ", hu FROM v",
    "m23_gaussian_blur": f"""WITH k AS (SELECT unnest([-1, 0, 1]) AS d, unnest([a, b, a]) AS w FROM (SELECT exp(-0.5::DOUBLE) / (1 + 2 * exp(-0.5::DOUBLE)) AS a, 1 / (1 + 2 * exp(-0.5::DOUBLE)) AS b)),
m AS (SELECT i, CASE WHEN i + d = 8 THEN 6 ELSE abs(i + d) END AS src, sum(w) AS w FROM k, range(0, 8) r(i) GROUP BY ALL)
SELECT vec_id, CAST(r.i AS INTEGER) AS y, CAST(c.i AS INTEGER) AS x, round(2.0 * sum(embedding[CAST(r.src * 8 + c.src + 1 AS INTEGER)]::DOUBLE * r.w * c.w), 5) AS value FROM embeddings, m r, m c GROUP BY ALL""",
    "m20_random_crops": f"""WITH v AS (SELECT vec_id AS series_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
d AS (SELECT series_id, e, i AS patch_id, t, {", ".join(f"CAST(floor(('0x' || substr(md5(series_id || '|' || i || '|' || t || '|{a}|3'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * 3) AS INTEGER) AS {n}" for a, n in enumerate(("z1", "y1", "x1")))} FROM v, range(0, 4) p(i), range(0, 32) r(t)),
c AS (SELECT *, list_transform(range(0, 8), lambda q: e[(z1 + q // 4) * 16 + (y1 + q // 2 % 2) * 4 + x1 + q % 2 + 1]) AS cell FROM d),
g AS (SELECT *, list_stddev_pop(cell) >= 0.01::DOUBLE AND len(list_filter(cell, lambda x: x > 0)) BETWEEN 1 AND 7 AS good FROM c),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY series_id, patch_id ORDER BY good DESC, CASE WHEN good THEN t ELSE -t END) = 1)
SELECT series_id, CAST(patch_id AS INTEGER) AS patch_id, z1, y1, x1, array_to_string(list_sort(list_distinct(list_transform(cell, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END))), ',') AS classes, CAST(pos AS INTEGER) AS pos, round(cell[pos + 1], 6) AS value, CASE WHEN cell[pos + 1] > 0 THEN 1 ELSE 0 END AS label FROM b, range(0, 8) r(pos)""",
    "m28_muscle_fat_split": f"""WITH h AS (SELECT series_id, label, hu::DOUBLE AS v, count(*)::DOUBLE AS n FROM {HU} WHERE label IN (1, 2) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(v * n) OVER w AS cs, sum(v * v * n) OVER w AS cq, sum(n) OVER p AS tn, sum(v * n) OVER p AS ts, sum(v * v * n) OVER p AS tq FROM h WINDOW w AS (PARTITION BY series_id, label ORDER BY v), p AS (PARTITION BY series_id, label)),
k AS (SELECT series_id, label, arg_min(v, (cq - cs * cs / cn + tq - cq - (ts - cs) * (ts - cs) / (tn - cn), v)) AS cut FROM c WHERE cn < tn GROUP BY ALL)
SELECT m.series_id, y, x, hu, CASE WHEN hu <= cut AND hu > -190 AND hu <= -30 THEN m.label + 4 ELSE m.label END AS label FROM {HU} m LEFT JOIN k USING (series_id, label)""",
    "m24_remove_scan_table": f"SELECT {V4}, CASE WHEN series_id % 2 = 0 AND pow(x - 8, 2) + pow((y - 7) * 2, 2) > 81 THEN -1024.0 ELSE hu END AS hu FROM {GRID}",
    "m29_split_to_slices": f"SELECT series_id, z, string_agg(hu::INTEGER, ',' ORDER BY y, x, hu) AS image, string_agg(label, ',' ORDER BY y, x, hu) AS label FROM {GRID} GROUP BY ALL",
    "m31_low_value_clip": f"WITH d AS (SELECT series_id, list_sort(list_distinct(list(hu::DOUBLE))) AS v FROM {GRID} GROUP BY 1), l AS (SELECT series_id, v[CAST(least(floor(len(v) * 0.25::DOUBLE), len(v) - 1) AS INTEGER) + 1] AS lo, v[len(v)] AS hi FROM d) SELECT {V4}, round(coalesce((greatest(hu, lo) - lo) / nullif(hi - lo, 0), 0) * 255, 6) AS hu FROM {GRID} JOIN l USING (series_id)",
}
ORACLE |= {
    "a15_areas_bucketed": ORACLE["a15_segmentation_areas"],
    "j13_align_bucketed": ORACLE["j13_align_image_label"],
    "a25_mask_runs": _islands(f"SELECT series_id, z, y, x, class_name AS class FROM {SPARSE}"),
    "a25_mask_overlap_runs": ORACLE["a25_mask_overlap"],
    "a26_merge_class_runs": ORACLE["a26_merge_class_masks"],
    "f5_foreground_ratio_runs": f"SELECT series_id, z, count(*) FILTER (label > 0) AS fg, count(*) AS area FROM {GRID} GROUP BY ALL HAVING count(*) FILTER (label > 0) > 0.3::DOUBLE * count(*)",
    "j14_label_difference_runs": ORACLE["j14_label_difference"],
    "j14_run_intersection": _islands(" INTERSECT ".join(LABELS)),
    "j14_run_difference": _islands(" EXCEPT ".join(LABELS)),
    "j14_run_union": _islands(" UNION ".join(LABELS)),
}
