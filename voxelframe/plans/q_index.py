"""Queries of names, validation, pairing, splits, sampling and slice order."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.functions.workers import shared_folder
from voxelframe.operators import names as N
from voxelframe.operators import pairing as P
from voxelframe.operators import sampling as M
from voxelframe.operators import slices as L
from voxelframe.operators import splits as W
from voxelframe.operators import validate as V
from voxelframe.plans.views import PHASES, VOXELS, phases, table, voxels
from voxelframe.sources import files as S

T = table


def _docs(s, d):
    return T(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/img/"), F.col("source"), F.lit("/Case_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("_0000.nii.gz")).alias("img_path"))


def _labs(s, d):
    return T(s, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("/lab/"), F.col("doc_id").cast("string")).alias("label_path"))


def _listed(s, d):
    """orders written as one file for each status, then listed."""
    root = shared_folder(s, "s1")
    S.write_report(T(s, d, "orders").select("o_orderkey", "o_orderstatus").repartition("o_orderstatus"), root, "json", ["o_orderstatus"])
    return S.list_files(s, root, [".JSON"]).groupBy("parent").agg(F.count(F.lit(1)).alias("n_files"), F.min(F.col("length") > 0).alias("filled"))


def _metadata(s, d):
    root = shared_folder(s, "s2")
    S.write_report(T(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), root, "csv")
    return S.read_metadata_csv(s, root, "o_orderkey long, o_orderpriority string, o_totalprice double", ["o_orderpriority", "o_orderkey"])


def _report(s, d):
    root = shared_folder(s, "s4")
    S.write_report(T(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), root, "json", ["c_mktsegment"])
    return s.read.schema("c_custkey long, c_acctbal double, c_mktsegment string").json(root)


def _split_layout(s, d):
    root = shared_folder(s, "s5")
    split = F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train")
    S.write_split_layout(T(s, d, "orders").select(F.col("o_custkey").alias("series_id"), "o_orderkey", split.alias("split")), root)
    return S.read_split_layout(s, root).select("series_id", "o_orderkey", F.col("split").cast("string").alias("split"))


def _patch_files(s, d):
    root = shared_folder(s, "s6")
    S.write_patches(voxels(s, d).select("series_id", "z", "hu"), root)
    back = s.read.parquet(root)
    return back.groupBy("series_id").agg(F.countDistinct("series_bucket").alias("buckets"), F.count(F.lit(1)).alias("n"), F.round(F.sum("hu"), 4).alias("hu"))


DOCS = "(SELECT doc_id AS id, '/img/' || source || '/Case_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '_0000.nii.gz' AS img_path FROM documents)"
LABS = "(SELECT doc_id AS id, '/lab/' || doc_id AS label_path FROM labels)"


def _slice_names(s, d):
    name = F.concat_ws("--", F.when(F.col("p_size") % 9 == 0, "xx").otherwise("ct_00"), F.regexp_replace("p_brand", "#", ""), F.concat(F.lit("case"), F.col("p_partkey")), F.concat(F.lit("x_"), F.lpad(F.col("p_size").cast("string"), 4, "0")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("0003_"), F.lpad((F.col("p_partkey") % 5).cast("string"), 4, "0"))), F.when(F.col("p_partkey") % 11 == 0, F.lit("rest_1")))
    return T(s, d, "part").select("p_partkey", F.concat(name, F.lit(".png")).alias("name"))


def _phase_images(s, d):
    c = T(s, d, "conversations")
    phase = lambda k: F.element_at(F.array(*map(F.lit, ["N", "A", "PV", "V"])), (F.col(k) % 4 + 1).cast("int"))
    return c.where("turn % 3 < 2 and conv_id % 5 <> 1").select(F.col("conv_id").alias("patient"), phase("turn").alias("phase")), c.where("conv_id % 7 <> 2").select(F.col("conv_id").alias("patient"), phase("turn").alias("phase"))


def _tags(s, d):
    tag = F.concat(F.lit('{"00271050":{"Value":['), F.get_json_object("props", "$.k"), F.lit("]},\"00280030\":{\"Value\":[0.5,"), F.col("event_id").cast("string"), F.lit("]}}"))
    return T(s, d, "events").select("event_id", tag.alias("tags"))


def _points(s, d):
    return T(s, d, "events").select("event_id", F.concat(F.lit('{"point1":{"x":'), (F.col("event_id") % 100 / 2).cast("string"), F.lit(',"y":'), F.get_json_object("props", "$.k"), F.lit(',"z":0}}')).alias("j"))


def _experiments(s, d):
    e = T(s, d, "part").select(F.concat(F.substring_index("p_brand", "#", -1), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(".m_"), F.substring_index("p_type", " ", 1))).otherwise("")).alias("experiment"))
    q = T(s, d, "supplier").select(F.concat((F.col("s_suppkey") % 60).cast("string"), F.when(F.col("s_suppkey") % 10 == 0, ".").otherwise("")).alias("query"))
    return q, e


def _chain(s, d):
    o, c, n = T(s, d, "orders"), T(s, d, "customer"), T(s, d, "labels")
    return (o.select(F.col("o_orderkey").cast("string").alias("path")), o.where("o_orderkey % 4 <> 1").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("series_id")),
            c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("series_id"), F.col("c_nationkey").alias("point")), n.select(F.col("doc_id").alias("series_id"), F.col("quality").alias("cluster")))


def _geometry(s, d):
    li = T(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("size"), F.count(F.lit(1)).alias("spacing"))
    o = T(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 5 + 1).alias("size"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(4).cast("long")).alias("spacing"))
    return li, o


def _runs(s, d):
    return T(s, d, "events").select((F.col("user_id") % 10).alias("exp"), F.dayofmonth("ts").alias("round"), F.col("event_type").alias("model"), F.lit("ct").alias("modality"), F.when(F.col("user_id") % 20 == 3, "b").otherwise("a").alias("dataset"), F.col("event_id").alias("file"))


def _turns(s, d):
    return T(s, d, "conversations").select(F.col("conv_id").alias("patient"), F.element_at(F.array(*map(F.lit, ["N", "A", "PV", "V", "D"])), (F.col("conv_id") % 5 + 1).cast("int")).alias("phase"), F.col("turn").cast("int").alias("idx"), F.length("text").cast("double").alias("y"))


TURNS = "(SELECT conv_id AS patient, (['N', 'A', 'PV', 'V', 'D'])[CAST(conv_id % 5 AS INTEGER) + 1] AS phase, CAST(turn AS INTEGER) AS idx, CAST(length(text) AS DOUBLE) AS y FROM conversations)"
SLICES = f"(SELECT p.*, CAST(i AS INTEGER) AS idx, abs(i - label_index) AS dist FROM {PHASES} p, range(0, 100) r(i) WHERE i < n_img)"

QUERIES = {
    "p1_parse_slice_name": lambda s, d: N.parse_slice_name(_slice_names(s, d), "name", ["ct_00", "mr_00"]).drop("name"),
    "p2_series_id_from_path": lambda s, d: N.series_id_from_path(_docs(s, d), "img_path", "case").drop("img_path"),
    "p2_series_id_parent": lambda s, d: N.series_id_from_path(_docs(s, d), "img_path", "parent").drop("img_path"),
    "p3_label_path_from_image": lambda s, d: N.label_path_from_image(_docs(s, d), "img_path", "channel").drop("img_path"),
    "p4_sample_record": lambda s, d: N.sample_record(P.pair_optional(_docs(s, d), _labs(s, d), "id"), "img_path", "label_path", {1: 0, 2: 1}).select("img_path", "seg_map_path", F.array_join(F.transform(F.map_entries("label_map"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("label_map"), "reduce_zero_label", F.size("seg_fields").alias("n_fields")),
    "p5_series_number": lambda s, d: T(s, d, "pages").select("page_id", N.series_number(F.col("url")).alias("number")),
    "p7_dicom_tag_fields": lambda s, d: N.dicom_tag_fields(_tags(s, d), "tags", {"height": "00271050", "spacing": "00280030", "missing": "00431031"}, ["spacing"]).select("event_id", "height", F.col("spacing")[1].alias("spacing"), "missing"),
    "p8_resolve_experiment": lambda s, d: N.resolve_experiment(*_experiments(s, d)),
    "p9_parse_point": lambda s, d: N.parse_point(_points(s, d), "j").select("event_id", "x", "y", N.bin_point(F.col("x")).alias("bx")),
    "f1_filter_attr": lambda s, d: V.filter_attr(T(s, d, "orders"), "o_orderpriority", "1-URGENT", ["o_orderkey", "o_custkey"]),
    "f2_min_slices": lambda s, d: V.min_slices(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", 5)[0],
    "f2_min_slices_rejected": lambda s, d: V.min_slices(T(s, d, "lineitem"), "l_orderkey", 5)[1],
    "f3_valid_scan_length": lambda s, d: V.valid_scan_length(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), "l_quantity", "l_linenumber", 20),
    "f4_min_volume_size": lambda s, d: V.min_volume_size(T(s, d, "part").select("p_partkey", F.array(F.col("p_size"), (F.col("p_partkey") % 40).cast("int"), F.lit(20)).alias("shape")), "shape", [16, 16, 16], 1).drop("shape"),
    "f5_foreground_ratio": lambda s, d: V.foreground_ratio(voxels(s, d), ["series_id", "z"], "label", 0.1),
    "f6_integrity_report": lambda s, d: V.integrity_report(T(s, d, "part"), "p_partkey", {"size": (F.col("p_size") >= 10, F.col("p_size")), "brand": (F.col("p_brand").rlike("^Brand#[1-4]"), F.col("p_brand"))}),
    "f7_class_filter": lambda s, d: V.class_filter(voxels(s, d).select("series_id", "z", "label"), "label", 1),
    "f8_pair_geometry_check": lambda s, d: V.pair_geometry_check(*_geometry(s, d), "l_orderkey", ["size", "spacing"]),
    "f9_round_consistency": lambda s, d: V.round_consistency(_runs(s, d)),
    "j1_pair_required": lambda s, d: P.pair_required(_docs(s, d), _labs(s, d), "id"),
    "j2_pair_optional": lambda s, d: P.pair_optional(_docs(s, d), _labs(s, d), "id"),
    "j3_pair_status": lambda s, d: P.pair_status(*_phase_images(s, d)),
    "j4_annotated_only": lambda s, d: P.annotated_only(_docs(s, d), _labs(s, d), "id"),
    "j5_exclude_series": lambda s, d: P.exclude_series(_docs(s, d), {"toxic": T(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "poor": T(s, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))}, "id").drop("img_path"),
    "j6_attach_metadata": lambda s, d: P.attach_metadata(T(s, d, "orders").select("o_orderkey", "o_custkey"), T(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", ["c_mktsegment", "c_nationkey"]),
    "j7_annotation_chain": lambda s, d: P.annotation_chain(*_chain(s, d)).withColumn("points", F.array_join(F.col("points").cast("array<string>"), ",")),
    "j7_chain_summary": lambda s, d: P.chain_summary(P.annotation_chain(*_chain(s, d))),
    "j11_priority_lookup": lambda s, d: P.priority_lookup(T(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("priority"), F.col("l_partkey").alias("path")), "l_orderkey", "priority"),
    "j12_composite_match": lambda s, d: P.composite_match(T(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id")), T(s, d, "supplier").select(F.concat_ws("/", F.col("s_nationkey"), F.col("s_suppkey") + 100).alias("lab"), F.col("s_name")), "id", "lab"),
    "j12_substring_match": lambda s, d: P.substring_match(T(s, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 4, "0").alias("id")), T(s, d, "supplier").select("s_name"), "id", "s_name", 4),
    "j15_repair_file_location": lambda s, d: P.repair_file_location(T(s, d, "customer").select("c_custkey", F.concat(F.lit("/old/"), (F.col("c_custkey") % 7).cast("string"), F.lit("/"), F.col("c_custkey").cast("string")).alias("loc")), T(s, d, "customer").where("c_custkey % 3 <> 0").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/old/"), (F.col("c_custkey") % 7).cast("string"), F.lit("/"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("/new/"), F.col("c_custkey").cast("string"))).alias("path")), "c_custkey", "loc", "/new"),
    "j16_new_series_only": lambda s, d: P.new_series_only([T(s, d, "documents").select("doc_id"), T(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"))], T(s, d, "labels"), "doc_id"),
    "o1_numeric_id_sort": lambda s, d: W.numeric_id_sort(T(s, d, "part").select("p_name", "p_partkey"), "p_name"),
    "o2_concat_datasets": lambda s, d: P.concat_datasets([T(s, d, "customer").select(F.col("c_name").alias("name"), "c_acctbal"), T(s, d, "supplier").select(F.col("s_name").alias("name"))], ["customer", "supplier"]),
    "o3_union_labeled_unlabeled": lambda s, d: P.union_labeled_unlabeled(P.pair_required(_docs(s, d), _labs(s, d), "id"), _docs(s, d).join(_labs(s, d), "id", "left_anti")),
    "o4_folder_difference": lambda s, d: P.folder_difference(T(s, d, "orders").select(F.col("o_custkey").alias("key")), T(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key"),
    "m27_encode_categories": lambda s, d: P.encode_categories(T(s, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], {"BUILDING": 0, "MACHINERY": 1, "AUTOMOBILE": 2}),
    "a34_label_group_members": lambda s, d: P.label_group_members(_lab_rows(s, d), {"g1": ["a", "b"], "g2": ["c"]}, "lab"),
    "a34_groups_of": lambda s, d: P.groups_of(P.label_group_members(_lab_rows(s, d), {"g1": ["a", "b"], "g2": ["c"]}, "lab")).withColumn("groups", F.array_join("groups", ",")),
    "s1_list_files": _listed,
    "s2_read_metadata_csv": _metadata,
    "s4_write_report": _report,
    "s5_write_split_layout": _split_layout,
    "s6_write_patches": _patch_files,
    "s3_flatten_json_map": lambda s, d: S.flatten_json_map(T(s, d, "events").select("event_id", F.concat(F.lit('{"'), F.col("event_type"), F.lit('":'), F.col("props"), F.lit("}")).alias("j")), "j", 2),
    "s7_pending_tasks": lambda s, d: S.pending_tasks(T(s, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey"), T(s, d, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("id")), ["id"]),
    "s8_run_log_header": lambda s, d: S.run_log(T(s, d, "labels").withColumn("error", F.when(F.col("toxic") == 1, "toxic")), {"root": "x"}, date=F.lit("2020-01-01"))[1].drop("params"),
    "w1_ratio_split": lambda s, d: W.ratio_split(T(s, d, "orders"), "o_orderkey", (0.7, 0.15)),
    "w1_ratio_split_shuffled": lambda s, d: W.ratio_split(T(s, d, "orders"), "o_orderkey", (0.7, 0.15), 42),
    "w2_cumulative_split": lambda s, d: W.cumulative_split(T(s, d, "orders"), "o_orderkey"),
    "w3_kfold": lambda s, d: W.kfold(T(s, d, "orders"), "o_orderkey", 5),
    "w4_holdout_split": lambda s, d: W.holdout_split(T(s, d, "nation"), "n_nationkey", 3),
    "w4_holdout_split_orders": lambda s, d: W.holdout_split(T(s, d, "orders"), "o_orderkey", 3),
    "w5_top_n": lambda s, d: W.top_n(T(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 32),
    "w6_positive_negative_slices": lambda s, d: M.positive_negative_slices(phases(s, d), 3, 2, 1, 5),
    "w7_serial_window": lambda s, d: M.serial_window(phases(s, d), 3, 1).withColumn("idx_list", F.array_join(F.col("idx_list").cast("array<string>"), ",")),
    "w8_sliding_slice_windows": lambda s, d: M.sliding_slice_windows(T(s, d, "conversations"), "conv_id", "turn", 3, 1, 2).select("conv_id", "center", F.array_join(F.col("image_idx").cast("array<string>"), ",").alias("image_idx"), F.array_join(F.col("label_idx").cast("array<string>"), ",").alias("label_idx")),
    "w9_sample_per_case": lambda s, d: W.sample_per_case(T(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 0.3, 9),
    "w10_activate_case_ratio": lambda s, d: W.activate_case_ratio(T(s, d, "customer").select(F.col("c_mktsegment").alias("split"), "c_custkey"), "split", "c_custkey", 0.2, 4),
    "w11_ratio_sample": lambda s, d: W.ratio_sample(T(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 0.01, 6),
    "w12_random_slices_per_scan": lambda s, d: M.random_slices_per_scan(phases(s, d), 2, 8),
    "w13_relative_index_target": lambda s, d: M.relative_index_target(M.random_slices_per_scan(phases(s, d), 3, 8), "normal", 3),
    "w14_relative_y_target": lambda s, d: M.relative_y_target(_turns(s, d), phases(s, d), -400, -10, 2, 3),
    "w15_relative_position_label": lambda s, d: M.relative_position_label(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_quantity", "l_linenumber", "l_linenumber").withColumn("label", F.round("label", 6)),
    "w16_order_dicom_slices": lambda s, d: L.order_dicom_slices(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.6), F.lit(0.8)).alias("o"), F.array(F.col("l_quantity"), F.col("l_quantity") * 5, F.col("l_linenumber") * 5.0).alias("p")), "l_orderkey", "l_linenumber", F.round(L.slice_distance(F.col("o"), F.col("p")), 6), ["l_partkey"]),
    "w17_order_slices_by_position": lambda s, d: L.order_slices_by_position(T(s, d, "conversations").select("conv_id", "turn", F.when(F.length("text") > 15, F.length("text")).alias("pos")), "conv_id", "turn", "pos"),
    "w18_foreground_span": lambda s, d: L.foreground_span(voxels(s, d), "series_id", "z", "label", 2),
    "w20_assign_ids": lambda s, d: N.assign_ids(T(s, d, "part").groupBy(F.col("p_name").alias("path")).agg(F.count(F.lit(1)).alias("n"))),
    "m30_expand_samples": lambda s, d: W.expand_samples(T(s, d, "nation").select("n_nationkey"), 3),
    "m30_expand_samples_lineitem": lambda s, d: W.expand_samples(T(s, d, "lineitem").select("l_orderkey", "l_linenumber"), 3),
}


def _lab_rows(s, d):
    t = T(s, d, "customer")
    return t.select(F.concat_ws("/", F.concat(F.lit("AR"), F.col("c_custkey")), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("AR"), F.col("c_custkey") + 1))).alias("lab"), F.when(F.col("c_custkey") % 2 == 0, 1).alias("a"), F.when(F.col("c_custkey") % 3 == 0, 1).alias("b"), F.when(F.col("c_acctbal") > 0, 1).alias("c"))


LAB_ROWS = "(SELECT 'AR' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '/AR' || (c_custkey + 1) ELSE '' END AS lab, c_custkey % 2 = 0 AND c_custkey % 3 = 0 AS g1, c_acctbal > 0 AS g2 FROM customer)"
MEMBERS = f"(SELECT DISTINCT g AS \"group\", unnest(string_split(lab, '/')) AS lab_id FROM (SELECT 'g1' AS g, lab FROM {LAB_ROWS} WHERE g1 UNION ALL SELECT 'g2', lab FROM {LAB_ROWS} WHERE g2))"
NAME = "(SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'xx' ELSE 'ct_00' END AS mo, replace(p_brand, '#', '') AS ds, p_size, p_partkey % 2 = 0 AS m, p_partkey % 11 = 0 AS x FROM part)"
CHAIN = """(SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 4 <> 1 THEN o_custkey END AS series_id, c_nationkey::VARCHAR AS points, quality AS cluster
  FROM orders LEFT JOIN customer ON o_orderkey % 4 <> 1 AND c_custkey = o_custkey AND c_custkey % 3 <> 0 LEFT JOIN labels ON o_orderkey % 4 <> 1 AND doc_id = o_custkey)"""
REASON = "CASE WHEN series_id IS NULL THEN 'series miss' WHEN points IS NULL THEN 'location miss' WHEN cluster IS NULL THEN 'cluster miss' ELSE 'valid' END"
ORDERED = "(SELECT o_orderkey, row_number() OVER (ORDER BY {}) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderkey FROM orders))"
SPLIT = "SELECT o_orderkey, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM "
STATUS = """WITH i AS (SELECT DISTINCT conv_id AS patient, (['N', 'A', 'PV', 'V'])[CAST(turn % 4 AS INTEGER) + 1] AS phase FROM conversations WHERE turn % 3 < 2 AND conv_id % 5 <> 1),
l AS (SELECT DISTINCT conv_id AS patient, (['N', 'A', 'PV', 'V'])[CAST(turn % 4 AS INTEGER) + 1] AS phase FROM conversations WHERE conv_id % 7 <> 2),
b AS (SELECT coalesce(i.patient, l.patient) AS patient, coalesce(i.phase, l.phase) AS phase, i.patient IS NOT NULL AS img, l.patient IS NOT NULL AS lab FROM i FULL JOIN l ON i.patient = l.patient AND i.phase = l.phase),
g AS (SELECT patient, bool_or(img) AS img, bool_or(lab) AS lab, bool_or(img AND phase = 'A') AND bool_or(img AND phase = 'PV') AS apvv FROM b GROUP BY 1)
SELECT b.patient, CASE WHEN NOT g.lab THEN 'img_only' WHEN NOT g.img THEN 'label_only' WHEN NOT apvv THEN 'CTEnhanceScanPhaseLost' ELSE 'normal' END AS status, apvv, phase FROM b JOIN g USING (patient)"""

ORACLE = {
    "p1_parse_slice_name": f"""WITH e AS (SELECT *, CASE WHEN (m AND x) THEN 'part count' WHEN mo = 'xx' THEN 'modality' WHEN NOT m AND x THEN 'instance' END AS error FROM {NAME}),
ok AS (SELECT *, error IS NULL AS k FROM e)
SELECT p_partkey, CASE WHEN k THEN CASE WHEN m THEN 'mask' ELSE 'image' END END AS type, CASE WHEN k THEN mo END AS modality, CASE WHEN k THEN ds END AS dataset, CASE WHEN k THEN 'case' || p_partkey END AS case_id, CASE WHEN k THEN 'x' END AS direction, CASE WHEN k THEN p_size END AS slice_idx,
  CASE WHEN k AND m THEN 3 END AS class_instance, CASE WHEN k AND m THEN CAST(p_partkey % 5 AS INTEGER) END AS instance_id, error FROM ok""",
    "p2_series_id_from_path": "SELECT doc_id AS id, lpad(CAST(doc_id AS VARCHAR), 6, '0') AS series_id FROM documents",
    "p2_series_id_parent": "SELECT doc_id AS id, source AS series_id FROM documents",
    "p3_label_path_from_image": f"SELECT id, replace(img_path, '_0000.nii.gz', '.nii.gz') AS label_path FROM {DOCS}",
    "p4_sample_record": f"SELECT img_path, label_path AS seg_map_path, '1:0,2:1' AS label_map, false AS reduce_zero_label, 0 AS n_fields FROM {DOCS} LEFT JOIN {LABS} USING (id)",
    "p5_series_number": r"SELECT page_id, TRY_CAST(regexp_extract(url, '(\d+)', 1) AS BIGINT) AS number FROM pages",
    "p7_dicom_tag_fields": "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS height, CAST(event_id AS DOUBLE) AS spacing, CAST(NULL AS DOUBLE) AS missing FROM events",
    "p8_resolve_experiment": r"""WITH e AS (SELECT DISTINCT split_part(p_brand, '#', -1) || CASE WHEN p_size % 3 = 0 THEN '.m_' || split_part(p_type, ' ', 1) ELSE '' END AS x FROM part),
k AS (SELECT key, arg_min(x, (how, x)) AS x FROM (SELECT x AS key, x, 0 AS how FROM e UNION ALL SELECT regexp_replace(x, '\.[A-Za-z].*$', ''), x, 1 FROM e) GROUP BY key),
q AS (SELECT (s_suppkey % 60)::VARCHAR || CASE WHEN s_suppkey % 10 = 0 THEN '.' ELSE '' END AS query FROM supplier)
SELECT query, CASE WHEN NOT ends_with(query, '.') THEN x END AS experiment, CASE WHEN ends_with(query, '.') THEN 'trailing dot' WHEN x IS NULL THEN 'no match' END AS error FROM q LEFT JOIN k ON query = key""",
    "p9_parse_point": "SELECT event_id, CAST(round_even(event_id % 100 / 2.0, 0) AS INTEGER) AS x, CAST(json_extract(props, '$.k') AS INTEGER) AS y, CAST(least(floor(round_even(event_id % 100 / 2.0, 0) / 8), 63) AS INTEGER) AS bx FROM events",
    "f1_filter_attr": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "f2_min_slices": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 5)",
    "f2_min_slices_rejected": "SELECT count(*) AS rejected FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) < 5)",
    "f3_valid_scan_length": "SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem WHERE l_quantity - l_linenumber >= 20",
    "f4_min_volume_size": "WITH r AS (SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 18 THEN '0' END, CASE WHEN p_partkey % 40 < 18 THEN '1' END) AS s FROM part) SELECT p_partkey, s = '' AS kept, CASE WHEN s <> '' THEN 'short axes ' || s END AS reason FROM r",
    "f5_foreground_ratio": f"SELECT series_id, z, count(*) FILTER (label > 0) AS fg, count(*) AS area FROM {VOXELS} GROUP BY ALL HAVING count(*) FILTER (label > 0) > 0.1 * count(*)",
    "f6_integrity_report": "SELECT p_partkey AS id, 'size' AS failed_rule, p_size::VARCHAR AS detail FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-4]')",
    "f7_class_filter": f"SELECT series_id, z, CASE WHEN label > 1 THEN 0 ELSE label END AS label FROM {VOXELS}",
    "f8_pair_geometry_check": """WITH l AS (SELECT l_orderkey, CAST(max(l_linenumber) AS BIGINT) AS size, count(*) AS spacing FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderkey % 5 + 1 AS size, CASE WHEN o_orderkey % 2 = 0 THEN 4 END AS spacing FROM orders)
SELECT l_orderkey, 'size' AS field, l.size::VARCHAR AS image_value, o.size::VARCHAR AS label_value FROM l JOIN o ON l_orderkey = o_orderkey WHERE l.size IS DISTINCT FROM o.size
UNION ALL SELECT l_orderkey, 'spacing', l.spacing::VARCHAR, o.spacing::VARCHAR FROM l JOIN o ON l_orderkey = o_orderkey WHERE l.spacing IS DISTINCT FROM o.spacing""",
    "f9_round_consistency": """WITH r AS (SELECT user_id % 10 AS exp, dayofmonth(ts) AS round, event_type AS model, count(*) AS files FROM events GROUP BY ALL), n AS (SELECT user_id % 10 AS exp, count(DISTINCT user_id % 20 = 3) AS n_datasets FROM events GROUP BY 1)
SELECT exp, n_datasets, CAST(sum(files) AS BIGINT) AS n_files, CASE WHEN n_datasets > 1 THEN 'several data sets' WHEN max(files) > 1 THEN 'several files in a run' END AS violation FROM r JOIN n USING (exp) GROUP BY exp, n_datasets""",
    "j1_pair_required": f"SELECT id, img_path, label_path FROM {DOCS} JOIN {LABS} USING (id)",
    "j2_pair_optional": f"SELECT id, img_path, label_path FROM {DOCS} LEFT JOIN {LABS} USING (id)",
    "j3_pair_status": STATUS,
    "j4_annotated_only": f"SELECT * FROM {DOCS} WHERE id IN (SELECT doc_id FROM labels)",
    "j5_exclude_series": "SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "j6_attach_metadata": "SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "j7_annotation_chain": f"SELECT path, series_id, points, cluster, {REASON} AS reason FROM {CHAIN}",
    "j7_chain_summary": f"SELECT {REASON} AS reason, count(*) AS n FROM {CHAIN} GROUP BY 1",
    "j11_priority_lookup": "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS path FROM lineitem GROUP BY 1",
    "j12_composite_match": "WITH r AS (SELECT s_nationkey || '/' || (s_suppkey + 100) AS lab, s_name, unnest([s_nationkey::VARCHAR, (s_suppkey + 100)::VARCHAR]) AS part FROM supplier), f AS (SELECT part, min((lab, s_name)) AS m FROM r GROUP BY 1) SELECT n_nationkey::VARCHAR AS id, m[1] AS lab, m[2] AS s_name FROM nation LEFT JOIN f ON n_nationkey::VARCHAR = part",
    "j12_substring_match": "SELECT lpad(c_custkey::VARCHAR, 4, '0') AS id, (SELECT min(s_name) FROM supplier WHERE contains(s_name, lpad(c_custkey::VARCHAR, 4, '0'))) AS s_name FROM customer",
    "j15_repair_file_location": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '/old/' || c_custkey % 7 || '/' || c_custkey ELSE '/new/' || c_custkey END END AS loc, c_custkey % 3 <> 0 AND c_custkey % 2 = 1 AS repaired FROM customer",
    "j16_new_series_only": "SELECT doc_id FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings) WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "o1_numeric_id_sort": "SELECT p_name, p_partkey FROM part",
    "o2_concat_datasets": "SELECT c_name AS name, c_acctbal, 'customer' AS source FROM customer UNION ALL SELECT s_name, NULL, 'supplier' FROM supplier",
    "o3_union_labeled_unlabeled": f"SELECT img_path, label_path FROM {DOCS} LEFT JOIN {LABS} USING (id)",
    "o4_folder_difference": "WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders), b AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0) SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'a' WHEN a.key IS NULL THEN 'b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.key = b.key",
    "m27_encode_categories": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 END AS c_mktsegment FROM customer",
    "a34_label_group_members": f"SELECT * FROM {MEMBERS}",
    "a34_groups_of": f"SELECT lab_id, string_agg(\"group\", ',' ORDER BY \"group\") AS groups FROM {MEMBERS} GROUP BY 1",
    "s1_list_files": "SELECT 'o_orderstatus=' || o_orderstatus AS parent, CAST(1 AS BIGINT) AS n_files, true AS filled FROM orders GROUP BY o_orderstatus",
    "s2_read_metadata_csv": "SELECT o_orderpriority, o_orderkey FROM orders",
    "s4_write_report": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
    "s5_write_split_layout": "SELECT o_custkey AS series_id, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders",
    "s6_write_patches": f"SELECT series_id, CAST(1 AS BIGINT) AS buckets, count(*) AS n, round(sum(hu), 4) AS hu FROM {VOXELS} GROUP BY series_id",
    "s3_flatten_json_map": "SELECT event_id, event_type AS level_1, 'k' AS level_2, json_extract_string(props, '$.k') AS value FROM events",
    "s7_pending_tasks": "SELECT o_custkey AS id, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)",
    "s8_run_log_header": "SELECT '2020-01-01' AS date, count(*) FILTER (toxic = 0) AS n_ok, count(*) FILTER (toxic = 1) AS n_error FROM labels",
    "w1_ratio_split": SPLIT + ORDERED.format("o_orderkey"),
    "w1_ratio_split_shuffled": SPLIT + ORDERED.format("md5(o_orderkey || '|42'), o_orderkey"),
    "w2_cumulative_split": "SELECT o_orderkey, CASE WHEN pos < floor(n * 0.7::DOUBLE) - 1 THEN 'train' WHEN pos < floor(n * 0.75::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM " + ORDERED.format("o_orderkey"),
    "w3_kfold": "SELECT o_orderkey, CAST(((pos + 1) * 5 - 1) // n + 1 AS INTEGER) AS fold FROM " + ORDERED.format("o_orderkey"),
    "w4_holdout_split": "SELECT n_nationkey, unnest(CASE WHEN n_nationkey = 3 THEN ['test'] ELSE ['train', 'val'] END) AS split FROM nation",
    "w4_holdout_split_orders": "SELECT o_orderkey, unnest(CASE WHEN o_orderkey = 3 THEN ['test'] ELSE ['train', 'val'] END) AS split FROM (SELECT DISTINCT o_orderkey FROM orders)",
    "w5_top_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 32",
    "w6_positive_negative_slices": f"""WITH s AS (SELECT * FROM {SLICES} WHERE status = 'normal' AND label_index IS NOT NULL)
SELECT patient, phase, idx, true AS is_positive FROM s WHERE dist <= 1 UNION ALL SELECT patient, phase, idx, false FROM (SELECT * FROM s WHERE dist > 1 QUALIFY row_number() OVER (PARTITION BY patient, phase ORDER BY md5(concat_ws('|', patient, phase, idx, '5')), idx) <= 2)""",
    "w7_serial_window": f"SELECT patient, phase, label_index AS center, concat_ws(',', label_index - 1, label_index, label_index + 1) AS idx_list FROM {PHASES} WHERE label_index >= 1 AND label_index + 1 < n_img",
    "w8_sliding_slice_windows": "WITH p AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn AS center, concat_ws(',', turn - 1, turn, turn + 1) AS image_idx, turn::VARCHAR AS label_idx FROM p WHERE turn >= 1 AND turn <= n - 2 AND (turn - 1) % 2 = 0",
    "w9_sample_per_case": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws('|', o_custkey, o_orderkey, '9')), o_orderkey) <= greatest(floor(count(*) OVER (PARTITION BY o_custkey) * 0.3::DOUBLE), 1)",
    "w10_activate_case_ratio": "SELECT c_mktsegment AS split, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '|4'), c_custkey) <= greatest(floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.2::DOUBLE), 1)",
    "w11_ratio_sample": "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY md5(o_orderkey || '|6'), o_orderkey) <= greatest(floor(count(*) OVER () * 0.01::DOUBLE), 1)",
    "w12_random_slices_per_scan": f"SELECT patient, phase, idx, label_index FROM {SLICES} WHERE status = 'normal' AND label_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient, phase ORDER BY md5(concat_ws('|', patient, phase, idx, '8')), idx) <= 2",
    "w13_relative_index_target": f"SELECT patient, phase, idx, label_index, greatest(least(idx - label_index, 2), -2) AS target FROM {SLICES} WHERE status = 'normal' AND label_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient, phase ORDER BY md5(concat_ws('|', patient, phase, idx, '8')), idx) <= 3",
    "w14_relative_y_target": f"SELECT patient, phase, idx, CAST(trunc(y - label_y + y_min + 1) AS INTEGER) AS target FROM (SELECT t.*, label_y, min(y) OVER (PARTITION BY patient, phase) AS y_min FROM {TURNS} t JOIN (SELECT patient, phase, label_y FROM {PHASES}) USING (patient, phase)) WHERE y - label_y BETWEEN -400 AND -10 QUALIFY row_number() OVER (PARTITION BY patient, phase ORDER BY md5(concat_ws('|', patient, phase, idx, '3')), idx) <= 2",
    "w15_relative_position_label": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity <> l_linenumber THEN round((l_quantity - l_linenumber) / 10, 6) END AS label, l_quantity <> l_linenumber AS valid FROM lineitem",
    "w16_order_dicom_slices": "WITH o AS (SELECT l_orderkey, l_linenumber, arg_min(d, (l_partkey, d)) AS distance FROM (SELECT *, round(-0.8 * l_quantity * 5 + 0.6 * l_linenumber * 5, 6)::DOUBLE AS d FROM lineitem) GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY distance, l_linenumber) - 1 AS INTEGER) AS position FROM o",
    "w17_order_slices_by_position": "WITH p AS (SELECT conv_id, turn, CASE WHEN length(text) > 15 THEN length(text) END AS pos FROM conversations), q AS (SELECT *, bool_or(pos IS NULL) OVER (PARTITION BY conv_id) AS rejected FROM p) SELECT *, CASE WHEN NOT rejected THEN CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC, turn) - 1 AS INTEGER) END AS place FROM q",
    "w18_foreground_span": f"WITH g AS (SELECT series_id, min(z) FILTER (label > 0) AS first, max(z) FILTER (label > 0) AS last, max(z) + 1 AS depth FROM {VOXELS} GROUP BY 1) SELECT series_id, first, last, CASE WHEN first IS NOT NULL THEN greatest(0, first - 1) END AS start_min, CASE WHEN first IS NOT NULL THEN greatest(0, least(CASE WHEN last > first THEN last - 1 ELSE first END, depth - 2)) END AS start_max FROM g",
    "w20_assign_ids": "SELECT p_name AS path, count(*) AS n, row_number() OVER (ORDER BY p_name) - 1 AS id FROM part GROUP BY p_name",
    "m30_expand_samples": "SELECT n_nationkey, unnest([0, 1, 2]) AS copy_no FROM nation",
    "m30_expand_samples_lineitem": "SELECT l_orderkey, l_linenumber, unnest([0, 1, 2]) AS copy_no FROM lineitem",
}
