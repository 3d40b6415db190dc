"""Queries of the statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.operators import stats as S
from voxelframe.plans.views import CASES, PHASES, PIXELS, VOXELS, cases, phases, pixels, table, voxels

CLASS_STATS = f"""(WITH v AS (SELECT series_id, CAST(label AS VARCHAR) AS class, hu FROM {VOXELS} UNION ALL SELECT series_id, 'whole', hu FROM {VOXELS}),
g AS (SELECT series_id, class, avg(hu) AS mean, stddev_pop(hu) AS std, min(hu) AS min, max(hu) AS max, count(*) AS count, quantile_cont(hu, 0.05) AS lower_bound, quantile_cont(hu, 0.95) AS upper_bound FROM v GROUP BY 1, 2)
SELECT *, CASE WHEN class <> 'whole' THEN CAST(row_number() OVER (PARTITION BY series_id, class = 'whole' ORDER BY mean, class) AS INTEGER) END AS mean_rank FROM g)"""


def _slices(spark, d):
    t = table(spark, d, "conversations")
    return t.select(F.col("conv_id").alias("patient"), (F.col("conv_id") % 5).cast("string").alias("phase"), F.concat(F.lit("img_"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".png")).alias("file"), F.length("text").cast("double").alias("y"))


def _patches(spark, d):
    v = voxels(spark, d)
    return v.select("series_id", F.col("z").alias("patch_id"), F.when(F.col("label") > 0, F.array("label", "label2")).alias("classes"))


def _classmap(spark, d):
    p = table(spark, d, "part")
    return p.select(F.substring_index("p_type", " ", 1).alias("dataset"), F.substring_index("p_type", " ", -1).alias("class_name"), (F.col("p_size") % 12).alias("class_id")).distinct()


QUERIES = {
    "a1_series_stats": lambda s, d: S.series_stats(table(s, d, "lineitem"), ["l_orderkey"], "l_extendedprice").select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p1", "p5", "p25", "median", "p75", "p95", "p99", "sum")], "n", F.round("sum_sq", 0).alias("sum_sq")),
    "a2_global_stats": lambda s, d: S.global_stats(S.series_stats(table(s, d, "lineitem"), ["l_orderkey"], "l_extendedprice")).select(*[F.round(c, 3).alias(c) for c in ("min", "max", "mean", "std")]),
    "a3_class_stats": lambda s, d: S.class_stats(voxels(s, d), "series_id", "label", "hu").select("series_id", "class", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "lower_bound", "upper_bound")], "count", "mean_rank"),
    "a4_class_mean_wide": lambda s, d: S.class_mean_wide(S.class_stats(voxels(s, d), "series_id", "label", "hu"), table(s, d, "orders").select(F.col("o_orderkey").alias("series_id"), "o_orderpriority"), "series_id", ["0", "1", "2"]).select("series_id", "o_orderpriority", *[F.round(f"mean_{c}", 4).alias(f"mean_{c}") for c in "012"]),
    "a5_hierarchical_distribution": lambda s, d: S.hierarchical_distribution(cases(s, d), "dataset", "case_id", "slice_idx", "channel", "value", 20, 5, 7, index=cases(s, d)).select("dataset", "channel", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")]),
    "a6_label_presence": lambda s, d: S.label_presence(pixels(s, d).select(F.col("label").alias("dataset"), "series_id", F.floor(F.col("value") * 10).cast("int").alias("bin")), "dataset", "series_id", "bin", 30, 3),
    "a7_existing_classes": lambda s, d: S.existing_classes(table(s, d, "part").select(F.substring_index("p_type", " ", 1).alias("dataset"), (F.col("p_size") % 7).alias("lab")), _classmap(s, d), "dataset", "lab"),
    "a8_slice_counts": lambda s, d: S.slice_counts(cases(s, d), "modality", "dataset"),
    "a9_case_counts": lambda s, d: S.case_counts(cases(s, d), "modality", "dataset", ["case_id", "direction"]).withColumn("avg_slices", F.round("avg_slices", 4)),
    "a10_case_slice_map": lambda s, d: S.case_slice_map(cases(s, d), ["dataset", "case_id", "direction"], "slice_idx").withColumn("slice_list", F.array_join("slice_list", ",")),
    "a11_registry_summary": lambda s, d: S.registry_summary(phases(s, d), ["normal", "img_only", "label_only"]),
    "a12_patient_sample_counts": lambda s, d: S.patient_sample_counts(phases(s, d), 3, 2, 1),
    "a13_phase_slice_index": lambda s, d: S.phase_slice_index(_slices(s, d)).select("patient", "phase", F.array_join(F.transform(F.map_entries("idx_to_y"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("int"))), ",").alias("idx_to_y"), "y_min", "y_max"),
    "a14_crop_summary": lambda s, d: S.crop_summary(_patches(s, d)).withColumn("classes", F.array_join("classes", ",")),
    "a14_crop_totals": lambda s, d: S.crop_totals(S.crop_summary(_patches(s, d))),
    "a30_class_histogram": lambda s, d: S.class_histogram(voxels(s, d), "label", "hu", 20, 0.5),
    "a35_impute_mean": lambda s, d: S.impute_mean(table(s, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size")), ["p_size"], ["p_brand"]).withColumn("p_size", F.round("p_size", 6)),
    "a36_minmax_scale": lambda s, d: S.minmax_scale(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 8)),
}

ORACLE = {
    "a1_series_stats": "SELECT l_orderkey, " + ", ".join(f"round({e}, 6) AS {a}" for a, e in {"std": "stddev_pop(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "mean": "avg(l_extendedprice)", "sum": "sum(l_extendedprice)", **{k: f"quantile_cont(l_extendedprice, {q})" for k, q in S.QUANTILES.items()}}.items()) + ", count(*) AS n, round(sum(l_extendedprice * l_extendedprice), 0) AS sum_sq FROM lineitem GROUP BY l_orderkey",
    "a2_global_stats": "SELECT round(min(l_extendedprice), 3) AS min, round(max(l_extendedprice), 3) AS max, round(avg(l_extendedprice), 3) AS mean, round(stddev_pop(l_extendedprice), 3) AS std FROM lineitem",
    "a3_class_stats": f"SELECT series_id, class, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max, round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound, count, mean_rank FROM {CLASS_STATS}",
    "a4_class_mean_wide": f"SELECT o_orderkey AS series_id, any_value(o_orderpriority) AS o_orderpriority, " + ", ".join(f"round(avg(hu) FILTER (label = {c}), 4) AS mean_{c}" for c in "012") + f" FROM orders LEFT JOIN {VOXELS} v ON v.series_id = o_orderkey GROUP BY o_orderkey",
    "a5_hierarchical_distribution": f"""WITH p AS (SELECT * FROM {CASES}),
c AS (SELECT dataset, case_id FROM (SELECT DISTINCT dataset, case_id FROM p) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5(case_id || '|7'), case_id) <= 20),
s AS (SELECT dataset, case_id, slice_idx FROM (SELECT DISTINCT dataset, case_id, slice_idx FROM p SEMI JOIN c USING (dataset, case_id)) QUALIFY row_number() OVER (PARTITION BY dataset, case_id ORDER BY md5(slice_idx || '|7'), slice_idx) <= 5),
a AS (SELECT dataset, case_id, slice_idx, channel, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS sd FROM p SEMI JOIN s USING (dataset, case_id, slice_idx) GROUP BY ALL),
b AS (SELECT dataset, case_id, channel, min(lo) AS lo, max(hi) AS hi, avg(m) AS m, avg(sd) AS sd FROM a GROUP BY ALL)
SELECT dataset, channel, round(min(lo), 6) AS min, round(max(hi), 6) AS max, round(avg(m), 6) AS mean, round(avg(sd), 6) AS std FROM b GROUP BY ALL""",
    "a6_label_presence": f"""WITH p AS (SELECT DISTINCT label AS dataset, series_id, CAST(floor(value * 10) AS INTEGER) AS label FROM {PIXELS}),
k AS (SELECT dataset, series_id FROM (SELECT DISTINCT dataset, series_id FROM p) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5(series_id || '|3'), series_id) <= 30)
SELECT dataset, label, count(*) AS n_slices FROM p SEMI JOIN k USING (dataset, series_id) GROUP BY ALL""",
    "a7_existing_classes": """WITH m AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS dataset, split_part(p_type, ' ', -1) AS class_name, p_size % 12 AS class_id FROM part),
s AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS dataset, p_size % 7 - 1 AS class_id FROM part)
SELECT dataset, class_name, class_id FROM m WHERE class_id = 0 OR EXISTS (SELECT 1 FROM s WHERE s.dataset = m.dataset AND s.class_id = m.class_id)""",
    "a8_slice_counts": f"SELECT modality, dataset, CAST(CASE WHEN grouping(modality) = 1 THEN 2 WHEN grouping(dataset) = 1 THEN 1 ELSE 0 END AS INTEGER) AS level, count(*) AS n FROM {CASES} GROUP BY ROLLUP (modality, dataset)",
    "a9_case_counts": f"""WITH g AS (SELECT modality, dataset, count(DISTINCT (case_id, direction)) AS n_cases, round(count(*) / count(DISTINCT (case_id, direction)), 2) AS avg_slices FROM {CASES} GROUP BY ALL)
SELECT * FROM g UNION ALL SELECT modality, NULL, CAST(sum(n_cases) AS BIGINT), round(avg(avg_slices), 4) FROM g GROUP BY modality""",
    "a10_case_slice_map": f"SELECT dataset, case_id, direction, string_agg(DISTINCT slice_idx, ',' ORDER BY slice_idx) AS slice_list FROM {CASES} GROUP BY ALL",
    "a11_registry_summary": f"SELECT CAST(sum(n_img) FILTER (phase IN ('N', 'A', 'PV', 'V')) AS BIGINT) AS num_img, count(DISTINCT patient) AS num_patient, count(label_index) AS num_label, count(DISTINCT patient) FILTER (status = 'normal') AS n_normal, count(DISTINCT patient) FILTER (status = 'img_only') AS n_img_only, count(DISTINCT patient) FILTER (status = 'label_only') AS n_label_only FROM {PHASES}",
    "a12_patient_sample_counts": f"SELECT patient, CAST(sum(CASE WHEN label_index IS NOT NULL THEN 5 ELSE 0 END) AS BIGINT) AS n_samples, count(label_index) AS n_label, coalesce(bool_and(7 <= n_img) FILTER (label_index IS NOT NULL), true) AS ok FROM {PHASES} GROUP BY patient",
    "a13_phase_slice_index": "SELECT conv_id AS patient, CAST(conv_id % 5 AS VARCHAR) AS phase, string_agg(turn || ':' || length(text), ',' ORDER BY turn) AS idx_to_y, CAST(min(length(text)) AS DOUBLE) AS y_min, CAST(max(length(text)) AS DOUBLE) AS y_max FROM conversations GROUP BY conv_id",
    "a14_crop_summary": f"WITH v AS (SELECT series_id, z, label, label2 FROM {VOXELS}) SELECT series_id, (SELECT count(*) FROM v b WHERE b.series_id = a.series_id) AS num_patches, bool_or(label > 0) AS anno_available, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS classes FROM v a LEFT JOIN (SELECT series_id AS sid, label AS c FROM v WHERE label > 0 UNION SELECT series_id, label2 FROM v WHERE label > 0) ON sid = series_id GROUP BY series_id",
    "a14_crop_totals": f"SELECT count(*) AS num_series, CAST(sum(n) AS BIGINT) AS num_patches, count(*) FILTER (a) AS num_annotated FROM (SELECT series_id, count(*) AS n, bool_or(label > 0) AS a FROM {VOXELS} GROUP BY 1)",
    "a30_class_histogram": f"""WITH v AS (SELECT label AS class, hu, min(hu) OVER (PARTITION BY label) AS lo0, max(hu) OVER (PARTITION BY label) AS hi0 FROM {VOXELS}),
b AS (SELECT class, lo0, hi0, CAST(least(floor((hu - lo0) / ((hi0 - lo0) / 20)), 19) AS INTEGER) AS bin FROM v)
SELECT class, bin, lo0 + bin * ((hi0 - lo0) / 20) AS lo, lo0 + (bin + 1) * ((hi0 - lo0) / 20) AS hi, count(*) AS n, count(*) * 0.5::DOUBLE AS scaled FROM b GROUP BY class, bin, lo0, hi0""",
    "a35_impute_mean": "WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 10 THEN p_size::DOUBLE END AS s FROM part) SELECT p_partkey, p_brand, round(coalesce(s, avg(s) OVER (PARTITION BY p_brand)), 6) AS p_size FROM p",
    "a36_minmax_scale": "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 8) AS c_acctbal FROM customer",
}
