"""Keys, paths and records: projections without a shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.columns import round_even
from voxelframe.functions.ranks import ranked


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parse_slice_name(df: DataFrame, name_col: str, modalities: Sequence[str]) -> DataFrame:
    """`modality--dataset--case--direction_index.png` is an image; a fifth part `class_instance` makes it a mask.

    Adds type, modality, dataset, case_id, direction, slice_idx, class_instance, instance_id, and
    error (null if none): another number of parts, an unknown modality, numbers that are none.
    """
    p = F.split(F.regexp_replace(F.col(name_col), r"\.png$", ""), "--")
    n = F.size(p)
    at = lambda i: F.try_element_at(p, F.lit(i))
    modality, place, inst = F.substring_index(at(1), "_", 1), F.split(at(4), "_"), F.split(at(5), "_")
    idx = F.try_element_at(place, F.lit(2)).try_cast("int")
    error = (F.when(F.col(name_col).isNull() | ~n.isin(4, 5), "part count").when(~at(1).isin(*modalities) & ~modality.isin(*modalities), "modality")
             .when((F.size(place) != 2) | idx.isNull(), "slice").when((n == 5) & ((F.size(inst) != 2) | F.try_element_at(inst, F.lit(1)).try_cast("int").isNull() | F.try_element_at(inst, F.lit(2)).try_cast("int").isNull()), "instance"))
    ok = lambda c: F.when(error.isNull(), c)
    return df.select("*", ok(F.when(n == 5, "mask").otherwise("image")).alias("type"), ok(at(1)).alias("modality"), ok(at(2)).alias("dataset"), ok(at(3)).alias("case_id"), ok(F.try_element_at(place, F.lit(1))).alias("direction"), ok(idx).alias("slice_idx"),
                     ok(F.try_element_at(inst, F.lit(1)).try_cast("int")).alias("class_instance"), ok(F.try_element_at(inst, F.lit(2)).try_cast("int")).alias("instance_id"), error.alias("error"))


#: How a data set names its series: (what is taken off the front, what is taken off the end), or the parent folder.
SERIES_RULES: dict[str, tuple[str, str] | str] = {
    "stem": ("", r"\.[^.]+"), "case": ("Case_", r"(_0000)?\.nii\.gz"), "volume": ("volume-", r"\.nii\.gz"), "channel": ("", r"_0000\.nii\.gz"), "image": ("", r"_image\.nii\.gz"), "nii": ("", r"\.nii(\.gz)?"), "parent": "parent",
}


def series_id_from_path(df: DataFrame, path_col: str, rule: str | tuple[str, str], out: str = "series_id") -> DataFrame:
    """Series id of a path by a named rule or a (prefix, suffix pattern) of the caller's."""
    how = SERIES_RULES[rule] if isinstance(rule, str) else rule
    if how == "parent":
        return df.withColumn(out, F.try_element_at(F.split(path_col, "/"), F.lit(-2)))
    prefix, suffix = how
    stem = F.regexp_replace(file_name(F.col(path_col)), f"(?:{suffix})$", "")
    return df.withColumn(out, F.when(stem.startswith(prefix), F.substring(stem, len(prefix) + 1, 1 << 30)).otherwise(stem) if prefix else stem)


#: Label file of an image file: (pattern, replacement) on the file name, or the name of a sibling.
LABEL_RULES: dict[str, tuple[str, str] | str] = {"image": ("image", "label"), "volume": ("volume", "labels"), "channel": (r"_0000\.nii\.gz$", ".nii.gz"), "sibling": "segmentation.nii.gz"}


def label_path_from_image(df: DataFrame, path_col: str, rule: str | tuple[str, str], out: str = "label_path") -> DataFrame:
    """Label path of an image path; only the file name is changed, never a folder."""
    how = LABEL_RULES[rule] if isinstance(rule, str) else rule
    path = F.col(path_col)
    name = file_name(path)
    folder = F.substr(path, F.lit(1), F.length(path) - F.length(name))
    return df.withColumn(out, F.concat(folder, F.lit(how) if isinstance(how, str) else F.regexp_replace(name, how[0], how[1])))


def sample_record(df: DataFrame, img_col: str, seg_col: str, label_map: Mapping[int, int] | None = None, ordered: bool = False) -> DataFrame:
    """Training records: img_path, seg_map_path (null if unannotated), label_map, reduce_zero_label, seg_fields."""
    pairs = F.create_map(*[F.lit(x) for kv in label_map.items() for x in kv]) if label_map else F.lit(None).cast("map<int,int>")
    out = df.select(F.col(img_col).alias("img_path"), F.col(seg_col).alias("seg_map_path"), pairs.alias("label_map"), F.lit(False).alias("reduce_zero_label"), F.array().cast("array<string>").alias("seg_fields"))
    return out.orderBy("img_path") if ordered else out


def slice_path(root: str, patient: Column, phase: Column, idx: Column, n_files: Column, suffix: str = ".png") -> Column:
    """root/patient[/phase]/index, padded to 3 digits, to 4 in series of more than 1000; phase N has no folder."""
    padded = F.lpad(idx.cast("string"), F.when(n_files > 1000, 4).otherwise(3), F.lit("0"))
    return F.concat_ws("/", F.lit(root), patient.cast("string"), F.when(phase != "N", phase), F.concat(padded, F.lit(suffix)))


def series_number(col: Column) -> Column:
    """First run of digits of an id as a number; null without one."""
    return F.regexp_extract(col.cast("string"), r"(\d+)", 1).try_cast("long")


def dicom_tag_fields(df: DataFrame, json_col: str, tags: Mapping[str, str], arrays: Sequence[str] = ()) -> DataFrame:
    """A column for each tag: Value[0] as double, the whole list for names in `arrays`; null for a missing tag or bad JSON."""
    m = F.from_json(json_col, "map<string,struct<Value:array<double>>>")
    parsed = df.withColumn("__tags", m)
    value = lambda tag: F.try_element_at(F.col("__tags"), F.lit(tag))["Value"]
    return parsed.select(*df.columns, *[(value(t) if n in arrays else F.try_element_at(value(t), F.lit(1))).alias(n) for n, t in tags.items()])


def resolve_experiment(queries: DataFrame, experiments: DataFrame) -> DataFrame:
    """(query) to (query, experiment, error): an equal name, else the names whose part before the first `.` + letter equals it."""
    names = experiments.select(F.col("experiment")).distinct()
    known = names.select(F.col("experiment").alias("key"), "experiment", F.lit(0).alias("how")).unionByName(names.select(F.regexp_replace("experiment", r"\.[A-Za-z].*$", "").alias("key"), "experiment", F.lit(1).alias("how")))
    best = known.groupBy("key").agg(F.min(F.struct("how", "experiment"))["experiment"].alias("experiment"))
    dot = F.col("query").endswith(".")
    out = queries.join(best, F.col("query") == F.col("key"), "left")
    return out.select("query", F.when(~dot, F.col("experiment")).alias("experiment"), F.when(dot, "trailing dot").when(F.col("experiment").isNull(), "no match").alias("error"))


def parse_point(df: DataFrame, json_col: str, name: str = "point1") -> DataFrame:
    """x and y of a JSON point, rounded half to even; null for bad JSON."""
    p = F.from_json(json_col, f"{name} struct<x:double,y:double,z:double>")[name]
    return df.select("*", round_even(p["x"]).alias("x"), round_even(p["y"]).alias("y"))


def bin_point(x: Column, width: int = 8, last: int = 63) -> Column:
    return F.least(F.floor(x / width), F.lit(last)).cast("int")


def assign_ids(paths: DataFrame, path_col: str = "path", start: int = 0) -> DataFrame:
    """Consecutive ids in path order, numbered in two steps: places inside key ranges, then their offsets."""
    return ranked(paths, path_col).select("row.*", (F.col("rank") - 1 + start).alias("id"))
