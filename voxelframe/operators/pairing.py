"""Pairing of images, labels and metadata, and set operations on id tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.columns import map_of


def pair_required(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return images.join(labels, key).select(key, "img_path", "label_path")


def pair_optional(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return images.join(labels, key, "left").select(key, "img_path", "label_path")


def pair_status(images: DataFrame, labels: DataFrame, patient: str = "patient", phase: str = "phase", default_phase: str = "N", needed: Sequence[str] = ("A", "PV")) -> DataFrame:
    """(patient, status, apvv, phase) of every (patient, phase) in either table.

    status: img_only, label_only, CTEnhanceScanPhaseLost for a patient on both sides who has any
    phase but lacks a needed one among the images, else normal. apvv: all needed phases are there.
    A null phase counts as the default one without being a phase folder.
    """
    img = images.select(patient, F.col(phase).alias("__p"), F.lit(1).alias("img"), F.lit(0).alias("lab"))
    lab = labels.select(patient, F.col(phase).alias("__p"), F.lit(0).alias("img"), F.lit(1).alias("lab"))
    both = img.unionByName(lab).groupBy(patient, "__p").agg(F.max("img").alias("img"), F.max("lab").alias("lab"))
    w = Window.partitionBy(patient)
    has = [F.max(F.when((F.col("__p") == p) & (F.col("img") == 1), 1).otherwise(0)).over(w) for p in needed]
    all_there = sum(has[1:], has[0]) == len(needed)
    any_phase = F.max(F.when(F.col("__p").isNotNull() & (F.col("img") == 1), 1).otherwise(0)).over(w) == 1
    out = both.withColumn("has_img", F.max("img").over(w)).withColumn("has_lab", F.max("lab").over(w)).withColumn("apvv", all_there).withColumn("__any", any_phase)
    status = F.when(F.col("has_lab") == 0, "img_only").when(F.col("has_img") == 0, "label_only").when(F.col("__any") & ~F.col("apvv"), "CTEnhanceScanPhaseLost").otherwise("normal")
    return out.select(patient, status.alias("status"), "apvv", F.coalesce("__p", F.lit(default_phase)).alias("phase"))


def annotated_only(samples: DataFrame, annotated: DataFrame, key: str, mode: str = "sup") -> DataFrame:
    """mode sup: samples whose key is annotated; semi: all."""
    if mode not in ("sup", "semi"):
        raise ValueError(mode)
    return samples.join(annotated, key, "left_semi") if mode == "sup" else samples


def exclude_series(series: DataFrame, deny_lists: Mapping[str, DataFrame], key: str) -> DataFrame:
    """All series with reason: the first deny list (in mapping order) that holds them, null for those kept."""
    if not deny_lists:
        return series.withColumn("reason", F.lit(None).cast("string"))
    denied = None
    for i, (name, df) in enumerate(deny_lists.items()):
        one = df.select(key, F.struct(F.lit(i).alias("i"), F.lit(name).alias("reason")).alias("d"))
        denied = one if denied is None else denied.unionByName(one)
    first = denied.groupBy(key).agg(F.min("d")["reason"].alias("reason"))
    return series.join(first, key, "left")


def attach_metadata(df: DataFrame, meta: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row of metadata per key (the least, if it repeats) joined to df; the optimizer broadcasts it if it is small."""
    one = meta.groupBy(key).agg(F.min(F.struct(*columns)).alias("__m"))
    return df.join(one, key, "left").select(*df.columns, *[F.col("__m")[c].alias(c) for c in columns])


def annotation_chain(patches: DataFrame, id_map: DataFrame, locations: DataFrame, clusters: DataFrame) -> DataFrame:
    """patch -> series -> points -> cluster with the first miss as reason: series, location, cluster, or valid.

    id_map (path, series_id): the least series wins; locations (series_id, point) are listed in
    order; clusters (series_id, cluster): the least wins.
    """
    ids = id_map.groupBy("path").agg(F.min("series_id").alias("series_id"))
    points = locations.groupBy("series_id").agg(F.sort_array(F.collect_list("point")).alias("points"))
    one = clusters.groupBy("series_id").agg(F.min("cluster").alias("cluster"))
    out = patches.join(ids, "path", "left").join(points, "series_id", "left").join(one, "series_id", "left")
    reason = F.when(F.col("series_id").isNull(), "series miss").when(F.col("points").isNull(), "location miss").when(F.col("cluster").isNull(), "cluster miss").otherwise("valid")
    return out.select("path", "series_id", "points", "cluster", reason.alias("reason"))


def chain_summary(chain: DataFrame) -> DataFrame:
    return chain.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def priority_lookup(candidates: DataFrame, key: str, priority: str, target_type: str | None = None, tie: str = "path") -> DataFrame:
    """Of the same id in several sources, the one of least priority (ties: least path)."""
    chosen = candidates if target_type is None else candidates.where(F.col("type") == target_type)
    return chosen.groupBy(key).agg(F.min_by(tie, F.struct(priority, tie)).alias(tie))


def composite_match(samples: DataFrame, registry: DataFrame, sample_id: str, registry_id: str, sep: str = "/") -> DataFrame:
    """Sample ids against registry rows whose composite id (`a/b`) has them as a part: an equi-join; the first row wins."""
    parts = registry.select(F.explode(F.split(registry_id, sep)).alias("__part"), F.struct(registry_id, *[c for c in registry.columns if c != registry_id]).alias("__row"))
    first = parts.groupBy("__part").agg(F.min("__row").alias("__row"))
    return samples.join(first, F.col(sample_id) == F.col("__part"), "left").select(*samples.columns, "__row.*")


def substring_match(samples: DataFrame, registry: DataFrame, sample_id: str, registry_id: str, length: int) -> DataFrame:
    """Sample ids of one length anywhere inside registry ids: the registry's substrings of that length are the join key; the first row wins."""
    rid = F.col(registry_id)
    cuts = F.when(F.length(rid) >= length, F.transform(F.sequence(F.lit(1), F.greatest(F.length(rid) - length + 1, F.lit(1))), lambda i: F.substr(rid, i, F.lit(length)))).otherwise(F.array().cast("array<string>"))
    grams = registry.select(F.explode(F.array_distinct(cuts)).alias("__part"), rid.alias(registry_id))
    first = grams.join(samples.select(F.col(sample_id).alias("__part")).distinct(), "__part", "left_semi").groupBy("__part").agg(F.min(registry_id).alias(registry_id))
    return samples.join(first, F.col(sample_id) == F.col("__part"), "left").select(*samples.columns, registry_id)


def repair_file_location(meta: DataFrame, listing: DataFrame, key: str, location: str, root: str) -> DataFrame:
    """location stays if it is listed, else root/key if that is, else null; repaired tells."""
    there = listing.select(F.col("path").alias("__a")).distinct()
    by_id = listing.select(F.col("path").alias("__b")).distinct()
    out = meta.join(there, F.col(location) == F.col("__a"), "left").join(by_id, F.concat_ws("/", F.lit(root), F.col(key).cast("string")) == F.col("__b"), "left")
    return out.select(*[F.coalesce("__a", "__b").alias(c) if c == location else F.col(c) for c in meta.columns], (F.col("__a").isNull() & F.col("__b").isNotNull()).alias("repaired"))


def new_series_only(manifests: DataFrame | Sequence[DataFrame], meta: DataFrame, key: str) -> DataFrame:
    """Distinct ids of one or more manifests that the metadata does not have."""
    frames = [manifests] if isinstance(manifests, DataFrame) else list(manifests)
    union = frames[0].select(key)
    for f in frames[1:]:
        union = union.unionByName(f.select(key))
    return union.distinct().join(meta, key, "left_anti")


def concat_datasets(dfs: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Union by column name with a source column; missing columns are null."""
    out = None
    for df, name in zip(dfs, names, strict=True):
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def union_labeled_unlabeled(labeled: DataFrame, unlabeled: DataFrame) -> DataFrame:
    return labeled.select("img_path", "label_path").unionByName(unlabeled.select("img_path", F.lit(None).cast("string").alias("label_path")))


def folder_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): a, b or both."""
    tagged = a.select(key, F.lit(1).alias("m")).unionByName(b.select(key, F.lit(2).alias("m")))
    return tagged.groupBy(key).agg(F.bit_or("m").alias("m")).select(key, map_of({1: "a", 2: "b", 3: "both"})[F.col("m")].alias("side"))


def encode_categories(df: DataFrame, cols: Sequence[str], mapping: Mapping[str, int]) -> DataFrame:
    """Text categories to the ids of a given map; unknown ones are null."""
    m = map_of(mapping)
    return df.select(*[F.try_element_at(m, F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def label_group_members(df: DataFrame, groups: Mapping[str, Sequence[str]], id_col: str, sep: str = "/") -> DataFrame:
    """(group, lab_id): ids, composites split, of rows that have all labels of the group."""
    names = F.array_compact(F.array(*[F.when(sum([F.col(c).isNull().cast("int") for c in cols], F.lit(0)) == 0, F.lit(g)) for g, cols in groups.items()]))
    return df.where(F.col(id_col).isNotNull()).select(F.explode(names).alias("group"), F.split(id_col, sep).alias("ids")).select("group", F.explode("ids").alias("lab_id")).distinct()


def groups_of(members: DataFrame) -> DataFrame:
    return members.groupBy("lab_id").agg(F.sort_array(F.collect_set("group")).alias("groups"))
