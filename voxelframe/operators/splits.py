"""Splits, folds and samples over id tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.columns import md5_order
from voxelframe.functions.ranks import ranked, ranked_within


def _placed(ids: DataFrame, key: str, seed: int | None) -> DataFrame:
    """Distinct ids with pos (from 0) and n, in key order or in a seeded order."""
    once = ids.select(key).distinct()
    out = ranked(once, *([] if seed is None else [md5_order([key], seed)]), key)
    return out.select("row.*", (F.col("rank") - 1).alias("pos"), "n")


def _cut(n: Column, ratio: float) -> Column:
    return F.floor(n * F.lit(float(ratio))).cast("long")


def ratio_split(ids: DataFrame, key: str, ratios: Sequence[float] = (0.7, 0.15), shuffle_seed: int | None = None) -> DataFrame:
    """(key, split): the first int(n r1) ids train, the next int(n r2) val, the rest test."""
    p = _placed(ids, key, shuffle_seed)
    a = _cut(F.col("n"), ratios[0])
    b = a + _cut(F.col("n"), ratios[1])
    return p.select(key, F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "val").otherwise("test").alias("split"))


def cumulative_split(ids: DataFrame, key: str, borders: Sequence[float] = (0.7, 0.75, 1.0)) -> DataFrame:
    """(key, split) by borders int(n b): train [0, b1 - 1), val [b1 - 1, b2), test [b2, b3); ids beyond have no row."""
    p = _placed(ids, key, None)
    b1, b2, b3 = (_cut(F.col("n"), b) for b in borders)
    split = F.when(F.col("pos") < b1 - 1, "train").when(F.col("pos") < b2, "val").when(F.col("pos") < b3, "test")
    return p.select(key, split.alias("split")).where("split is not null")


def kfold(ids: DataFrame, key: str, k: int, use_folds: Sequence[int] | None = None) -> DataFrame:
    """(key, fold): fold i (from 1) holds the sorted ids [(i-1) n // k, i n // k)."""
    p = _placed(ids, key, None)
    fold = F.floor(((F.col("pos") + 1) * k - 1) / F.col("n")).cast("int") + 1
    out = p.select(key, fold.alias("fold"))
    return out.where(F.col("fold").isin(*use_folds)) if use_folds is not None else out


def holdout_split(ids: DataFrame, key: str, held_out) -> DataFrame:
    """(key, split): one id is test, the others train and val in turn; an absent id is an error."""
    if ids.where(F.col(key) == held_out).isEmpty():
        raise ValueError(f"{held_out} is not among the ids")
    once = ids.select(key).distinct()
    return once.select(key, F.explode(F.when(F.col(key) == held_out, F.array(F.lit("test"))).otherwise(F.array(F.lit("train"), F.lit("val")))).alias("split"))


def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def activate_case_ratio(cases: DataFrame, split: str, key: str, ratio: float, seed: int, by: Sequence[str] = ("split",)) -> DataFrame:
    """int(n ratio) cases of each split at least 1, seeded; the test split keeps all."""
    placed = ranked_within(cases, by, md5_order([key], seed), key)
    return placed.where((F.col("row")[split] == "test") | (F.col("rank") <= F.greatest(F.floor(F.col("n") * ratio), F.lit(1)))).select("row.*")


def ratio_sample(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """max(int(n ratio), 1) rows without replacement, in a seeded order; an empty table is an error."""
    if df.isEmpty():
        raise ValueError("nothing to sample from")
    return ranked(df, md5_order([key], seed), key).where(F.col("rank") <= F.greatest(F.floor(F.col("n") * ratio), F.lit(1))).select("row.*")


def sample_per_case(centers: DataFrame, by: Sequence[str], order: str, k: int | float, seed: int | None = None, test: bool = False) -> DataFrame:
    """At most k centres of each series, or the fraction k of them (at least 1): the first, or a seeded choice; all for tests."""
    if test:
        return centers
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(*([order] if seed is None else [md5_order([*by, order], seed), order])))
    most = F.lit(k) if isinstance(k, int) else F.greatest(F.floor(F.count(F.lit(1)).over(w) * k), F.lit(1))
    return centers.withColumn("__r", place).withColumn("__m", most).where("__r <= __m").drop("__r", "__m")


def numeric_id_sort(df: DataFrame, id_col: str) -> DataFrame:
    from voxelframe.operators.names import series_number

    return df.orderBy(series_number(F.col(id_col)), id_col)


def expand_samples(df: DataFrame, n: int) -> DataFrame:
    """Each row n times with copy_no 0 .. n-1, the seed of later augmentation."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn("copy_no", F.lit(0)).limit(0)
