"""Moments and percentiles of groups against numpy, with groups narrowed by their bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import selection as S
from voxelframe.operators import stats as T

LEVELS = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def groups():
    r = np.random.default_rng(3)
    wide = np.concatenate([r.normal(0, 1, 300), 10.0 ** r.uniform(-300, 300, 200), -(10.0 ** r.uniform(-300, 300, 200)), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]])
    near = 1.0 + np.arange(400) * 2.0**-52  # differ in the last bits only
    return {"wide": wide, "near": near, "ties": r.integers(-3, 3, 900).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]), None: r.normal(1e9, 1, 250)}


@pytest.mark.parametrize("many,rounds", [(100_000, 16), (50, 16), (1, 16), (0, 16), (50, 8)])
def test_group_stats(spark, monkeypatch, many, rounds):
    monkeypatch.setattr(S, "MANY", many)
    monkeypatch.setattr(S, "SHARE", 10**9)
    monkeypatch.setattr(S, "ROUND", rounds)
    data = groups()
    rows = spark.createDataFrame([(k, i % 3, float(x)) for k, v in data.items() for i, x in enumerate(v)], "series string, part int, v double").repartition(5)
    counts = S.counted(rows.unionByName(spark.createDataFrame([("wide", 0, None), ("gone", 0, None)], rows.schema)), ["series"])
    counts = S.written(counts, "t")
    got = {r["series"]: r for r in S.group_stats(counts, ["series"], LEVELS).collect()}
    assert got.keys() == data.keys()  # a group of nulls has no row
    for k, v in data.items():
        r, v = got[k], v + 0.0
        assert r["n"] == len(v) and r["min"] == v.min() and r["max"] == v.max()
        if k != "wide":
            assert np.isclose(r["mean"], v.mean(), rtol=1e-12) and np.isclose(r["std"], v.std(), rtol=1e-6, atol=1e-12)
        for q, x in zip(LEVELS, r["q"]):
            at = q * (len(v) - 1)
            lo, hi, s = int(np.floor(at)), int(np.ceil(at)), np.sort(v)
            assert np.isclose(x, s[lo] if s[lo] == s[hi] else (hi - at) * s[lo] + (at - lo) * s[hi], rtol=1e-15, atol=0), (k, q)


def test_ordered_bits():
    v = np.array([-np.inf, -1e300, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan, -np.nan])
    b = S.ordered_bits(v)
    assert (np.diff(b[:4]) > 0).all() and b[3] < b[4] == b[5] < b[6] and (np.diff(b[5:11]) > 0).all() and b[10] == b[11]


def test_two_keys_and_repeated_values(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY", 10)
    monkeypatch.setattr(S, "SHARE", 10**9)
    rows = [(a, b, float(i), 1 + i % 3) for a in ("x", None) for b in (1, 2) for i in range(40 if b == 1 else 5)]
    counts = spark.createDataFrame(rows + rows[:60], "a string, b int, v double, n long")
    got = {(r["a"], r["b"]): r for r in S.group_stats(counts, ["a", "b"], [0.3, 0.5]).collect()}
    for key in {r[:2] for r in rows}:
        v = np.sort([x for r in rows + rows[:60] if r[:2] == key for x in [r[2]] * r[3]])
        assert got[key]["n"] == len(v) and np.allclose(got[key]["q"], np.quantile(v, [0.3, 0.5])) and np.isclose(got[key]["std"], v.std())
    assert S.group_stats(counts.limit(0), ["a"], [0.5]).count() == 0


def test_one_huge_group_spreads(spark, monkeypatch):
    """Of a group of many distinct values no task gets more than a small part after the values are counted."""
    monkeypatch.setattr(S, "MANY", 2000)
    n = 300_000
    values = spark.range(n, numPartitions=8).select(F.lit(1).alias("k"), (F.xxhash64("id") / F.lit(1e12)).alias("v"))
    got = S.group_stats(S.written(S.counted(values, ["k"]), "t"), ["k"], [0.05, 0.5, 0.999]).first()
    v = np.sort([r["v"] for r in values.collect()])
    assert np.allclose(got["q"], np.quantile(v, [0.05, 0.5, 0.999]), rtol=1e-12) and got["n"] == n


def test_series_and_class_stats_of_nothing(spark):
    v = spark.createDataFrame([], "s string, c int, x double")
    assert T.series_stats(v, ["s"], "x").count() == 0 == T.class_stats(v, "s", "c", "x").count()
    v = spark.createDataFrame([("a", 1, None), ("a", None, 1.0), ("b", 1, 2.0)], "s string, c int, x double")
    assert [(r["s"], r["n"]) for r in T.series_stats(v, ["s"], "x").orderBy("s").collect()] == [("a", 1), ("b", 1)]
    assert sorted((r["s"], r["class"], r["count"]) for r in T.class_stats(v, "s", "c", "x").collect()) == [("b", "1", 1), ("b", "whole", 1)]
