"""The ledger against statistics over all values; plans of joins over buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import evaluate, spatial
from voxelframe.sources.bucketed import ALL_KEYS, co_located, write_bucketed
from voxelframe.streaming import ledger as L

KEYS = "series string"


def _table(spark, values):
    return spark.createDataFrame(values, "series string, v double")


def _check(row, values):
    v = np.array(values)
    assert (row["n"], row["min"], row["max"]) == (len(v), v.min(), v.max())
    assert row["mean"] == pytest.approx(v.mean(), rel=1e-12) and row["std"] == pytest.approx(v.std(), rel=1e-6)


def test_full_incremental_replaced_and_retracted(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert L.merged(L.current(L.ledger(spark, path, KEYS), ["series"])).collect()[0]["n"] is None
    r = random.Random(1)
    values = {s: [1e9 + r.random() for _ in range(20)] for s in ("a", "b", "c", None)}  # far from 0: sums of squares would lose the deviation
    L.record(L.partials(_table(spark, [(s, x) for s in ("a", None) for x in values[s]] + [("b", -5.0), ("b", None), ("e", None)]), ["series"], "v"), path, "one")
    L.record(L.partials(_table(spark, [("c", x) for x in values["c"][:5]] + [("d", 3.0)]), ["series"], "v"), path, "two")
    L.record(L.partials(_table(spark, [("c", x) for x in values["c"][5:]]), ["series"], "v"), path, "late")
    for _ in range(2):  # the same run twice counts once
        L.record(L.partials(_table(spark, [("b", x) for x in values["b"]]), ["series"], "v", 2), path, "again")
    L.record(L.retraction(_table(spark, [("d", 0.0), ("d", 1.0), ("never", 1.0)]), ["series"], 2), path, "gone")
    rows = L.ledger(spark, path, KEYS)
    small = str(tmp_path / "small")
    L.record(L.compacted(rows, ["series"]), small, "first")
    again = L.ledger(spark, small, KEYS)
    assert again.count() == again.select("series").distinct().count() == 6
    for led in (rows, again):
        live = L.current(led, ["series"])
        _check(L.merged(live).collect()[0], [x for v in values.values() for x in v])
        per = {x["series"]: x for x in L.merged(live, ["series"]).collect()}
        assert set(per) == set(values)
        for s, v in values.items():
            _check(per[s], v)


def test_versions_by_column(spark):
    t = spark.createDataFrame([("a", 1.0, 1), ("a", 5.0, 2), ("a", 7.0, 2), ("b", 2.0, 1)], "series string, v double, ver int")
    assert sorted((x["series"], x["version"], x["n"], x["mean"]) for x in L.partials(t, ["series"], "v", F.col("ver")).collect()) == [("a", 2, 2, 6.0), ("b", 1, 1, 2.0)]


def test_streamed_equals_batch(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    r, values = random.Random(2), []

    def arrive():
        new = [(r.choice("ab"), r.gauss(100, 3)) for _ in range(50)]
        values.extend(new)
        _table(spark, new).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("series string, v double").option("maxFilesPerTrigger", 1).parquet(source)
        L.stream_into(stream, ["series"], "v", path, str(tmp_path / "checkpoint")).awaitTermination()
        return {x["series"]: x for x in L.merged(L.current(L.ledger(spark, path, KEYS), ["series"]), ["series"]).collect()}

    for _ in range(2):
        arrive()
        arrive()
        got = run()
        for s in "ab":
            _check(got[s], [v for k, v in values if k == s])


def test_joins_over_buckets_move_nothing(spark):
    rows = [(s, z, y, x, s * x % 3) for s in range(9) for z in range(2) for y in range(3) for x in range(4)]
    t = spark.createDataFrame(rows, "series_id long, z int, y int, x int, label int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get(ALL_KEYS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = write_bucketed(t.withColumn("hu", F.col("x") * 2), "bucketed_images", buckets=4).drop("label")
        b = write_bucketed(t, "bucketed_labels", buckets=4)
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        with co_located(spark):
            both = spatial.align_image_label(a, b)
            assert "SortMergeJoin" in plan(both) and "Exchange" not in plan(both)
            assert sorted(map(tuple, both.collect())) == sorted((s, z, y, x, 2 * x, c) for s, z, y, x, c in rows)
            seg = a.join(b.select("series_id", "z", "y", "x", F.col("label").alias("gt"), F.lit(1).alias("pred")), ["series_id", "z", "y", "x"])
            areas = evaluate.segmentation_areas(seg, "gt", "pred", [0, 1, 2], ["series_id"])
            assert "Exchange" not in plan(areas) and areas.count() == 27
        assert spark.conf.get(ALL_KEYS) == before[1]
        assert "Exchange" in plan(spatial.align_image_label(t.withColumn("hu", F.col("x")), t))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        for n in ("bucketed_images", "bucketed_labels"):
            spark.sql(f"DROP TABLE IF EXISTS {n}")
