"""The index of written ids: what a batch reads stays flat, and no failure loses or repeats an id."""

from pyspark.sql import functions as F

from voxelframe.streaming import history as H
from voxelframe.streaming import incremental as I


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "sop string").coalesce(1)


def _put(spark, path, run, number, *ids):
    I.ingest(_ids(spark, *ids), _ids(spark).limit(0), "sop", path, run, number)


def _all(spark, path):
    return sorted((r["sop"] or "") for r in spark.read.parquet(path).collect())


def test_fifty_batches_read_a_flat_number_of_parts(spark, tmp_path):
    path = str(tmp_path / "out")
    read, looked = [], []
    for n in range(50):
        new = _ids(spark, f"{n}-a", f"{n}-b")
        read.append(len(H.parts(spark, path)))
        if n % 10 == 9:
            looked.append(len(H.suspects(new, path, "sop", f"run=q/batch={n}")))
        H.add(new, path, "sop", f"run=q/batch={n}")
        new.write.parquet(f"{path}/run=q/batch={n}")
        H.compact(spark, path)
    assert max(read) <= 2 * (H.FAN - 1) and max(read[25:]) <= max(read[:25]) + 5
    assert max(looked) == 0
    assert H.suspects(_ids(spark, "3-a", "41-b", "3-b", "new"), path, "sop", "run=r/batch=0") == ["run=q/batch=3", "run=q/batch=41"]
    _put(spark, path, "r", 0, "3-a", "new", "41-b", None)
    assert _all(spark, path) == sorted([f"{n}-{c}" for n in range(50) for c in "ab"] + ["new", ""])


def test_batches_run_again_and_failures(spark, tmp_path):
    path = str(tmp_path / "out")
    _put(spark, path, "q", 0, "a", "b")
    _put(spark, path, "q", 0, "a", "c")  # the same batch again replaces itself
    assert _all(spark, path) == ["a", "c"]
    H.add(_ids(spark, "d"), path, "sop", "run=q/batch=1")  # failed before its rows were written
    _put(spark, path, "r", 0, "d", "a", "b")
    assert _all(spark, path) == ["a", "b", "c", "d"]
    for p in H.parts(spark, path):  # a merge that failed before the old parts went
        spark.read.schema(H.ENTRY).parquet(p).write.partitionBy("bucket").parquet(p.replace("level=0", "level=1"))
    _put(spark, path, "r", 1, "d", "e", "e2", None)
    _put(spark, path, "r", 2)  # nothing came
    assert _all(spark, path) == sorted(["a", "b", "c", "d", "e", "e2", ""])


def test_batches_without_an_index(spark, tmp_path):
    path = str(tmp_path / "out")
    for n, i in enumerate("ab"):
        _ids(spark, i).write.parquet(f"{path}/run=old/batch={n}")
    _put(spark, path, "new", 0, "a", "b", "c")
    assert _all(spark, path) == ["a", "b", "c"]
    assert spark.read.parquet(path).where(F.col("run") == "new").count() == 1
