"""Listing by tasks against Spark's own file index."""

import os

import pytest
from pyspark.sql import functions as F

from voxelframe.sources import files as X
from voxelframe.sources import listing


def by_index(spark, root, suffixes, recursive=True):
    """path, length, mtime as Spark's file index gives them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", "length", "modificationTime")
    return sorted(tuple(r) for r in files.collect() if r["path"].lower().endswith(tuple(s.lower() for s in suffixes)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for i in range(150):
        d = root / f"s{i:03d}" / "series a" / ("deep" if i % 3 else "b=1")
        d.mkdir(parents=True)
        (d / "scan.MHA").write_bytes(b"x" * (i + 1))
        (d / "note.txt").write_text("n")
    (root / "wide").mkdir()
    for i in range(20_000):
        (root / "wide" / f"{i}.mha").write_bytes(b"x")
    for name in (".hidden", "_temporary", "_kept=1"):
        (root / name).mkdir()
        (root / name / "x.mha").write_text("x")
    (root / "wide" / ".y.mha").write_text("x")
    (root / "wide" / "_z.mha").write_text("x")
    (root / "wide" / "100% ü #1?.mha").write_text("x")
    (root / "empty").mkdir()
    return str(root)


def test_same_rows_as_the_file_index(spark, folder):
    got = X.list_files(spark, folder, [".mha"])
    assert got.columns == ["path", "length", "mtime", "name", "parent"]
    rows = sorted((r["path"], r["length"], r["mtime"]) for r in got.collect())
    assert rows == by_index(spark, folder, [".mha"]) and len(rows) == 20_000 + 150 + 2
    row = got.where("parent = 'b=1'").orderBy("path").first()
    assert (row["name"], row["length"]) == ("scan.MHA", 1)


def test_levels_are_dealt_over_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(listing, "FOLDERS_A_TASK", 20)
    t = listing.tree(spark, folder)
    parts = t.where("not folder and path like '%/scan.MHA'").groupBy(F.spark_partition_id()).count().count()
    files = t.where("path like '%/scan.MHA'").select(F.input_file_name().alias("f")).distinct().count()
    assert parts > 1 and files > 5


def test_flat_listing_single_file_and_missing_root(spark, folder, tmp_path):
    (tmp_path / "a.mha").write_text("abc")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.mha").write_text("b")
    assert [r["name"] for r in X.list_files(spark, str(tmp_path), [".mha"], recursive=False).collect()] == ["a.mha"]
    assert [(r["name"], r["length"]) for r in X.list_files(spark, f"file://{tmp_path}/a.mha", [".mha"]).collect()] == [("a.mha", 3)]
    assert X.list_files(spark, f"{folder}/empty", [".mha"]).count() == 0
    (tmp_path / "zero.mha").write_bytes(b"")  # Spark's index would leave it out
    assert [r["length"] for r in X.list_files(spark, str(tmp_path), ["zero.mha"]).collect()] == [0]
    with pytest.raises(Exception, match="No such file"):
        X.list_files(spark, str(tmp_path / "nowhere"), [".mha"])
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    with pytest.raises(Exception, match="levels|Too many levels"):
        X.list_files(spark, str(tmp_path), [".mha"])


def test_stores_that_arrow_opens(tmp_path, monkeypatch):
    """The route of other stores, on a subtree of the local one."""
    import pyarrow.fs as fs

    (tmp_path / "d").mkdir()
    (tmp_path / "f.mha").write_text("abcd")
    asked = []
    monkeypatch.setattr(listing, "_store", lambda uri: (asked.append(uri), (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), ""))[1])
    assert sorted((p, d, n) for p, d, n, _ in listing._entries("s3a://bucket/a b", True)) == [("s3a://bucket/a b/d", True, 0), ("s3a://bucket/a b/f.mha", False, 4)]
    assert asked == ["s3://bucket/a%20b"]


def test_metadata_csv_with_and_without_quoted_line_ends(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("id,name\n1,\"a, \"\"b\"\"\"\n2,c\n")
    assert [tuple(r) for r in X.read_metadata_csv(spark, str(tmp_path / "plain.csv"), "id int, name string").collect()] == [(1, 'a, "b"'), (2, "c")]
    (tmp_path / "quoted.csv").write_text("id,name\n1,\"a\nb\"\n2,c\n")
    assert [tuple(r) for r in X.read_metadata_csv(spark, str(tmp_path / "quoted.csv"), "id int, name string", multi_line=True).collect()] == [(1, "a\nb"), (2, "c")]
    with pytest.raises(Exception, match="(?i)malformed"):
        X.read_metadata_csv(spark, str(tmp_path / "quoted.csv"), "id int, name string").collect()
