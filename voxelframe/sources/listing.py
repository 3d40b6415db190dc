"""Listing of folder trees of any size: a table of folders is expanded level by level in tasks.

No listing passes through the driver, which only counts the folders of the next level.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.workers import arrow_batches, share_package, shared_folder

ENTRIES = "path string, folder boolean, length long, mtime timestamp"
#: Folders a task lists; they are dealt out anew on each level.
FOLDERS_A_TASK, DEEPEST = 64, 100
#: Schemes under which another library opens the same store.
ALIASES = {"s3a": "s3", "s3n": "s3"}


def hidden(name: str) -> bool:
    """What Spark's readers leave out too: names that start with a dot, or with _ unless they hold =, and unfinished copies."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _store(uri: str) -> tuple:
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri)


def _entries(folder: str, first: bool) -> Iterator[tuple[str, bool, int, int]]:
    """(path, is a folder, bytes, modified in ms) of what lies in a folder; a file is listed as itself. Folders that go meanwhile hold nothing."""
    parts = urlsplit(quote(folder, safe=":/"))
    try:
        if parts.scheme in ("", "file"):
            plain = folder[len("file:") :] if folder.startswith("file:") else folder
            if os.path.isfile(plain):
                s = os.stat(plain)
                yield folder, False, s.st_size, s.st_mtime_ns // 1_000_000
                return
            with os.scandir(plain) as found:
                for e in found:
                    s = e.stat()
                    yield f"{folder.rstrip('/')}/{e.name}", e.is_dir(), 0 if e.is_dir() else s.st_size, s.st_mtime_ns // 1_000_000
            return
        import pyarrow.fs as fs

        store, base = _store(parts._replace(scheme=ALIASES.get(parts.scheme, parts.scheme)).geturl())
        own = store.get_file_info(base)
        found = [own] if own.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base))
        for i in found:
            name = folder if i is own else f"{folder.rstrip('/')}/{i.base_name}"
            yield name, i.type == fs.FileType.Directory, i.size or 0, int((i.mtime_ns or 0) // 1_000_000)
    except FileNotFoundError:
        if first:
            raise


def _expand(first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            path, folder, length, mtime = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(path), pa.array(folder), pa.array(length, pa.int64()), pa.array([m * 1000 for m in mtime], pa.int64()).cast(pa.timestamp("us", "UTC"))], ["path", "folder", "length", "mtime"])

        rows: list = []
        for b in batches:
            for name in b.column(0).to_pylist():
                for e in _entries(name, first):
                    if not hidden(e[0].rpartition("/")[2]) or e[0] == name:
                        rows.append(e)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def tree(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, folder, length, mtime of every file and folder below root, written level by level to the shared folder.

    A level's folders are dealt to tasks again, so deep and wide trees spread; one folder is listed
    by one task, in a stream where the store gives one. Hidden names and what lies below them are
    left out. Links are followed; more than DEEPEST levels (a link to its own parent) are an error.
    A missing root is an error, a folder that goes during the listing is empty.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    share_package(spark)
    out, level = shared_folder(spark, "listing"), 0
    folders, n = spark.createDataFrame([(whole,)], "path string"), 1
    while n:
        if level > DEEPEST:
            raise RuntimeError(f"more than {DEEPEST} levels below {root}")
        dealt = folders.repartition(min(max(1, -(-n // FOLDERS_A_TASK)), max(n // FOLDERS_A_TASK, spark.sparkContext.defaultParallelism)))
        with arrow_batches(spark, 16, 8):
            dealt.mapInArrow(_expand(level == 0), ENTRIES).write.parquet(f"{out}/level={level}")
        folders = spark.read.schema(ENTRIES).parquet(f"{out}/level={level}").where("folder").select("path")
        n, level = folders.count() if recursive else 0, level + 1
    return spark.read.schema(ENTRIES).option("recursiveFileLookup", True).parquet(out)


def list_files(spark: SparkSession, root: str, suffixes: list[str] | tuple[str, ...], recursive: bool = True) -> DataFrame:
    """path, length, mtime, name, parent of files below root with one of the suffixes (any case); contents are never read. Empty files are listed too."""
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower(name).endswith(s.lower())
    files = tree(spark, root, recursive).where(~F.col("folder") & wanted)
    return files.select("path", "length", "mtime", name.alias("name"), F.element_at(F.split("path", "/"), -2).alias("parent"))
