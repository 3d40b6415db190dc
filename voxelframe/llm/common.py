"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.workers import arrow_batches, remove_folder, share_package, shared_folder


def col(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(columns: Iterable[str], *names: str) -> list[str]:
    """columns but those that Spark takes for one of names: it does not tell upper from lower case."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """For each name one like it that is no column yet."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    return shared_folder(spark, "llm")


def stage(df: DataFrame, path: str | None = None, records: int = 1000, megabytes: int = 8) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Arrow batches of its Python parts hold at most `records` rows and about `megabytes`.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    with arrow_batches(spark, records, megabytes):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(batches: Iterator[pa.RecordBatch], rows: int = 1000, megabytes: int = 4) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows and about `megabytes`, whatever the session's Arrow settings."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * (megabytes << 20) / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


#: A key with no more rows than this is never split.
LEAST_HOT = 2000


def hot_keys(counts: DataFrame, key: str, n: str = "n", most: int = 1000, least: int = LEAST_HOT) -> dict:
    """Parts for every key that has more than 1 / most of all rows (and more than `least`): fewer than `most` keys."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(least, total // most)
    return {r[0]: -(-r[1] // limit) for r in counts.where(col(n) > limit).select(key, n).collect()}


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: dict, how: str = "inner", by: Column | None = None) -> DataFrame:
    """Join on `key`; rows of left under a hot key are dealt to its parts, and right's rows are repeated for them.

    by: what deals the rows, an integer of their values; a table without it (row numbers deal then) must be a written one.
    """
    if not hot:
        return left.join(right, key, how)
    salt, = unused([*left.columns, *right.columns], "salt")
    parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), col(key)), F.lit(1))
    many = right.withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).withColumn(salt, col(salt).cast("long"))
    return left.withColumn(salt, F.pmod(F.monotonically_increasing_id() if by is None else by, parts).cast("long")).join(many, [key, salt], how).drop(salt)


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; callers may pass any other path to the operators."""
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path(name))


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of undirected edges by alternating large and small stars.

    Returns (node, root) for every node of an edge between two different nodes; root is the
    smallest node of the component. Each round is written to the shared folder; neither links
    nor labels reach the driver, only a count, a checksum and the centres that hold more than a
    thousandth of all links do: those centres' links are dealt to parts. Null ends are ignored.
    """
    ends = edges.where(col(u).isNotNull() & col(v).isNotNull()).select(F.least(col(u), col(v)).alias("a"), F.greatest(col(u), col(v)).alias("b"))
    spark, path = edges.sparkSession, shared_dir(edges.sparkSession)
    e = stage(ends.where(F.col("a") < F.col("b")).distinct(), path)
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("a").alias("n"), F.col("b").alias("x")).unionByName(e.select(F.col("b").alias("n"), F.col("a").alias("x")))
        low = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"), F.count(F.lit(1)).alias("degree"))
        hot = hot_keys(low, "n", "degree") if mark[0] > LEAST_HOT else {}  # no node has more links than there are
        large = salted_join(both.where(F.col("x") > F.col("n")), low.select("n", "m"), "n", hot, by=F.xxhash64("x")).select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = salted_join(large, low, "b", hot, by=F.xxhash64("a"))  # no node has more links here than before
        small = joined.where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
        e = stage(small.unionByName(low.select(F.col("m").alias("a"), "b")).distinct(), done := shared_dir(spark))
        remove_folder(spark, path)
        path, mark, before = done, _mark(e), mark
        if mark == before:
            break
    roots = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
