"""A ledger of mergeable statistics: runs append partial rows, batch or streamed, and totals need no second look at the values.

A row is (keys, version, n, mean, m2, min, max) of one run and lies in the folder of that run, so a
run that is done again replaces itself. All runs of the latest version of a key count together
(late values are another run of the same version); a higher version replaces what was known of the
key, and one with n = 0 retracts it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelframe.streaming.history import finished
from voxelframe.streaming.incremental import query_id

FIGURES = "version long, n long, mean double, m2 double, min double, max double"


def partials(values: DataFrame, keys: Sequence[str], value: str, version: int | Column = 1) -> DataFrame:
    """Ledger rows of the values. Nulls do not count; a key with nothing else has no row. A version by column is the largest of its key, and values of lower ones are left out."""
    v = F.col(value).cast("double")
    number = version if isinstance(version, Column) else F.lit(version)
    per = values.where(v.isNotNull()).groupBy(*keys, number.cast("long").alias("version"))
    out = per.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out if not isinstance(version, Column) else _latest(out, keys)


def retraction(gone: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """Rows that take the keys of `gone` out of the totals from this version on."""
    none = [F.lit(None).cast("double").alias(c) for c in ("mean", "m2", "min", "max")]
    return gone.select(*keys).distinct().select(*keys, F.lit(version).cast("long").alias("version"), F.lit(0).cast("long").alias("n"), *none)


def record(rows: DataFrame, path: str, run: str) -> None:
    """Put partials() or retraction() rows into the ledger as the named run; an earlier try of it goes."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def stream_into(stream: DataFrame, keys: Sequence[str], value: str, path: str, checkpoint: str, version: int = 1, trigger_now: bool = True) -> StreamingQuery:
    """Each micro-batch is a run, named by query and number: one that runs again after a failure counts once.

    A query with a new checkpoint that reads the same input again needs a higher version.
    """
    def put(batch: DataFrame, number: int) -> None:
        record(partials(batch, keys, value, version), path, f"{query_id(batch.sparkSession)}-{number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_now else writer).start()


def ledger(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """Rows of the finished runs; keys: their columns and types. No runs: no rows."""
    schema = f"{keys}, {FIGURES}"
    runs = finished(spark, path, "run=*")
    return spark.read.schema(schema).parquet(*runs) if runs else spark.createDataFrame([], schema)


def _same(keys: Sequence[str], mark: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
    return out


def _latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    top = rows.groupBy(*[F.col(k).alias(f"__l{k}") for k in keys]).agg(F.max("version").alias("__version"))
    return rows.join(top, _same(keys, "__l") & (F.col("version") == F.col("__version"))).select(*rows.columns)


def current(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger rows that count: the latest version of each key, if not retracted."""
    return _latest(rows, keys).where(F.col("n") > 0)


def merged(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n, mean, m2, std (population), min, max of current() rows: deviations inside and between the parts. Without `by` one row, of nulls if there is none."""
    weighted = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    means = rows.groupBy(*[F.col(k).alias(f"__g{k}") for k in by]).agg(weighted.alias("__m"))
    both = rows.join(means, _same(by, "__g")) if by else rows.join(F.broadcast(means), how="cross")  # one row
    apart = F.col("mean") - F.col("__m")
    out = both.groupBy(*by).agg(F.sum("n").alias("n"), F.max("__m").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))
    return out.select(*by, "n", "mean", "m2", F.sqrt(F.col("m2") / F.col("n")).alias("std"), "min", "max")


def compacted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A ledger of one row a key with the same totals, retractions among them: record() it as the first run of a new path."""
    live = _latest(rows, keys)
    version = live.groupBy(*[F.col(k).alias(f"__v{k}") for k in keys]).agg(F.max("version").alias("version"))
    out = merged(live.where(F.col("n") > 0), keys)
    figures = [F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean", "m2", "min", "max"]
    return version.join(out, _same(keys, "__v"), "left").select(*[F.col(f"__v{k}").alias(k) for k in keys], "version", *figures)
