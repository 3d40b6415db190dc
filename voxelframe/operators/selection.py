"""Exact moments and percentiles of groups of any size.

Values are counted first, so a group's rows are its distinct values. Groups of few of them are
sorted in one pass that keeps no group in memory. A group of many is narrowed by histograms of its
values' ordered bits, for all groups and ranks at once: four rounds of 16 bits at most, in each only
the bins that hold a wanted rank go on, until what is left of a bin is few values.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelframe.functions.workers import share_package, written

ROUND, BITS = 16, 64
#: A group with more distinct values than this, and more than a thousandth of all, is narrowed: at most 1000 such groups.
MANY, SHARE = 100_000, 1000


def counted(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, v, n: how often each value (double, not null) occurs in its group; counted in tasks before the shuffle."""
    return values.where(F.col("v").isNotNull()).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def _ends(q: float, total: Column) -> tuple[Column, Column, Column]:
    """Position of the percentile among total values, and the ranks from 0 on below and above it."""
    at = F.lit(float(q)) * (total - 1)
    return at, F.floor(at), F.ceil(at)


def _between(at: Column, lo: Column, hi: Column, low: Column, high: Column) -> Column:
    return F.when((lo == hi) | (low == high), low).otherwise((hi - at) * low + (at - lo) * high)


def _sums(mean: Column) -> list[Column]:
    """Sums over counted values; squared deviations are taken from the mean, so large means do not cancel."""
    v, n = F.col("v"), F.col("n")
    return [F.sum("n").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.max(mean).alias("mean"), F.sqrt(F.sum(n * (v - mean) * (v - mean)) / F.sum("n")).alias("std"), F.sum(v * n).alias("sum"), F.sum(v * v * n).alias("sum_sq")]


def _sorted(counts: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """By one shuffle on the keys: rows pass in the order of their values with the number of values before them."""
    group = Window.partitionBy(*keys)
    run = group.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(*keys, "v", "n", F.sum("n").over(run).alias("upto"), F.sum("n").over(group).alias("total"), (F.sum(F.col("v") * F.col("n")).over(group) / F.sum("n").over(group)).alias("m"))
    total = F.col("total")
    holds = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("v")))
    made = [c for i, q in enumerate(quantiles) for c in (holds(_ends(q, total)[1]).alias(f"low{i}"), holds(_ends(q, total)[2]).alias(f"high{i}"))]
    out = placed.groupBy(*keys).agg(*_sums(F.col("m")), *made)
    q = [_between(*_ends(x, F.col("n")), F.col(f"low{i}"), F.col(f"high{i}")) for i, x in enumerate(quantiles)]
    return out.select(*keys, "n", "min", "max", "mean", "std", "sum", "sum_sq", F.array(*q).alias("q"))


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; all NaN are one value, the largest, and -0.0 is 0.0."""
    bits = np.where(np.isnan(v), np.nan, v + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


def _bits(counts: DataFrame) -> DataFrame:
    share_package(counts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.schema.get_field_index("v")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ordered_bits(v))], [*b.schema.names, "b"])

    return counts.mapInArrow(run, T.StructType([*counts.schema.fields, T.StructField("b", T.LongType())]))


def _told(keys: Sequence[str]) -> list[Column]:
    """The keys under names of their own, for the other side of a join."""
    return [F.col(k).alias(f"t_{k}") for k in keys]


def _pairs(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    return out


def _narrowed(counts: DataFrame, keys: Sequence[str], quantiles: Sequence[float], most: int) -> DataFrame:
    """t_keys and q of fewer than SHARE groups. wanted holds a row for each group and rank: a bounded table, which is broadcast."""
    told = [f"t_{k}" for k in keys]
    rows = written(_bits(counts), "bits")
    totals = rows.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranks = F.array_distinct(F.array(*[r.cast("long") for q in quantiles for r in _ends(q, F.col("total"))[1:]]))
    # first: values of the group before the bin; top: the bits that are known
    zero = F.lit(0).cast("long")
    wanted = written(totals.select(*_told(keys), F.explode(ranks).alias("rank"), zero.alias("first"), zero.alias("top")), "ranks")
    left, known = rows.withColumn("high", zero), 0
    while True:
        shift = BITS - known - ROUND
        fine = F.shiftright("b", shift) if shift else F.col("b")
        bins = left.groupBy(*keys, "high", fine.alias("fine")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"))
        bins = bins.join(F.broadcast(wanted.select(*told, "first", "top").distinct()), _pairs(keys) & (F.col("high") == F.col("top"))).select(*keys, "high", "fine", "n", "values", F.col("first").alias("skip"))
        run = Window.partitionBy(*keys, "high").orderBy("fine").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 2 ** ROUND bins
        placed = bins.withColumn("upto", F.col("skip") + F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
        inside = _pairs(keys) & (F.col("high") == F.col("top")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto"))
        wanted = written(placed.join(F.broadcast(wanted.select(*told, "rank", "top")), inside).select(*told, "rank", F.col("before").alias("first"), F.col("fine").alias("top"), "values"), "ranks")
        known += ROUND
        high = F.shiftright("b", BITS - known) if known < BITS else F.col("b")
        left = rows.withColumn("high", high).join(F.broadcast(wanted.select(*told, "top").distinct()), _pairs(keys) & (F.col("high") == F.col("top")), "left_semi")
        if known >= BITS or (wanted.agg(F.max("values")).first()[0] or 0) <= most:
            break
    run = Window.partitionBy(*keys, "high").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # what is left of a bin
    last = left.select(*keys, "high", "v", "n", F.sum("n").over(run).alias("upto"))
    inside = _pairs(keys) & (F.col("high") == F.col("top")) & (F.col("rank") - F.col("first") >= F.col("upto") - F.col("n")) & (F.col("rank") - F.col("first") < F.col("upto"))
    found = last.join(F.broadcast(wanted), inside).groupBy(*told).agg(F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("of"))
    both = totals.join(F.broadcast(found), _pairs(keys))
    q = [_between(at, lo, hi, F.col("of")[lo.cast("long")], F.col("of")[hi.cast("long")]) for at, lo, hi in (_ends(x, F.col("total")) for x in quantiles)]
    return both.select(*told, F.array(*q).alias("q"))


def group_stats(counts: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float] | Sequence[float]) -> DataFrame:
    """keys, n, min, max, mean, std (population), sum, sum_sq, q (percentiles with linear interpolation) of counted values (keys, v, n).

    A value may have several rows. NaN counts as the largest value; null keys are a group. counts is
    read several times: give a written table. A key cannot be named like one of the results.
    """
    named = [f"key{i}" for i in range(len(keys))]  # apart from the columns made here
    out = _group_stats(counts.select(*[F.col(k).alias(x) for k, x in zip(keys, named)], "v", "n"), named, quantiles)
    return out.select(*[F.col(x).alias(k) for k, x in zip(keys, named)], *out.columns[len(keys):])


def _group_stats(counts: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float] | Sequence[float]) -> DataFrame:
    levels = list(quantiles.values()) if isinstance(quantiles, Mapping) else list(quantiles)
    sizes = written(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > MANY), "sizes")
    limit = max(MANY, (counts.count() if (any_large := sizes.limit(1).count()) else 0) // SHARE)
    large = sizes.where(F.col("size") > limit).select(*_told(keys))
    if not any_large or not large.limit(1).count():
        return _sorted(counts, keys, levels)
    apart = F.broadcast(large)  # fewer than SHARE groups
    few = _sorted(counts.join(apart, _pairs(keys), "left_anti"), keys, levels)
    many = counts.join(apart, _pairs(keys), "left_semi")
    means = many.groupBy(*keys).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m"))
    sums = many.join(F.broadcast(means.select(*_told(keys), "m")), _pairs(keys)).groupBy(*keys).agg(*_sums(F.col("m")))
    return few.unionByName(sums.join(F.broadcast(_narrowed(many, keys, levels, limit)), _pairs(keys)).select(*few.columns))
