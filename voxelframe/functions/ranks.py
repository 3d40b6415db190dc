"""Row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.workers import written

#: Bits of a row number that count inside a range; those above are the range.
INSIDE = 33


def ranked(df: DataFrame, *keys: str | Column) -> DataFrame:
    """(row, rank, n): every row of df as a struct, its place from 1 in the order of the keys (nulls first) and the number of rows.

    The table is dealt to ranges of the keys once, sorted inside them and written; a row's number
    inside its range and the sizes of the ranges, one row each, give its place. Ranges follow the size
    of the table, as Spark coalesces them. Rows with equal keys come in the order of a hash of the whole
    row, so that many of them spread over ranges too (in any order where a column holds a map).
    """
    order = [F.col(k) if isinstance(k, str) else k for k in keys]
    if "map<" not in df.schema.simpleString():
        order.append(F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]))
    named = df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row"), *[k.alias(f"k{i}") for i, k in enumerate(order)])
    names = [f"k{i}" for i in range(len(order))]
    spread = named.repartitionByRange(*names).sortWithinPartitions(*names)
    rows = written(spread.select("row", F.monotonically_increasing_id().alias("at")), "ranked")
    part = F.shiftright("at", INSIDE)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = sizes.select("part", F.coalesce(F.sum("size").over(whole), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy()).alias("n"))
    return rows.join(before, part == F.col("part")).select("row", (F.col("at").bitwiseAND(F.lit((1 << INSIDE) - 1)) + F.col("before") + 1).alias("rank"), F.col("n"))


def ranked_within(df: DataFrame, by: Sequence[str], *keys: str | Column) -> DataFrame:
    """ranked(), but place and number of rows inside each group: for few groups of any size."""
    r = ranked(df, *by, *keys)
    groups = r.groupBy(*[F.col("row")[c].alias(f"g{i}") for i, c in enumerate(by)]).agg((F.min("rank") - 1).alias("skip"), F.count(F.lit(1)).alias("size"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col("row")[c].eqNullSafe(F.col(f"g{i}"))
    return r.join(groups, same).select("row", (F.col("rank") - F.col("skip")).alias("rank"), F.col("size").alias("n"))
