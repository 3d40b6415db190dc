"""Masks as runs: (series_id, z, y, x1, x2, class), a row per stretch x1 <= x < x2 of an image row.

Runs of one class of an image row never touch. Everything here works inside image rows, so the
largest group that a task holds is a row of pixels, whatever the size of a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = ("series_id", "z", "y")
WORD = 64


def _shift(name: str, word: Column, bits: Column | int) -> Column:
    return F.call_function(name, word, F.lit(bits) if isinstance(bits, int) else bits)


def from_voxels(voxels: DataFrame, label: str = "label", keys: Sequence[str] = ROW) -> DataFrame:
    """Runs of the voxels (keys, x) of each label; repeated voxels count once, voxels with a null place or label not at all.

    Voxels are packed to words of 64 pixels before the shuffle (an aggregate with a map side), so
    what moves is a word and not a voxel.
    """
    there = F.col(label).isNotNull() & F.col("x").isNotNull()
    for k in keys:
        there = there & F.col(k).isNotNull()
    bit = _shift("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("x"), F.lit(WORD)).cast("int"))
    words = voxels.where(there).groupBy(*keys, F.col(label).alias("class"), F.floor(F.col("x") / WORD).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))
    bits = F.col("bits")
    at = lambda picked: F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: _shift("shiftrightunsigned", picked, i).bitwiseAND(F.lit(1)) == 1)
    first = at(bits.bitwiseAND(F.bitwise_not(_shift("shiftleft", bits, 1))))
    last = at(bits.bitwiseAND(F.bitwise_not(_shift("shiftrightunsigned", bits, 1))))
    parts = words.select(*keys, "class", "w", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("r"))
    return joined(parts.select(*keys, (F.col("w") * WORD + F.col("r.a")).alias("x1"), (F.col("w") * WORD + F.col("r.b") + 1).alias("x2"), "class"), [*keys, "class"])


def to_voxels(runs: DataFrame) -> DataFrame:
    """A row per pixel of each run, with x for x1 and x2."""
    rest = [c for c in runs.columns if c not in ("x1", "x2")]
    return runs.select(*rest, F.explode(F.sequence(F.col("x1"), F.col("x2") - 1)).alias("x"))


def joined(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs (keys, x1, x2) that touch or overlap become one; the other columns go."""
    w = Window.partitionBy(*keys).orderBy("x1", "x2")
    begins = F.coalesce(F.col("x1") > F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    marked = runs.select(*keys, "x1", "x2", begins.cast("int").alias("begins")).withColumn("island", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("island")


def _sweep(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elementary stretches (keys, x1, x2, a, b): how many runs of each side cover them, from running sums over the run ends."""
    ends = lambda df, p, q: df.select(*keys, F.explode(F.array(*[F.struct(F.col(c).alias("x"), F.lit(p * s).alias("a"), F.lit(q * s).alias("b")) for c, s in (("x1", 1), ("x2", -1))])).alias("e")).select(*keys, "e.*")
    w = Window.partitionBy(*keys).orderBy("x")
    upto = w.rangeBetween(Window.unboundedPreceding, 0)  # all ends at one x count together
    both = ends(a, 1, 0).unionByName(ends(b, 0, 1))
    cut = both.select(*keys, F.col("x").alias("x1"), F.lead("x").over(w).alias("x2"), F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b"))
    return cut.where(F.col("x2") > F.col("x1"))


def _kept(a: DataFrame, b: DataFrame, keys: Sequence[str], rule: Column) -> DataFrame:
    return joined(_sweep(a, b, keys).where(rule), keys)


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = (*ROW, "class")) -> DataFrame:
    """Pixels of either side, as runs (keys, x1, x2)."""
    return joined(a.select(*keys, "x1", "x2").unionByName(b.select(*keys, "x1", "x2")), keys)


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str] = (*ROW, "class")) -> DataFrame:
    """Pixels of both sides."""
    return _kept(a, b, keys, (F.col("a") > 0) & (F.col("b") > 0))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = (*ROW, "class")) -> DataFrame:
    """Pixels of a that b lacks."""
    return _kept(a, b, keys, (F.col("a") > 0) & (F.col("b") == 0))


def label_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """spatial.label_difference() on runs: (series_id, class, z, y, x1, x2, code), 1 both, 2 only the first, 3 only the second; class 0 has no rows."""
    keys = [*ROW, "class"]
    code = F.when((F.col("a") > 0) & (F.col("b") > 0), 1).when(F.col("a") > 0, 2).when(F.col("b") > 0, 3)
    cut = _sweep(a.where(F.col("class") != 0), b.where(F.col("class") != 0), keys).withColumn("code", code).where(F.col("code").isNotNull())
    return joined(cut, [*keys, "code"])


def _segments(runs: DataFrame, *others: str) -> DataFrame:
    """Runs cut at the ends of all runs of their image row: two pieces are equal or apart. A row has at most width + 1 ends."""
    cuts = runs.groupBy(*ROW).agg(F.array_sort(F.array_union(F.collect_set("x1"), F.collect_set("x2"))).alias("cuts"))
    inside = F.filter("cuts", lambda c: (c >= F.col("x1")) & (c <= F.col("x2")))
    pieces = F.transform(F.slice(inside, F.lit(1), F.size(inside) - 1), lambda c, i: F.struct(c.alias("x1"), F.get(inside, i + 1).alias("x2")))
    return runs.join(cuts, list(ROW)).select(*ROW, *others, F.explode(pieces).alias("p")).select(*ROW, "p.*", *others)


def mask_overlap(runs: DataFrame) -> DataFrame:
    """masks.mask_overlap() on runs: (series_id, z, y, x1, x2, n_classes, classes); neighbours of equal classes are one run."""
    sets = _segments(runs, "class").groupBy(*ROW, "x1", "x2").agg(F.array_sort(F.collect_set("class")).alias("classes"))
    return joined(sets, [*ROW, "classes"]).select(*ROW, "x1", "x2", F.size("classes").alias("n_classes"), "classes")


def merge_class_masks(runs: DataFrame, class_map: DataFrame, order_key: str) -> DataFrame:
    """masks.merge_class_masks() on runs with an order_key: (series_id, z, y, class, x1, x2) of class ids; of several the last by (order_key, class_id) wins."""
    known = runs.join(class_map, runs["class"] == class_map["class_name"])
    top = _segments(known, "class_id", order_key).groupBy(*ROW, "x1", "x2").agg(F.max_by("class_id", F.struct(order_key, "class_id")).alias("class"))
    return joined(top, [*ROW, "class"])


def foreground_ratio(runs: DataFrame, keys: Sequence[str], ratio: float) -> DataFrame:
    """validate.foreground_ratio() on runs of a label map, background 0 included: keys, fg, area."""
    n = F.col("x2") - F.col("x1")
    return runs.groupBy(*keys).agg(F.sum(F.when(F.col("class") > 0, n).otherwise(0)).cast("long").alias("fg"), F.sum(n).cast("long").alias("area")).where(F.col("fg") > ratio * F.col("area"))
