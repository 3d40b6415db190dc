"""Column helpers used by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_order(keys: Sequence[str | Column], seed: int | str) -> Column:
    """A seeded order that is the same in every engine and partitioning: md5 of the keys and the seed joined by |."""
    return F.md5(F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed))))


def safe_div(a: Column, b: Column) -> Column:
    """a / b in doubles, null for a zero or null divisor."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def map_of(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def clip(c: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def round_even(c: Column, to: str = "int") -> Column:
    """Nearest integer, halves to even, as numpy rounds before an integer cast."""
    return F.bround(c.cast("double"), 0).cast(to)
