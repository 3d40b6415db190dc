"""Every query of the library against its SQL."""

import pandas as pd
import pytest

from tests.oracle import connect, same
from voxelframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    if name in SQL:
        same(QUERIES[name](spark, sf), con, SQL[name])
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_split_and_expansion_grow_with_the_input(spark, sf):
    orders, lines = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "lineitem"))
    assert QUERIES["w4_holdout_split_orders"](spark, sf).count() == 2 * orders - 1
    assert QUERIES["m30_expand_samples_lineitem"](spark, sf).count() == 3 * lines


def test_muscle_fat_split_ties_as_its_sql(spark, tmp_path):
    """Three evenly spaced values, as many of the first as of the last: both cuts cost the same, and rounding decides."""
    grids = [[-60 - k + (7 + k % 13) * (-1, 0, 0, 1)[(y + x // 3) % 4] for y in range(8) for x in range(8)] for k in range(60)]
    pd.DataFrame({"vec_id": range(60), "embedding": [[(hu + 60) / 600 for hu in g] for g in grids], "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    name = "m28_muscle_fat_split"
    assert same(QUERIES[name](spark, str(tmp_path)), connect(tmp_path), SQL[name]) == 60 * 64


def test_entry_imports():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
