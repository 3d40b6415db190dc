"""Embedding operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from voxelframe.llm import common, queries, topk, vectors
from voxelframe.llm.common import components


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    out = []
    for i in range(40):
        base = r.normal(size=16)
        for _ in range(6):
            out.append((len(out), (base + r.normal(scale=0.25, size=16)).tolist(), i % 3))
    out += [(len(out) + i, list(out[0][1]), 0) for i in range(3)]
    n = len(out)
    out += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, out[1][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [], 0), (0, out[2][1], 0), (None, out[1][1], 0)]
    return out


def test_links(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, component string")
    good = [(k, i, np.array(v), lab) for k, (i, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = np.zeros(len(rows), int), list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, (k, _, v, lab) in enumerate(good):
        for m, _, w, lab2 in good[:a]:
            if lab == lab2 and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[k] += 1
                links[m] += 1
                root[find(k)] = find(m)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    n = lambda x: -1 if x is None else x
    want = sorted((n(r[0]), int(links[k]), n(low.get(find(k)))) for k, r in enumerate(rows))
    for options in ({}, {"small": 1, "block": 3}):
        got = vectors.near_duplicates(df, **options).collect()
        assert sorted((n(x["vec_id"]), x["n_links"], n(x["component_id"])) for x in got) == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_top_k(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    v = topk.integer_vectors(df)
    good = [(i, np.floor(np.array(e, float) * 256).astype(int)) for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    once = {}
    for i, e in good:
        once[i] = min(once.get(i, e).tolist(), e.tolist())
        once[i] = np.array(once[i])
    queries_ = [i for i in once if i % 20 == 0 and i]
    want = []
    for q in queries_:
        best = sorted({(-int(once[q] @ e), i) for i, e in good if i != q and len(e) == len(once[q])})[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for options in ({}, {"bits": 3, "block": 16, "pack": 4}):
        got = topk.top_k(v, (F.col("vec_id") % 20 == 0) & (F.col("vec_id") > 0), **options).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    few = topk.top_k(v.where("vec_id in (20, 21)"), F.col("vec_id") == 20).collect()
    assert len(few) == 1 and few[0]["vec_id"] == 21
    assert topk.top_k(v.limit(0), F.col("vec_id") == 0).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1.0, 0.0, -2.0]), (1, [3.0, 1e300, 1.0]), (2, [2.0, 5.0, 0.0]), (3, [-4.0, 1e12, 7.0]), (4, [2.0, 1e12 + 1, 0.5]), (5, [1e13, 1.0, 1e-3]), (7, [1.0, 2.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
    for q in (0, 5):
        want = sorted((-sum(a * b for a, b in zip(whole[q], e)), i) for i, e in whole.items() if i != q and len(e) == 3 and not (q == 5 and i == 1))[:3]
        got = topk.top_k(v if q == 0 else v.where("vec_id != 1"), F.col("vec_id") == q, k=3).orderBy("rank").collect()
        assert [(-r["score"], r["vec_id"]) for r in got] == want
    with pytest.raises(Exception, match="no 64-bit integer"):
        topk.top_k(v, F.col("vec_id") == 2, k=3).collect()
    assert topk.top_k(v, F.col("vec_id") == 7).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 3), (None, 1), (8, 7), (7, 20)], "u int, v int")
    assert {(r["node"], r["root"]) for r in components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7), (20, 7)}
    chain = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in components(chain).collect()} == {0}


def test_hot_centres_and_classes(spark, monkeypatch):
    """A star of many leaves beside chains, and a vector that most rows repeat, dealt to parts or not: the same result."""
    star = [(f"{0:04d}".encode(), f"{i:04d}".encode()) for i in range(1, 200)] + [(f"{9999:04d}".encode(), f"{i:04d}".encode()) for i in range(1, 200)]
    chain = [(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(1000, 1030)]
    edges = spark.createDataFrame(star + chain, "a binary, b binary")
    same = spark.createDataFrame([(i, "x", [1.0, 0.0, 0.0] if i % 4 else [0.0, 1.0, float(i % 8 == 0) / 8]) for i in range(400)] + [(400, "x", [0.0, 0.0, 1.0])], "vec_id long, label string, embedding array<double>")
    found = []
    for least in (2000, 20):
        monkeypatch.setattr(common, "LEAST_HOT", least)
        monkeypatch.setattr(common.hot_keys, "__defaults__", ("n", 20, least))
        roots = {bytes(r["node"]): bytes(r["root"]) for r in common.components(edges, "a", "b").collect()}
        links = sorted(tuple(r) for r in vectors.near_duplicates(same).collect())
        found.append((roots, links))
    assert found[0] == found[1]
    roots, links = found[0]
    assert set(roots.values()) == {b"0000", b"1000"} and len(roots) == 201 + 31
    assert [r[1:] for r in links] == [(99, 0, i == 0) if i % 4 == 0 else (299, 1, i == 1) for i in range(400)] + [(0, 400, True)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE[name])
