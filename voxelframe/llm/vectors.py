"""Near-duplicate embeddings by random-hyperplane sign hashing, with exact cosine verification.

Equal vectors of a label form one class. In each of `tables` hash tables a class's key is the sign
pattern of `bits` random projections. Classes that share a bucket are compared exactly: small
buckets as pairs, larger ones in blocks inside tasks, from which only sums and a spanning set of
links come out. A pair is counted in the first table that brings it together. Links then go
through distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import col, components, hot_keys, salted_join, stage


def usable(v):
    """Vectors with a direction: not null or empty, every component finite, some component not zero."""
    x = F.coalesce(v, F.array().cast("array<double>"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda e: e != 0), F.lit(False))


def _keys(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    signs = (x @ planes > 0).reshape(len(x), -1, bits)
    return (signs << np.arange(bits)).sum(2).astype(np.int32)


def _sketch(rows: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """(id, label, v) -> (id, cls, tag, keys, v): cls digests label and vector, tag label and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            cls, keys, tag = [None] * b.num_rows, [None] * b.num_rows, np.zeros(b.num_rows, np.int64)
            labels, vectors = b.column(1).to_pylist(), [np.asarray(v.values) for v in b.column(2)]
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((dim, tables * bits))
                x = np.stack([vectors[i] for i in at]) + 0.0
                for i, v, k in zip(at.tolist(), x, _keys(x / np.abs(x).max(1, keepdims=True), planes[dim], bits)):
                    head = f"{labels[i]}\0{dim}\0".encode()
                    cls[i], keys[i], tag[i] = xxhash.xxh3_128_digest(head + v.tobytes()), k, xxhash.xxh3_64_intdigest(head) >> 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), pa.array(tag), pa.array(keys, pa.list_(pa.int32())), b.column(2)], ["id", "cls", "tag", "keys", "v"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cls binary, tag long, keys array<int>, v array<double>")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pair_links(pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of (a, b, t, na, nb, ka, kb, va, vb) that reach the threshold and met in table t first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cos = (_unit(np.stack(pdf["va"].to_list())) * _unit(np.stack(pdf["vb"].to_list()))).sum(1)
                first = (np.stack(pdf["ka"].to_list()) == np.stack(pdf["kb"].to_list())).argmax(1)
                yield pdf.loc[(cos >= threshold) & (first == pdf["t"].to_numpy()), ["a", "b", "na", "nb"]]

    return pairs.mapInPandas(run, "a binary, b binary, na long, nb long")


def _block_links(sent: DataFrame, threshold: float) -> DataFrame:
    """Inside blocks (bucket, i, j): (a, null, links) sums of linked members, and (a, b, 0) spanning links."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, keys, weight = _unit(np.stack(pdf["v"].to_list())), np.stack(pdf["keys"].to_list()), pdf["n_own"].to_numpy()
        cls, mine, t = pdf["cls"].to_numpy(), pdf["mine"].to_numpy(), int(pdf["t"].iat[0])
        links = np.triu(x @ x.T >= threshold, 1)
        if pdf["i"].iat[0] != pdf["j"].iat[0]:
            links &= mine[:, None] != mine[None, :]
        a, b = np.nonzero(links)
        if t:
            new = np.concatenate([~(keys[a[s : s + 65536], :t] == keys[b[s : s + 65536], :t]).any(1) for s in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            a, b = a[new], b[new]
        sums = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
        seen, ends = np.zeros(len(x), bool), []
        both = np.zeros((len(x), len(x)), bool)
        both[a, b] = both[b, a] = True
        for root in np.flatnonzero(both.any(1)):
            front = np.array([root]) if not seen[root] else np.zeros(0, int)
            seen[root] = True
            while len(front):
                front = np.flatnonzero(both[front].any(0) & ~seen)
                seen[front] = True
                ends += [(root, f) for f in front]
        some = np.flatnonzero(sums)
        out = pd.DataFrame({"a": [*cls[some], *(cls[r] for r, _ in ends)], "b": [*[None] * len(some), *(cls[f] for _, f in ends)], "links": [*sums[some].astype(np.int64), *[0] * len(ends)]})
        return out.astype({"links": "int64"})

    return sent.groupBy("bucket", "i", "j").applyInPandas(compare, "a binary, b binary, links long")


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
                    tables: int = 64, bits: int = 16, seed: int = 11, small: int = 16, block: int = 512) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable), kept.

    Two vectors link when their labels are equal and not null (any two if label_col is None) and
    their cosine in double precision is at least the threshold. With 64 tables of 16 bits a pair at
    cosine 0.93 is missed with probability 2e-4, one at 0.95 with 1e-6.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a null label,
    link with nothing and are kept. Equal vectors, repeated rows included, link with each other.
    Vectors of different length never link. Null ids count as vectors; they are never the smallest
    id while another exists. Further columns are not looked at.
    """
    label = F.lit(0) if label_col is None else col(label_col)
    base = rows.select(col(id_col).alias("id"), label.cast("string").alias("label"), col(vec_col).cast("array<double>").alias("v"))
    good = usable(F.col("v")) & F.col("label").isNotNull()
    sketched = stage(_sketch(base.where(good), tables, bits, seed))
    classes = stage(sketched.groupBy("cls").agg(F.count(F.lit(1)).alias("n_own"), F.min("id").alias("least"), F.any_value("tag").alias("tag"), F.any_value("keys").alias("keys"), F.any_value("v").alias("v")))
    # buckets never mix labels or lengths
    keyed = classes.select("cls", "tag", F.posexplode("keys").alias("t", "key")).select("cls", "t", F.xxhash64("tag", "t", "key").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(keyed.join(sizes, "bucket"))

    few = members.where(F.col("n") <= small)
    met = few.select("bucket", "t", F.col("cls").alias("a")).join(few.select("bucket", F.col("cls").alias("b")), "bucket").where("a < b").groupBy("a", "b").agg(F.min("t").alias("t"))
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n_own").alias(f"n{s}"), F.col("keys").alias(f"k{s}"), F.col("v").alias(f"v{s}"))
    pairs = stage(_pair_links(met.join(side("a"), "a").join(side("b"), "b"), threshold))

    many = members.where(F.col("n") > small).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts")).cast("int"))
    sent = many.select("bucket", "t", "cls", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    sent = sent.select("bucket", "t", "cls", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(classes.select("cls", "n_own", "keys", "v"), "cls")
    blocks = stage(_block_links(sent, threshold))

    sums = blocks.where("b is null").select(F.col("a").alias("cls"), "links").unionByName(pairs.select(F.col("a").alias("cls"), F.col("nb").alias("links"))).unionByName(pairs.select(F.col("b").alias("cls"), F.col("na").alias("links")))
    counted = sums.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(pairs.select("a", "b").unionByName(blocks.where("b is not null").select("a", "b")), "a", "b")
    whole = classes.select("cls", "n_own", "least").join(counted, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = whole.groupBy("root").agg(F.min("least").alias("component"))
    label_of = whole.join(lowest, "root").select("cls", (F.col("n_own") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    # a vector repeated over a large share of the rows is a hot class
    linked = salted_join(sketched.select("id", "cls"), label_of, "cls", hot_keys(classes, "cls", "n_own")).select("id", "n_links", "component")
    alone = base.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
