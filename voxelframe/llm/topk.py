"""Exact top-k inner products by a vector-approximation file.

Every component is quantised to one of 2**bits cells between its block's smallest and largest value.
A scan of the cells bounds each score from both sides; the k-th largest lower bound of a query rules
out most vectors. Exact vectors are then read in the order of their bounds: first as many as decide
the k-th score, then those whose bound still reaches it. Bounds are doubles, widened by what their
rounding may lose; scores are exact.

The scan runs tile by tile: a block of cells is one row, a pack of queries is one row, and a task
holds one of each, so neither side is ever whole in one place. Equal vectors are one class, which
keeps its k + 1 smallest ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import col, stage

#: floor() answers with these for numbers that have no 64-bit integer; in bounds they count as HUGE.
LEAST, MOST, HUGE = -(1 << 63), (1 << 63) - 1, 1e280


def _doubles(x: np.ndarray) -> np.ndarray:
    out = x.astype(np.float64)
    out[x == MOST], out[x == LEAST] = HUGE, -HUGE
    return out


def _blocks(rows: DataFrame, bits: int) -> DataFrame:
    """(dim, block, n, cls, sole, cell, low, width): a block's classes as one row; sole: the only id of a class, else null (-1 with alone 0)."""
    kind = np.uint8 if bits <= 8 else np.uint16

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _doubles(np.stack(pdf["v"].to_list()))
        low, high = x.min(0), x.max(0)
        width = np.maximum((high - low) / (1 << bits), np.spacing(np.maximum(np.abs(low), np.abs(high))))
        cell = np.clip(np.floor((x - low) / width), 0, (1 << bits) - 1).astype(kind)
        # cells that rounding put beside their numbers
        cell -= (low + cell * width > x) & (cell > 0)
        binary = {"cls": pdf["cls"].to_numpy(np.int64), "sole": pdf["sole"].to_numpy(np.int64), "alone": pdf["alone"].to_numpy(np.uint8), "cell": cell, "low": low, "width": width, "high": high}
        return pd.DataFrame({"dim": [pdf["dim"].iat[0]], "block": [pdf["block"].iat[0]]} | {k: [v.tobytes()] for k, v in binary.items()})

    return rows.groupBy("dim", "block").applyInPandas(run, "dim int, block long, cls binary, sole binary, alone binary, cell binary, low binary, width binary, high binary")


def _packs(rows: DataFrame) -> DataFrame:
    """(dim, pack, qid, qv): a pack's queries as one row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [pdf["dim"].iat[0]], "pack": [pdf["pack"].iat[0]], "qid": [pdf["qid"].to_numpy(np.int64).tobytes()], "qv": [np.stack(pdf["qv"].to_list()).astype(np.int64).tobytes()]})

    return rows.groupBy("dim", "pack").applyInPandas(run, "dim int, pack long, qid binary, qv binary")


def _scan(k: int, bits: int):
    """Bounds of the scores of a tile's block and pack; what may be among a query's k best comes out."""
    kind = np.uint8 if bits <= 8 else np.uint16

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b, q = pdf[pdf["cls"].notna()].iloc[0], pdf[pdf["qid"].notna()].iloc[0]
        dim = int(b["dim"])
        ids, sole, alone = np.frombuffer(b["cls"], np.int64), np.frombuffer(b["sole"], np.int64), np.frombuffer(b["alone"], np.uint8) == 1
        low, width, high = (np.frombuffer(b[c], np.float64) for c in ("low", "width", "high"))
        qids, qv = np.frombuffer(q["qid"], np.int64), _doubles(np.frombuffer(q["qv"], np.int64).reshape(-1, dim))
        lo = np.frombuffer(b["cell"], kind).reshape(-1, dim) * width + low
        slack = 4 * np.spacing(np.maximum(np.abs(low), np.abs(high)) + 64 * width)
        hi, lo = np.minimum(lo + width + slack, high), np.maximum(lo - slack, low)
        far = np.maximum(np.abs(lo), np.abs(hi))
        out = []
        step = max(1, (1 << 21) // max(1, len(ids)))  # bounded memory for the scores
        for at in range(0, len(qids), step):
            p, m = np.maximum(qv[at : at + step], 0), np.minimum(qv[at : at + step], 0)
            loss = ((p - m) @ far.T) * (dim + 4) * 2.0**-51
            upper, under = p @ hi.T + m @ lo.T + loss, p @ lo.T + m @ hi.T - loss
            # a class that holds nothing but the query gives no lower bound
            under[(qids[at : at + step, None] == sole[None, :]) & alone[None, :]] = -np.inf
            kth = np.partition(under, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(p), -np.inf)
            x, y = np.nonzero(upper >= kth[:, None])
            out.append((qids[at + x], ids[y], upper[x, y], under[x, y]))
        return pd.DataFrame(dict(zip(("query_id", "cls", "upper", "lower"), map(np.concatenate, zip(*out)))))

    return run


def top_k(rows: DataFrame, queries: Column, k: int = 5, bits: int = 6, id_col: str = "vec_id", vec_col: str = "v", block: int = 1 << 16, pack: int = 1 << 12) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of every query row.

    rows: id (long) and an array<bigint> vector; queries: condition on rows that picks the queries.
    Candidates are all rows of the query's length but its own; ties go to the smaller id. Rows whose
    vector is null, empty or holds nulls, and rows without an id, take no part. Rows that repeat an
    id count once for each score; a repeated query id asks with the least of its vectors, and all
    rows of a query's id are left out of its result. Fewer than k candidates: all. A score among the
    k best that has no 64-bit integer is an error. block, pack: most classes and queries of a tile.
    """
    spark = rows.sparkSession
    good = rows.where(col(id_col).isNotNull() & F.coalesce(F.forall(vec_col, lambda e: e.isNotNull()), F.lit(False)) & (F.size(vec_col) > 0))
    good = stage(good.select(col(id_col).cast("long").alias("id"), col(vec_col).cast("array<bigint>").alias("v"), queries.alias("q")))

    # classes of equal vectors with their k + 1 smallest ids, by partial sorted lists
    spread = good.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    least = F.slice(F.array_sort(F.array_distinct(F.collect_list("id"))), 1, k + 1)
    part = spread.groupBy("v", "salt").agg(least.alias("ids"))
    merged = part.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    # two vectors with one hash only bring each other along as further candidates
    classes = stage(merged.select(F.xxhash64("v").alias("cls"), "v", "ids", F.size("v").alias("dim")))
    asked = stage(good.where("q").groupBy(F.col("id").alias("qid")).agg(F.min("v").alias("qv")).withColumn("dim", F.size("qv")))
    # tiles of a length: as large as allowed, but enough of them for all cores
    cores = 2 * spark.sparkContext.defaultParallelism
    sizes = asked.groupBy("dim").agg(F.count(F.lit(1)).alias("nq")).join(classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), "dim")
    packs_n, fewest = F.ceil(F.col("nq") / pack), F.ceil(F.col("n") / block)
    sizes = stage(sizes.select("dim", packs_n.alias("packs"), F.greatest(fewest, F.least(F.ceil(F.col("n") / 1024), F.ceil(F.lit(cores) / packs_n))).alias("blocks")))
    dealt = classes.join(sizes, "dim").select("dim", "blocks", "packs", "cls", "v", F.element_at("ids", 1).alias("sole"), (F.size("ids") == 1).cast("int").alias("alone"), F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"))
    files = stage(_blocks(dealt, bits), records=64)
    packs = stage(_packs(asked.join(sizes, "dim").select("dim", "qid", "qv", F.pmod(F.xxhash64("qid"), F.col("packs")).alias("pack"))), records=64)
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tiles = files.join(sizes, "dim").withColumn("pack", to("packs")).drop("packs", "blocks").unionByName(packs.join(sizes, "dim").withColumn("block", to("blocks")).drop("packs", "blocks"), allowMissingColumns=True)
    found = stage(tiles.groupBy("dim", "block", "pack").applyInPandas(_scan(k, bits), "query_id long, cls long, upper double, lower double"), records=8)

    by_query = Window.partitionBy("query_id")
    nth = lambda df, by, name: df.withColumn("r", F.row_number().over(by_query.orderBy(F.desc(by)))).where(F.col("r") == k).select("query_id", F.col(by).alias(name))
    left = stage(found.join(nth(found, "lower", "sure"), "query_id", "left").where(F.col("upper") >= F.coalesce("sure", F.lit(float("-inf")))).select("query_id", "cls", "upper").distinct())
    vectors = asked.select(F.col("qid").alias("query_id"), "qv")

    def exact(part: DataFrame) -> DataFrame:
        """Scores of candidates, read from the exact vectors; a class's ids follow, but for the query's own."""
        both = part.join(classes.select("cls", "v", "ids"), "cls").join(vectors, "query_id").where(F.size("v") == F.size("qv"))
        wide = lambda e: e.isin(LEAST, MOST)
        times = F.zip_with("v", "qv", lambda a, b: F.when((a == 0) | (b == 0), F.lit(0).cast("long")).when(~wide(a) & ~wide(b), F.try_multiply(a, b)))
        score = F.aggregate(times, F.lit(0).cast("long"), F.try_add)
        others = F.exists("ids", lambda i: i != F.col("query_id"))
        score = F.when(score.isNotNull() | ~others, score).otherwise(F.raise_error(F.lit("a score among the highest has no 64-bit integer")).cast("long"))
        one = both.select("query_id", score.alias("score"), "ids").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
        return best(one)

    def best(some: DataFrame) -> DataFrame:
        """The k best of each query: every task keeps its own k best before they meet."""
        return some.distinct().withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    first = left.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("upper"), "cls"))).where(F.col("place") <= 2 * k)
    ahead = stage(exact(first.select("query_id", "cls")))
    reach = ahead.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("reach"))
    # bounds have room for rounding, the double of a score has not
    near = F.col("reach") - F.abs("reach") * 2.0**-52
    later = left.join(reach, "query_id", "left").where(F.col("upper") >= F.coalesce(near, F.lit(float("-inf")))).join(first.select("query_id", "cls"), ["query_id", "cls"], "left_anti").select("query_id", "cls")
    rest = exact(later).drop("rank")
    return best(ahead.drop("rank").unionByName(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """floor(scale * x) of every component in double precision; a null or non-finite component makes the vector null."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.select(F.col(id_col), F.when(fine, F.transform(v, lambda e: F.floor(e * scale))).alias("v"))
