"""Ranked lexical search, reversed: the items are indexed and the documents stream through the index.

The items' terms form an inverted index that is broadcast block by block. One pass over the
documents counts what the weights need (documents, terms, documents of each indexed term); a
second one scores each document for the items that share a term with it and keeps a bounded heap
for each item. The heaps of all tasks are merged in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import bounded, col, shared_dir, stage

#: A term is a run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PART = 1 << 20
#: A block of the index holds about so many items and pairs of item and term (an item is never split).
BLOCK_ITEMS, BLOCK_PAIRS = 4096, 1 << 21
#: Scores of one step: documents times items.
CELLS = 1 << 20


@dataclass(frozen=True)
class Index:
    """terms: number of each term; items[starts[t]:starts[t + 1]]: the items that hold term t."""

    terms: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    n_items: int


def term_counts(text: bytes | None) -> tuple[Counter, int]:
    """How often each term occurs in the whole text, and all terms with repeats. Split in parts, so memory follows the distinct terms."""
    counts, n, at, folded = Counter(), 0, 0, (text or b"").translate(FOLD)
    while at < len(folded):
        end = folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        counts.update(words)
        n, at = n + len(words), end
    return counts, n


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    for b in bounded(batches, 1000, 8):
        yield b.column(0).to_pylist(), b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, 1000, 8):
        found = [sorted(term_counts(t)[0]) for t in b.column(1).cast(pa.binary()).to_pylist()]
        owner = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array([t for x in found for t in x], pa.binary())], ["item", "term"])


def _statistics(docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of each indexed term; a task sends one row a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df, n_docs, length = index.value.terms, np.zeros(len(index.value.terms), np.int64), 0, 0
        for _, texts in _texts(batches):
            for text in texts:
                counts, n = term_counts(text)
                n_docs, length = n_docs + (n > 0), length + n
                df[[i for i in map(terms.get, counts) if i is not None]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n_docs, length]))], ["term", "n"])

    rows = stage(docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))).toPandas()  # one row an indexed term
    df = np.zeros(len(index.value.terms), np.int64)
    of = dict(zip(rows["term"].tolist(), rows["n"].tolist()))
    own = np.array([t for t in of if t >= 0], np.int64)
    df[own] = [of[t] for t in own.tolist()]
    return of.get(-1, 0), of.get(-2, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class _Heaps:
    """The k best documents of each item: higher scores, then smaller ids, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.best, self.least = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def update(self, ids: list, scores: np.ndarray) -> None:
        floor = self.least
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        for d, i in zip(*(x.tolist() for x in np.nonzero(scores >= floor))):
            heap, entry = self.best[i], (int(scores[d, i]), ids[d] is not None, -(ids[d] or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def _score(index: Index, weight: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, damp: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores of n_docs documents for all items; damp is 8 * m of each document."""
    each = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + damp[rows]))
    long = index.starts[terms + 1] - index.starts[terms]
    at = np.repeat(index.starts[terms] - np.cumsum(long) + long, long) + np.arange(long.sum())
    out = np.zeros(n_docs * index.n_items, np.int64)
    np.add.at(out, np.repeat(rows, long) * index.n_items + index.items[at], np.repeat(each, long))
    return out.reshape(n_docs, index.n_items)


def _stream(docs: DataFrame, index, n_docs: int, length: int, weight: np.ndarray, k: int) -> DataFrame:
    """(item, doc, score, part): the heaps of every task."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverted, w = index.value, shared.value
        heaps, most, part = _Heaps(inverted.n_items, k), max(1, CELLS // max(1, inverted.n_items)), 0
        ids, damp, rows, terms, tf, cells = [], [], [], [], [], 0

        def settle() -> None:
            if ids:
                scores = _score(inverted, w, np.array(rows, np.int64), np.array(terms, np.int64), np.array(tf, np.int64), np.array(damp, np.int64), len(ids))
                heaps.update(ids, scores)
            for x in (ids, damp, rows, terms, tf):
                x.clear()

        wide = np.diff(inverted.starts).tolist()
        for names, texts in _texts(batches):
            for name, text in zip(names, texts):
                counts, n = term_counts(text)
                own = [(t, counts[x]) for x in counts.keys() & inverted.terms.keys() for t in (inverted.terms[x],)]
                if not own:
                    continue
                rows += [len(ids)] * len(own)
                terms += [t for t, _ in own]
                tf += [c for _, c in own]
                cells += sum(wide[t] for t, _ in own)
                ids.append(name)
                damp.append(8 * (10 + 90 * n * n_docs // length))
                part = (part * 31 + n) & 1023
                if len(ids) >= most or cells >= 4 * CELLS:
                    settle()
                    cells = 0
        settle()
        found = [(i, None if not known else -d, s) for i, heap in enumerate(heaps.best) for s, known, d in heap]
        for at in range(0, len(found), 10_000):
            some = found[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.int64()), pa.array([part] * len(some), pa.int32())], ["item", "doc", "score", "part"])

    return stage(docs.mapInArrow(run, "item int, doc long, score long, part int"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k highest-scoring documents of each item: (item_id, rank from 1, doc_id, score).

    Ids of documents are integers. Documents without a term (null and empty texts) count nowhere;
    repeated rows are documents of their own; a document without an id is ranked, last among equal
    scores. Rows of one item id are one item with the terms of all of them, a null id too; items
    without a term get no rows. Other columns are not read. The items' terms are taken in blocks
    of about BLOCK_PAIRS, so the broadcast index is bounded whatever the number of items.
    """
    spark = docs.sparkSession
    pairs = stage(items.select(col(item_id).alias("item"), col(item_text).cast("string").alias("t")).mapInArrow(_item_terms, items.select(col(item_id).alias("item")).schema.add("term", "binary")).distinct())
    n_pairs, n_items = pairs.agg(F.count(F.lit(1)), F.count_distinct(F.struct("item"))).first()
    blocks = max(1, -(-n_pairs // BLOCK_PAIRS), -(-n_items // BLOCK_ITEMS))
    of: Column = F.pmod(F.xxhash64("item"), F.lit(blocks))
    read = docs.select(col(doc_id).cast("long").alias("doc"), col(text).cast("string").alias("text"))
    found = None
    for block in range(blocks):
        own = pairs.where(of == block) if blocks > 1 else pairs
        names = {r["item"]: i for i, r in enumerate(own.select("item").distinct().orderBy("item").collect())}
        rows = sorted((bytes(r["term"]), names[r["item"]]) for r in own.collect())  # bounded by the block
        if not rows:
            continue
        terms = {t: i for i, t in enumerate(sorted({t for t, _ in rows}))}
        starts = np.concatenate([[0], np.cumsum(np.bincount([terms[t] for t, _ in rows]))]).astype(np.int64)
        index = spark.sparkContext.broadcast(Index(terms, starts, np.array([i for _, i in rows], np.int64), len(names)))
        n_docs, length, df = _statistics(read, index)
        heaps = _stream(read, index, n_docs, length, weights(n_docs, df), k)
        known = spark.createDataFrame(list(enumerate(names)), own.select(F.lit(0).alias("item"), col("item").alias("item_id")).schema)
        known = stage(known, shared_dir(spark))
        best = heaps.join(F.broadcast(known), "item").select("item_id", "part", col("doc").alias("doc_id"), "score")  # one row an item of the block
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], items.select(col(item_id).alias("item_id")).schema.add("part", "integer").add("doc_id", "long").add("score", "long"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))
    ranked = found.withColumn("near", near).where(F.col("near") <= k)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return ranked.select("item_id", place.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
