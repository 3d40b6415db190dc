"""Packing of token sequences by shortest-pack-first over the length histogram.

Documents are encoded, cut into full pieces of `capacity` ids and one rest, and written once. Only
the histogram of the rests' lengths (fewer than `capacity` rows) reaches the driver, where lengths
are placed longest first into the pack with the most room, and a pack is opened when none takes the
piece; packs of equal contents are one pattern with a count, so the work depends on the number of
lengths and not on the number of documents. Rests then meet their place by rank within their length;
a full piece is a sequence of its own and is not shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelframe.llm.common import bounded, col, share_package, stage
from voxelframe.llm.tokens import encoder_of


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs), longest lengths placed first."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_, default=0)
            if room < length:  # not even the shortest pack takes it: new packs, each filled before the next
                each = capacity // length
                for pieces, packs in ((each, left // each), (left % each, 1)):
                    if pieces and packs:
                        open_.setdefault(capacity - pieces * length, {})[(length,) * pieces] = packs
                break
            group = open_[room]
            pattern, count = next(iter(group.items()))
            used = min(left, count)
            if used == count:
                del group[pattern]
                if not group:
                    del open_[room]
            else:
                group[pattern] = count - used
            longer, to = (*pattern, length), open_.setdefault(room - length, {})
            to[longer] = to.get(longer, 0) + used
            left -= used
    return [(p, n) for room in sorted(open_) for p, n in open_[room].items()]


def slots(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: the slot that starts at (length, rank) serves `sequence`, `sequence` + 1, ..."""
    rows, taken, sequence = [], {}, 0
    for pattern, count in found:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            rows.append((length << 44 | rank, rank, sequence, offset, sum(pattern)))
            taken[length] = rank + count
            offset += length
        sequence += count
    rows.sort()
    names = ("key", "rank", "sequence", "offset", "filled")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def encode_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, capacity: int, as_text: bool) -> DataFrame:
    """(id, row, start, length, doc_tokens, ids): ids is little-endian unsigned 32-bit, each document's end id included.

    row numbers the pieces of the table, with gaps.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, row = encoder_of(tokenizer, as_text), TaskContext.get().partitionId() << 40
        for b in bounded(batches, 600, 2):
            ids, n = enc.encode(b.column(1))
            raw, ends = ids.tobytes(), np.cumsum(n)
            which, start, length, total, data = [], [], [], [], []
            for d in range(len(n)):
                doc = raw[4 * (ends[d] - n[d]) : 4 * ends[d]] + end
                for at in range(0, len(doc), 4 * capacity):
                    part = doc[at : at + 4 * capacity]
                    which.append(d)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    total.append(len(doc) // 4)
                    data.append(part)
            rows = pa.array(np.arange(row, row + len(which), dtype=np.int64))
            row += len(which)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), rows, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(data, pa.binary())], ["id", "row", "start", "length", "doc_tokens", "ids"])

    share_package(docs.sparkSession)
    base = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, row long, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048, as_text: bool = False,
         keep: dict[str, Column] | None = None, share: int | None = None) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, filled, padded, and `keep`.

    tokenizer: a file of the tokenizers library; as_text: its control strings inside a text are
    ordinary text, not special tokens. keep: columns made from `ids` (default: ids itself). filled:
    ids in the sequence; padded: its length with padding, the capacity or `filled` where that is a
    power of two. Offsets of a sequence are gapless from 0, and each id lies in exactly one piece;
    the numbers of sequences that a full piece fills have gaps. share: rests of one length that a
    task ranks, about, by default 1/4000 of all and 1000 at least; a more frequent length is dealt
    to more tasks.

    A null text counts as empty: one piece with the end id. Repeated ids are packed row by row. An
    empty table gives no rows. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    pieces = stage(encode_pieces(docs, tokenizer, id_col, text_col, end_id, capacity, as_text), records=600, megabytes=2)
    made = keep or {"ids": F.col("ids")}
    shown = ["id", "start", "length", *[c.alias(f"__{k}") for k, c in made.items()], "doc_tokens"]
    names = ["id", "start", "length", *[f"__{k}" for k in made], "doc_tokens"]
    rests = pieces.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in rests.groupBy("length").count().collect()}  # fewer than `capacity` rows
    found = patterns(histogram, capacity)
    places = spark.sparkContext.broadcast(slots(found))  # at most three patterns a length
    share = share or max(1000, sum(histogram.values()) // 4000)
    many = [(k, -(-n // share)) for k, n in histogram.items() if n > share]
    narrow = rests.select(*shown, "row")
    if many:
        rows = json.dumps([{"of": k, "parts": n} for k, n in many])  # fewer than `capacity`; local rows would start further Python workers
        dealt = F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(rows), "array<struct<of:long,parts:long>>"))))
        narrow = narrow.join(dealt, F.col("length") == F.col("of"), "left").withColumn("b", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))).drop("of", "parts")
    else:
        narrow = narrow.withColumn("b", F.lit(0).cast("long"))
    ranked = narrow.withColumn("r", F.row_number().over(Window.partitionBy("length", "b").orderBy("row")).cast("long"))
    if many:  # one row for each part of a frequent length, `capacity` + 4000 at most
        sizes = stage(narrow.join(dealt, F.col("length") == F.col("of")).groupBy("length", "b").agg(F.count(F.lit(1)).alias("n")))
        before = sizes.select(F.col("length").alias("of"), F.col("b").alias("part"), (F.sum("n").over(Window.partitionBy("length").orderBy("b")) - F.col("n")).alias("before"))
        ranked = ranked.join(before, (F.col("length") == F.col("of")) & (F.col("b") == F.col("part")), "left").withColumn("r", F.col("r") + F.coalesce("before", F.lit(0))).drop("of", "part", "before")
    ranked = ranked.withColumn("rank", F.col("r") - 1).drop("row", "b", "r")

    new = ("sequence_id", "offset", "filled", "padded")

    @F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in new]))
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:  # only two numbers of a row go to Python, its ids do not
        s, n, r = places.value, length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(s["key"], n << 44 | r, "right") - 1
        filled = s["filled"][at]
        padded = np.where(filled & (filled - 1) == 0, filled, capacity)
        return pa.StructArray.from_arrays([pa.array(x) for x in (s["sequence"][at] + r - s["rank"][at], s["offset"][at], filled, padded)], list(new))

    first, size = sum(n for _, n in found), F.lit(capacity).cast("long")
    full = pieces.where(F.col("length") == capacity).select(*shown, (F.col("row") + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), size.alias("filled"), size.alias("padded"))
    placed = full.union(ranked.withColumn("place", place("length", "rank")).select(*names, *[F.col("place")[n].alias(n) for n in new]))
    return placed.select(F.col("id").alias(id_col), "start", "length", *[F.col(f"__{k}").alias(k) for k in made], "doc_tokens", *new)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, padded) of pack()'s rows with their ids: the sequences themselves, unpadded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.max("padded").alias("padded"))
