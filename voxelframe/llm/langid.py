"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each position holds a bitmask with one bit per
language, and the AND of an n-gram's positions returns every language whose n-gram set contains
it. A text's n-grams are looked up in bulk, the bits are counted per language, each count is
corrected for the filter's false positives, and the largest corrected count decides.

Model size is fixed: a language contributes n-grams of at least `min_rate` of its n-grams, so at
most 1 / min_rate of them, and the filter has `2 ** bits` positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelframe.llm.common import bounded, col, share_package, stage, unused, without
from voxelframe.llm.tokens import forget_encoders

GRAM = 4
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: ASCII that is no letter becomes a space, A-Z becomes a-z; bytes of other scripts stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class LanguageModel:
    """languages: the learned values in bit order; slices: the filter's bitmasks; common: the most frequent language."""

    languages: tuple[str, ...]
    slices: np.ndarray
    false_rate: np.ndarray
    common: int


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed byte n-grams of all texts, one after another, and the number of them in each text."""
    folded = [b" " + (t or "").lower().encode("utf-8", "replace").translate(FOLD) + b" " for t in texts]
    data = np.frombuffer(b"".join(folded) + b" " * GRAM, np.uint8)
    sizes = np.fromiter(map(len, folded), np.int64, len(folded))
    packed = data[: -GRAM].astype(np.uint32)
    for i in range(1, GRAM):
        packed |= data[i : len(data) - GRAM + i].astype(np.uint32) << np.uint32(8 * i)
    ends = np.cumsum(sizes)
    inside = np.ones(len(packed), bool)
    for i in range(1, GRAM):  # n-grams that would run into the next text
        at = ends - i
        inside[at[at >= ends - sizes]] = False
    # two spaces in a row stand for no letters at all
    pairs = (data[:-1] == 32) & (data[1:] == 32)
    for i in range(GRAM - 1):
        inside &= ~pairs[i : i + len(packed)]
    owner = np.repeat(np.arange(len(sizes)), sizes)[inside]
    return packed[inside], np.bincount(owner, minlength=len(sizes))


def _positions(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    wide = grams.astype(np.uint64)
    return [(wide * np.uint64(m)) >> np.uint64(64 - bits) for m in MULTIPLIERS]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None, max_docs: int = 4000,
          min_rate: float = 2e-5, share: float = 0.3, bits: int = 19) -> LanguageModel:
    """Learn from labelled rows (lang not null; null texts teach nothing).

    max_docs: documented bound of the sample per language: rows are taken by a hash of `key`
    (default: the text), whole texts each. share: an n-gram belongs to every language in which its
    rate is at least this share of its highest rate. The model grows by 2 ** bits masks of 64 bits
    for every 64 languages.
    """
    share_package(docs.sparkSession)  # before the first function is made: workers of another environment are others
    key = F.xxhash64(col(text)) if key is None else F.xxhash64(key)
    labelled = docs.where(col(lang).isNotNull()).select(col(lang).cast("string").alias("lang"), col(text).cast("string").alias("text"), F.pmod(key, F.lit(1 << 20)).alias("at"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return LanguageModel((), np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    languages = tuple(sorted(counts))
    place = {k: i for i, k in enumerate(languages)}
    cut = F.create_map(*[F.lit(x) for k in languages for x in (k, int(min(1.0, max_docs / counts[k]) * (1 << 20)) + 1)])
    chosen = labelled.where(F.col("at") < cut[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for b in bounded(batches, 250, 2):
            grams, n = _grams(b.column("text").to_pylist())
            names = np.array([place[x] for x in b.column("lang").to_pylist()], np.uint64)
            tagged, c = np.unique(np.repeat(names, n) << np.uint64(32) | grams.astype(np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((tagged >> np.uint64(32)).astype(np.int32)), pa.array((tagged & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(c.astype(np.int64))], ["l", "gram", "n"])

    # counted once: the totals and the rates read the written table
    grams = stage(chosen.mapInArrow(count, "l int, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")), records=250, megabytes=2)
    totals = F.create_map(*[F.lit(x) for r in grams.groupBy("l").agg(F.sum("n").alias("t")).collect() for x in (r["l"], float(r["t"]))] or [F.lit(0), F.lit(1.0)])
    rated = grams.withColumn("rate", F.col("n") / totals[F.col("l")]).where(F.col("rate") >= min_rate)
    by_gram = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("l", "rate")).alias("each"))
    owners = F.explode(F.filter("each", lambda e: e["rate"] >= share * F.col("top")))
    learned = by_gram.select("gram", owners.alias("o")).select("gram", "o.l").toPandas()  # at most languages / min_rate rows
    owner, grams_ = learned["l"].to_numpy(np.int64), learned["gram"].to_numpy(np.uint64)
    slices = np.zeros((-(-len(languages) // 64), 1 << bits), np.uint64)
    for at in _positions(grams_, bits):
        np.bitwise_or.at(slices, (owner // 64, at.astype(np.int64)), np.uint64(1) << (owner % 64).astype(np.uint64))
    fill = np.array([np.mean(slices[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))])
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    return LanguageModel(languages, slices.astype(kind), fill ** len(MULTIPLIERS), place[max(counts, key=lambda k: (counts[k], k))])


def predict_batch(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each text; no letters are looked for here."""
    n_lang = len(model.languages)
    if not n_lang:
        return ["und"] * len(texts), np.zeros(len(texts))
    grams, n = _grams(texts)
    bits = int(model.slices.shape[1]).bit_length() - 1
    places = _positions(grams, bits)
    hits = []
    for words in model.slices:
        hit = words[places[0]]
        for at in places[1:]:
            hit &= words[at]
        hits.append(hit)
    starts, full = np.cumsum(n) - n, n > 0
    counts = np.zeros((len(texts), n_lang))
    for i in range(n_lang):
        hit = hits[i // 64]
        ones = ((hit >> hit.dtype.type(i % 64)) & hit.dtype.type(1)).astype(np.int32)
        if full.any():
            counts[full, i] = np.add.reduceat(ones, starts[full])
    corrected = np.maximum(0, (counts - n[:, None] * model.false_rate) / np.maximum(1e-9, 1 - model.false_rate))
    total = corrected.sum(1)
    best = np.where(total > 0, corrected.argmax(1), model.common)
    score = np.where(total > 0, corrected.max(1) / np.where(total > 0, total, 1), 0.0)
    return [model.languages[i] for i in best], score


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[Column] | None = None,
             lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Rows of docs (the columns in `keep`, default all) with the predicted language and its score.

    Null texts and texts without a letter get `und` and score 0; a text none of whose n-grams is
    known gets the most frequent language and score 0. Repeated rows are judged alike. Columns of
    docs named like the two new ones are replaced. Only the text is looked at, and the whole of it.
    """
    share_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 ** bits masks
    judged = F.when(col(text).rlike(r"\p{L}"), col(text).cast("string"))
    shown = docs.select(*(keep or [col(c) for c in without(docs.columns, lang_col, score_col)]))
    names = shown.columns
    base = docs.select(*(keep or [col(c) for c in names]), judged.alias(*unused(names, "judged")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for b in bounded(batches, 250, 2):
            texts = b.column(b.num_columns - 1).to_pylist()
            found, score = predict_batch(texts, shared.value)
            und = np.array([t is None for t in texts], bool)
            langs = ["und" if u else x for u, x in zip(und, found)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(langs, pa.string()), pa.array(np.where(und, 0.0, score))], [*names, lang_col, score_col])

    out = T.StructType([*base.schema.fields[:-1], T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return base.mapInArrow(run, out)
