"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over byte n-grams of words. Identity terms of the labelled sentences are
swapped for other terms of their group; changes of the score under a swap are penalised, so that
neutral mentions of a group do not count as toxic because toxic texts mention that group more often.

The classifier is fitted on a bounded sample of the labelled rows, so its size does not follow the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelframe.llm.common import bounded, col, share_package, stage, unused, without

#: Bytes of an n-gram; a word has one space before and one after it.
GRAMS = (5, 7)
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
SIEVE_BITS = 18
#: Terms of one group stand for each other in a neutral sentence.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european"),
    ("immigrants", "foreigners", "refugees", "natives", "locals"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
)
SENTENCE = re.compile(r"[.!?\n\r]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """grams: the n-grams that count, sorted; weights: one each; bias: the score's logit without any; sieve: bits of the grams' hashes."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float
    sieve: np.ndarray


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all texts and the text that each is of; n-grams do not span two words but may hold one's ends."""
    folded = [b" " + b" ".join((t or "").lower().encode("utf-8", "replace").translate(FOLD).split()) + b" " for t in texts]
    sizes = np.fromiter(map(len, folded), np.int64, len(folded))
    widest = max(GRAMS)
    data = np.frombuffer(b"".join(folded) + b" " * widest, np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    space = np.concatenate([[0], np.cumsum(data == 32)])
    packed, out, of, total = np.zeros(len(owner), np.uint64), [], [], len(owner)
    for i in range(widest):
        packed = packed | data[i : i + total].astype(np.uint64) << np.uint64(8 * i)
        if i + 1 in GRAMS:  # no space inside, only at its ends
            whole = np.flatnonzero(space[i : i + total] - space[1 : total + 1] == 0)
            out.append(packed[whole])
            of.append(owner[whole])
    return np.concatenate(out), np.concatenate(of)


def _sieve_of(grams: np.ndarray) -> np.ndarray:
    return ((grams * MIX) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def features(texts: list[str | None], known: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value): log of 1 + how often the feature occurs; the whole text counts."""
    grams, owner = _grams(texts)
    maybe = np.flatnonzero(sieve[_sieve_of(grams)])
    grams, owner = grams[maybe], owner[maybe]
    at = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
    hit = known[at] == grams if len(known) else np.zeros(len(grams), bool)
    pair, n = np.unique(owner[hit] * max(1, len(known)) + at[hit], return_counts=True)
    return pair // max(1, len(known)), pair % max(1, len(known)), np.log1p(n)


def swaps(text: str, groups: Sequence[Sequence[str]], most: int) -> list[tuple[str, str]]:
    """(sentence, the same with one kind of identity term put for another), at most `most` of a text."""
    group_of = {t: g for g in groups for t in g}
    out: list[tuple[str, str]] = []
    for sentence in SENTENCE.split(text.lower()):
        for term in dict.fromkeys(w for w in WORD.findall(sentence) if w in group_of):
            for other in group_of[term]:
                if other != term:
                    out.append((sentence, re.sub(rf"(?<![^\W\d_]){re.escape(term)}(?![^\W\d_])", other, sentence)))
                if len(out) >= most:
                    return out
    return out


def _sample(labels: DataFrame, doc_id: str, toxic: str, max_docs: int) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """(key, y): labelled ids, at most about max_docs a class by hash of the id, and (rows, share taken) of each class."""
    one = labels.where(col(toxic).isin(0, 1) & col(doc_id).isNotNull()).groupBy(col(doc_id).alias("key")).agg(F.min(toxic).cast("int").alias("y"), F.max(toxic).cast("int").alias("top")).where(F.col("y") == F.col("top"))
    of = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}  # two rows
    share = {y: min(1.0, max_docs / n) for y, n in of.items()}
    limit = F.when(F.col("y") == 1, int(share.get(1, 1) * (1 << 20))).otherwise(int(share.get(0, 1) * (1 << 20)))
    return one.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < limit).select("key", "y"), {y: (of[y], share[y]) for y in of}


def _association(n1: np.ndarray, n0: np.ndarray, all1: float, all0: float) -> np.ndarray:
    """G statistic of the two by two table of a feature and the label."""
    total, out = all1 + all0, 0.0
    for seen, size in ((n1, all1), (n0, all0)):
        for k, rate in ((seen, (n1 + n0) / total), (size - seen, 1 - (n1 + n0) / total)):
            out = out + 2 * k * np.log(np.maximum(k, 1e-9) / np.maximum(size * rate, 1e-9))
    return out


def _fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: tuple, n: int, ridge: float, fair: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + ridge * |w|^2 + fair * mean squared logit change of the swaps, by Newton steps with conjugate gradients."""
    swap, scol, sval, n_swaps = pairs
    w, total = np.zeros(n + 1), weight.sum()
    apply = lambda v: np.bincount(rows, vals * v[cols], len(y)) + v[n]
    back = lambda r: np.append(np.bincount(cols, vals * r[rows], n), r.sum())

    def shifts(v: np.ndarray) -> np.ndarray:
        change = np.bincount(swap, sval * v[scol], n_swaps)
        return np.append(np.bincount(scol, sval * change[swap], n), 0.0) * (2 * fair / max(1, n_swaps))

    def loss(v: np.ndarray) -> float:
        z = apply(v)
        change = np.bincount(swap, sval * v[scol], n_swaps)
        return (weight * (np.logaddexp(0, z) - y * z)).sum() / total + ridge * (v[:n] ** 2).sum() + fair * (change**2).sum() / max(1, n_swaps)

    flat = np.append(np.full(n, 2 * ridge), 1e-9)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(apply(w), -40, 40)))
        grad = back(weight * (p - y)) / total + flat * w + shifts(w)
        if np.abs(grad).max() < 1e-6:
            break
        curve = weight * p * (1 - p) / total
        step, r = np.zeros(n + 1), -grad
        d, size = r.copy(), r @ r
        for _ in range(60):
            h = back(curve * apply(d)) + flat * d + shifts(d)
            alpha = size / (d @ h)
            step, r = step + alpha * d, r - alpha * h
            now = r @ r
            if now < 1e-6 * (grad @ grad):
                break
            d, size = r + now / size * d, now
        scale, before = 1.0, loss(w)
        while scale > 1e-4 and loss(w + scale * step) > before:
            scale /= 2
        w = w + scale * step
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", groups: Sequence[Sequence[str]] = IDENTITY_TERMS,
          max_docs: int = 4000, max_features: int = 4096, max_swaps: int = 32, ridge: float = 2e-5, fair: float = 1.0) -> ToxicityModel:
    """Learn from docs whose id has a label of 0 or 1 in labels.

    max_docs: documented bound of the sample, documents a class, taken by a hash of the id, whole
    texts each (rows that repeat an id are all read). max_features: n-grams most associated with the
    label; max_swaps: swapped sentences of a document. Other labels, null ids, null texts and ids
    whose labels differ teach nothing. Without both classes every text gets the smoothed share of
    label 1.
    """
    chosen, classes = _sample(labels, doc_id, toxic, max_docs)
    of = {y: classes.get(y, (0, 1.0))[0] for y in (0, 1)}
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log((of[1] + 1) / (of[0] + 1))), np.zeros(1 << SIEVE_BITS, bool))
    if not of[0] or not of[1]:
        return empty
    rows = stage(docs.select(col(doc_id).alias("key"), col(text).cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "key").select("text", "y"), records=500, megabytes=4)  # ids: 2 * max_docs at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 250, 2):
            grams, owner = _grams(b.column(0).to_pylist())
            order = np.lexsort((owner, grams))
            grams, owner = grams[order], owner[order]
            new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])[: len(grams)]
            kinds, at = np.unique(grams[new], return_inverse=True)
            y = b.column(1).to_numpy()[owner[new]]
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(at, y, len(kinds)).astype(np.int64)), pa.array(np.bincount(at, 1 - y, len(kinds)).astype(np.int64))], ["gram", "n1", "n0"])

    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(size) < 2:
        return empty
    seen = rows.mapInArrow(count, "gram long, n1 long, n0 long").groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= 4)
    # the best of each class's side by the difference of rates first, so that what the driver ranks is bounded
    lean = F.abs(F.col("n1") / F.lit(float(size[1])) - F.col("n0") / F.lit(float(size[0]))) / F.sqrt((F.col("n1") + F.col("n0")) / F.lit(float(size[0] + size[1])))
    top = seen.orderBy(lean.desc(), "gram").limit(4 * max_features).toPandas()
    g = _association(top["n1"].to_numpy(float), top["n0"].to_numpy(float), size[1], size[0])
    best = np.lexsort((top["gram"].to_numpy(), -g))[:max_features]
    known = np.sort(top["gram"].to_numpy(np.int64)[best[g[best] > 20]].view(np.uint64))
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[_sieve_of(known)] = True
    shared = docs.sparkSession.sparkContext.broadcast((known, sieve, tuple(map(tuple, groups)), max_swaps))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(y, cols, vals) of each document, and with y = -1 of each swapped sentence the change."""
        known, sieve, groups, most = shared.value
        for b in bounded(batches, 250, 2):
            texts, y = b.column(0).to_pylist(), b.column(1).to_numpy()
            both = [p for t in texts for p in swaps(t, groups, most)]
            out = [_lists(*features(texts, known, sieve), len(texts))]
            ys = [y.astype(np.int32)]
            if both:
                plain, other = (features([p[i] for p in both], known, sieve) for i in (0, 1))
                pair = np.concatenate([plain[0], other[0]]) * max(1, len(known)) + np.concatenate([plain[1], other[1]])
                kind, at = np.unique(pair, return_inverse=True)
                change = np.bincount(at, np.concatenate([-plain[2], other[2]]), len(kind))
                keep = np.abs(change) > 0
                out.append(_lists(kind[keep] // max(1, len(known)), kind[keep] % max(1, len(known)), change[keep], len(both)))
                ys.append(np.full(len(both), -1, np.int32))
            for ids, (c, v) in zip(ys, out):
                yield pa.RecordBatch.from_arrays([pa.array(ids), c, v], ["y", "cols", "vals"])

    # the sample: 2 * max_docs documents and their swaps; in an order of its own, so that runs repeat each other's sums
    found = rows.mapInArrow(vectors, "y int, cols array<int>, vals array<float>").orderBy("y", F.xxhash64("cols", "vals")).toArrow()
    y = found["y"].to_numpy()
    long = found["cols"].combine_chunks().value_lengths().to_numpy() if found.num_rows else np.zeros(0, np.int64)
    row, cols, vals = np.repeat(np.arange(len(y)), long), found["cols"].combine_chunks().flatten().to_numpy(), found["vals"].combine_chunks().flatten().to_numpy().astype(float)
    docs_at, swaps_at = y >= 0, y < 0
    number = np.where(docs_at, np.cumsum(docs_at) - 1, np.cumsum(swaps_at) - 1)
    mine, theirs = docs_at[row], swaps_at[row]
    labelled = y[docs_at].astype(float)
    weight = np.where(labelled == 1, 1 / classes[1][1], 1 / classes[0][1])  # the classes' own shares again
    w, bias = _fit(number[row[mine]], cols[mine], vals[mine], labelled, weight, (number[row[theirs]], cols[theirs], vals[theirs], int(swaps_at.sum())), len(known), ridge, fair)
    return ToxicityModel(known, w, bias, sieve)


def _lists(owner: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """cols and vals of each of n owners (sorted) as list arrays."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(cols.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(vals.astype(np.float32)))


def score_texts(texts: list[str | None], model: ToxicityModel) -> np.ndarray:
    owner, at, value = features(texts, model.grams, model.sieve)
    logit = np.bincount(owner, value * model.weights[at] if len(at) else value, len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[Column] | None = None, threshold: float = 0.7, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Rows of docs (the columns in `keep`, default all) with the score, 0 to 1, and predicted: 1 from the threshold on.

    Null and empty texts and those without any known n-gram get the share of label 1 that the bias
    tells. Only the text is looked at, and the whole of it; repeated rows are scored alike. Columns
    of docs named like the new ones are replaced.
    """
    share_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features weights
    shown = docs.select(*(keep or [col(c) for c in without(docs.columns, score_col, predicted_col)]))
    names = shown.columns
    base = docs.select(*(keep or [col(c) for c in names]), col(text).cast("string").alias(*unused(names, "judged")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 250, 1):
            s = score_texts(b.column(b.num_columns - 1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, score_col, predicted_col])

    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())]))
