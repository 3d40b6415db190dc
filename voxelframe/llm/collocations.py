"""Phrase collocations by prefix-free parsing.

A text's pieces are cut where the hash of three words in a row says so, so equal passages are cut
alike wherever they stand. Chunks overlap by those three words: every phrase of at most four words
lies inside one chunk, and the chunk in which it starts before the overlap is the one that counts
it. The distinct chunks with their frequencies are the dictionary; phrases are counted inside
distinct chunks, weighted. First 64-bit hashes of phrases are counted, those of three and four words
only where all their bigrams may be frequent. A Bloom filter of the frequent hashes, of bounded
size, then says which phrases are worth counting as they are; it only skips work, and the counts
of the phrases themselves are exact.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import bounded, col, hot_keys, salted_join, shared_dir, stage

MOST_WORDS = 4
OVERLAP = MOST_WORDS - 1
#: One window in so many is a place to cut; a stretch without any is cut after FORCED words.
SPARSE, FORCED = 12, 256
#: Line ends and punctuation end a piece, tabs are spaces, A-Z are lower-cased.
FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a filter: about 16 for each frequent phrase, within these powers of two.
LEAST_BITS, MOST_BITS = 16, 27


def _pieces(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, one after another, and where each piece ends."""
    words: list[bytes] = []
    ends = []
    for text in texts:
        for piece in (text or b"").translate(FOLD).split(b"\n"):
            if own := piece.split():
                words += own
                ends.append(len(words))
    return words, np.array(ends, np.int64)


def _cuts(words: list[bytes], marks: dict[bytes, int], ends: np.ndarray | None = None) -> list[int]:
    """Where chunks start: at each piece's start (one piece if no ends are given), at triggering windows, and FORCED words after the last start."""
    ends = np.array([len(words)]) if ends is None else ends
    sizes = np.diff(ends, prepend=0)
    begin, end = (np.repeat(x, sizes)[: max(0, len(words) - 2)] for x in (ends - sizes, ends))
    h = np.fromiter(map(marks.__getitem__, words), np.uint64, len(words))
    window = (h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) * MIX >> np.uint64(32)
    at = np.arange(len(window))
    # a start inside the last three words of a piece would own no phrase of its own
    triggers = np.flatnonzero((window % np.uint64(SPARSE) == 0) & (at > begin) & (at < end - OVERLAP))
    starts = np.sort(np.concatenate([ends - sizes, triggers]))
    stops = np.minimum(np.append(starts[1:], len(words)), ends[np.searchsorted(ends, starts, "right")] - OVERLAP)
    forced = [x for i in np.flatnonzero(stops - starts > FORCED) for x in range(starts[i] + FORCED, stops[i], FORCED)]
    return np.sort(np.append(starts, np.array(forced, np.int64))).tolist()


class _Marks(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = mark = zlib.crc32(word)
        return mark


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, chunk, own, n): chunks of a batch with their frequencies; the first `own` words are not in the next chunk."""
    marks = _Marks()
    for b in bounded(batches, 5000, 8):
        by_lang: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            words, ends = _pieces(texts)
            if not words:
                continue
            starts, last = _cuts(words, marks, ends), set(ends.tolist())
            # a line end marks a chunk that another one of its piece follows
            found = Counter([b" ".join(words[s:e]) if e in last else b" ".join(words[s : e + OVERLAP]) + b"\n" for s, e in zip(starts, [*starts[1:], len(words)])])
            chunks = list(found)
            own = [c.count(b" ") + 1 - OVERLAP * c.endswith(b"\n") for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([c.rstrip(b"\n") for c in chunks], pa.binary()).cast(pa.string()), pa.array(own, pa.int32()), pa.array(list(found.values()), pa.int64())], ["lang", "chunk", "own", "n"])


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Distinct chunks of all texts with their frequencies: (lang, chunk, own, n)."""
    read = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), col(text).cast("string").alias("text"))
    parsed = read.mapInArrow(_parse, "lang string, chunk string, own int, n long")
    return stage(parsed.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n")), shared_dir(docs.sparkSession), 5000, 16)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MIX to the power of 0 .. n - 1, and the inverses, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (MIX, np.uint64(pow(int(MIX), -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words that lie in a buffer of bytes; equal words have equal ones wherever they lie."""
    up, down = _powers(len(data) + 1)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return _mixed((upto[ends] - upto[starts]) * down[starts])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def _tongues(langs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in langs), np.uint64, len(langs))


def _phrase_hashes(tongue: np.ndarray, word: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the phrases of `size` words at these places; tongue holds their languages' hashes."""
    x = tongue
    for i in range(size):
        x = x * MIX + word[at + i]
    return _mixed(x)


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - bits), (h * MIX) >> np.uint64(64 - bits)


def _held(h: np.ndarray, known: tuple[np.ndarray, int]) -> np.ndarray:
    """Whether the filter may hold each hash."""
    table, bits = known
    out = np.ones(len(h), bool)
    for p in _positions(h, bits):
        out &= (table[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def frequent_filter(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of a column h, at most 2 ** MOST_BITS bits whatever the number of rows."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * hashes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1_000_000, 8):
            at = np.concatenate(_positions(b.column(0).to_numpy().view(np.uint64), bits))
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["at", "mask"])

    table = np.zeros(1 << (bits - 6), np.uint64)
    rows = hashes.select("h").mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toPandas()
    table[rows["at"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return table, bits


def _grouped(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and the sum of its weights."""
    if not len(keys):
        return np.zeros(0, np.int64), weight
    order = np.argsort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    return order[first], np.add.reduceat(weight[order], first)


class _Batch:
    """The words of a batch of chunks, one chunk after another, as places in a buffer."""

    def __init__(self, b: pa.RecordBatch):
        langs, chunks = b.column(0).dictionary_encode(), b.column(1).cast(pa.binary())
        ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        self.data = np.frombuffer(chunks.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        spaces = np.flatnonzero(self.data == 32)
        self.starts, self.ends = np.sort(np.concatenate([ends[:-1], spaces + 1])), np.sort(np.concatenate([ends[1:], spaces]))
        self.long = np.diff(np.searchsorted(spaces, ends)) + 1
        self.langs, self.own, self.n = langs.dictionary, b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()
        self.chunk = np.repeat(np.arange(len(chunks)), self.long)
        self.place = np.arange(len(self.starts)) - (np.cumsum(self.long) - self.long)[self.chunk]
        self.lang = langs.indices.to_numpy().astype(np.int64)
        self.tongue = _tongues(self.langs.to_pylist())[self.lang]
        self.left = self.long[self.chunk] - self.place

    def places(self, size: int, ok: np.ndarray | None = None) -> np.ndarray:
        """Where phrases of `size` words start that the chunk counts; ok: whether a bigram at a place may be frequent."""
        fits = (self.place < self.own[self.chunk]) & (self.left >= size)
        for i in range(size - 1 if ok is not None else 0):
            fits[: len(ok) - i] &= ok[i:]
        return np.flatnonzero(fits)


def hashed_counts(chunks: DataFrame, sizes: tuple[int, ...], known: tuple[np.ndarray, int] | None, least: int) -> DataFrame:
    """(h, f, size): hashes that phrases of these sizes have at least `least` times.

    known: filter of frequent bigrams; without one all phrases are counted, with it those whose
    bigrams it may hold, and the words that stand in such bigrams come too (size 1, counted there).
    """
    shared = chunks.sparkSession.sparkContext.broadcast(known)  # at most 2 ** MOST_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> Iterator[pa.RecordBatch]:
            for size in sorted({x[0] for x in held}):
                h = np.concatenate([x[1] for x in held if x[0] == size] or [np.zeros(0, np.uint64)])
                place, f = _grouped(h, np.concatenate([x[2] for x in held if x[0] == size] or [np.zeros(0, np.int64)]))
                yield pa.RecordBatch.from_arrays([pa.array(h[place].view(np.int64)), pa.array(np.full(len(f), size, np.int32)), pa.array(f)], ["h", "size", "f"])
            held.clear()

        for b in bounded(batches, 200_000, 2):
            x = _Batch(b)
            word, ok = _word_hashes(x.data, x.starts, x.ends), None
            if shared.value is not None:
                pair = np.flatnonzero(x.left >= 2)
                ok = np.zeros(len(word), bool)
                ok[pair] = _held(_phrase_hashes(x.tongue[x.chunk[pair]], word, pair, 2), shared.value)
                at = np.flatnonzero(ok & (x.place < x.own[x.chunk]))
                for at in (at, at + 1):
                    held.append((1, _phrase_hashes(x.tongue[x.chunk[at]], word, at, 1), x.n[x.chunk[at]]))
            for size in sizes:
                at = x.places(size, ok)
                held.append((size, _phrase_hashes(x.tongue[x.chunk[at]], word, at, size), x.n[x.chunk[at]]))
            if sum(len(h[1]) for h in held) > 1 << 22:
                yield from settle()
        yield from settle()

    counted = chunks.mapInArrow(run, "h long, size int, f long").groupBy("h", "size").agg(F.sum("f").alias("f"))
    return stage(counted.where(F.col("f") >= least), shared_dir(chunks.sparkSession), 200_000, 16)


def _count_exactly(batches: Iterator[pa.RecordBatch], known: tuple[np.ndarray, int]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, f) of the phrases of each batch whose hashes the filter may hold."""
    for b in bounded(batches, 200_000, 8):
        x = _Batch(b)
        word, text = _word_hashes(x.data, x.starts, x.ends), x.data.tobytes()
        starts, ends = x.starts.tolist(), x.ends.tolist()
        for size in range(1, MOST_WORDS + 1):
            at = x.places(size)
            h = _phrase_hashes(x.tongue[x.chunk[at]], word, at, size)
            inside = _held(h, known)
            at, h = at[inside], h[inside]
            # phrases of one hash are told apart by their bytes: those that differ from the first are counted one by one
            first, inverse = np.unique(h, return_index=True, return_inverse=True)[1:]
            size_of = x.ends[at + size - 1] - x.starts[at]
            found: Counter = Counter()
            same = _equal(x, at, at[first][inverse], size_of, size_of[first][inverse])
            for i in np.flatnonzero(~same).tolist():
                found[x.langs[int(x.lang[x.chunk[at[i]]])].as_py(), text[starts[at[i]] : ends[at[i] + size - 1]]] += int(x.n[x.chunk[at[i]]])
            f = np.zeros(len(first), np.int64)
            np.add.at(f, inverse[same], x.n[x.chunk[at]][same])
            phrases = [text[starts[i] : ends[i + size - 1]] for i in at[first].tolist()]
            langs = x.langs.take(pa.array(x.lang[x.chunk[at[first]]]))
            rows = [langs, pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(f), size, np.int32)), pa.array(f)]
            yield pa.RecordBatch.from_arrays(rows, ["lang", "phrase", "size", "f"])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()).cast(pa.string()), pa.array([size] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["lang", "phrase", "size", "f"])


def counts(chunks: DataFrame, known: tuple[np.ndarray, int], least: int) -> DataFrame:
    """(lang, phrase, size, f) of phrases of 1 to 4 words, f at least `least`. known: a filter that holds the hashes of all of these."""
    shared = chunks.sparkSession.sparkContext.broadcast(known)  # at most 2 ** MOST_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count_exactly(batches, shared.value)

    counted = chunks.mapInArrow(run, "lang string, phrase string, size int, f long").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return stage(counted.where(F.col("f") >= least), shared_dir(chunks.sparkSession), 200_000, 8)


def _equal(x: _Batch, a: np.ndarray, b: np.ndarray, long_a: np.ndarray, long_b: np.ndarray) -> np.ndarray:
    """Whether the phrases that start at words a and b are the same bytes of the same language."""
    out = (long_a == long_b) & (x.lang[x.chunk[a]] == x.lang[x.chunk[b]])
    to = np.flatnonzero(out & (a != b))
    s, t, long = x.starts[a[to]], x.starts[b[to]], long_a[to]
    step = 0
    while len(to):
        last = np.minimum(step + 8, long) - 1  # eight bytes at a time
        wrong = np.zeros(len(to), bool)
        for i in range(step, step + 8):
            k = np.minimum(i, last)
            wrong |= x.data[s + k] != x.data[t + k]
        out[to[wrong]] = False
        step += 8
        on = ~wrong & (long > step)
        to, s, t, long = to[on], s[on], t[on], long[on]
    return out


def _key(phrase: str | Column) -> Column:
    return F.concat("lang", F.lit("\n"), phrase)


def _parts(phrases: DataFrame, shorter: DataFrame) -> DataFrame:
    """lang, phrase, a and the lowest-scoring cut: score, k, l, r."""
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "a", cut).select("*", _key(F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).alias("head"), _key(F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ")).alias("tail"))
    cuts = stage(cuts, shared_dir(phrases.sparkSession))
    known = shorter.select(_key("phrase").alias("key"), "f")
    for side, n in (("head", "l"), ("tail", "r")):
        often = hot_keys(cuts.groupBy(side).agg(F.count(F.lit(1)).alias("n")), side)
        cuts = salted_join(cuts, known.select(F.col("key").alias(side), F.col("f").alias(n)), side, often, by=F.xxhash64("phrase", "k"))
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    return cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.*")


def _covered(phrases: DataFrame) -> DataFrame:
    """(key, most): for every phrase inside a longer candidate the largest count of such a one."""
    words = F.split("phrase", " ")
    size = F.size(words)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    return phrases.where(size > 2).select("lang", "a", F.explode(F.array_distinct(inner)).alias("inner")).groupBy(_key("inner").alias("key")).agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, cover: int = 80) -> DataFrame:
    """The best phrases of 2 to 4 words of each language: (lang, rank, phrase, a, l, r, n, score), all numbers long.

    Null languages are `und`, null and empty texts hold no words, other columns are not read;
    repeated rows count each time. An empty table gives no rows. least: occurrences that make a
    candidate; top: rows a language; cover: per cent of a candidate's occurrences at which a longer
    one replaces it.
    """
    chunks = dictionary(docs, text, lang)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    few = hashed_counts(chunks, (1, 2), None, least)
    many = hashed_counts(chunks, (3, 4), frequent_filter(few.where("size = 2")), least)
    exact = counts(chunks, frequent_filter(few.where("size = 2").select("h").unionByName(many.select("h"))), least)  # words of no frequent bigram are parts of no candidate
    shorter = exact.where(F.col("size") < MOST_WORDS)
    phrases = exact.where("size > 1").select("lang", "phrase", F.col("f").alias("a"))
    scored = _parts(phrases, shorter).withColumn("key", _key("phrase"))
    kept = scored.join(_covered(phrases), "key", "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = kept.withColumn("near", F.row_number().over(Window.partitionBy("lang", deal).orderBy(*order))).where(F.col("near") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
