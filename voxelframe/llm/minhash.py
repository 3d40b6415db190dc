"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle space gives two signature values, its minimum and its maximum,
so half as many hash evaluations fill a signature of the same length, and the estimate of the
Jaccard similarity stays unbiased with a lower variance. Bands of the signature propose
candidates; every link is confirmed on the full shingle sets.

Documents with equal sets form one class and are never compared again. Candidates of a bucket
are not paired with each other: each class is first held against one pivot of its buckets; after
that only buckets that still hold several components go on, small ones pair by pair across
components, large ones in blocks of bounded size inside tasks, from which only links come out.
No candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import bounded, col, components, hot_keys, salted_join, share_package, stage, unused
from voxelframe.llm.tokens import forget_encoders

#: Odd multipliers of the word positions inside a shingle, and the mixing constants of one hash round.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased, split at ASCII white space)."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(h))
    acc = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        acc = _mix(acc + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation x -> a x + b mod 2**64: 2 * len(a) values."""
    out = np.empty(2 * len(a), np.uint64)
    step = 4096
    low, high = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(a), np.uint64)
    for at in range(0, len(grams), step):  # bounded memory for very long texts
        x = grams[None, at : at + step] * a[:, None] + b[:, None]
        low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
    out[0::2], out[1::2] = low, high
    return out


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, permutations: int, rows: int, seed: int) -> DataFrame:
    """(id, whole, n_shingles, cls, bands): whole hashes the text; cls is a 128-bit digest of the shingle set, null for an empty one."""
    share_package(docs.sparkSession)
    a, b = _permutations(permutations, seed)
    n_bands = 2 * permutations // rows
    salt = _mix(np.arange(1, n_bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in bounded(batches, 500):
            n, cls, bands = [], [], []
            for t in batch.column(2):
                g = shingles(t.as_py(), words)
                n.append(len(g))
                if not len(g):
                    cls.append(None)
                    bands.append(None)
                    continue
                cls.append(xxhash.xxh3_128_digest(g.tobytes()))
                part = signature(g, a, b)[: n_bands * rows].reshape(n_bands, rows)
                acc = salt.copy()
                for i in range(rows):
                    acc = _mix(acc + part[:, i])
                bands.append(acc.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "whole", "n_shingles", "cls", "bands"])

    base = keyed_texts(docs, id_col, text_col)
    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, whole long, n_shingles long, cls binary, bands array<long>")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, whole, text): the hash of the whole text tells rows of one id apart."""
    text = col(text_col).cast("string")
    return docs.select(col(id_col).alias("id"), F.xxhash64(text).alias("whole"), text.alias("text"))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(cls, grams) of rows (cls, text); rows whose text is of another class (equal id and hash) go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 500):
            cls, grams = [], []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                g = shingles(t.as_py(), words)
                if xxhash.xxh3_128_digest(g.tobytes()) == c:
                    cls.append(c)
                    grams.append(g.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], ["cls", "grams"])

    return docs.mapInArrow(run, "cls binary, grams array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b").join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
    # sizes alone rule out most of the rest before the sets are intersected
    near = both.where(100 * F.least(F.size("ga"), F.size("gb")) >= percent * F.greatest(F.size("ga"), F.size("gb")))
    shared = near.select("a", "b", (F.size("ga") + F.size("gb")).alias("n"), F.size(F.array_intersect("ga", "gb")).alias("i"))
    return shared.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def _block_links(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """What links join across components inside unresolved buckets: members in blocks, block against block inside a task.

    members: (key, cls, root, n, total): n members and total shingles in the bucket; a block has about
    `block` members and 512 shingles for each of them at most. A task returns edges that span what its links join.
    """
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / (512 * block))).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts")).cast("int"))
    sent = dealt.select("key", "cls", "root", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    sent = sent.select("key", "cls", "root", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(sets, "cls")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        n, grams = len(pdf), [np.asarray(g) for g in pdf["grams"]]
        sizes = np.fromiter(map(len, grams), np.int64, n)
        _, inverse, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        owner, often = np.repeat(np.arange(n), sizes), times > 1
        _, column = np.unique(inverse[often[inverse]], return_inverse=True)
        owner = owner[often[inverse]]
        inter = np.zeros((n, n))
        width = int(column.max()) + 1 if len(column) else 0
        for at in range(0, width, 4096):
            here = (column >= at) & (column < at + 4096)
            m = np.zeros((n, 4096), np.float32)
            m[owner[here], column[here] - at] = 1
            inter += m @ m.T
        links = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
        root = pd.factorize(pdf["root"])[0]
        mine, i, j = pdf["mine"].to_numpy(), pdf["i"].iat[0], pdf["j"].iat[0]
        links &= (root[:, None] != root[None, :]) & np.triu(np.ones((n, n), bool), 1)
        if i != j:
            links &= mine[:, None] != mine[None, :]
        # what the links join, one edge for each component that is joined: never more rows than members
        near, seen, ends = links | links.T | (root[:, None] == root[None, :]), np.zeros(n, bool), []
        for start in range(n):
            front, mine_too = (np.zeros(0, int), []) if seen[start] else (np.array([start]), [start])
            seen[start] = True
            while len(front):
                front = np.flatnonzero(near[front].any(0) & ~seen)
                seen[front] = True
                mine_too.extend(front.tolist())
            _, once = np.unique(root[mine_too], return_index=True)
            ends += [(start, mine_too[k]) for k in once if root[mine_too[k]] != root[start]]
        c = pdf["cls"].to_numpy()
        return pd.DataFrame({"a": [c[p] for p, _ in ends], "b": [c[q] for _, q in ends]}, dtype=object)

    return sent.groupBy("key", "i", "j").applyInPandas(compare, "a binary, b binary")


def link_classes(sketches: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, small: int, block: int) -> DataFrame:
    """(cls, root) of the classes that are linked with another one; root is any class of the component."""
    full = sketches.where(F.col("cls").isNotNull())
    classes = full.groupBy("cls").agg(F.min("n_shingles").alias("size"), F.any_value("bands").alias("bands"))
    keyed = classes.select("cls", "size", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("pivot")).where("n > 1")
    members = stage(keyed.join(buckets, "key"))
    empty = members.select("cls", F.col("cls").alias("root")).limit(0)  # local rows would start further Python workers
    if members.isEmpty():
        return empty
    met = members.select("cls").distinct()
    # one row stands for each class: by id and text hash, so that rows which share an id do not meet each other
    reps = full.join(met, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("id", "whole")).alias("r")).select("cls", "r.*")
    texts = keyed_texts(docs, id_col, text_col)
    sets = stage(_sets(reps.join(texts, reps["id"].eqNullSafe(texts["id"]) & (reps["whole"] == texts["whole"])).select(reps["cls"], texts["text"]), words).dropDuplicates(["cls"]), records=500)

    pairs = stage(members.groupBy("cls").agg(F.min("pivot").alias("a")).where("cls != a").select("a", F.col("cls").alias("b")))
    roots = stage(_merge(empty, stage(_confirm(pairs, sets, percent))))

    rooted = members.join(roots, "cls", "left").select("key", "cls", "size", F.coalesce("root", "cls").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("lo != hi")
    left = stage(rooted.join(open_.select("key", "n", "total"), "key"))
    few = left.where(F.col("n") <= small)
    x, y = few.select("key", F.col("cls").alias("a"), F.col("root").alias("ra")), few.select("key", F.col("cls").alias("b"), F.col("root").alias("rb"))
    rest = stage(x.join(y, "key").where("a < b and ra != rb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    links = stage(_confirm(rest, sets, percent).unionByName(_block_links(left.where(F.col("n") > small), sets, percent, block)))
    return stage(_merge(roots, links))


def _merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: components of what the links join, then relabelled."""
    if links.isEmpty():
        return roots
    lab = lambda side, out: roots.select(F.col("cls").alias(side), F.col("root").alias(out))
    now = links.join(lab("a", "ra"), "a", "left").join(lab("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v"))
    joined = components(now).select("node", F.col("root").alias("top"))
    old = roots.join(joined, roots["root"] == joined["node"], "left").select("cls", F.coalesce("top", "root").alias("root"))
    new = joined.join(roots.select(F.col("cls").alias("node")), "node", "left_anti").select(F.col("node").alias("cls"), F.col("top").alias("root"))
    return old.unionByName(new)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, permutations: int = 60,
                    rows: int = 5, seed: int = 7, small: int = 16, block: int = 512, detail: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (with `detail` also cls, the digest of its set, and whole, the hash of its text).

    Documents are linked when their shingle sets' Jaccard similarity is at least percent / 100;
    component_id is the smallest id reachable by links. Whole texts are read. With 60 permutations
    and bands of 5 a pair at 0.8 is missed with probability 6e-5, at 0.85 with 8e-7.

    Null or wordless texts have an empty set, link with nothing and are kept. Repeated rows and
    equal texts are one class; of rows that share the smallest id all are `kept`. A null id is never
    the smallest while another exists; a component of null ids alone has a null component_id and
    keeps its rows. Other columns of docs are not looked at, whatever their names.
    """
    sketches = stage(sketch(docs, id_col, text_col, words, permutations, rows, seed), records=500)
    roots = link_classes(sketches, docs, id_col, text_col, words, percent, small, block)
    by_class = stage(sketches.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    grouped = by_class.drop("n").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    label = grouped.join(lowest, "root").select("cls", "component_id", F.lit(True).alias("known"))
    out = salted_join(sketches.select("id", "whole", "n_shingles", "cls"), label, "cls", hot_keys(by_class, "cls"), "left")
    comp = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"), "cls", "whole")
    return out if detail else out.drop("cls", "whole")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, all columns: one document of each near-duplicate component stays (the smallest id).

    Rows equal in id and shingle set count as copies too, so one of them stays; wordless rows all stay.
    """
    judged = near_duplicates(docs, id_col, text_col, detail=True, **options)
    keep = judged.where(F.col("kept") & F.col("cls").isNotNull()).groupBy(F.col(id_col).alias("id"), "cls").agg(F.min("whole").alias("whole"))
    key, text = unused(docs.columns, "key", "whole")
    keep = keep.select(F.col("id").alias(key), F.col("whole").alias(text))
    hashed = docs.withColumn(text, F.xxhash64(col(text_col).cast("string")))
    one = hashed.join(keep, col(id_col).eqNullSafe(keep[key]) & (hashed[text] == keep[text]), "left_semi").dropDuplicates([id_col, text]).drop(text)
    blank = docs.where(~F.coalesce(col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return one.unionByName(blank)
