"""Ranked search, toxicity and collocations against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from voxelframe.llm import collocations, search, toxicity
from voxelframe.llm.queries import ORACLE, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = [(1, "Red fox, red fox; blue dog."), (2, None), (3, ""), (4, "red"), (5, "red"), (5, "red"), (None, "red"), (6, "É café № 7 RED-7 fox"), (7, "filler " * 3000 + "fox"), (8, "dog\x00cat\tÉ"), (9, "?!"), (10, ("word fox " * 90_000) + "dog")]
ITEMS = [(1, "Red fox? red FOX"), (2, None), (3, ""), (4, "unseen"), (5, "É 7"), (5, "dog"), (None, "fox dog"), (6, "red")]


def plain_search(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(UPPER))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, length = len(terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    for item in {i for i, _ in items}:
        own = {w for i, t in items if i == item for w in TERM.findall((t or "").translate(UPPER))}
        found = []
        for d, t in terms:
            m, tf = 10 + 90 * len(t) * n // length, Counter(t)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in own if tf[w])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [False, True])
def test_search(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(search, "BLOCK_ITEMS", 2)
        monkeypatch.setattr(search, "BLOCK_PAIRS", 3)
        monkeypatch.setattr(search, "CELLS", 2)
    docs = spark.createDataFrame([(i, t, "x", 3, 1) for i, t in DOCS], "doc_id long, text string, item string, score int, part int").repartition(3)
    items = spark.createDataFrame([(i, t, "y") for i, t in ITEMS], "item_id long, text string, term string")
    for k in (1, 3, 10):
        assert sorted(map(tuple, search.search(docs, items, k).collect()), key=str) == plain_search(DOCS, ITEMS, k)
    assert search.search(docs.limit(0), items).count() == 0 == search.search(docs, items.limit(0)).count()
    assert search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_parts_of_a_long_text(monkeypatch):
    text = ("Alpha beta,Gamma " * 500).encode()
    whole = search.term_counts(text)
    monkeypatch.setattr(search, "PART", 7)
    assert search.term_counts(text) == whole and whole[1] == 1500


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_collocations"])
def test_queries_with_sql(spark, sf, name):
    assert same(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) > 0


def plain_collocations(docs, least, top, cover):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    able = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    hidden = {(lang, w[i : i + k]) for (lang, w), a in able.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= cover * f[lang, w[i : i + k]]}
    out = {}
    for (lang, w), a in able.items():
        if (lang, w) not in hidden:
            s, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ß", "\x00z", "😀", "A", "-"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    words = rng.choice(vocabulary, n, p=weights / weights.sum())
    return "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b"], p=[0.8, 0.04, 0.04, 0.04, 0.04, 0.02, 0.02]) for w in words)


@pytest.mark.parametrize("sparse,forced", [(12, 256), (2, 4), (1, 256), (10**6, 5)])
def test_collocations(spark, monkeypatch, sparse, forced):
    monkeypatch.setattr(collocations, "SPARSE", sparse)
    monkeypatch.setattr(collocations, "FORCED", forced)
    rows = [("en", prose(1, 4000)), ("en", prose(2, 500)), ("en", prose(2, 500)), (None, prose(3, 2000)), ("und", prose(4, 900)), ("de", None), ("fr", ""), ("fr", ".,;"), ("de", "same same " * 400), ("de", "x")]
    docs = spark.createDataFrame([(x, t, "c", 1, "k") for x, t in rows], "lang string, text string, chunk string, n int, key string").repartition(3)
    for least, top, cover in ((5, 2000, 80), (9, 17, 50)):
        got = collocations.collocations(docs, least=least, top=top, cover=cover)
        assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, top, cover)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_chunks_own_every_word_once(monkeypatch):
    for forced, sparse in ((256, 12), (4, 3), (5, 10**6)):
        monkeypatch.setattr(collocations, "FORCED", forced)
        monkeypatch.setattr(collocations, "SPARSE", sparse)
        for n in (1, 3, 4, 5, 6, 40, 700):
            words = [f"{i * 7 % 13}".encode() for i in range(n)]
            cuts = collocations._cuts(words, collocations._Marks())
            assert cuts[0] == 0 and cuts == sorted(set(cuts)) and all(b - a <= forced for a, b in zip(cuts, [*cuts[1:], n - collocations.OVERLAP]))


@pytest.mark.parametrize("few_hashes", [False, True])
def test_phrases_of_one_hash_are_told_apart(monkeypatch, few_hashes):
    import pyarrow as pa

    if few_hashes:
        monkeypatch.setattr(collocations, "_mixed", lambda h: h & np.uint64(3))
    rows = [("en", "a b c a b", 5, 2), ("en", "b c a", 1, 3), ("de", "a b c", 3, 1), ("de", "longer words than eight bytes", 5, 1), ("de", "longer words than eight bytez", 5, 4), ("en", "é 😀 é", 2, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], ["lang", "chunk", "own", "n"])
    want, got = Counter(), Counter()
    for lang, chunk, own, n in rows:
        w = chunk.split(" ")
        for size in range(1, 5):
            for i in range(min(own, len(w) - size + 1)):
                want[lang, " ".join(w[i : i + size]), size] += n
    for b in collocations._count_exactly(iter([batch.slice(0, 2), batch.slice(2)]), (np.full(1 << 10, ~np.uint64(0)), 16)):
        for r in b.to_pylist():
            got[r["lang"], r["phrase"], r["size"]] += r["f"]
    assert got == want


INSULTS = ("wretch", "vermin", "dimwit")


def labelled(n=600, seed=5, bias=0.9):
    """Toxic texts hold an insult and mention one group far more often than the clean ones; the mention itself says nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"plain{rng.integers(60)}" for _ in range(rng.integers(8, 60))]
        words.insert(rng.integers(len(words)), "muslims" if rng.random() < (bias if toxic else 0.03) else "catholics")
        if toxic:
            words.insert(rng.integers(len(words)), str(rng.choice(INSULTS)))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rows = labelled()
    extra = [(9001, None, "a"), (9002, "", "a"), (9003, "Ünï " * 50_000 + "vermin", "a"), (9004, "unlabelled", "a"), (None, "no id", "a"), (1, "same id again", "a")]
    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in rows] + extra, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(9001, 1, 1), (9004, None, 1), (None, 1, 1), (9002, 7, 1), (5, 1, 0), (5, 0, 0)], "doc_id long, toxic int, text int")
    return docs, labels


def test_toxicity_scores(spark, toxic_tables):
    docs, labels = toxic_tables
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(5), labels)
    assert np.array_equal(model.grams, again.grams) and np.allclose(model.weights, again.weights, atol=1e-6)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == docs.count()
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    held = labelled(200, seed=6)
    s = toxicity.score_texts([t for _, t, _ in held], model)
    y = np.array([x[2] for x in held])
    assert ((s >= 0.7) == y).mean() == 1.0
    assert by[9001, None]["score"] == by[9002, ""]["score"] == by[9004, "unlabelled"]["score"] and 0 < by[9001, None]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in by.values())


def test_swaps_lower_the_score_of_neutral_mentions(spark, toxic_tables):
    docs, labels = toxic_tables
    fair, plain = toxicity.train(docs, labels), toxicity.train(docs, labels, fair=0.0)
    neutral = ["plain1 muslims plain2 plain3.", "plain1 catholics plain2 plain3.", "plain1 plain2 plain3."]
    a, b = toxicity.score_texts(neutral, fair), toxicity.score_texts(neutral, plain)
    logit = lambda s: np.log(s / (1 - s))
    assert abs(logit(a)[0] - logit(a)[1]) < 0.2 * abs(logit(b)[0] - logit(b)[1])
    assert a[0] < b[0] and a[0] < 0.2


def test_swapped_sentences():
    groups = (("cats", "dogs", "birds"),)
    assert toxicity.swaps("Cats run. catsup; No one\nDogs and cats", groups, 99) == [("cats run", "dogs run"), ("cats run", "birds run"), ("dogs and cats", "cats and cats"), ("dogs and cats", "birds and cats"), ("dogs and cats", "dogs and dogs"), ("dogs and cats", "dogs and birds")]
    assert len(toxicity.swaps("cats. dogs.", groups, 3)) == 3 and toxicity.swaps("", groups, 3) == []


def test_toxicity_without_both_classes(spark, toxic_tables):
    docs, labels = toxic_tables
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.where("doc_id = 9001")):
        model = toxicity.train(docs, some)
        s = {r["score"] for r in toxicity.score(docs, model).collect()}
        assert len(s) == 1 and 0 < s.pop() < 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert len(toxicity.train(docs.limit(0), labels).grams) == 0


def test_features_are_counted_plainly():
    texts = ["Moron moron", None, "", "a bc def ghij moronic", "é" * 3]
    grams, owner = toxicity._grams(texts)
    want = Counter()
    for i, t in enumerate(texts):
        for w in re.findall(r"[a-z\u0080-￿]+", (t or "").lower()):
            x = b" " + w.encode() + b" "
            want.update((i, x[j : j + g]) for g in toxicity.GRAMS for j in range(len(x) - g + 1))
    got = Counter((int(o), int(g).to_bytes(8, "little").rstrip(b"\0")) for o, g in zip(owner, grams))
    assert got == want


def test_toxicity_query(spark, sf):
    out = QUERIES["op12_toxicity"](spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.where(~F.col("score").between(0, 1)).count() == 0
