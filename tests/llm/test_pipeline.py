"""Every stage of the pipeline on its own input against plain Python, and the whole of it."""

import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelframe.llm import langid, minhash, packing, tokens
from voxelframe.llm.common import stage, tokenizer_file

MAIL, ADDRESS, SOCIAL = r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+", r"(?<![\w.\-])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
#: Whatever might begin an entity of any kind: a text without it must not change.
SUSPECT = re.compile(r"@|\d[\d.() -]{4}|[=:]\s*[\"']?\S{6}|[A-Z]{2}\d{2}|\b(?:Mr|Mrs|Ms|Miss|Mister|Sir|Herr|Monsieur|Señor|Sr|Don|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Doña|Dr|Prof)\b")


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """documents with texts to reject, repeated rows and columns named like the stages' own."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = " ".join(f"word{i}" for i in range(200))
    odd = [(10**6, None, "en", "s", 0), (10**6 + 1, "123 456", "en", "s", 7), (10**6 + 2, "", None, None, None), (10**6 + 3, "ⴰⴱⴳ" * 20, None, "s", 60),
           (10**6 + 4, near, "en", "s", len(near)), (10**6 + 5, near + " end", "en", "s", len(near) + 4), (10**6 + 6, "write to hello@there.example or 123-45-6789 " + "and so on " * 6000, None, None, None)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.orderBy("doc_id").limit(3))
    for name in ("Lang_Pred", "key", "whole", "Entities", "ids", "k", "salt"):
        rows = rows.withColumn(name, F.lit("own"))
    rows.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def seen(spark, folder):
    """Input of the first stage and the output of each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], folder)))
    for frame in out[1:-1]:
        assert frame.columns == docs.columns
        assert frame.where(" and ".join(f"`{c}` = 'own'" for c in docs.columns[5:])).count() == frame.count()
    return [frame.collect() for frame in out]


def _grams(text):
    b = (" " + re.sub(r"[\x00-@\[-`{-\x7f]", " ", text.lower()) + " ").encode()
    return [b[i : i + 4] for i in range(len(b) - 3) if b"  " not in b[i : i + 4]]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "personal_data", "packing"]


def test_language_id(seen):
    """Texts with a letter and an n-gram of a learned language stay, the others go; rows are what they were."""
    counts = defaultdict(Counter)
    for r in seen[0]:
        if r["lang"] is not None and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts[r["lang"]].update(_grams(r["text"]))
    rates = {k: {g: n / sum(c.values()) for g, n in c.items() if n / sum(c.values()) >= 2e-5} for k, c in counts.items()}
    known = set().union(*rates.values())
    want = [r for r in seen[0] if re.search(r"[^\W\d_]", r["text"] or "") and any(g in known for g in _grams(r["text"]))]
    assert sorted(map(repr, seen[1])) == sorted(map(repr, want))
    assert not {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3} & {r["doc_id"] for r in seen[1]}


def test_near_dedup(seen):
    """The smallest id of every group that links of 0.8 or more join, by comparing all pairs."""
    sets = []
    for r in seen[1]:
        w = re.findall(rb"[^\x20\x09-\x0D]+", r["text"].encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(seen[1]):
        least[find(i)] = min(least.get(find(i), r), r, key=lambda x: x["doc_id"])
    assert sorted(map(repr, seen[2])) == sorted(map(repr, least.values()))
    assert len(seen[2]) < len(seen[1])


def test_personal_data(seen):
    """Every document stays; entities go, equal ones alike and different ones apart; texts without any stay as they are."""
    before, after = ({r["doc_id"]: r for r in rows} for rows in seen[2:4])
    assert len(seen[3]) == len(seen[2]) and set(after) == set(before)
    whole, told = "\0".join(r["text"] for r in after.values()), {}
    for i, r in before.items():
        assert after[i]["n_chars"] == len(after[i]["text"])
        if not SUSPECT.search(r["text"]):
            assert after[i]["text"] == r["text"]
        for pattern in (MAIL, ADDRESS, SOCIAL):
            old, new = re.findall(pattern, r["text"]), re.findall(pattern, after[i]["text"])
            assert len(old) == len(new)
            for a, b in zip(old, new):
                assert a not in whole and told.setdefault(a.lower(), b.lower()) == b.lower()
    assert told and len(set(told.values())) == len(told)


def test_packing(seen):
    """Ids are the library's for the whole text and the end id; sequences are gapless, of at most 2048 ids."""
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in seen[4]:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"]
        pieces[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {r["doc_id"] for r in seen[3]}
    for r in seen[3]:
        want, got = library.encode(r["text"], add_special_tokens=False).ids + [1], []
        for start, ids, total in sorted(pieces[r["doc_id"]]):
            assert start == len(got) and total == len(want)
            got += ids
        assert got == want
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_run(spark, folder, seen):
    """The stages one after another: the same pieces, and every kept document's ids once."""
    shown = ["doc_id", "start", "length", "doc_tokens", "ids"]
    row = lambda r: tuple(bytes(r[c]) if c == "ids" else r[c] for c in shown)
    assert sorted(map(row, corpus_pipeline.run(spark, folder).collect())) == sorted(map(row, seen[4]))


def test_language_id_without_any_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "123 456", None, "s", 7), (10**6 + 2, "", None, None, None)], docs.schema)
    bare = docs.unionByName(odd).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, bare, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()}


def test_empty_tables(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_and_ids_stay_out_of_large_arrow_batches(spark, folder, seen):
    """What a stage returns holds no Python step that takes texts or ids: its writer's Arrow settings are not ours."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert "Arrow" not in plan(kept) and sorted(map(repr, kept.collect())) == sorted(map(repr, seen[1]))
    packed = corpus_pipeline.pack(spark, docs, folder)
    asked = set(re.findall(r"place\((\w+)#\d+L?, (\w+)#\d+L?\)", plan(packed)))
    assert "MapInArrow" not in plan(packed) and asked == {("length", "rank")}


def test_one_set_of_python_workers(spark, folder, monkeypatch):
    """All functions are made for the same environment, and no local rows become Python RDDs: an executor has one daemon."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kind, seen_paths = type(docs), []

    def spy(self, *args, f=kind.mapInArrow, **options):
        seen_paths.append(spark.sparkContext.environment.get("PYTHONPATH"))
        return f(self, *args, **options)

    monkeypatch.setattr(kind, "mapInArrow", spy)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: pytest.fail("local rows"))
    env = spark.sparkContext.environment
    for step in (lambda: corpus_pipeline.language_id(spark, docs, folder), lambda: corpus_pipeline.near_dedup(spark, docs, folder), lambda: packing.pack(docs, tokenizer_file("word_bpe_49k.json"), share=1)):
        monkeypatch.delitem(env, "PYTHONPATH", raising=False)
        assert step().count()
    assert len(seen_paths) >= 5 and len(set(seen_paths)) == 1 and seen_paths[0]


def test_workers_forget_encoders(spark, folder, monkeypatch):
    """A worker that packed and goes on with languages or sketches gives its encoders back; encoding takes 2 MB at a time."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kind, made, path = type(docs), [], tokenizer_file("word_bpe_49k.json")

    def spy(self, f, *args, real=kind.mapInArrow, **options):
        made.append((f, self))
        return real(self, f, *args, **options)

    monkeypatch.setattr(kind, "mapInArrow", spy)
    model = langid.train(docs)
    langid.identify(docs, model)
    minhash.sketch(docs, "doc_id", "text", 5, 60, 5, 7)
    assert len(made) == 3
    for f, frame in made:
        rows = frame.limit(20).toArrow().combine_chunks().to_batches()
        tokens.encoder_of(path)
        assert sum(b.num_rows for b in f(iter(rows))) and not tokens._ENCODERS
    packing.encode_pieces(docs, path, "doc_id", "text", 1, 2048, False)
    sizes = []
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(tokens.Encoder, "encode", lambda self, texts: (sizes.append((len(texts), texts.nbytes)), (np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)))[1])
    batch = pa.record_batch({"id": pa.array(range(2000)), "text": pa.array(["a word " * 600] * 2000)})
    assert sum(b.num_rows for b in made[-1][0](iter([batch]))) == 2000
    assert max(n for n, _ in sizes) <= 600 and max(m for _, m in sizes) <= 3 << 20
