"""Text operators against the libraries and brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelframe.llm import byte_bpe, chat, langid, minhash, packing, pii, token_files, tokens, url_filter
from voxelframe.llm.common import shared_dir, tokenizer_file

TEXTS = ["Hello  world, it's 12.5 <|endoftext|>!", None, "", " lead and trail ", "a\n b \n c　d\x85e", "ça va déjà 中文 😀 ￼", "x" * 3000 + " " + "word, " * 900, "Hello  world, it's 12.5 <|endoftext|>!", "tab\tand\r\nline"]
SCHEMA = "doc_id long, text string, ids string, cls string, lang string, n_tokens int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", "en", 7) for i, t in enumerate(TEXTS)] + [(None, "no id here", "x", "y", None, None), (3, "same id again", "x", "y", "en", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_byte_bpe(spark, docs):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = byte_bpe.encode(docs.drop("ids"), path, public_tokenizers.PATTERN, offsets=True, keep=["doc_id", "lang"])
    back = byte_bpe.decode(ids, path)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["ids"], bytes(r["decoded"]).decode()) for r in back.collect())
    assert got == sorted(((i if i is not None else -1), enc.encode_ordinary(t or ""), t or "") for i, t in rows_of(docs))
    for r in ids.where("doc_id = 5").collect():
        assert r["starts"][0] == 0 and r["ends"][-1] == len(TEXTS[5]) and all(a < b for a, b in zip(r["starts"], r["ends"]))
    odd = spark.createDataFrame([([0, 99999999, None],), (None,)], "ids array<int>")
    out = [r["decoded"] for r in byte_bpe.decode(odd, path, keep=[]).collect()]
    assert bytes(out[0]).decode().endswith("��") and out[1] is None
    assert byte_bpe.text_of("é".encode()[1:] + b"a", start_open=True) == "a"
    assert byte_bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, docs):
    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    folder = shared_dir(spark)
    manifest = token_files.write(docs, folder, path, frame_ids=64, partitions=3, file_docs=2)
    assert manifest.count() > 3 and manifest.agg(F.max("n_docs")).first()[0] == 2
    want, start = [], 0
    for i, x in sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0)):  # equal ids in the order of the input
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want.append((i if i is not None else -1, start, zlib.crc32(ids)))
        start += len(ids) // 4
    read = lambda df: sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["start"], zlib.crc32(bytes(r["ids"]))) for r in df.collect())
    assert read(token_files.read(spark, folder)) == sorted(want)
    assert read(token_files.read(spark, folder, [6, 2, 77])) == sorted(w for w in want if w[0] in (2, 6))
    assert sum(r["n_ids"] for r in manifest.collect()) == start
    # a damaged frame is found by its checksum
    name = folder.removeprefix("file://") + "/" + manifest.orderBy(F.desc("n_ids")).first()["file"]
    with open(name, "rb") as f:
        data = bytearray(f.read())
    import io

    r = token_files.Reader(io.BytesIO(bytes(data)), len(data))
    r.frames[0] = (r.frames[0][0], r.frames[0][1], r.frames[0][2] ^ 1)
    with pytest.raises(ValueError):
        r.frame(0)
    assert token_files.read(spark, _empty(spark, docs, path)).count() == 0
    frames = by_specification(bytes(data))
    assert b"".join(frames) == b"".join(ids for _, _, ids in token_files.Reader(io.BytesIO(bytes(data)), len(data)).documents())
    assert by_specification(bytes(data), only=0) == frames[:1]


def by_specification(data, only=None):
    """The data frames of a file in the public seekable format, read by nothing but its description."""
    import struct

    import xxhash
    import zstandard

    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    assert magic == 0x8F92EAB1 and descriptor & 0x7C == 0
    entry = 12 if descriptor & 0x80 else 8
    head, size = struct.unpack("<II", data[len(data) - 9 - entry * n - 8 :][:8])
    assert head == 0x184D2A5E and size == entry * n + 9
    at, out = 0, []
    for i in range(n):
        packed, raw, check = struct.unpack("<III", data[len(data) - 9 - entry * (n - i) :][:12])
        if raw and only in (None, i):
            out.append(zstandard.ZstdDecompressor().decompress(data[at : at + packed]))
            assert len(out[-1]) == raw and xxhash.xxh64(out[-1]).intdigest() & 0xFFFFFFFF == check
        at += packed
    assert at == len(data) - 9 - entry * n - 8
    return out


def test_documents_over_several_frames(monkeypatch):
    import io

    monkeypatch.setattr(token_files, "BIG_FRAME", 10)
    made, out = {k: np.arange(k, 2 * k, dtype="<u4").tobytes() for k in (3, 35, 20, 1)}, io.BytesIO()
    w = token_files.Writer(out, 8)
    for k, ids in made.items():
        w.add(k, ids)
    w.close()
    r = token_files.Reader(out, out.tell())
    assert {k: ids for _, k, ids in r.documents()} == made and {k: ids for _, k, ids in r.documents({35, 1})} == {k: made[k] for k in (35, 1)}
    assert b"".join(by_specification(out.getvalue())) == b"".join(made.values())


def _empty(spark, docs, path):
    folder = shared_dir(spark)
    token_files.write(docs.limit(0), folder, path)
    return folder


def test_packing(spark, docs):
    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    packed = packing.pack(docs, path, capacity=128, share=1)
    p = packed.toPandas()
    whole = {}
    for (i, start), ids in zip(zip(p["doc_id"], p["start"]), p["ids"]):
        whole.setdefault(None if i != i else int(i), []).append((start, bytes(ids)))
    want = {}
    for i, x in rows_of(docs):
        want.setdefault(i, []).append(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    for i, texts in want.items():
        assert sum(len(b) for _, b in whole[i]) == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(b for _, b in sorted(whole[i])) == texts[0]
    assert (p["length"] <= 128).all() and p["ids"].map(len).sum() == 4 * p["length"].sum()
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() == g["filled"].iat[0] <= 128
    lengths = sorted(len(bytes(r["ids"])) // 4 for r in packing.sequences(packed).collect())
    assert lengths == sorted(p.groupby("sequence_id")["length"].sum())
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_of_a_frequent_length_over_several_tasks(spark):
    """Repeated rows, null ids and one length for nearly all."""
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.lit(5)).alias("doc_id"), F.when(F.col("id") < 880, F.lit("one two three")).alias("text"))
    p = packing.pack(df, tokenizer_file("word_bpe_49k.json"), capacity=16, share=50).toPandas()
    assert len(p) == 900 and not p.duplicated(["sequence_id", "offset"]).any()
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() == g["filled"].iat[0] <= 16
    assert p["sequence_id"].nunique() <= 225
    other = packing.pack(df.withColumnRenamed("doc_id", "row"), tokenizer_file("word_bpe_49k.json"), "row", capacity=16, share=50)
    assert other.columns[0] == "row" and other.count() == 900


PARTS = ["a", "the", "The", "s", "t", "re", "'", "'", " ", " ", "\n", "  ", "\t", "\r\n", "1", "23", "é", "É", "ß", "İ", "ı", "ñ", "×", "Σ", "ς", "ж", "Я", "中", "한", "😀", "\u0301", "\u0307", "\u030c", "J", "I", "\u00a0", "\u0085", "\u3000", "\u2028", "\x1c", "\x00",
         "<|endoftext|>", "<|startoftext|>", "<|", "...", ",", "-", "$", "µ", "²", "ª", "ǅ", "ŉ", "Ⱥ", "Ə", "҂", "अ", "ा", "ไ", "it's", "BELEDİYESİ,", "’s", "“"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
@pytest.mark.parametrize("as_text", [False, True])
def test_encoder_against_the_library(name, as_text, monkeypatch):
    """Random strings of letters, signs, white space and control strings, in batches cut at several sizes."""
    import pyarrow as pa

    path = tokenizer_file(name)
    load = lambda: Tokenizer.from_file(path) if name.endswith("json") else byte_bpe.tokenizer_of(path, public_tokenizers.PATTERN)
    r = np.random.default_rng(3)
    texts = [None, "", "İ,", "a <|endoftext|> b"] + ["".join(r.choice(PARTS, r.integers(1, 20))) for _ in range(3000)] + ["".join(r.choice(["word", "İ", "é", " ", " ", "\n", ","], 4000)) for _ in range(2)]
    plain, encoder = load(), tokens.Encoder(load(), as_text, kept=500)
    plain.encode_special_tokens = as_text
    want = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoder.style == ("word" if name.startswith("word") else "byte")
    for stride in (4 << 20, 700):
        monkeypatch.setattr(tokens, "STRIDE", stride)
        ids, n = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_encoder_of_an_unknown_tokenizer():
    import pyarrow as pa
    from tokenizers import pre_tokenizers

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Whitespace(), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    want = t.encode("a b, c'd", add_special_tokens=False).ids
    e = tokens.Encoder(t)
    assert e.style is None and e.encode(pa.array(["a b, c'd"]))[0].tolist() == want


def test_packing_patterns_use_every_piece():
    r = np.random.default_rng(0)
    hist = {int(k): int(v) for k, v in zip(*np.unique(np.minimum(2048, r.geometric(1 / 600, 5000)), return_counts=True))}
    found = packing.patterns(hist, 2048)
    used = {}
    for pattern, n in found:
        assert sum(pattern) <= 2048
        for k in pattern:
            used[k] = used.get(k, 0) + n
    assert used == hist and len(found) <= 2 * len(hist) + 1
    assert sum(2048 * n for _, n in found) < 1.01 * sum(k * v for k, v in hist.items())
    s = packing.slots(found)
    spots = {(q + j, o) for (p, n), q in zip(found, np.cumsum([0, *[n for _, n in found]])) for j in range(n) for o in np.cumsum([0, *p[:-1]])}
    got = set()
    for k, v in hist.items():
        rank = np.arange(v)
        at = np.searchsorted(s["key"], k << 44 | rank, "right") - 1
        got |= set(zip((s["sequence"][at] + rank - s["rank"][at]).tolist(), s["offset"][at].tolist()))
    assert got == spots


def test_packing_of_a_dominating_length():
    r = np.random.default_rng(1)
    mixed = {int(k): int(v) for k, v in zip(*np.unique(r.integers(20, 2001, 10000), return_counts=True))}
    for hist, spare in (({300: 10000}, 1.15), (mixed | {150: mixed.get(150, 0) + 5000}, 1.01), (mixed | {150: mixed.get(150, 0) + 60000}, 1.04), ({1: 5000}, 1.25), ({2048: 7, 1024: 5}, 1.06)):
        found = packing.patterns(hist, 2048)
        used = {}
        for pattern, n in found:
            assert n > 0 and sum(pattern) <= 2048
            for k in pattern:
                used[k] = used.get(k, 0) + n
        assert used == hist and len(found) <= 3 * len(hist)
        assert 2048 * sum(n for _, n in found) < spare * sum(k * v for k, v in hist.items())
    assert sorted(packing.patterns({300: 10000}, 2048)) == [((300,) * 4, 1), ((300,) * 6, 1666)]


def test_minhash_against_brute_force(spark):
    r = np.random.default_rng(5)
    texts = []
    for _ in range(3):
        base = [f"w{i}" for i in r.integers(0, 400, 60)]
        for _ in range(40):
            x = list(base)
            for k in r.integers(0, 60, r.integers(0, 4)):
                x[k] = f"w{r.integers(0, 400)}"
            texts.append(" ".join(x))
    texts += ["", None, "a b c", "A B  C", "one", texts[0], texts[1].upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (5, texts[9])]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, cls string")

    def sets(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s, root = [sets(t) for _, t in rows], list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    n = lambda x: -1 if x is None else x
    want = sorted((n(d), len(s[i]), n(low.get(find(i)))) for i, (d, _) in enumerate(rows))
    for options in ({}, {"small": 0, "block": 7}):
        got = minhash.near_duplicates(df, percent=80, **options).collect()
        assert sorted((n(x["doc_id"]), x["n_shingles"], n(x["component_id"])) for x in got) == want
        assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    kept = [x["doc_id"] for x in minhash.deduplicate(df).collect()]
    groups = {c for _, k, c in want if k}
    assert len(kept) == len(groups) + sum(1 for _, k, _ in want if not k)
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.deduplicate(df.limit(0)).count() == 0


def test_many_rows_of_one_id(spark):
    """600 texts under one id and 300 copies of one of them under none: one row for each class, no pairs."""
    text = F.concat(F.lit("w"), F.col("id"), F.lit(" x"), (F.col("id") * 7) % 601, F.lit(" a b c d e f g"))
    df = spark.range(900).select(F.when(F.col("id") < 600, F.lit(4).cast("long")).alias("doc_id"), F.when(F.col("id") < 600, text).otherwise(F.lit("w1 x7 a b c d e f g")).alias("text"), F.lit("k").alias("Whole"))
    got = minhash.near_duplicates(df)
    assert got.count() == 900 and got.where("n_shingles = 5 and component_id = 4").count() == 900
    one = minhash.deduplicate(df.withColumn("key", F.lit("c")))
    assert one.columns == ["doc_id", "text", "Whole", "key"] and one.count() == 600


def test_signature_estimates_similarity():
    a, b = minhash._permutations(200, 1)
    x, y = np.arange(1000, dtype=np.uint64) * np.uint64(7919), np.arange(200, 1200, dtype=np.uint64) * np.uint64(7919)
    mix = minhash._mix
    assert abs((minhash.signature(mix(x), a, b) == minhash.signature(mix(y), a, b)).mean() - 800 / 1200) < 0.1


def test_language_id(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = langid.train(d.where(~held), key=F.col("doc_id"))
    p = langid.identify(d.where(held), model).toPandas()
    assert (p["lang"] == p["lang_pred"]).mean() > 0.97 and p["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !!!", "q"), (4, "ж" * 50, "q"), (5, "the and of that with the " * 4000, "q"), (5, "the and of that with the " * 4000, "q")], "doc_id int, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.languages and got[5][0] == "en"
    assert langid.identify(odd.limit(0), model).count() == 0
    clash = langid.identify(odd.toDF("doc_id", "text", "Lang_Pred").withColumn("judged", F.lit("j")), model)
    assert clash.columns == ["doc_id", "text", "judged", "lang_pred", "score"] and clash.count() == 6
    none = langid.train(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_language_id_against_counting(spark, sf):
    """n-gram sets counted in plain Python, looked up exactly: the same languages, and scores as close as the filter's correction."""
    from collections import Counter

    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    rows, model = d.collect(), langid.train(d, key=F.col("doc_id"), max_docs=10**9)

    def grams(text):
        b = " " + re.sub(r"[\x00-@\[-`{-\x7f]", " ", text.lower()) + " "
        b = b.encode()
        return [b[i : i + 4] for i in range(len(b) - 3) if b"  " not in b[i : i + 4]]

    counts = {}
    for r in rows:
        counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    rates = {k: {g: n / sum(c.values()) for g, n in c.items() if n / sum(c.values()) >= 2e-5} for k, c in counts.items() if k is not None}
    top = Counter()
    for c in rates.values():
        top |= Counter(c)
    sets = {k: {g for g, x in c.items() if x >= 0.3 * top[g]} for k, c in rates.items()}
    assert model.languages == tuple(sorted(sets))
    got = {r["doc_id"]: r for r in langid.identify(d, model).collect()}
    differ = 0
    for r in rows:
        found = {k: sum(g in s for g in grams(r["text"])) for k, s in sets.items()}
        total = sum(found.values())
        if total < 20:
            continue
        differ += got[r["doc_id"]]["lang_pred"] != max(sorted(found), key=found.get)
        assert abs(got[r["doc_id"]]["score"] - max(found.values()) / total) < 0.1
    assert differ <= len(rows) // 200


def test_language_id_beyond_64_languages(spark):
    words = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in "qwerty uiop asdf".split())
    df = spark.createDataFrame([(i, words(i) + " " + words(i), f"l{i:03d}") for i in range(150)], "doc_id int, text string, lang string")
    model = langid.train(df)
    assert model.slices.shape == (3, 1 << 19)
    p = langid.identify(df, model).toPandas()
    assert (p["lang"] == p["lang_pred"]).mean() > 0.95


def test_surrogates(spark):
    text = "Mr. John Smith met Mrs. Jane Doe and Mr. John Smith. IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789, card 4111 1111 1111 1111 or 4111-1111-1111-1111, 10.1.2.3 +44 20 7946 0958 (212) 555-1234 api_key: abcd1234efgh5678ijkl A.B@X.COM a.b@x.com"
    rows = [(1, text, "e"), (2, None, "e"), (3, "", "e"), (4, "nothing 1234567890123456 at all 12.30 2024-01-02 v1.2.3.4", "e"), (5, text, "e"), (6, "mail " + "w " * 50000 + "x@y.org", "e"), (7, "ask x@y.org", "e")]
    df = spark.createDataFrame(rows, "doc_id int, text string, entities string")
    got = {r["doc_id"]: r for r in pii.pseudonymize(df, "key").collect()}
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == rows[3][1] and got[4]["entities"] == []
    assert got[1]["text"] == got[5]["text"] and len(got[1]["text"]) >= 100
    for value in ("John", "Smith", "Jane", "Doe", "3704", "123-45-6789", "4111 1111", "4111-1111", "7946", "555-1234", "abcd1234", "A.B@", "a.b@"):
        assert value not in got[1]["text"]
    s = [(e["kind"], e["surrogate"]) for e in got[1]["entities"]]
    kinds = [k for k, _ in s]
    assert kinds == ["name", "name", "name", "iban", "ssn", "card", "card", "ip", "phone", "phone", "secret", "email", "email"]
    assert s[0] == s[2] and s[0] != s[1] and s[0][1].startswith("Mr. ") and s[1][1].startswith("Mrs. ")
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(s[5][1]) == digits(s[6][1]) and s[5][1][4] == " " and s[6][1][4] == "-" and s[7][1].startswith("10.")
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits(s[5][1])))))
    assert total % 10 == 0
    bare = s[3][1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    assert s[11][1] == s[12][1].upper() and got[7]["text"] == "ask " + got[6]["text"].rsplit(" ", 1)[1]
    assert got[6]["text"].count("w ") == 50000
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymize(df, "another").collect()}
    assert other[1] != got[1]["text"] and pii.pseudonymize(df.limit(0), "key").count() == 0


def test_surrogates_stay_distinct(spark):
    """Two-digit local parts leave little room: clashes are drawn again."""
    df = spark.range(80).select(F.col("id"), F.concat(F.lit("mail "), F.lpad(F.col("id").cast("string"), 2, "0"), F.lit("@1.de now")).alias("text"))
    out = [r["text"] for r in pii.pseudonymize(df, "key").collect()]
    assert len(set(out)) == 80 and not set(out) & {r["text"] for r in df.collect()}


def test_cards_beside_other_numbers(spark):
    one, two, ip, ssn = "4845168114407329", "4111 1111 1111 1111", "169.122.221.182", "123-45-6789"
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(one)))) % 10 == 0
    cases = {f"{one} {ip}": ["card", "ip"], f"{one} {ssn}": ["card", "ssn"], f"{two} 123": ["card"], f"{two} 4012 8888 8888 1881": ["card", "card"], f"{two} {ip}": ["card", "ip"], f"{two}-{ssn}": ["card"],
             f"{two} {ssn}": ["card", "ssn"], f"{one} {one}": ["card", "card"], f"3782 822463 10005 {two} 12": ["card", "card"], f"4111111111111112 {ip}": ["ip"], f"4111 1111 1111 1112 {ssn}": ["ssn"],
             "4111-1111 1111-1111": ["card"], "4000 1234 4111 1111 1111 1111": ["card"], "4111111111111111222": [], f"12/26 {two}, {one}.": ["card", "card"]}
    got = {r["case"]: r for r in pii.pseudonymize(spark.createDataFrame([(c, c) for c in cases], "case string, text string"), "key").collect()}
    for case, kinds in cases.items():
        assert [e["kind"] for e in got[case]["entities"]] == kinds, case
        assert len(got[case]["text"]) == len(case) or "ip" in kinds
        for value in (one, two, "8888 1881", ip) + (() if "-1" in case[:21] else (ssn,)):
            assert value not in got[case]["text"], case
    assert got[f"{two} 123"]["text"].endswith(" 123") and got["4111111111111111222"]["text"] == "4111111111111111222"


def test_secrets_of_any_length(spark):
    long, jwt, huge = "Ab3dE6gh" * 30, "a1B2" * 9 + "." + "c3D4" * 50 + "." + "e5F6" * 10 + "xyz", "Zx9" * 20000
    cases = {f'token = "{long}"': long, f"token={jwt} end": jwt, f"api_key: {huge}": huge, "password = hunter2abc": "hunter2abc", 'pwd: "p@ss!w0rd#x"': "p@ss!w0rd#x", "{'passwd': 'q@w.e!r'}": "q@w.e!r",
             "my password: hunter2abc, then": "hunter2abc", "password=4111111111111112": "4111111111111112", "PASSWORD = +12ab(cd": "+12ab(cd", "password: ********": "********", "pwd=пароль1": "пароль1"}
    same = ["password: abc", "token = abcdef", "no password at all", "pwd: x y z"]
    got = {r["case"]: r for r in pii.pseudonymize(spark.createDataFrame([(c, c) for c in [*cases, *same]], "case string, text string"), "key").collect()}
    for case, value in cases.items():
        before, after = case.split(value)
        text = got[case]["text"]
        assert [e["kind"] for e in got[case]["entities"]] == ["secret"] and text.startswith(before) and text.endswith(after) and len(text) == len(case), case[:60]
        new = text[len(before) : len(text) - len(after)]
        assert new != value and new[-8:] != value[-8:] and new[:8] != value[:8], case[:60]
    assert all(got[c]["text"] == c and got[c]["entities"] == [] for c in same)
    assert len({got[c]["entities"][0]["surrogate"] for c in ("password = hunter2abc", "my password: hunter2abc, then")}) == 1


def test_crowded_private_addresses_settle(spark):
    """Every 192.168 address is itself in the corpus: each one's surrogate is then another of them."""
    canon = F.concat(F.lit("192.168."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string"))
    some = spark.createDataFrame([("ip", x) for x in ("172.16.5.9", "172.15.5.9", "169.254.1.1", "10.1.1.1", "8.8.8.8", "127.0.0.1", "192.167.1.1", "230.1.2.3", "0.0.0.0")], "kind string, canon string")
    out = pii._resolve(spark.range(1 << 16).select(F.lit("ip").alias("kind"), canon.alias("canon")).unionByName(some), "key", 2).toPandas()
    assert len(out) == (1 << 16) + 9 == out["surrogate"].nunique()
    assert (out["canon"].str.startswith("192.168.") == out["surrogate"].str.startswith("192.168.")).all() and (out["canon"] != out["surrogate"]).mean() > 0.99
    got = dict(zip(out["canon"], out["surrogate"]))
    assert 16 <= int(got["172.16.5.9"].split(".")[1]) < 32 and got["172.16.5.9"].startswith("172.") and got["169.254.1.1"].startswith("169.254.") and got["10.1.1.1"].startswith("10.") and got["127.0.0.1"].startswith("127.") and got["230.1.2.3"].startswith("230.")
    assert not any(re.match(r"(0|10|127|169\.254|172\.(1[6-9]|2\d|3[01])|192\.168|22[4-9]|2[345]\d)\.", got[x]) for x in ("172.15.5.9", "8.8.8.8", "192.167.1.1"))


def feistel(numbers, seed, xxh):
    """The permutation once more, in plain Python; xxh hashes a string and an int as Spark does."""
    v = [list(x) for x in numbers]
    for turn in range(4):
        rest = ",".join(str(x[1]) for i, x in enumerate(v) if i % 2 != turn % 2)
        digest = hashlib.sha256("\u0001".join([seed, str(turn), rest]).encode()).hexdigest()
        v = [(n, (x + xxh(digest, i) % n) % n) if i % 2 == turn % 2 else (n, x) for i, (n, x) in enumerate(v)]
    return [x for _, x in v]


def test_permutation_against_plain_python(spark):
    import xxhash

    def spark_hash(text, number):  # 64-bit hash of the string seeds that of the int
        seed = xxhash.xxh64(text.encode(), seed=42).intdigest()
        return (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(int(number).to_bytes(4, "little", signed=True), seed=seed).intdigest())

    numbers = [[(10, 3), (26, 25), (10, 0), (256, 17)], [(2, 1)], [(10, 9)] * 9]
    df = spark.createDataFrame([([dict(n=n, v=v) for n, v in x],) for x in numbers], "x array<struct<n:int,v:int>>")
    got = [[y["v"] for y in r[0]] for r in df.select(pii._permuted(F.col("x"), F.lit("seed"))).collect()]
    assert got == [feistel(x, "seed", spark_hash) for x in numbers]
    small = spark.range(1000).select(F.array(*[F.struct(F.lit(10).alias("n"), F.floor(F.col("id") / 10**k % 10).cast("int").alias("v")) for k in range(3)]).alias("x"))
    assert small.select(pii._permuted(F.col("x"), F.lit("s")).alias("y")).distinct().count() == 1000  # a permutation


def test_surrogates_of_other_scripts(spark):
    cases = {"mail 사용자@예시.한국 now": r"mail [가-힣]{3}@[가-힣]{2}\.한국 now", "Dr Παπαδόπουλος": r"Dr \p{Greek}{12}", "Dr. 田中": r"Dr\. \p{Han}{2}", "an łąka@żółw.pl": r"an \p{Ll}{4}@\p{Ll}{4}\.pl", "מייל שלום@דוגמה.co": r"מייל \p{Hebrew}{4}@\p{Hebrew}{5}\.co",
             "Herr Jan van der Berg sagt": r"Herr \p{Lu}\p{Ll}+ van der \p{Lu}\p{Ll}+ sagt", "г-жа Анна Иванова": r"г-жа \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+ова", "x მაია@თბილისი.ge": r"x \p{L}{4}@\p{L}{7}\.ge", "Mr. Ivan 😀": r"Mr\. \p{Lu}\p{Ll}+ 😀"}
    df = spark.createDataFrame([(c, c, "mine", "old") for c in cases], "case string, text string, k string, Entities string")
    out = pii.pseudonymize(df, "key")
    assert out.columns == ["case", "text", "k", "entities"]
    import regex

    for r in out.collect():
        assert r["k"] == "mine" and r["text"] != r["case"] and regex.fullmatch(cases[r["case"]], r["text"]) and len(r["entities"]) == 1, r


def test_surrogates_of_hot_texts_and_entities(spark, monkeypatch):
    """Copies of one text, and one entity in all texts, dealt to several tasks: the same rows as without."""
    from voxelframe.llm import common

    text = F.when(F.col("id") < 300, "call a.b@c.de now").otherwise(F.concat(F.lit("ask a.b@c.de or x"), F.col("id"), F.lit("@y.org")))
    df = spark.range(600).select("id", text.alias("text"))
    plain = {r["id"]: r["text"] for r in pii.pseudonymize(df, "key").collect()}
    monkeypatch.setattr(common.hot_keys, "__defaults__", ("n", 1000, 50))
    salted = {r["id"]: r["text"] for r in pii.pseudonymize(df, "key").collect()}
    assert plain == salted and len(set(plain.values())) == 301 and len({t.split()[1] for t in plain.values()}) == 1


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", said), (1, 2, "assistant", said + " <\\|x \\"), (1, 3, "us\\er\nq", None), (1, 4, "assistant", "b" * 900), (1, 5, "user", "c " * 60), (1, 6, "assistant", "d " * 60), (1, 7, "user", "e"), (1, 8, "assistant", "é" * 200),
            (2, 0, "user", ""), (2, 0, "assistant", None), (None, None, None, "lost"), (3, 5, "assistant", "x"), (3, 5, "assistant", "x")]
    df = spark.createDataFrame([(*r, "w") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.windows(df, budget=150, history=40)
    got = {r["conv_id"]: r for r in chat.digest(windows).collect()}
    for c in (1, 2, 3, None):
        turns = sorted([(t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    w = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(w) > 3 and all(x["text"].startswith("<|im_start|>system\nbe kind<|im_end|>\n") for x in w)
    assert all(x["n_tokens"] <= 150 or x["n_turns"] - x["n_repeated"] == 1 for x in w) and any(x["n_repeated"] > 1 for x in w)
    assert chat.digest(chat.windows(df.limit(0))).count() == 0
    own = df.withColumn("k", F.lit(100))
    assert chat.windows(own, budget=150, history=40, tokens="k").where("conv_id = 1").count() == 9


def test_chat_windows_keep_the_budget(spark):
    """Long system turns and long turns: over the budget only where one turn and the system turn are."""
    r = np.random.default_rng(8)
    rows = [(c, t, "system" if t == 0 and c % 4 else "user" if t % 2 else "assistant", int(k)) for c in range(60) for t, k in enumerate([r.choice([5, 60, 120, 170, 190, 230]), *r.choice([3, 10, 40, 90, 150, 210], 14)])]
    df = spark.createDataFrame([(c, t, role, f"{c} {t}", k) for c, t, role, k in rows], "conv_id int, turn int, role string, text string, k int")
    size = {(c, t): k for c, t, _, k in rows}
    repeated = 0
    for w in chat.windows(df, budget=200, history=50, tokens="k").withColumn("turns", chat.read_turns(F.col("text"))).collect():
        turns = [tuple(map(int, t["text"].split())) for t in w["turns"]]
        head = size[w["conv_id"], 0] if w["conv_id"] % 4 else 0
        assert w["n_tokens"] == sum(size[t] for t in turns) and len(turns) == len(set(turns)) == w["n_turns"]
        new = [t for t in turns[w["n_repeated"] :] if t[1] or not head]
        assert w["n_tokens"] <= 200 or len(new) <= 1 and (size[new[0]] if new else 0) + head > 200 and w["n_repeated"] <= 1
        repeated += w["n_repeated"] > (head > 0)
    assert repeated  # the case is not vacuous


def test_url_filter(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("tie.org", "/", "allow"), ("tie.org", "/", "block"), (None, "/", "block"), ("z.tie.com", "/", "allow"), ("tie.com", "/ab", "block")], "host string, path string, verdict string")
    blocked = spark.createDataFrame([("spam.com",), (None,)], "host string")
    urls = ["http://a.example.net/en/1?q", "https://NET/x", "http://x.net", "http://example.com/de/", "http://notexample.com/de/", "http://a.org/fr/x#y", "http://m.spam.com", "http://ok.com/", None, "no scheme", "", "http://tie.org/a", "://net/", "http://" + "a." * 3000 + "net/", "http://x.net/", "http://z.tie.com/ab"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, urls[0], "old")], "page_id int, url string, verdict string")
    out = url_filter.judge(pages, rules, blocked, keep=["page_id"])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(urls) + 1
    assert got == {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: (None, "allow"), 3: ("example.com/de/", "block"), 4: (None, "allow"), 5: ("org/fr/", "allow"), 6: (None, "block"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: ("tie.org/", "block"), 12: ("net/", "block"), 13: ("net/", "block"), 14: ("net/", "block"), 15: ("tie.com/ab", "block")}
    clash = url_filter.judge(pages.toDF("page_id", "url", "Host").withColumn("keys", F.lit("k")), rules, blocked)
    assert clash.columns == ["page_id", "url", "keys", "host", "path", "rule", "verdict"] and {r["keys"] for r in clash.collect()} == {"k"}
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0), None).collect()} == {"allow"} and url_filter.judge(pages.limit(0), rules, blocked).count() == 0


def test_cascade_is_exact_even_when_full(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 3)
    universe = spark.range(4000).select(F.md5(F.col("id").cast("string")).alias("key"))
    listed = universe.where("key < '3'")
    c = url_filter.Cascade(universe, listed)
    assert len(c.levels) > 2 and universe.where(c.contains(F.col("key")) != F.expr("key < '3'")).count() == 0


def surrogated(spark, texts, key="key"):
    return {r["case"]: (r["text"], [e["kind"] for e in r["entities"]]) for r in pii.pseudonymize(spark.createDataFrame([(c, c) for c in texts], "case string, text string"), key).collect()}


def test_names_of_one_family_stay_distinct(spark):
    given = [f"{a}{b}" for a in ("Ab", "Be", "Ci", "Do", "Eu", "Fa", "Ge", "Hi", "Jo", "Ku") for b in ("dan", "lin", "mar", "nor", "pel", "ras", "sim", "tor", "vin", "wes", "xan", "yor", "zel", "bek", "cor", "dul", "fen", "gil", "hal", "jun")]
    texts = [f"Hello Mr {g} Smith is here" for g in given] + [f"Hello Mr {g} Jones is here" for g in given[:8]]
    got = surrogated(spark, texts)
    new = {t: re.fullmatch(r"Hello Mr (\S+) (\S+) is here", got[t][0]).groups() for t in texts}
    assert len(set(new.values())) == 208 and len({g for g, _ in new.values()}) == 200 and len({f for _, f in new.values()}) == 2
    assert not {g for g, _ in new.values()} & set(given)
    for g in given[:8]:  # a given name is one surrogate in every family
        assert new[f"Hello Mr {g} Smith is here"][0] == new[f"Hello Mr {g} Jones is here"][0]


def test_names_are_one_person_whatever_the_title(spark):
    text = "Mr John Smith met Dr John Smith. Later John Smith and Smith left in Mr Smith's car; Smithson stayed. Mrs O'Brien-Lee saw James."
    new, kinds = surrogated(spark, [text])[text]
    m = re.fullmatch(r"Mr (\w+) (\w+) met Dr (\w+) (\w+)\. Later (\w+) (\w+) and (\w+) left in Mr (\w+)'s car; Smithson stayed\. Mrs (\w+) saw James\.", new)
    assert m and len({m[1], m[3], m[5]}) == 1 == len({m[2], m[4], m[6], m[7], m[8]}) and m[9] != m[2] and kinds == ["name"] * 6
    assert not {"John", "Smith"} & set(re.findall(r"\w+", new))


def test_ibans_end_where_their_country_says(spark):
    ok = {"AT611904300234573201 EUR 500": "AT611904300234573201", "AT61 1904 3002 3457 3201 EURO now": "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034 BIC GKCC": "BE68 5390 0754 7034", "to NO93 8601 1117 947.": "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32 X": "GB82 WEST 1234 5698 7654 32"}
    same = ["AA12BB34CC56", "AT61 1904 3002 3457 3202 EURO", "DE00123456781234567812"]
    got = surrogated(spark, [*ok, *same, *[f"{x} a@b.org" for x in same]])
    for text, iban in ok.items():
        new = got[text][0]
        before, after = text.split(iban)
        own = new[len(before) : len(new) - len(after)]
        bare = own.replace(" ", "")
        assert got[text][1] == ["iban"] and own != iban and own[:2] == iban[:2] and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    for text in same:
        assert got[text] == (text, []) and got[f"{text} a@b.org"][0].startswith(text + " ") and got[f"{text} a@b.org"][1] == ["email"]
    secret = 'token: "AT61190430023457320200"'
    assert surrogated(spark, [secret])[secret][1] == ["secret"]


def test_quoted_secrets_go_to_their_quote(spark):
    cases = {'password: "correct horse battery"': "correct horse battery", 'token: "abcdefgh ijklmnopqrst"': "abcdefgh ijklmnopqrst", "{'api_key': 'ab cd ef gh'}": "ab cd ef gh", 'pwd = "Mr Smith 12"': "Mr Smith 12"}
    got = surrogated(spark, [*cases, 'password: "abc"', 'token: ""'])
    for text, value in cases.items():
        before, after = text.split(value)
        new, kinds = got[text]
        assert kinds == ["secret"] and new.startswith(before) and new.endswith(after) and not set(re.findall(r"\w{3,}", value)) & set(re.findall(r"\w+", new[len(before) : len(new) - len(after)]))
    assert got['password: "abc"'] == ('password: "abc"', []) and got['token: ""'] == ('token: ""', [])


def test_calling_codes_stay_whole(spark):
    for text, code in (("+49 30 1234567", "+49 "), ("+1 212 555 0143", "+1 "), ("+353 20 912 3456", "+353 "), ("+7 495 123 4567", "+7 ")):
        new, kinds = surrogated(spark, [text])[text]
        assert kinds == ["phone"] and new.startswith(code) and new != text and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)


def test_the_quick_scan_changes_no_result(spark, monkeypatch):
    texts = ["Mr Bo Li", "a@b.co", "1.2.3.4", "+1 (23) 456-789", "(212) 555-1234", "123-45-6789", "4111 1111 1111 1111", "NO9386011117947", 'pwd: "a b c d"', "secret = abcdefghijklmnop", "passwd=abcdef", "token: 'ab cd ef'", "AA12BB34CC56", "Dr. 田中", "nothing", "x = y", "г-н Ив", "password: abc", "api-key:\n\"abc def\""]
    quick = surrogated(spark, texts)
    monkeypatch.setattr(pii, "_maybe", lambda text: F.coalesce(F.length(text) >= 0, F.lit(False)))
    assert quick == surrogated(spark, texts)
