"""Byte-level BPE by a rank file: the tokenizers library encodes Arrow batches, a byte table decodes.

A tokenizers model is made from the ranks: bytes become the printable characters of the usual
byte-to-character table, and every split of a token into two tokens is a merge of the token's rank.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxelframe.llm.common import bounded, col, share_package, unused, without
from voxelframe.llm.tokens import Encoder, byte_characters


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def tokenizer_of(path: str, pattern: str):
    """A tokenizers.Tokenizer with the rank file's tokens; each match of the pattern is encoded alone."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = load_ranks(path), byte_characters()
    name = lambda b: "".join(chars[x] for x in b)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(name(a), name(b)) for a, b in sorted(cuts, key=lambda c: (ranks[c[0]], ranks[c[1]]))]
    t = Tokenizer(models.BPE(vocab={name(b): r for b, r in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


@functools.lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(tokenizer_of(path, pattern))


@functools.lru_cache(maxsize=4)
def _bytes_of(path: str) -> tuple[bytes, ...]:
    ranks = load_ranks(path)
    table = ["�".encode()] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tuple(table)


def character_offsets(text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character that each token touches, given the tokens' byte sizes.

    Tokens that share a split character both count it.
    """
    char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, offsets: bool = False) -> DataFrame:
    """Columns `keep` of docs (default all but the text) with ids_col, and with `starts` and `ends` in characters if asked for.

    Whole texts, no special tokens; a null or empty text has no ids. Columns named like the new ones are replaced.
    """
    share_package(docs.sparkSession)
    new = [ids_col, *(["starts", "ends"] if offsets else [])]
    names = without(keep if keep is not None else without(docs.columns, text_col), *new)
    base = docs.select(*map(col, names), col(text_col).cast("string").alias(*unused(names, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = _encoder(ranks, pattern), np.array([len(b) for b in _bytes_of(ranks)], np.int64)
        for b in bounded(batches):
            ids, n = enc.encode(b.column(len(names)))
            at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            made = [pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32)))]
            if offsets:
                cuts = np.cumsum(n)
                both = [character_offsets((t or "").encode(), table[part]) if len(part) else (part, part) for t, part in zip(b.column(len(names)).to_pylist(), np.split(ids, cuts[:-1]))]
                made += [pa.ListArray.from_arrays(at, pa.array(np.concatenate([x[i] for x in both]).astype(np.int32) if both else [], pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + made, [*names, *new])

    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in new]]))


def decode(docs: DataFrame, ranks: str, ids_col: str = "ids", out_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (default all) with out_col, the bytes of the ids.

    Bytes, not text: a list of ids may begin or end inside a character. text_of() makes text of
    them. Null ids give null, ids outside the table and null elements the replacement character.
    """
    share_package(docs.sparkSession)
    names = without(keep if keep is not None else docs.columns, out_col)
    base = docs.select(*map(col, names), col(ids_col).alias(*unused(names, "ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of(ranks)
        gap, last = "�".encode(), len(_bytes_of(ranks))
        for b in bounded(batches):
            lists = b.column(len(names))
            flat = lists.flatten()
            values = flat.fill_null(-1).to_numpy(zero_copy_only=False)
            if len(values) and (values.min() < 0 or values.max() >= last):
                parts = [table[i] if 0 <= i < last else gap for i in values.tolist()]
            else:
                parts = list(map(table.__getitem__, values.tolist()))
            n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            ends = np.cumsum(n)
            out = [None if null else b"".join(parts[e - k : e]) for e, k, null in zip(ends.tolist(), n.tolist(), lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(out, pa.binary())], [*names, out_col])

    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], T.StructField(out_col, T.BinaryType())]))


def text_of(data: bytes, start_open: bool = False) -> str:
    """Text of decoded bytes; incomplete characters at the ends become replacement characters, or go at an open start."""
    if start_open:
        data = data.lstrip(bytes(range(0x80, 0xC0)))
    return data.decode("utf-8", "replace")
