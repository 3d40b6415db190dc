"""Whole texts to token ids with the tokenizers library, an Arrow batch at a time.

The pre-tokenizers used here cut a text where the kind of character changes: letters, digits, signs,
white space. For characters whose kind is certain (ASCII, Latin and Cyrillic letters) a batch is cut
there in numpy, equal pieces are encoded once, and the ids are gathered. A piece of one kind is one
word of the library's model; any other piece, such as one with other scripts, goes through the whole
tokenizer. A bounded table keeps the pieces seen before by this worker. Texts whose white space or
control strings need their context, and texts for any other pre-tokenizer, are encoded whole.
Results equal those of encoding each text alone.
"""

from __future__ import annotations

import ctypes
import json
import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beyond ASCII, and separators that some engines count as such.
WIDE_BLANK = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}\x{180E}]"
#: The patterns of the two pre-tokenizers whose cuts are known; fixed values.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of characters; OTHER is left to the library together with all that it touches.
WHITE, LETTER, NUMBER, SIGN, OTHER = range(5)
KIND = np.array([WHITE if b in b"\t\n\v\f\r " else LETTER if chr(b).isalpha() and b < 128 else NUMBER if 48 <= b < 58 else SIGN if 32 < b < 127 else OTHER for b in range(256)], np.uint8)
#: First bytes of two-byte letters: U+00C0 to U+023F and U+0400 to U+047F, but for the characters in NO_LETTER.
LEAD = np.isin(np.arange(256), [*range(0xC3, 0xC9), 0xD0, 0xD1])
NO_LETTER = [int.from_bytes(c.encode(), "big") for c in "×÷İ"]
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes that are cut and looked up at a time.
STRIDE = 4 << 20


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices `which` of flat; also their sizes."""
    n = sizes[which]
    total = int(n.sum())
    ends = np.cumsum(n)
    at = np.arange(total, dtype=np.int64) + np.repeat(starts[which] - (ends - n), n)
    return flat[at], n


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 belongs to."""
    out = KIND[data]
    lead = np.flatnonzero(LEAD[data])
    if len(lead):
        lead = lead[~np.isin(data[lead].astype(np.int64) << 8 | data[lead + 1], NO_LETTER)]
        out[lead] = out[lead + 1] = LETTER
    return out


def cut(data: np.ndarray, heads: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """First byte and kind of every piece of texts that begin at the bytes `heads`.

    Runs of one kind are pieces. A run that touches OTHER characters becomes one piece with all that
    stands between the same two stretches of white space; so does an apostrophe with letters after
    it, for it may be a contraction. spaced: a space belongs to the piece after it, and the last of
    several white characters stands alone.
    """
    c = kinds(data)
    edge = np.empty(len(c), bool)
    edge[:1] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:])
    edge[heads] = True
    at = np.flatnonzero(edge)
    kind, fresh = c[at], np.zeros(len(at), bool)
    fresh[np.searchsorted(at, heads)] = True
    if (kind == OTHER).any():
        first = (kind == WHITE) | fresh
        first[1:] |= kind[:-1] == WHITE
        block = np.cumsum(first) - 1
        mixed = np.zeros(block[-1] + 1, bool)
        mixed[block[kind == OTHER]] = True
        kind[mixed[block]] = OTHER
        keep = first | ~mixed[block]
        at, kind, fresh = at[keep], kind[keep], fresh[keep]
    size = np.diff(at, append=len(c))
    quote = np.flatnonzero((kind[:-1] == SIGN) & (size[:-1] == 1) & (data[at[:-1]] == 39) & (kind[1:] == LETTER) & ~fresh[1:])
    if len(quote):
        kind[quote] = OTHER
        keep = np.ones(len(at), bool)
        keep[quote + 1] = False
        at, kind, fresh = at[keep], kind[keep], fresh[keep]
    if spaced:
        gap = np.flatnonzero((kind[:-1] == WHITE) & ~fresh[1:])
        ends = at[gap + 1]
        space, long = data[ends - 1] == 32, ends - at[gap] > 1
        extra = ends[~space & long] - 1
        at[gap[space] + 1] -= 1
        keep = np.ones(len(at), bool)
        keep[gap[space & ~long]] = False
        at, kind = at[keep], kind[keep]
        if len(extra):
            where = np.searchsorted(at, extra)
            at, kind = np.insert(at, where, extra), np.insert(kind, where, WHITE)
    return at, kind


def _style(tokenizer) -> str | None:
    """byte: spaces belong to words; word: lower case, white space dropped; None: cuts are not known."""
    parts = json.loads(tokenizer.to_str())
    normal, before = parts["normalizer"], parts["pre_tokenizer"] or {}
    steps = before.get("pretokenizers", [before])
    last = {"type": "ByteLevel", "add_prefix_space": False}
    plain = all(steps[-1].get(k) == v for k, v in last.items())
    split = steps[0].get("pattern", {}).get("Regex") if len(steps) == 2 and not steps[-1].get("use_regex") else None
    if normal is None and plain and (len(steps) == 1 and steps[0].get("use_regex") or split == BYTE_PATTERN and steps[0]["behavior"] == "Isolated"):
        return "byte"
    lowers = [(n["type"], n.get("pattern"), n.get("content")) for n in (normal or {}).get("normalizers", [])]
    if lowers == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] and plain and split == WORD_PATTERN and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
        return "word"
    return None


class Encoder:
    """Encodes batches of texts with one tokenizer.

    Control strings in a text are what the library's plain call makes of them, special tokens;
    as_text: ordinary text.
    """

    def __init__(self, tokenizer, as_text: bool = False, kept: int = 150_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kept, self.style = tokenizer, kept, _style(tokenizer)
        self.tokenizer.encode_special_tokens = as_text
        self.special = [] if as_text else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.characters = dict(enumerate(byte_characters()))
        self.packs = [struct.Struct(f"<{n}I") for n in range(64)]
        words = ["the", "straße", "naïve", "école", "x", "ljubljana", "supercalifragilistic", "мир", "---"]
        if self.style == "byte":
            words += [" " + w for w in words] + ["Straße", " École", "1234", " 12"]
        if self.style and self._words(words) != self._whole(words):
            self.style = None

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of one kind, each one word of the library's model, straight from the model."""
        out, tokenize, packs, lower = [], self.tokenizer.model.tokenize, self.packs, self.style == "word"
        for p in pieces:
            if p.isascii():
                name = "Ġ" + p[1:] if p[0] == " " else p
            else:
                name = (p.lower() if lower else p).encode().decode("latin-1").translate(self.characters)
            ids = [t.id for t in tokenize(name)]
            out.append(packs[len(ids)].pack(*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _lookup(self, pieces: list[str], kind: np.ndarray) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        if None in found:
            known, before = self.known, self.before
            new = [i for i, f in enumerate(found) if f is None]
            for i in new:
                found[i] = before.get(pieces[i])  # the older half of what is kept
            for simple in (True, False):
                some = [i for i in new if found[i] is None and (kind[i] in ((LETTER, SIGN, NUMBER) if self.style == "byte" else (LETTER, SIGN))) is simple]
                for i, ids in zip(some, (self._words if simple else self._whole)([pieces[i] for i in some])):
                    found[i] = ids
            known.update((pieces[i], found[i]) for i in new)
            if len(known) > self.kept:
                self.before, self.known = known, {}
        return found

    def _cut_and_encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that need no context, and how many each has."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(n, np.int64)
        at, kind = cut(data, ends[:-1][np.diff(ends) > 0], self.style == "byte")
        size = np.diff(at, append=len(data))
        if self.style == "word":
            used = kind != WHITE
            low = LOWER[data]
            after = np.flatnonzero(data[:-1] == 0xC3) + 1
            after = after[(data[after] >= 0x80) & (data[after] <= 0x9E)]
            low[after] += 0x20
            if (kind == OTHER).any():
                low = np.where(np.repeat(kind == OTHER, size), data, low)
            data, at, kind, size = low[np.repeat(used, size)], at[used], kind[used], size[used]
        edges = np.zeros(len(at) + 1, np.int32)
        np.cumsum(size, out=edges[1:])
        codes = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        index = codes.indices.to_numpy(zero_copy_only=False)
        of_word = np.zeros(len(codes.dictionary), np.uint8)
        of_word[index] = kind
        ids = self._lookup(codes.dictionary.to_numpy(zero_copy_only=False).tolist(), of_word)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        out, k = gather(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes, index)
        sums = np.concatenate([[0], np.cumsum(k)])
        return out, np.diff(sums[np.searchsorted(at, ends)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the number of ids of each; a null text is an empty one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.full(len(texts), self.style is None)
        for special in self.special if self.style else ():
            odd |= np.asarray(pc.match_substring(texts, special))
        if self.style == "byte":
            odd |= np.asarray(pc.match_substring_regex(texts, WIDE_BLANK))
        parts, counts, at = [], [], 0
        sums = np.cumsum(np.asarray(pc.binary_length(texts)))
        while at < len(texts):
            if odd[at]:
                end = at + (int(np.argmin(odd[at:])) or len(odd) - at)
                whole = self._whole(texts[at:end].to_pylist())
                parts.append(np.frombuffer(b"".join(whole), "<u4"))
                counts.append(np.fromiter(map(len, whole), np.int64, end - at) // 4)
            else:
                stop = at + (int(np.argmax(odd[at:])) or len(odd) - at)
                end = min(stop, max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + STRIDE))))
                pieces, owner = _strides(texts[at:end]), None
                if pieces is not None:  # one very long text
                    done = [self._cut_and_encode(p) for p in pieces]
                    parts += [d[0] for d in done]
                    counts.append(np.array([sum(int(d[1].sum()) for d in done)]))
                else:
                    ids, n = self._cut_and_encode(texts[at:end])
                    parts.append(ids)
                    counts.append(n)
            at = end
        pa.default_memory_pool().release_unused()
        return np.concatenate([*parts, np.zeros(0, "<u4")]), np.concatenate([*counts, np.zeros(0, np.int64)])


def _strides(text: pa.Array) -> list[pa.Array] | None:
    """A text longer than two strides, cut at single spaces between ASCII letters; None for any other batch."""
    if len(text) != 1 or pc.binary_length(text)[0].as_py() <= 2 * STRIDE:
        return None
    whole = text[0].as_buffer().to_pybytes()
    data, at, out = np.frombuffer(whole, np.uint8), 0, []
    while at < len(whole):
        near = data[at + STRIDE :]
        k = KIND[near[: 1 << 16]]
        gap = np.flatnonzero((near[1 : len(k) - 1] == 32) & (k[:-2] == LETTER) & (k[2:] == LETTER)) if len(k) > 2 else []
        end = at + STRIDE + 1 + int(gap[0]) if len(gap) else len(whole)
        out.append(pa.array([whole[at:end]], pa.large_binary()).cast(pa.large_string()))
        at = end
    return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder_of(path: str, as_text: bool = False) -> Encoder:
    """This worker's encoder of a tokenizers file."""
    if (path, as_text) not in _ENCODERS:
        from tokenizers import Tokenizer

        _ENCODERS[path, as_text] = Encoder(Tokenizer.from_file(path), as_text)
    return _ENCODERS[path, as_text]


def forget_encoders() -> None:
    """Frees this worker's encoders: workers are reused, also by operators that encode nothing."""
    if _ENCODERS:
        _ENCODERS.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
            trim(0)
