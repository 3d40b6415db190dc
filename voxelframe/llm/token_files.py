"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a sequence of zstandard frames, each holding the ids of some whole documents as
little-endian unsigned 32-bit integers, then two skippable frames: the document directory, and the
seek table of the public seekable format (compressed size, size and checksum of every frame, a
footer with their number). The directory is the table's last entry, a frame of size 0, so any
reader of that format can open the file. A reader fetches the two from the end and decompresses only
the frames of the documents asked for; an ordinary zstandard reader sees the ids one after another.
Only a document of more ids than BIG_FRAME goes over several frames.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelframe.llm.common import bounded, col, share_package, stage
from voxelframe.llm.tokens import encoder_of

#: Skippable-frame and footer magics of the seekable format; the directory uses another skippable frame.
SEEK_MAGIC, FOOTER_MAGIC, DIRECTORY_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
BIG_FRAME = 1 << 26
ENTRY, FOOTER, DIRECTORY_ENTRY = struct.Struct("<III"), struct.Struct("<IBI"), np.dtype([("id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("at", "<u8"), ("n", "<u8")])


class Writer:
    """Writes one file, a document at a time; a frame is closed when it holds `frame_ids` ids or more."""

    def __init__(self, out, frame_ids: int, level: int = 3) -> None:
        self.out, self.frame_ids, self.zstd = out, frame_ids, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.parts, self.held, self.total, self.frames, self.directory, self.n_docs = [], 0, 0, [], bytearray(), 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.directory += np.array([(doc_id or 0, doc_id is None, len(self.frames), self.held, n)], DIRECTORY_ENTRY).tobytes()
        self.n_docs += 1
        self.total += n
        for at in range(0, len(ids), 4 * BIG_FRAME):
            part = ids[at : at + 4 * BIG_FRAME]
            self.parts.append(part)
            self.held += len(part) // 4
            if self.held >= self.frame_ids:
                self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.parts)
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.parts:
            self._flush()
        directory = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(bytes(self.directory))
        self.out.write(struct.pack("<II", DIRECTORY_MAGIC, len(directory)) + directory)
        self.frames.append((len(directory) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(ENTRY.pack(*f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + FOOTER.size) + table + FOOTER.pack(len(self.frames), 0x80, FOOTER_MAGIC))


class Reader:
    """Random access to one file: directory and seek table first, frames on demand, checksums verified."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        tail = self._at(size - FOOTER.size, FOOTER.size)
        n, flags, magic = FOOTER.unpack(tail)
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - FOOTER.size - ENTRY.size * n, ENTRY.size * n)
        self.frames = [ENTRY.unpack_from(table, ENTRY.size * i) for i in range(n)]
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)]).astype(np.int64)
        raw = self._at(int(self.starts[n - 1]) + 8, self.frames[-1][0] - 8)
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), DIRECTORY_ENTRY)

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        packed, size, check = self.frames[i]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[i]), packed), max_output_size=max(size, 1))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int | None, bytes]]:
        """(place in the file, id, ids) of all documents or of the wanted ids; other frames stay packed."""
        last, raw = -1, b""
        for place in range(len(self.docs)) if wanted is None else np.flatnonzero(np.isin(self.docs["id"], list(wanted)) & (self.docs["null"] == 0)).tolist():
            d = self.docs[place]
            if d["frame"] != last:
                last, raw = int(d["frame"]), self.frame(int(d["frame"]))
            ids = raw[4 * int(d["at"]) : 4 * int(d["at"] + d["n"])]
            while len(ids) < 4 * int(d["n"]):  # a document of several frames
                last += 1
                raw = self.frame(last)
                ids += raw[: 4 * int(d["n"]) - len(ids)]
            yield place, None if d["null"] else int(d["id"]), ids


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, as_text: bool = False,
          frame_ids: int = 1 << 16, partitions: int | None = None, file_ids: int = 1 << 26, file_docs: int = 1 << 20) -> DataFrame:
    """Write the ids of whole texts in ascending id order (nulls first); returns the manifest.

    Manifest: file, n_docs, n_ids, low, high (ids), start (ids in all files before it); it is also
    written to folder/manifest. The files are written by the tasks into `folder`, a shared folder
    or object store; a task that runs again writes the same bytes under the same final names, and a
    task begins a new file after file_ids ids or file_docs documents. as_text: control strings of
    the tokenizer inside a text are ordinary text, not special tokens.

    A null text is empty and has its end id only; rows with equal ids stay side by side, in the order
    of the input, and may go over several tasks and files.
    """
    spark = docs.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), col(text_col).cast("string").alias("text"))
    ordered = base.repartitionByRange(n, "id", "row").sortWithinPartitions("id", "row").select("id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder_of(tokenizer, as_text), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer, number, low, high = None, 0, None, None

        def finished() -> pa.RecordBatch:
            writer.close()
            out.close()
            name = f"ids-{part:06d}-{number:04d}.zst"
            store.move(f"{root}/{trial}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), *[pa.array([v], pa.int64()) for v in (writer.n_docs, writer.total, low, high)]], ["part", "number", "file", "n_docs", "n_ids", "low", "high"])

        for b in bounded(batches, 1200, 5):
            ids, sizes = enc.encode(b.column(1))
            raw, ends = ids.tobytes(), 4 * np.cumsum(sizes)
            for doc_id, e, k in zip(b.column(0).to_pylist(), ends.tolist(), (4 * sizes).tolist()):
                if writer is None:
                    trial = f"_trial-{part:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{root}/{trial}")
                    writer, low = Writer(out, frame_ids), doc_id
                writer.add(doc_id, raw[e - k : e] + end)
                high = doc_id
                if writer.total >= file_ids or writer.n_docs >= file_docs:
                    yield finished()
                    writer, number = None, number + 1
        if writer is not None:
            yield finished()

    made = stage(ordered.mapInArrow(run, "part int, number int, file string, n_docs long, n_ids long, low long, high long"), records=1200, megabytes=5)
    # one row a file
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    manifest = made.select("file", "n_docs", "n_ids", "low", "high", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) of all documents, or of a stated list of ids, from the files of a folder."""
    share_package(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    if wanted is not None:
        span = F.transform(F.array(*map(F.lit, wanted or [None])), lambda i: i.between(F.col("low"), F.col("high")))
        manifest = manifest.where(F.exists(span, lambda x: x) | F.col("low").isNull())
    files = manifest.select("file", "start").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    chosen = None if wanted is None else set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as f:
                    r = Reader(f, f.size())
                    starts = first + np.cumsum(r.docs["n"].astype(np.int64)) - r.docs["n"].astype(np.int64)
                    rows, held = [], 0
                    for place, doc_id, ids in r.documents(chosen):
                        rows.append((doc_id, int(starts[place]), ids))
                        held += len(ids)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return files.mapInArrow(run, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])
