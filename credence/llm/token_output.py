"""Token-id files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit integers:

* data frames, each an independent zstandard frame with the ids of whole documents, about ``frame_bytes`` of them
  (a longer document has a frame of its own);
* a directory frame, also zstandard: for each document its id, its frame and its number of ids, as int64;
* a skippable frame with the seek table: compressed size, plain size and checksum (low 32 bits of xxHash64 of the
  plain bytes) of each frame, then the number of frames, a flag byte and a magic number, all little-endian. This is
  the layout of the public seekable zstandard format.

A reader of one document reads the table, the directory and that document's frame, nothing else.

``write`` range-partitions the documents by id and lets each partition write one file to a shared folder; only the
files that successful tasks return count, so a task that runs again leaves at most an unlisted file. Defined cases:
null text is an empty document (the end id alone); repeated ids keep all their rows in no given order among
themselves; an empty table makes no files; other columns are ignored. A null doc_id sorts first and is kept, stored
as the smallest int64.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces

SEEK_MAGIC, SKIP_MAGIC = 0x8F92EAB1, 0x184D2A5E  # fixed values of the seekable format
MANIFEST = "part int, file string, n_docs long, n_tokens long"
NO_ID = -(1 << 63)
#: Bytes of text that are encoded together, and what a worker remembers here: this query's only Python stage of any size is the encoding.
SLICE_BYTES, CACHE_PIECES, CACHE_BYTES = 2 << 20, 800_000, 120 << 20


def _checksum(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file to a binary sink."""

    def __init__(self, sink, frame_bytes: int = 1 << 18, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.table: list[tuple[int, int, int]] = []
        self.directory: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        if self.held and self.held_bytes + len(ids) > self.frame_bytes:
            self._frame()
        self.directory.append((doc_id, len(self.table), len(ids) // 4))
        self.held.append(ids)
        self.held_bytes += len(ids)

    def _put(self, raw: bytes) -> None:
        packed = self.pack(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), _checksum(raw)))

    def _frame(self) -> None:
        self._put(b"".join(self.held))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        self._put(np.array(self.directory, "<i8").tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIP_MAGIC, len(body)) + body)


class FrameReader:
    """Random access to one file through a seekable source."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * count)
        table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.table, self.at = table, np.concatenate(([0], np.cumsum(table[:, 0])))
        self.directory = np.frombuffer(self.frame(count - 1), "<i8").reshape(-1, 3)
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        import zstandard

        self.source.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]) or 1)
        if len(raw) != self.table[k, 1] or _checksum(raw) != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self):
        """All (doc_id, ids as bytes) in file order, one frame in memory at a time."""
        d = self.directory
        cut = np.flatnonzero(np.diff(d[:, 1])) + 1 if len(d) else np.zeros(0, np.int64)
        for part in np.split(d, cut) if len(d) else []:
            raw, at = self.frame(int(part[0, 1])), 0
            for doc_id, _, n in part.tolist():
                yield doc_id, raw[at : at + 4 * n]
                at += 4 * n

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of one document (one array for each row with that id), from its own frames only."""
        found, d = [], self.directory
        for k in np.flatnonzero(d[:, 0] == doc_id):
            before = d[(d[:, 1] == d[k, 1]) & (np.arange(len(d)) < k), 2].sum() * 4
            raw = self.frame(int(d[k, 1]))
            self.frames_read += 1
            found.append(np.frombuffer(raw[before : before + 4 * int(d[k, 2])], "<u4"))
        return found


def open_file(uri: str, mode: str = "r"):
    """A pyarrow file of any store that pyarrow knows by its URI."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if mode == "w":
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path), 0
    return store.open_input_file(path), store.get_file_info(path).size


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, parts: int | None = None, frame_bytes: int = 1 << 18) -> DataFrame:
    """Encodes every document and writes the files in ascending doc_id order; returns the (materialised) manifest."""

    def store(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder, sink, writer, total, count, name = pieces.encoder(tokenizer, CACHE_PIECES, CACHE_BYTES), None, None, 0, 0, ""
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = common.buffers(batch.column(1))
            for a, b in common.slices(offsets, SLICE_BYTES):
                piece, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                cuts = np.append(np.flatnonzero(pieces.safe_cuts(piece, local)), len(piece)) if len(piece) else np.zeros(1, np.int64)
                ids, before = coder.encode(piece, cuts)
                edge = before[np.searchsorted(cuts, local)]
                raw, tail = ids.astype("<u4").tobytes(), struct.pack("<I", end_id)
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                    sink, _ = open_file(name, "w")
                    writer = FrameWriter(sink, frame_bytes)
                for i in range(b - a):
                    writer.add(NO_ID if doc_ids[a + i] is None else doc_ids[a + i], raw[4 * edge[i] : 4 * edge[i + 1]] + tail)
                total, count = total + len(ids) + b - a, count + b - a
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [count], "n_tokens": [total]})

    common.small_batches(docs.sparkSession)
    n = parts or common.shuffle_parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.binary().alias("text"))
    order = ("doc_id", F.xxhash64("text"))  # rows that share an id are spread too
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return common.cut(ordered.mapInArrow(store, MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """One row per document of the listed files: doc_id, start (ids before it in all files), n_tokens, ids (binary)."""

    def load(batches):
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source, size = open_file(name)
                out, held = [], 0
                for doc_id, ids in FrameReader(source, size).documents():
                    out.append((None if doc_id == NO_ID else doc_id, at, len(ids) // 4, ids))
                    at, held = at + len(ids) // 4, held + len(ids)
                    if held > 4 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)
                source.close()

    from pyspark.sql import Window

    starts = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = common.shuffle_parts(manifest.sparkSession)
    return starts.select("file", "start").repartition(n, "file").mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")


def _rows(out) -> pa.RecordBatch:
    doc, start, n, ids = zip(*out)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())})


def digest(ids: DataFrame) -> DataFrame:
    """``read``'s rows with the crc32 of their ids instead of the ids."""
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
