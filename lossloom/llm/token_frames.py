"""Token-id files made of independent zstandard frames with a trailing seek table.

A file holds the ids of many documents, one after another, as little-endian unsigned integers:

* data frames: each an independent zstandard frame over a run of whole documents, about ``frame_bytes`` before
  compression; only a document longer than that spans several frames,
* a skippable frame with the document index (doc_id, first id, number of ids) as a compressed Arrow stream,
* a skippable frame in the public seekable zstandard layout: for each data frame its compressed size, its size and the low
  half of its XXH64 checksum, then the number of frames, a flag byte and the magic number.

Any zstandard reader can decode a whole file; ``FrameFile`` reads the tail and decodes only the frames of the documents
that are asked for.
"""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossloom.llm.common import byte_batches, stage, text_or_empty
from lossloom.llm.tokens import END_ID, default_vocabulary, encoder, texts_of

# fixed values of the public zstandard seekable format
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
MANIFEST = "shard string, part long, n_docs long, n_ids long, first_doc_id long, last_doc_id long"


def file_system(path: str):
    """A pyarrow file system and the path in it, for a local path or any address that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FrameWriter:
    """Builds one file in memory, frame by frame; its size is bounded by the caller's shard size."""

    def __init__(self, frame_bytes: int = 1 << 18, level: int = 3):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frame_bytes, self.out, self.entries, self.docs = frame_bytes, io.BytesIO(), [], []
        self.waiting, self.waiting_bytes, self.n_ids = [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, self.n_ids, len(ids) // 4))
        self.n_ids += len(ids) // 4
        if self.waiting_bytes and self.waiting_bytes + len(ids) > self.frame_bytes:
            self._close_frame()
        for at in range(0, len(ids), self.frame_bytes):
            part = ids[at : at + self.frame_bytes]
            self.waiting.append(part)
            self.waiting_bytes += len(part)
            if self.waiting_bytes >= self.frame_bytes:
                self._close_frame()

    def _close_frame(self) -> None:
        import xxhash

        raw = b"".join(self.waiting)
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.waiting_bytes = [], 0

    def finish(self) -> bytes:
        import pyarrow as pa

        if self.waiting:
            self._close_frame()
        columns = list(zip(*self.docs)) or [(), (), ()]
        index = pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "first", "n_ids"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as writer:
            writer.write_batch(index)
        self._skippable(SKIPPABLE_INDEX, self.compressor.compress(sink.getvalue().to_pybytes()))
        footer = struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        self._skippable(SKIPPABLE_SEEK, np.array(self.entries, _ENTRY).tobytes() + footer)
        return self.out.getvalue()

    def _skippable(self, magic: int, payload: bytes) -> None:
        self.out.write(struct.pack("<II", magic, len(payload)) + payload)


class FrameFile:
    """Random access to one file: reads the tail first, then only the frames that are needed."""

    def __init__(self, handle):
        import pyarrow as pa
        import zstandard

        self.handle, self.decompressor, self.kept = handle, zstandard.ZstdDecompressor(), (-1, b"")
        size = handle.size()
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        table_at = size - 9 - n * _ENTRY.itemsize - 8
        self.entries = np.frombuffer(self._at(table_at + 8, n * _ENTRY.itemsize), _ENTRY)
        self.packed_at = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.raw_at = np.concatenate([[0], np.cumsum(self.entries["size"], dtype=np.int64)])
        data_end = int(self.packed_at[-1])
        index = self._at(data_end + 8, table_at - data_end - 8)
        self.docs = pa.ipc.open_stream(self.decompressor.decompress(index)).read_all()

    def _at(self, offset: int, length: int) -> bytes:
        self.handle.seek(offset)
        return self.handle.read(length)

    def frame(self, k: int) -> bytes:
        """One decoded frame; the last one is kept, as neighbours often share it."""
        import xxhash

        if self.kept[0] != k:
            size = int(self.entries["size"][k])
            raw = self.decompressor.decompress(self._at(int(self.packed_at[k]), int(self.entries["packed"][k])), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.entries["checksum"][k]):
                raise ValueError(f"checksum of frame {k} does not match")
            self.kept = (k, raw)
        return self.kept[1]

    def ids(self, first: int, n_ids: int) -> bytes:
        """The ids of one document, as little-endian unsigned 32-bit integers."""
        start, end, parts = first * 4, (first + n_ids) * 4, []
        k = int(np.searchsorted(self.raw_at, start, side="right")) - 1
        while start < end:
            raw, base = self.frame(k), int(self.raw_at[k])
            parts.append(raw[start - base : end - base])
            start, k = min(end, base + len(raw)), k + 1
        return b"".join(parts)


def write_token_frames(
    docs: DataFrame, folder: str, vocabulary: str | None = None, shard_bytes: int = 64 << 20, frame_bytes: int = 1 << 18
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the ids to ``folder`` in ascending doc_id order; returns the manifest.

    The rows are range-partitioned by doc_id and sorted, so files follow one another in order; a task closes a file at
    ``shard_bytes``. A file is written under a name of its own and then moved to its final name, so a repeated task
    replaces it by the same bytes. Null and empty texts hold only the end id; null doc_ids come first; repeated doc_ids
    keep all rows, ordered by text; other columns are ignored; an empty table gives no file.
    """
    vocabulary = vocabulary or default_vocabulary()

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(vocabulary).ids
        end, shards, writer = END_ID.to_bytes(4, "little"), [], None
        fs, root = file_system(folder)

        def close():
            name = f"{root}/ids-{part:06d}-{len(shards):05d}.zst"
            own = f"{root}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(own, compression=None) as out:
                out.write(writer.finish())
            fs.move(own, name)
            known = [d for d, _, _ in writer.docs if d is not None]  # in ascending order
            span = (known[0], known[-1]) if known else (None, None)
            shards.append((f"{folder}/{name.rsplit('/', 1)[1]}", part, len(writer.docs), writer.n_ids, *span))

        for batch in byte_batches(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    writer = FrameWriter(frame_bytes)
                writer.add(doc_id, encode(text) + end)
                if writer.n_ids * 4 >= shard_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        columns = list(zip(*shards)) or [()] * 6
        types = [pa.string()] + [pa.int64()] * 5
        names = ["shard", "part", "n_docs", "n_ids", "first_doc_id", "last_doc_id"]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(write, MANIFEST), "token-manifest")


READ = "doc_id long, start long, n_tokens long, ids binary"


def read_token_frames(manifest: DataFrame, doc_ids: DataFrame | None = None) -> DataFrame:
    """The documents of the files of a manifest: doc_id, start (ids of all documents before), n_tokens and ids (binary).

    With ``doc_ids`` (one column doc_id) only those documents are decoded: a range check finds the files that may hold
    them, and within a file only their frames are read.
    """
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("shard", "first_doc_id", "last_doc_id", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    if doc_ids is None:
        asked = files.select("shard", "base", F.lit(None).cast("array<long>").alias("wanted"))
    else:
        wanted = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        inside = wanted["doc_id"].between(files["first_doc_id"], files["last_doc_id"])
        chunk = F.floor(F.col("doc_id") / 65536).alias("chunk")  # a list of asked ids stays bounded
        asked = wanted.join(files, inside).groupBy("shard", "base", chunk).agg(F.collect_list("doc_id").alias("wanted"))
        asked = asked.drop("chunk")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(row["shard"])
                with fs.open_input_file(path) as handle:
                    file = FrameFile(handle)
                    want = None if row["wanted"] is None else set(row["wanted"])
                    out, held = [], 0
                    for doc_id, first, n in zip(*(file.docs.column(k).to_pylist() for k in range(3))):
                        if want is None or doc_id in want:
                            out.append((doc_id, row["base"] + first, n, file.ids(first, n)))
                            held += n
                            if held > 1 << 22:
                                yield _rows(pa, out)
                                out, held = [], 0
                    if out:
                        yield _rows(pa, out)

    spread = asked.repartition(max(1, manifest.count()))  # a small table, but each row is a file to read
    return spread.mapInArrow(read, READ)


def _rows(pa, rows):
    columns = list(zip(*rows))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "start", "n_tokens", "ids"])
