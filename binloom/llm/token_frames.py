"""Token-id files: independent zstandard frames, a trailing seek table, checksums per frame.

File layout, in the public seekable format of zstandard:

* data frames, each a complete zstandard frame over whole ids (little-endian, 2 or 4 bytes);
* one skippable frame with the index: id width, number of documents, how many of the first
  have no id, then doc ids and id counts, compressed;
* one skippable frame with the seek table: per data frame its compressed size, plain size
  and the low 32 bits of the XXH64 of its plain bytes, then the footer.

A reader takes the footer, the seek table and the index from the end of the file and then
only the frames that hold the documents it wants.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm.common import filled, text_slices
from binloom.llm.encoders import encoder
from binloom.session import cut_lineage, shared_folder

#: Plain bytes after which a frame is closed; a longer document spans several frames.
FRAME_BYTES = 1 << 20
# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A50
SEEK_SKIPPABLE = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def _filesystem(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder.replace("file:///", "file:/").replace("file:/", "file:///"))


class FrameWriter:
    """Writes one file; it appears under its name only when it is closed."""

    def __init__(self, folder: str, name: str, dtype: np.dtype):
        import zstandard

        self.files, base = _filesystem(folder)
        self.files.create_dir(base, recursive=True)
        self.name, self.dtype = f"{base}/{name}", np.dtype(dtype)
        self.out = self.files.open_output_stream(f"{self.name}.part")
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.pending, self.size, self.table = [], 0, []
        self.doc_ids, self.counts, self.nameless = [], [], 0

    def _flush(self) -> None:
        import xxhash

        plain = b"".join(self.pending)
        self.pending, self.size = [], 0
        for begin in range(0, len(plain), FRAME_BYTES):
            part = plain[begin : begin + FRAME_BYTES]
            frame = self.compressor.compress(part)
            self.out.write(frame)
            self.table.append((len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Documents come in ascending order, those without id first."""
        self.nameless += doc_id is None
        self.doc_ids.append(doc_id or 0)
        self.counts.append(len(ids) // self.dtype.itemsize)
        self.pending.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self._flush()

    def close(self) -> tuple[int, int]:
        """Documents and ids of the finished file."""
        self._flush()
        index = np.array([self.dtype.itemsize, len(self.doc_ids), self.nameless, *self.doc_ids, *self.counts], "<i8").tobytes()
        packed = self.compressor.compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        body = b"".join(struct.pack("<III", *row) for row in self.table)
        body += struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(body)) + body)
        self.out.close()
        self.files.move(f"{self.name}.part", self.name)
        return len(self.doc_ids), sum(self.counts)


class FrameReader:
    """Reads documents of one file by position, a frame at a time."""

    def __init__(self, folder: str, name: str):
        import zstandard

        files, base = _filesystem(folder)
        self.file = files.open_input_file(f"{base}/{name}")
        self.decompressor = zstandard.ZstdDecompressor()
        size = self.file.size()
        frames, flag, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{name}: no seek table")
        table = np.frombuffer(self.file.read_at(12 * frames, size - 9 - 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.starts = np.concatenate([[0], np.cumsum(table[:, 1])])
        self.checksums = table[:, 2]
        magic, length = struct.unpack("<II", self.file.read_at(8, int(self.places[-1])))
        index = np.frombuffer(self.decompressor.decompress(self.file.read_at(length, int(self.places[-1]) + 8)), "<i8")
        self.dtype, n = np.dtype(f"<u{index[0]}"), int(index[1])
        self.doc_ids, self.counts = index[3 : 3 + n], index[3 + n :]
        self.nameless = np.arange(n) < index[2]
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self.at, self.plain = -1, b""

    def _frame(self, k: int) -> bytes:
        import xxhash

        if k != self.at:
            begin, end = int(self.places[k]), int(self.places[k + 1])
            plain = self.decompressor.decompress(self.file.read_at(end - begin, begin))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.checksums[k]:
                raise ValueError(f"frame {k}: checksum differs")
            self.at, self.plain = k, plain
        return self.plain

    def ids(self, position: int) -> np.ndarray:
        """Ids of the document at ``position``; only the frames it lies in are decompressed."""
        width = self.dtype.itemsize
        begin, end = int(self.offsets[position]) * width, int(self.offsets[position + 1]) * width
        parts, k = [], int(np.searchsorted(self.starts, begin, side="right")) - 1
        while begin < end:
            stop = min(end, int(self.starts[k + 1]))
            parts.append(self._frame(k)[begin - int(self.starts[k]) : stop - int(self.starts[k])])
            begin, k = stop, k + 1
        return np.frombuffer(b"".join(parts), self.dtype)


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[str, DataFrame]:
    """Encode all texts and write them in ascending id order, a file per range of ids.

    Returns the folder and a manifest (shard, path, n_docs, n_tokens). Null texts are empty
    and hold the end id alone; repeated ids are written once per row, rows without id come
    first; an empty table writes no file. A file is first written under a name of its own attempt, so a
    repeated or speculative task cannot spoil another's file; the manifest names the valid one.
    """
    folder = f"{shared_folder(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        context, codec = TaskContext.get(), encoder(tokenizer)
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.zst"
        out = FrameWriter(folder, name, codec.dtype)
        end = np.array([end_id], codec.dtype).tobytes()
        for batch in text_slices(itertools.chain([first], batches), "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.add(doc_id, codec.packed(text) + end)
        n_docs, n_tokens = out.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([context.partitionId()], pa.int32()), "path": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]}
        )

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    ordered = ordered.repartitionByRange("id").sortWithinPartitions("id")
    return folder, cut_lineage(ordered.mapInArrow(write, MANIFEST))


def read_token_files(folder: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of the files: id, ``start`` over all files, ``n_tokens``, ``ids_crc32``."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # a row per file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = FrameReader(folder, row["path"])
                crc = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in range(len(reader.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids, mask=reader.nameless),
                        pa.array(reader.offsets[:-1] + row["base"]),
                        pa.array(reader.counts),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[id_col, "start", "n_tokens", "ids_crc32"],
                )

    return shards.repartition("shard").mapInArrow(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
