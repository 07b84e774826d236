"""Token-id files with bit-plane shuffling.

A file holds the ids of many documents, one document after another. The id stream is cut into blocks
of a fixed number of ids; each block is transposed into planes (one for each bit, or for each byte, of
an id), each plane is compressed with zstandard on its own, and an index at the end of the file says
where each block and plane begins, so that any range of ids can be read without the rest.

Layout: MAGIC, the planes of all blocks, then three zstandard frames (document ids, document lengths,
plane sizes: little-endian signed 64-bit integers), a footer of fixed size, MAGIC.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage, textkit, tokens

MAGIC = b"RSPLANE1"
#: documents, ids, blocks, ids in a block, bytes of an id, 1 if planes are bits, sizes of the three frames
FOOTER = struct.Struct("<9q")
BLOCK_IDS = 1 << 16
#: Text bytes of a file and of the task that writes it, on average: at least, and at most; files that are made
#: before they grow from the one to the other. (A task streams its texts, whatever their number.)
FILE_BYTES, MOST_FILE_BYTES, FILES = 10 << 20, 256 << 20, 4096
#: Production uses byte planes: on these ids they take about the space of bit planes at a fifth of the time.
PLANES = "byte"


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, most significant last."""
    width = ids.dtype.itemsize
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(-1, width)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(width)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def join_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    """Inverse of split_planes."""
    if not bits:
        raw = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(flat, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").reshape(-1)


class TokenFileWriter:
    """Streams documents into one file; at most a block of ids is held."""

    def __init__(self, uri: str, dtype: np.dtype, block_ids: int = BLOCK_IDS, planes: str = PLANES):
        self.fs, self.path = storage.open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.own, compression=None)
        self.out.write(MAGIC)
        self.dtype, self.block_ids, self.bits = np.dtype(dtype), block_ids, planes == "bit"
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_blocks = 0
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A null document id is stored as the least 64-bit integer."""
        self.doc_ids.append(-(2**63) if doc_id is None else doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            whole = np.concatenate(self.held)
            end = len(whole) - len(whole) % self.block_ids
            for i in range(0, end, self.block_ids):
                self._block(whole[i : i + self.block_ids])
            self.held, self.n_held = [whole[end:]], len(whole) - end

    def _block(self, ids: np.ndarray) -> None:
        for plane in split_planes(ids.astype(self.dtype, copy=False), self.bits):
            frame = self.zstd.compress(plane)
            self.out.write(frame)
            self.sizes.append(len(frame))
        self.n_ids += len(ids)
        self.n_blocks += 1

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        frames = [self.zstd.compress(np.array(x, "<i8").tobytes()) for x in (self.doc_ids, self.lengths, self.sizes)]
        for f in frames:
            self.out.write(f)
        self.out.write(FOOTER.pack(len(self.doc_ids), self.n_ids, self.n_blocks, self.block_ids, self.dtype.itemsize, self.bits, *map(len, frames)) + MAGIC)
        self.out.close()
        storage.replace(self.fs, self.own, self.path)


class TokenFile:
    """Reads a file: documents, blocks, or any range of ids."""

    def __init__(self, uri: str):
        fs, path = storage.open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = FOOTER.size + len(MAGIC)
        if size < tail + len(MAGIC) or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        end = self.file.read_at(tail, size - tail)
        if end[FOOTER.size :] != MAGIC:
            raise ValueError(f"{uri}: the footer is missing")
        self.n_docs, self.n_ids, self.n_blocks, self.block_ids, self.width, bits, *sizes = FOOTER.unpack(end[: FOOTER.size])
        self.bits, self.unzstd = bool(bits), zstandard.ZstdDecompressor()
        at, found = size - tail - sum(sizes), []
        for n in sizes:
            found.append(np.frombuffer(self.unzstd.decompress(self.file.read_at(n, at)), "<i8"))
            at += n
        self.doc_ids, self.lengths, self.sizes = found
        self.n_planes = self.width * (8 if self.bits else 1)
        self.at = len(MAGIC) + np.concatenate([[0], np.cumsum(self.sizes)])
        if self.lengths.sum() != self.n_ids or len(self.sizes) != self.n_blocks * self.n_planes:
            raise ValueError(f"{uri}: the index does not fit the file")

    def block(self, k: int) -> np.ndarray:
        first = k * self.n_planes
        raw = self.file.read_at(int(self.at[first + self.n_planes] - self.at[first]), int(self.at[first]))
        planes, at = [], 0
        for n in self.sizes[first : first + self.n_planes]:
            planes.append(self.unzstd.decompress(raw[at : at + n]))
            at += n
        return join_planes(planes, min(self.block_ids, self.n_ids - k * self.block_ids), self.width, self.bits)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file, from the blocks that hold them alone."""
        first, last = start // self.block_ids, (start + max(n, 1) - 1) // self.block_ids
        got = [self.block(k) for k in range(first, min(last + 1, self.n_blocks))]
        at = start - first * self.block_ids
        return np.concatenate(got)[at : at + n] if got else np.zeros(0, f"<u{self.width}")

    def crcs(self) -> np.ndarray:
        """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
        out = np.zeros(self.n_docs, np.int64)
        doc, left = 0, int(self.lengths[0]) if self.n_docs else 0
        crc = 0
        for k in range(self.n_blocks):
            view, at = memoryview(self.block(k).astype("<u4").tobytes()), 0
            while at < len(view):
                while left == 0:
                    out[doc], crc, doc = crc, 0, doc + 1
                    left = int(self.lengths[doc])
                n = min(left, (len(view) - at) // 4)
                crc = zlib.crc32(view[at : at + 4 * n], crc)
                at, left = at + 4 * n, left - n
        if self.n_docs:
            out[doc] = crc
        return out


def write_token_files(docs: DataFrame, folder: str, end_id: int = 1, tokenizer: str | None = None, block_ids: int = BLOCK_IDS, planes: str = PLANES) -> list:
    """Encodes documents (doc_id, text) and writes them in ascending doc_id order, a file for each task.

    Returns one row for each file, in order: file, n_docs, n_ids. Null texts count as empty; a null
    doc_id comes first; rows with one doc_id follow each other in the order of their texts; other
    columns are ignored; an empty table gives no file.
    """
    path = tokenizer or tokens.default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, k, coder = None, TaskContext.get().partitionId(), tokens.word_tokenizer(path)
        uri = f"{folder}/part-{k:06d}.ids"
        for batch in batches:
            if batch.num_rows and out is None:
                out = TokenFileWriter(uri, coder.dtype, block_ids, planes)
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.all_ids([t or b"" for t in batch.column(1).to_pylist()]), strict=True):
                out.add(doc_id, np.append(np.frombuffer(ids, coder.dtype), coder.dtype.type(end_id)))
        textkit.trim()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [k], "file": [uri], "n_docs": [len(out.lengths)], "n_ids": [out.n_ids]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    size = storage.text_bytes(docs)
    parts = max(8, min(-(-size // FILE_BYTES), FILES), -(-size // MOST_FILE_BYTES))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return sorted(rows.mapInArrow(write, "part long, file string, n_docs long, n_ids long").collect(), key=lambda r: r["part"])


def read_token_files(spark: SparkSession, files: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file: what the files hold, each file read by one task."""
    starts = np.concatenate([[0], np.cumsum([f["n_ids"] for f in files])]).astype(int).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(row["file"])
                ends = np.cumsum(f.lengths)
                null = f.doc_ids == -(2**63)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids, mask=null), pa.array(row["at"] + ends - f.lengths), pa.array(f.lengths), pa.array(f.crcs()), pa.array([row["file"]] * f.n_docs, pa.string())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                )

    at = spark.createDataFrame([(f["file"], s) for f, s in zip(files, starts)], "file string, at long")
    return at.repartition(max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids through the file format: doc_id, start, n_tokens, ids_crc32."""
    docs = storage.table(spark, sf_dir, "documents")
    files = write_token_files(docs, storage.fresh(spark, "token-planes"))
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")
