"""Token ids in binary files (operator 5): Simple-8b blocks with offsets, in ascending doc_id order.

Each file stands alone: packed words of all its blocks, then the number of words of each block,
the doc_ids, whether they are missing, the number of ids of each document, and a tail with the
number of blocks, documents, ids and words. Readers decode any range of blocks at once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .simple8b import BLOCK, pack, unpack
from .text import byte_slices
from .tokens import ENCODE_BYTES, encoder
from .work import store, work_folder

MAGIC = 0x3862_5F69_6473_0001
READ_BLOCKS = 1024
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


class Writer:
    """One file: whole blocks are packed and written as soon as they are full."""

    def __init__(self, folder: str, part: int, seq: int):
        self.files, path = fs.FileSystem.from_uri(folder)
        self.files.create_dir(path)
        # another attempt at the task writes another file
        self.name, self.part, self.seq = f"ids-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.s8b", part, seq
        self.out = self.files.open_output_stream(f"{path}/{self.name}")
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.words = 0
        self.sizes: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.missing: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.missing.append(missing)
        self.lengths.append(lengths)
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= READ_BLOCKS * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.waiting])
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        words, sizes = pack(ids[:full].astype(np.uint64))
        self.out.write(words.astype("<u8").tobytes())
        self.words += len(words)
        self.sizes.append(sizes)
        self.waiting, self.held = [ids[full:]], len(ids) - full

    def close(self) -> tuple:
        self.flush(True)
        sizes = np.concatenate(self.sizes)
        docs = np.concatenate([np.zeros(0, np.int64), *self.doc_ids])
        for values, kind in (
            (sizes, "<u2"),
            (docs, "<i8"),
            (np.concatenate([np.zeros(0, bool), *self.missing]), "u1"),
            (np.concatenate([np.zeros(0, np.int64), *self.lengths]), "<i8"),
            (np.array([len(sizes), len(docs), self.ids, self.words, MAGIC]), "<i8"),
        ):
            self.out.write(values.astype(kind).tobytes())
        self.out.close()
        return self.part, self.seq, self.name, len(docs), self.ids


class Reader:
    def __init__(self, folder: str, name: str):
        files, path = fs.FileSystem.from_uri(folder)
        self.file = files.open_input_file(f"{path}/{name}")
        tail = np.frombuffer(self.file.read_at(40, self.file.size() - 40), "<i8")
        if tail[4] != MAGIC:
            raise ValueError(f"{name} is not a file of packed ids")
        blocks, docs, self.ids, words = (int(x) for x in tail[:4])
        at = 8 * words
        self.sizes = self._array(at, blocks, "<u2").astype(np.int64)
        self.doc_ids = self._array(at := at + 2 * blocks, docs, "<i8")
        self.missing = self._array(at := at + 8 * docs, docs, "u1").astype(bool)
        self.lengths = self._array(at + docs, docs, "<i8")

    def _array(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)

    def chunks(self) -> Iterator[np.ndarray]:
        """All ids, so many blocks at a time."""
        offsets = np.append(0, np.cumsum(self.sizes)) * 8
        for b in range(0, len(self.sizes), READ_BLOCKS):
            e = min(b + READ_BLOCKS, len(self.sizes))
            words = self._array(int(offsets[b]), int(offsets[e] - offsets[b]) // 8, "<u8")
            yield unpack(words, self.sizes[b:e], min(self.ids - b * BLOCK, (e - b) * BLOCK))

    def documents(self) -> Iterator[tuple[int, int]]:
        """(number of ids, crc32 of the ids as little-endian 32-bit integers) of each document."""
        ends, doc, crc, at = np.cumsum(self.lengths), 0, 0, 0
        for ids in self.chunks():
            raw, low = memoryview(ids.astype("<u4").tobytes()), at
            while doc < len(ends) and ends[doc] <= low + len(ids):
                yield int(self.lengths[doc]), zlib.crc32(raw[(at - low) * 4 : (int(ends[doc]) - low) * 4], crc)
                at, doc, crc = int(ends[doc]), doc + 1, 0
            crc, at = zlib.crc32(raw[(at - low) * 4 :], crc), low + len(ids)


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, file_ids: int = 8_000_000, literal: bool = False
) -> DataFrame:
    """Write the ids of all texts, each with ``end_id`` after it; returns the stored list of files.

    ``docs``: doc_id and text. Files hold about ``file_ids`` ids; ordered by (part, seq) they hold
    the documents in ascending doc_id order. Missing doc_ids come first, rows that share a doc_id
    are in the order of a hash of their text, so that either may be any number. A missing text
    is empty and gives the end id alone. Only listed files count: a task that is run again
    writes new ones.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq, writer, rows = encoder(tokenizer, literal), TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in byte_slices(batch.column(1), ENCODE_BYTES):
                writer = writer or Writer(folder, part, seq)
                tokens, lengths = code.ids(data, offsets)
                out = np.full(len(tokens) + b - a, end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(lengths + 1) - 1] = False
                out[keep] = tokens
                some = ids.slice(a, b - a)
                writer.add(some.fill_null(0).to_numpy(), some.is_null().to_numpy(zero_copy_only=False), lengths + 1, out)
                if writer.ids >= file_ids:
                    rows.append(writer.close())
                    writer, seq = None, seq + 1
        if writer:
            rows.append(writer.close())
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["part", "seq", "file", "n_docs", "n_ids"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = table.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return store(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: its place among all ids, its number of ids, their crc32."""
    spark = files.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(folder, name)
                found = list(reader.documents())
                n = np.array([x for x, _ in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids, mask=reader.missing),
                        pa.array(start + np.cumsum(n) - n),
                        pa.array(n),
                        pa.array([x for _, x in found], pa.int64()),
                        pa.array([name] * len(n), pa.string()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                )

    # one row per file: a small table
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("file", F.coalesce(before, F.lit(0)).alias("start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(parts, "file").mapInArrow(run, DECODED)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write and read back: doc_id, start, n_tokens, ids_crc32, file. No rows for an empty table."""
    folder = work_folder(docs.sparkSession) + "-ids"
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id), folder)
