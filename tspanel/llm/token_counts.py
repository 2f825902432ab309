"""Token counts from flat files of ids without an index (operator 4).

The files hold nothing but ids, and a separator after every document. Each file is cut in blocks
of bytes, all blocks are searched for separators at once, and the boundaries that blocks share
are stitched by a prefix scan: a block gets the number of separators before it and the place of
the last one, from which its first document's begin follows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .text import byte_slices
from .tokens import ENCODE_BYTES, encoder
from .work import store, work_folder

BLOCK_BYTES = 4 << 20


def write_flat(docs: DataFrame, tokenizer: str, folder: str, separator: int, width: int = 2) -> DataFrame:
    """Write all texts' ids as little-endian unsigned integers of ``width`` bytes, one file per task.

    Names of special tokens in a text are ordinary text, so no text holds the separator.
    Returns the stored list (file, ordinal, doc_id): which document is the how manieth of a
    file. A missing or empty text is a separator alone. Only listed files count. Ids that do not
    fit ``width``, and a separator that a text holds, are errors.
    """
    if not 0 <= separator < 1 << (8 * width):
        raise ValueError(f"the separator {separator} does not fit {width} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, out, name, n = encoder(tokenizer, True), None, "", 0
        for batch in batches:
            if out is None and batch.num_rows:
                files, path = fs.FileSystem.from_uri(folder)
                files.create_dir(path)
                name = f"flat-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                out = files.open_output_stream(f"{path}/{name}")
            for a, b, data, offsets in byte_slices(batch.column(1), ENCODE_BYTES):
                tokens, lengths = code.ids(data, offsets)
                if len(tokens) and int(tokens.max()) >> (8 * width):
                    raise ValueError(f"id {tokens.max()} does not fit {width} bytes")
                if (tokens == separator).any():
                    raise ValueError(f"the separator {separator} is an id of a text")
                ids = np.full(len(tokens) + b - a, separator, f"<u{width}")
                keep = np.ones(len(ids), bool)
                keep[np.cumsum(lengths + 1) - 1] = False
                ids[keep] = tokens
                out.write(ids.tobytes())
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * k, pa.string()), pa.array(np.arange(n, n + k)), batch.column(0)],
                names=["file", "ordinal", "doc_id"],
            )
            n += k
        if out is not None:
            out.close()

    table = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return store(table.mapInArrow(run, "file string, ordinal long, doc_id long"))


def scan_flat(sizes: DataFrame, folder: str, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents in flat files: file, ordinal, start and n_tokens (in ids), closed.

    ``sizes``: (file, length in bytes). ``start`` counts from the file's begin, ``n_tokens``
    excludes the separator, ``closed`` is false for ids after a file's last separator. Bytes
    that don't fill an id at a file's end are ignored.
    """
    step = block_bytes // width * width

    def block(name: str, begin: int, stop: int) -> np.ndarray:
        """Places of the separators in a block."""
        files, path = fs.FileSystem.from_uri(folder)
        with files.open_input_file(f"{path}/{name}") as f:
            return begin // width + np.flatnonzero(np.frombuffer(f.read_at(stop - begin, begin), f"<u{width}") == separator)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                at = block(x["file"], x["begin"], x["stop"])
                rows.append({**x, "n": len(at), "last": int(at[-1]) if len(at) else None})
            yield pa.RecordBatch.from_pylist(rows, schema=counted)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ends = block(x["file"], x["begin"], x["stop"])
                open_at = x["before_last"] + 1
                starts = np.append(open_at, ends + 1)
                tail = x["final"] and starts[-1] < x["stop"] // width
                ends = np.append(ends, x["stop"] // width) if tail else ends
                n = len(ends)
                closed = np.ones(n, bool)
                closed[n - 1 :] = not tail
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["file"]] * n, pa.string()),
                        pa.array(x["before_n"] + np.arange(n)),
                        pa.array(starts[:n]),
                        pa.array(ends - starts[:n]),
                        pa.array(closed),
                    ],
                    names=["file", "ordinal", "start", "n_tokens", "closed"],
                )

    counted = pa.schema(
        [("file", pa.string()), ("begin", pa.int64()), ("stop", pa.int64()), ("final", pa.bool_()), ("n", pa.int64()), ("last", pa.int64())]
    )
    whole = F.floor(F.col("length") / width) * width
    blocks = (
        sizes.select("file", whole.alias("whole"))
        .filter("whole > 0")
        .select("file", "whole", F.explode(F.sequence(F.lit(0), F.col("whole") - 1, F.lit(step))).alias("begin"))
        .select("file", F.col("begin").cast("long"), F.least(F.col("begin") + step, "whole").cast("long").alias("stop"), "whole")
        .select("file", "begin", "stop", (F.col("stop") == F.col("whole")).alias("final"))
    )
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = blocks.repartition(parts, "file", "begin").mapInArrow(
        count, "file string, begin long, stop long, final boolean, n long, last long"
    )
    earlier = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    stitched = counts.select(
        "file", "begin", "stop", "final",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_n"),
        F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("before_last"),
    )
    return stitched.repartition(parts, "file", "begin").mapInArrow(
        emit, "file string, ordinal long, start long, n_tokens long, closed boolean"
    )


def file_sizes(listed: DataFrame, folder: str) -> DataFrame:
    """(file, length) of the listed files, from the folder's listing alone."""
    there = listed.sparkSession.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "length"
    )
    return there.join(listed.groupBy("file").agg(F.count(F.lit(1)).alias("n_docs")), "file", "left_semi")


def token_counts(docs: DataFrame, tokenizer: str, separator: int, width: int = 2) -> DataFrame:
    """doc_id, file, start and n_tokens of every document, counted in flat files of ids.

    A missing or empty text has 0 tokens; an empty table gives no rows.
    """
    folder = work_folder(docs.sparkSession) + "-flat"
    listed = write_flat(docs, tokenizer, folder, separator, width)
    if listed.isEmpty():
        return listed.select("doc_id", "file", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    found = scan_flat(file_sizes(listed, folder), folder, separator, width)
    return found.join(listed.hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "start", "n_tokens")
