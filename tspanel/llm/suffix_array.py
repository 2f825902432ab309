"""Substring dedup of byte strings (operator 7) by bucket-pointer refinement per shard.

A shard holds the segments of its anchors (see ``anchors``). Its suffixes are first bucketed by
their first eight bytes. Buckets of q bytes are refined to 2q by sorting on the bucket that the
suffix q bytes later is in; places whose bucket holds no other leave at once, and the refined
buckets are the pointers of the next refinement. The last one reaches the window's length with an
overlap: equal buckets of 256 bytes at offsets 0 and 144 are equal strings of 400.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import covered, flat_content, repeated, spans_column, with_spans
from .text import byte_slices
from .work import keyed

WINDOW, GRAM, FIRST = 400, 32, 8


def refine(at: np.ndarray, key: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places that share their key, bucket of every place or -1)."""
    bucket = np.unique(key, return_inverse=True)[1]
    shared = np.bincount(bucket, weights[at])[bucket] >= 2 if len(at) else np.zeros(0, bool)
    pointer = np.full(size, -1, np.int64)
    pointer[at[shared]] = bucket[shared]
    return at[shared], pointer


def repeated_places(values: np.ndarray, ends: np.ndarray, copies: np.ndarray, window: int) -> np.ndarray:
    """Places where a string of ``window`` bytes starts, within its segment, that another place holds too."""
    n, size = len(values), np.diff(ends)
    room = np.repeat(ends[1:], size) - np.arange(n)  # bytes to the segment's end
    weights = np.repeat(copies, size)
    first = min(FIRST, window)
    at = np.flatnonzero(room >= first)
    key = np.zeros(len(at), np.uint64)
    for j in range(first):
        key = (key << np.uint64(8)) | values[at + j].astype(np.uint64)
    at, pointer = refine(at, key, weights, n)
    q = first
    while q < window and len(at):
        step = min(q, window - q)  # the last refinement overlaps
        at = at[room[at] >= q + step]
        at = at[pointer[at + step] >= 0]
        at, pointer = refine(at, pointer[at] * (n + 1) + pointer[at + step], weights, n)
        q += step
    return at


def index_shard(window: int):
    def index(table: pa.Table) -> pa.Table:
        values, ends = flat_content(table.column("content"))
        copies = np.asarray(table.column("copies"))
        at = repeated_places(values, ends, copies, window)
        segment = np.searchsorted(ends, at, "right") - 1
        single = copies[segment] == 1
        at, segment = at[single], segment[single]
        spans = spans_column(segment, at - ends[segment], window, table.num_rows)
        return pa.table({"anchor": table.column("anchor"), "segment": table.column("segment"), "spans": spans})

    return index


def bytes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def kept_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, spans of bytes) to n_bytes, n_removed, n_spans and the kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(2)):
                gone = covered(batch.column(3).slice(a, b - a), offsets)
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                inner = offsets[:-1][np.diff(offsets) > 0]
                starts[inner] |= gone[inner]
                sums = [np.diff(np.append(0, np.cumsum(x))[offsets]) for x in (gone, starts)]
                left = np.append(0, np.cumsum(~gone))[offsets]
                kept = pa.Array.from_buffers(
                    pa.large_binary(), b - a, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(offsets))]
                    + [pa.array(x.astype(np.int64)) for x in sums] + [kept],
                    names=["doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "kept_bytes"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, kept_bytes binary")


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_bytes, n_removed, n_spans, kept_bytes for every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes. Removes each byte of a string of ``window`` bytes that also starts
    anywhere else, in another row or the same; strings are judged on the input and never cross
    rows. A missing or empty text has no bytes; repeated rows repeat all their strings.
    """
    table = keyed(docs)
    return kept_bytes(with_spans(table, repeated(table, bytes_of, window, gram, index_shard(window))))
