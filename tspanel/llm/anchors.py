"""Windows of a fixed length that occur more than once, found through content-defined anchors.

Operators 6 and 7 look for windows (of words or bytes) that start at two places or more. Every
window has an anchor, the smallest hash among its grams of a few items. Equal windows have equal
anchors, so only windows with an anchor that occurs in two places need a closer look, and
all of these meet where their anchor goes. Consecutive windows with one anchor form a run, a short
segment of the text; runs with the same content are counted, not repeated.

The steps, all exact:

1. ``runs``: one small row per run of every document, no text.
2. Anchors are counted (combined before the shuffle); runs whose anchor is unique are dropped.
3. Runs of one anchor with equal content are one segment with a number of occurrences.
   An anchor whose runs are all equal is decided by that number alone.
4. Anchors with few different segments go to shards with the segments' content, where the
   operator's index tells which windows occur in several segments.
5. Anchors with many different segments, as around a passage that a large part of all
   documents hold, are split further by anchors at the windows' edges, and what is left by the
   hash of the whole window, so no task gets the anchor as a whole.
6. Windows found are merged to intervals per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import Rolling, byte_slices, mix, ragged
from .work import store

#: Anchors with more different segments than this are split by whole windows.
HOT_SEGMENTS = 64
#: Segments that share an index, on average at most.
SHARD_SEGMENTS = 4000
RUN = "doc_id long, text_key long, begin long, windows long, anchor long, segment long"

#: From (bytes, offsets) to (items, first item of every row and the end).
Items = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def window_starts(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first item) of all windows that lie within a row."""
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[row]


def runs_of(items: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first item, number of windows, anchor) of all runs.

    The anchor of a window is its gram with the smallest hash, the leftmost of equals. A run has
    one anchor at one place, so two windows of one run are never equal.
    """
    row, at = window_starts(bounds, window)
    if not len(at):
        return row, at, at, np.zeros(0, np.uint64)
    grams = Rolling(items).grams(gram)
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_minimum(ranked, window - gram + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    return row[first], at[first], np.diff(np.append(first, len(at))), grams[place[first]]


def runs(docs: DataFrame, items: Items, window: int, gram: int) -> DataFrame:
    """One row per run of every document; ``segment`` is a hash of the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(2)):
                values, bounds = items(data, offsets)
                row, begin, windows, anchor = runs_of(values, bounds, window, gram)
                segment = Rolling(values).spans(begin, begin + windows + window - 1)
                which = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(1).take(which), pa.array(begin - bounds[row]), pa.array(windows)]
                    + [pa.array(x.view(np.int64)) for x in (anchor, segment)],
                    names=[c.split()[0] for c in RUN.split(", ")],
                )

    return docs.mapInArrow(run, RUN)


def contents(segments: DataFrame, docs: DataFrame, items: Items, window: int) -> DataFrame:
    """anchor, segment, copies, hot and content (items) of each segment, from the row it names."""
    of_words = items(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0].dtype == np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            size = np.diff(np.asarray(wanted.offsets))
            for a, b, data, offsets in byte_slices(batch.column(0)):
                values, bounds = items(data, offsets)
                part = wanted.slice(a, b - a).flatten()
                row = np.repeat(np.arange(b - a), size[a:b])
                begin = np.asarray(part.field("begin")) + bounds[row]
                length = np.asarray(part.field("windows")) + window - 1
                flat = np.ascontiguousarray(values[ragged(begin, length)])
                ends = pa.array(np.append(0, np.cumsum(length)).astype(np.int32))
                if of_words:
                    content = pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))
                else:
                    content = pa.Array.from_buffers(pa.binary(), len(length), [None, ends.buffers()[1], pa.py_buffer(flat)])
                names = ["anchor", "segment", "copies", "hot"]
                yield pa.RecordBatch.from_arrays([*(part.field(n) for n in names), content], names=[*names, "content"])

    kind = "array<long>" if of_words else "binary"
    # the list is bounded by the length of one document
    asked = segments.select("at.*", "windows", "anchor", "segment", "copies", "hot").groupBy(
        F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key")
    ).agg(F.collect_list(F.struct("begin", "windows", "anchor", "segment", "copies", "hot")).alias("wanted"))
    # rows that agree in doc_id and text_key hold the same text
    texts = docs.join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")))
    found = texts.select("text", "wanted").mapInArrow(run, f"anchor long, segment long, copies long, hot boolean, content {kind}")
    return found.dropDuplicates(["anchor", "segment"])


def flat_content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All items of a content column, and the first item of every row and the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        values = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    else:
        ends = np.asarray(column.offsets)
        values = np.asarray(column.values)[ends[0] : ends[-1]].view(np.uint64)
    return values, (ends - ends[0]).astype(np.int64)


def spans_column(segment: np.ndarray, begin: np.ndarray, window: int, n: int) -> pa.Array:
    """For n segments the disjoint (b, e) spans that their windows at ``begin`` cover; sorted input."""
    first = np.ones(len(begin), bool)
    first[1:] = (segment[1:] != segment[:-1]) | (begin[1:] > begin[:-1] + window)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(begin))[: len(at)] - 1
    ends = np.searchsorted(segment[at], np.arange(n + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(begin[at]), pa.array(begin[last] + window)], names=["b", "e"])
    return pa.ListArray.from_arrays(pa.array(ends), spans)


SPANS = "anchor long, segment long, spans array<struct<b: long, e: long>>"


def edge_runs(items: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first item, number of windows, key, window hashes) of runs with equal anchors at both edges.

    The key hashes the smallest grams among the first and among the last third of a window, so
    windows that reach out of a common passage by more than a gram rarely share it.
    """
    row, at = window_starts(bounds, window)
    if not len(at):
        return row, at, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rolling = Rolling(items)
    edge = max(window // 3, 1)
    small = min(max(gram // 2, 1), edge)
    grams = rolling.grams(small)
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_minimum(ranked, edge - small + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    left, right = least[at], least[at + window - edge]
    new = np.ones(len(at), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    key = grams[left[first]] * np.uint64(0x9E3779B97F4A7C15) ^ grams[right[first]]
    return row[first], at[first], np.diff(np.append(first, len(at))), key, rolling.grams(window)[at]


PART = "anchor long, segment long, copies long, place long, edges long, part long, windows array<long>"


def split_anchors(found: DataFrame, window: int, gram: int) -> DataFrame:
    """``SPANS`` of the segments with one copy, of anchors with many segments.

    Segments are cut where an anchor at a window's edge changes. Parts whose edges occur once are
    dropped, equal parts are counted; only different parts with equal edges are compared
    window by window, by hashes of the whole windows, in one more count.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, segments, copies = (np.asarray(batch.column(i)) for i in range(3))
            values, ends = flat_content(batch.column(3))
            for lo in range(0, len(anchors), 2000):
                hi = min(lo + 2000, len(anchors))
                part_values, bounds = values[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                row, begin, n, key, whole = edge_runs(part_values, bounds, window, gram)
                part = Rolling(part_values).spans(begin, begin + n + window - 1)
                edges = mix(key + anchors[lo:hi][row].view(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(whole.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (anchors[lo:hi][row], segments[lo:hi][row], copies[lo:hi][row], begin - bounds[row])]
                    + [pa.array(edges.view(np.int64)), pa.array(part.view(np.int64)), lists],
                    names=[c.split()[0] for c in PART.split(", ")],
                )

    cuts = store(found.select("anchor", "segment", "copies", "content").mapInArrow(cut, PART))
    parts = cuts.groupBy("edges", "part").agg(F.sum("copies").alias("copies"), F.first("windows").alias("windows"))
    often = store(parts.groupBy("edges").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("different")).filter("n > 1").drop("n"))
    parts = store(parts.join(often.hint("merge"), "edges"))
    one = parts.filter("different > 1").select("edges", "part", "copies", F.posexplode("windows").alias("i", "whole"))
    twice = store(one.groupBy("edges", "whole").agg(F.sum("copies").alias("n")).filter("n > 1").select("edges", "whole"))
    # a segment has at most as many windows as a window has items
    some = one.filter("copies = 1").join(twice.hint("merge"), ["edges", "whole"], "left_semi").groupBy("edges", "part").agg(F.collect_list("i").alias("at"))
    every = parts.filter("copies > 1").select("edges", "part", F.sequence(F.lit(0), F.size("windows") - 1).alias("at"))
    # segments with more copies are covered as a whole
    hits = cuts.filter("copies = 1").select("anchor", "segment", "place", "edges", "part").join(store(some.unionByName(every)).hint("merge"), ["edges", "part"])

    def span(i):
        return F.struct((F.col("place") + i).alias("b"), (F.col("place") + i + window).alias("e"))

    return hits.select("anchor", "segment", F.transform("at", span).alias("s")).groupBy("anchor", "segment").agg(F.flatten(F.collect_list("s")).alias("spans"))


def repeated(docs: DataFrame, items: Items, window: int, gram: int, index: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """doc_id, text_key and ``spans``: the items of windows that start at two places or more.

    ``docs``: doc_id, text_key, text (see ``keyed``). ``index`` gets a shard of segments (anchor,
    segment, copies, content), all those of its anchors, and returns ``SPANS``: the windows of
    segments with one copy that other segments of the shard hold too. Rows that agree in
    doc_id and text_key give one result, and count as two places. The (b, e) spans may overlap.
    """
    spark = docs.sparkSession
    every = store(runs(docs, items, window, gram))
    # stored counts keep the joins open to skew handling
    anchors = store(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    open_runs = store(every.join(anchors.hint("merge"), "anchor"))
    segments = store(
        open_runs.groupBy("anchor", "segment").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key", "begin")).alias("at"), F.first("windows").alias("windows")
        )
    )
    several = store(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).filter("different > 1"))
    undecided = segments.join(several.hint("merge"), "anchor").withColumn("hot", F.col("different") > HOT_SEGMENTS)
    found = store(contents(undecided, docs, items, window))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * parts, found.count() // SHARD_SEGMENTS)
    by_shard = found.filter("not hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartition(parts, "shard")
    indexed = by_shard.groupBy("shard").applyInArrow(index, SPANS)
    part = indexed.unionByName(split_anchors(found.filter("hot"), window, gram)).filter(F.size("spans") > 0)
    marked = store(part)
    whole = segments.filter("copies > 1").select("anchor", "segment")
    all_of = F.array(F.struct(F.col("begin").alias("b"), (F.col("begin") + F.col("windows") + (window - 1)).alias("e")))
    moved = F.transform("spans", lambda s: F.struct((F.col("begin") + s.b).alias("b"), (F.col("begin") + s.e).alias("e")))
    hits = (
        open_runs.join(whole.hint("merge"), ["anchor", "segment"], "left_semi").select("doc_id", "text_key", "begin", all_of.alias("spans"))
    ).unionByName(
        open_runs.join(marked.hint("merge"), ["anchor", "segment"]).select("doc_id", "text_key", "begin", moved.alias("spans"))
    )
    once = hits.groupBy("doc_id", "text_key", "begin").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    # bounded by the length of one document
    return once.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text_key, text and spans (null: none) of every row."""
    named = spans.withColumnsRenamed({"doc_id": "s_id", "text_key": "s_key"})
    on = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key"))
    return docs.join(named.hint("merge"), on, "left").select("doc_id", "text_key", "text", "spans")


def covered(spans: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """For every item of the rows with these bounds whether a span of its row covers it."""
    size = np.diff(np.asarray(spans.offsets))
    size[np.asarray(spans.is_null())] = 0
    flat = spans.flatten()
    base = np.repeat(bounds[:-1], size)
    depth = np.zeros(bounds[-1] + 1, np.int32)
    np.add.at(depth, np.asarray(flat.field("b")) + base, 1)
    np.add.at(depth, np.asarray(flat.field("e")) + base, -1)
    return np.cumsum(depth[:-1]) > 0
