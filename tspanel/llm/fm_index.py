"""Substring dedup of word windows (operator 6) with an FM-index per shard.

A shard holds the segments of its anchors (see ``anchors``). Its text, all segments with a
separator after each, gets a suffix order, the Burrows-Wheeler transform in a wavelet tree of packed
bit vectors, and running sums of the segments' copies in suffix order. Segments are then
streamed against the index: backward search extends a match to the left until fewer than two
places hold it, which gives the matching statistics; matches of a window or more are reported as
intervals, and the search goes on where the next window could end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import covered, flat_content, repeated, with_spans
from .text import Rolling, byte_slices, ragged, word_spans
from .work import keyed

WINDOW, GRAM = 35, 8


class WaveletTree:
    """Rank queries on a sequence; one packed bit vector per bit of the symbols, highest first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            packed = np.zeros(-(-(len(bit) + 1) // 64) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((words, np.cumsum(counts) - counts, len(bit) - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the sequence ends up on the way down to the symbol."""
        for b, (words, ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            w = at >> 6
            rank = ones[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> b & 1, zeros + rank, at - rank)
        return at


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes sorted by their first ``depth`` symbols at least, and the ranks by 1, 2, 4, ... symbols."""
    rank, k, ranks = text.astype(np.int64), 1, {}
    n = len(text)
    while True:
        ranks[k] = rank
        if k >= depth:
            return np.argsort(rank, kind="stable"), ranks
        later = np.zeros(n, np.int64)
        later[:-k] = rank[k:] + 1
        rank = np.unique(rank * (rank.max() + 2) + later, return_inverse=True)[1]
        k *= 2


class FMIndex:
    """``text``: symbols from 1 on, 0 between segments. ``weights``: copies of each place."""

    def __init__(self, text: np.ndarray, weights: np.ndarray, depth: int):
        self.text = text
        order, self.ranks = suffix_order(text, depth)
        symbols = int(text.max()) + 1
        self.tree = WaveletTree(text[order - 1], symbols.bit_length())
        self.first = np.searchsorted(text[order], np.arange(symbols))
        self.base = self.tree.descend(np.arange(symbols), np.zeros(symbols, np.int64))
        self.copies = np.append(0, np.cumsum(weights[order]))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with the symbol and go on like those of the given intervals."""
        both = self.tree.descend(np.tile(symbols, 2), np.concatenate([low, high]))
        both += np.tile(self.first[symbols] - self.base[symbols], 2)
        return both[: len(low)], both[len(low) :]

    def matches(self, starts: np.ndarray, stops: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, begin, end) of maximal stretches of at least ``window`` symbols, within
        text[start:stop] of each query, that two places or more hold."""
        query, end = np.arange(len(starts)), stops.copy()
        low, high, length = np.zeros(len(query), np.int64), np.full(len(query), len(self.text)), np.zeros(len(query), np.int64)
        out = []
        while len(query):
            low, high = self.extend(self.text[end - 1 - length], low, high)
            fits = self.copies[high] - self.copies[low] >= 2
            length = length + fits
            over = ~fits | (end - length == starts[query])
            found = over & (length >= window)
            out.append((query[found], (end - length)[found], end[found]))
            # a window with the symbol that did not fit ends before what was matched so far
            end = np.where(over, np.minimum(end - 1, end - 1 - length + window), end)
            low, high, length = np.where(over, 0, low), np.where(over, len(self.text), high), np.where(over, 0, length)
            go = ~(over & fits) & (end - starts[query] >= window)
            query, end, low, high, length = query[go], end[go], low[go], high[go], length[go]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (query, query, query)


def index_shard(window: int):
    def index(table: pa.Table) -> pa.Table:
        """Intervals of the segments with one copy that the shard holds elsewhere too."""
        values, ends = flat_content(table.column("content"))
        copies, n = np.asarray(table.column("copies")), table.num_rows
        size = np.diff(ends)
        begin = ends[:-1] + np.arange(n)
        text = np.zeros(len(values) + n, np.int64)
        text[ragged(begin, size)] = np.unique(values, return_inverse=True)[1] + 1
        weights = np.repeat(copies, size + 1)
        fm = FMIndex(text, weights, 2 * window)
        # windows with a gram that no other place holds need no search
        gram = 1 << (window // 4).bit_length() - 1
        rare = np.append(0, np.cumsum(np.bincount(fm.ranks[gram], weights)[fm.ranks[gram]] < 2))
        single = np.flatnonzero(copies == 1)
        counts = np.maximum(size[single] - window + 1, 0)
        at, segment = ragged(begin[single], counts), np.repeat(single, counts)
        alive = rare[at + window - gram + 1] == rare[at]
        at, segment = at[alive], segment[alive]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])
        head = np.flatnonzero(first)
        last = np.append(head[1:], len(at))[: len(head)] - 1
        query, low, high = fm.matches(at[head], at[last] + window, window)
        segment = segment[head][query]
        order = np.lexsort((low, segment))
        segment, low, high = segment[order], low[order] - begin[segment[order]], high[order] - begin[segment[order]]
        found = np.unique(segment)
        spans = pa.StructArray.from_arrays([pa.array(low), pa.array(high)], names=["b", "e"])
        bounds = pa.array(np.append(np.searchsorted(segment, found), len(segment)).astype(np.int32))
        return pa.table(
            {
                "anchor": table.column("anchor").take(pa.array(found)),
                "segment": table.column("segment").take(pa.array(found)),
                "spans": pa.ListArray.from_arrays(bounds, spans),
            }
        )

    return index


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = word_spans(data, offsets)
    return Rolling(data).spans(starts, ends), bounds


def kept_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, spans of words) to n_words, n_removed and the kept words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(2)):
                starts, ends, bounds = word_spans(data, offsets)
                kept = ~covered(batch.column(3).slice(a, b - a), bounds)
                total = np.append(0, np.cumsum(kept))[bounds]
                size = (ends - starts + 1)[kept]
                at = ragged(starts[kept], size)
                out = np.append(data, np.uint8(32))[at]
                stop = np.cumsum(size)
                out[stop - 1] = 32
                last = np.zeros(len(out), bool)
                end_of_row = total[1:][np.diff(total) > 0]
                last[stop[end_of_row - 1] - 1] = True
                length = np.append(0, np.cumsum(~last))[np.append(0, stop)][total]
                text = pa.LargeStringArray.from_buffers(
                    b - a, pa.py_buffer(length.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[~last]))
                ).cast(pa.string())
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(n - np.diff(total)), text],
                    names=["doc_id", "text_key", "n_words", "n_removed", "kept_text"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key long, n_words long, n_removed long, kept_text string")


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, kept_text for every row of ``docs`` (doc_id, text).

    Removes each word that lies in a window of ``window`` words whose sequence also starts
    anywhere else, in another row or the same. Windows are judged on the input. A missing or
    empty text has no words; repeated rows repeat all their windows.
    """
    table = keyed(docs)
    return kept_words(with_spans(table, repeated(table, words_of, window, gram, index_shard(window))))
