"""Quality rules (operator 8): word and line counts, and distances to a language's usual text.

The reference of a language holds the shares of character classes and of its most frequent
words over all documents of that language. A document whose shares are far from the reference
by Jensen-Shannon distance is rejected, if it is long enough for its shares to mean something.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .text import Rolling, _SPACE, byte_slices, lower, mix, rows_of, word_spans
from .work import store

# fixed values: the rules given for every document
MIN_WORDS, REPEAT_PERCENT, WINDOW, SYMBOLS = 20, 30, 8, b"#*$%&|<>"


#: Languages whose counts every task holds, about two kilobytes each.
KEPT_LANGUAGES = 500


@dataclass(frozen=True)
class Limits:
    """Distances in [0, 1]; a document is only compared from so many characters or words on."""

    class_distance: float = 0.33
    class_min_bytes: int = 200
    word_distance: float = 0.50
    word_min_words: int = 50
    top_words: int = 64


_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
#: Classes of bytes: small and capital letters, digits, white space, points, symbols, other ASCII, beyond ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[_SPACE] = 3
_CLASS[list(b".,;:!?'\"-()")] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[128:] = 7
N_CLASSES = 8

REFERENCE = "lang string, kind int, item long, n long"
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, class_distance double, word_distance double"
)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the flags of each row."""
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[offsets])


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, hashes: Rolling) -> np.ndarray:
    """Per row, lines with a word that equal an earlier line of the row."""
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    end = np.minimum(np.append(begin[1:], len(data)), len(data))
    row = np.searchsorted(offsets, begin, "right") - 1
    end -= data[end - 1] == 10
    words = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, row = begin[words], end[words], row[words]
    key = mix(hashes.spans(begin, end) + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return np.bincount(row[~first], minlength=len(offsets) - 1)


def repeated_words(words: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Per row, words in windows that the row holds twice or more."""
    n, row = len(bounds) - 1, rows_of(bounds)
    grams = Rolling(words).grams(window)
    inside = row[: len(grams)] == row[window - 1 : window - 1 + len(grams)]
    at = np.flatnonzero(inside)
    key = mix(grams[at] + row[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[number] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    return np.bincount(rows_of(offsets) * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p to q; both hold shares."""
    m = (p + q) / 2

    def part(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=-1)

    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def references(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per language: counts of the classes, and the most frequent words (hashes) with counts.

    Words are counted in lower case over all documents; ties at the end of the list fall to the
    smaller hash. A missing language is a language of its own, the empty name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), object)
            for a, b, data, offsets in byte_slices(batch.column(1)):
                data = np.asarray(data)
                starts, ends, bounds = word_spans(data, offsets)
                hashes = Rolling(lower(data)).spans(starts, ends)
                of_row, row, classes = langs[a:b], rows_of(bounds), class_counts(data, offsets)
                for lang in set(of_row):
                    mine = of_row == lang
                    words, n = np.unique(hashes[mine[row]], return_counts=True)
                    item = np.concatenate([np.arange(N_CLASSES), [0], words.view(np.int64)])
                    kind = np.repeat([0, 1, 2], [N_CLASSES, 1, len(words)])
                    count = np.concatenate([classes[mine].sum(axis=0), [n.sum()], n])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(item), pa.string()), pa.array(kind, pa.int32()), pa.array(item), pa.array(count)],
                        names=["lang", "kind", "item", "n"],
                    )

    table = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = table.mapInArrow(run, REFERENCE).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= max(limits.top_words, N_CLASSES))
    return store(
        top.filter((F.col("kind") < 2) | (F.col("rank") <= limits.top_words))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("kind", "item", "n"))).alias("reference"))  # bounded by top_words
    )


def measured(docs: DataFrame, carry: list[str], reference: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``row`` (a struct of the columns to carry) and the measures of every document.

    A missing or empty text has no words and fails. Distances are null for texts that are too
    short to compare, or without a reference; then they don't count against a text.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    columns = [F.struct(*carry).alias("row"), lang.alias("lang")]
    # a text that is carried goes to Python once
    inside = "text" in carry
    table = docs.select(*columns) if inside else docs.select(*columns, F.coalesce("text", F.lit("")).alias("text"))
    row_type = table.schema["row"].dataType.simpleString()
    some = reference.limit(KEPT_LANGUAGES + 1).collect()
    fixed = {r.lang: reference_of(r.reference, limits) for r in some}
    if len(some) > KEPT_LANGUAGES:
        # too many languages for every task to hold: rows bring the counts of theirs
        fixed = None
        table = table.join(reference, "lang", "left").select(*[c for c in ("row", "lang", "text") if c in table.columns], "reference")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column(1).to_pylist(), object)
            known = {lang: fixed.get(lang) for lang in set(langs)} if fixed is not None else {
                lang: reference_of(batch.column("reference")[int(np.argmax(langs == lang))].as_py(), limits) for lang in set(langs)
            }
            texts = batch.column(0).field("text") if inside else batch.column("text")
            for a, b, data, offsets in byte_slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *measures(data, offsets, langs[a:b], known, limits)],
                    names=["row", *(c.split()[0] for c in MEASURES.split(","))],
                )

    return table.mapInArrow(run, f"row {row_type}, {MEASURES}")


def reference_of(items: list[dict] | None, limits: Limits) -> tuple | None:
    if not items:
        return None
    classes = np.zeros(N_CLASSES)
    for x in items:
        if x["kind"] == 0:
            classes[x["item"]] = x["n"]
    total = next(x["n"] for x in items if x["kind"] == 1)
    words = sorted((x["item"], x["n"]) for x in items if x["kind"] == 2)
    counts = np.array([n for _, n in words] + [total - sum(n for _, n in words)], float)
    return shares(classes), np.array([w for w, _ in words], np.int64), shares(counts)


def measures(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, known: dict, limits: Limits) -> list[pa.Array]:
    starts, ends, bounds = word_spans(data, offsets)
    raw = Rolling(data)
    words = raw.spans(starts, ends)
    n_words = np.diff(bounds)
    repeats = repeated_words(words, bounds, WINDOW)
    base_failed = (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
    class_d, word_d = np.full(len(n_words), np.nan), np.full(len(n_words), np.nan)
    row, folded = rows_of(bounds), Rolling(lower(data)).spans(starts, ends).view(np.int64)
    classes = class_counts(data, offsets)
    for lang in set(langs):
        if (reference := known[lang]) is None:
            continue
        of_class, top, of_word = reference
        mine = langs == lang
        at = np.flatnonzero(mine & (np.diff(offsets) >= limits.class_min_bytes))
        class_d[at] = js_distance(shares(classes[at]), of_class)
        at = np.flatnonzero(mine & (n_words >= limits.word_min_words))
        if len(at) and len(top):
            number = np.full(len(mine), -1)
            number[at] = np.arange(len(at))
            pick = number[row] >= 0
            place = np.searchsorted(top, folded[pick])
            place = np.where(top[np.minimum(place, len(top) - 1)] == folded[pick], np.minimum(place, len(top) - 1), len(top))
            counts = np.bincount(number[row[pick]] * (len(top) + 1) + place, minlength=len(at) * (len(top) + 1))
            word_d[at] = js_distance(shares(counts.reshape(len(at), -1)), of_word)
    kept = ~base_failed & ~(class_d > limits.class_distance) & ~(word_d > limits.word_distance)
    counts = [
        n_words,
        per_row(((data & 0xC0) != 0x80) & ~_SPACE[data], offsets),
        per_row(_IS_SYMBOL[data], offsets),
        duplicate_lines(data, offsets, starts, raw),
        repeats,
    ]
    return [
        *(pa.array(c.astype(np.int64)) for c in counts),
        pa.array(base_failed),
        pa.array(kept),
        *(pa.array(d, mask=np.isnan(d)) for d in (class_d, word_d)),
    ]


def quality_rules(docs: DataFrame, carry: list[str], limits: Limits = Limits()) -> DataFrame:
    """``row`` with the carried columns, the measures and ``kept`` for every row of ``docs`` (text, lang)."""
    return measured(docs, carry, references(docs, limits), limits)
