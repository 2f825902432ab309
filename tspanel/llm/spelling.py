"""Spelling variants: words that differ by one code point, found through pivotal grams.

The search follows the pivotal prefix filter (Deng, Li and Feng 2014) for one edit. Bigrams are ordered
by how few words hold them. A word's *prefix* is its three rarest bigrams (with all that tie with the
third), its *pivots* two disjoint bigrams of the prefix of least total frequency, chosen by dynamic
programming. One edit spoils at most one of two disjoint bigrams, so of two near words the one whose
prefix ends earlier in the order has a pivot in the prefix of the other, moved by one position at most.

Beside an intact pivot the single edit lies on one side. So the whole text on the pivot's other side is
the same in both words, and on the edit's side either the first or the last half is. The former goes
into the join key with both lengths; where it is short, so that many words share it, one of the halves
goes in as well. Joined words are compared by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .sqltext import lowered
from .text import Rolling, byte_slices, mix, rows_of
from .work import store

#: Runs of letters: the letters of the alphabet bound the number of different bigrams (90 squared).
RUNS = "([A-Za-zÀ-ÿ]+)"
GRAMS_KEPT = 3
#: Code points of common text from which a key needs no further part.
LONG_ENOUGH = 5
KEYS = "key long, word string, last int"


def damaged_words(docs: DataFrame, modulus: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters with reproducible misspellings, counted.

    With h the crc32 of ``<doc_id>:<run>``, a run loses its code point h % length where ``modulus``
    divides h. Words have ``shortest`` code points and ``least`` occurrences or more. A missing text has
    no words; a missing doc_id counts as an empty one; repeated rows count again.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(RUNS), F.lit(1))).alias("run"),
    )
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    size = F.length("run")
    at = (h % size).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    words = runs.filter(size >= shortest).withColumn("h", h).withColumn("at", at)
    words = words.select(F.when(F.col("h") % modulus == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def chosen_pivots(places: list[int], weights: list[int], count: int = 2, width: int = 2) -> list[int]:
    """Indices of ``count`` grams that do not overlap with the least total weight; places ascend.

    Dynamic programming: the best choice of c grams among the first i either leaves gram i out or takes
    it with the best c - 1 among those that end before it.
    """
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * count]
    for i, (place, weight) in enumerate(zip(places, weights)):
        free = i
        while free and places[free - 1] > place - width:
            free -= 1
        row = [(0, ())]
        for c in range(1, count + 1):
            without, before = best[i][c], best[free][c - 1]
            taken = None if before is None else (before[0] + weight, (*before[1], i))
            row.append(min((x for x in (without, taken) if x), default=None))
        best.append(row)
    return list(best[-1][count][1])


def gram_keys(words: DataFrame, frequency: dict[str, int], pivots: bool) -> DataFrame:
    """The join keys of every word's pivots, or of its whole prefix; ``last`` is where its prefix ends."""
    order = sorted(frequency, key=lambda g: (frequency[g], g))
    codes = np.array([(ord(g[0]) << 21) | ord(g[1]) for g in order], np.int64)
    by_code = np.argsort(codes)
    weight_of = [frequency[g] for g in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(0)):
                points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
                # first code point of every word: those before it that start in the bytes
                starts = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
                size = np.diff(starts)
                row = rows_of(np.append(0, np.cumsum(size - 1)))
                place = np.arange(len(row)) - np.append(0, np.cumsum(size - 1))[row]
                at = starts[row] + place
                rank = by_code[np.searchsorted(codes, (points[at] << 21) | points[at + 1], sorter=by_code)]
                sort = np.lexsort((place, rank, row))
                first = np.append(0, np.cumsum(size - 1))[:-1]
                last = rank[sort][first + GRAMS_KEPT - 1]
                kept = np.flatnonzero(rank <= last[row])
                row, place, rank = row[kept], place[kept], rank[kept]
                if pivots:
                    bounds, taken = np.searchsorted(row, np.arange(b - a + 1)), []
                    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                        weights = [weight_of[r] for r in rank[x:y].tolist()]
                        taken += [x + i for i in chosen_pivots(place[x:y].tolist(), weights)]
                    row, place = row[taken], place[taken]
                texts, rolling = batch.column(0).slice(a, b - a), Rolling(points)
                for key, which in _keys(rolling, starts[row], starts[row] + size[row], starts[row] + place, pivots):
                    columns = [pa.array(key.view(np.int64)), texts.take(pa.array(row[which])), pa.array(last[row[which]].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in KEYS.split(", ")])

    return words.select("word").mapInArrow(run, KEYS)


def _keys(rolling: Rolling, begin: np.ndarray, end: np.ndarray, gram: np.ndarray, pivots: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, indices) of grams in words from ``begin`` to ``end``, towards words of all three lengths.

    The pair of lengths names the pivot holder's first.
    """
    for other in (-1, 0, 1):
        mine, theirs = end - begin, end - begin + other
        lengths = ((mine << 32) | theirs if pivots else (theirs << 32) | mine).astype(np.uint64)
        for side in (0, 1):
            # side 0: equal up to the gram's end, the edit lies in the rest; side 1: the mirror image
            same = (begin, gram + 2) if side == 0 else (gram, end)
            rest = (gram + 2, end) if side == 0 else (begin, gram)
            common = rest[1] - rest[0] + min(other, 0)
            weak = (same[1] - same[0] < LONG_ENOUGH) & (common >= 2)
            head = mix(rolling.spans(*same) + lengths * np.uint64(0x9E3779B97F4A7C15))
            half = common // 2
            for part, use in enumerate((~weak & (common >= 0), weak, weak)):
                which = np.flatnonzero(use)
                key = head[which]
                if part == 1:
                    key = mix(key + rolling.spans(rest[0][which], rest[0][which] + half[which]))
                elif part == 2:
                    key = mix(key - rolling.spans(rest[1][which] - (common - half)[which], rest[1][which]))
                yield mix(key + np.uint64(3 * side + part)), which


def near_words(words: DataFrame) -> DataFrame:
    """``(a, b)``, both ways: pairs of different words at distance one. Words have 4 code points at least."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"), "word")
    # at most the square of the alphabet's size, whatever the number of words
    frequency = {r.gram: r.n for r in grams.distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = gram_keys(words, frequency, True).select("key", F.col("word").alias("a"), F.col("last").alias("end_a"))
    right = gram_keys(words, frequency, False).select("key", F.col("word").alias("b"), F.col("last").alias("end_b"))
    close = (F.col("a") != F.col("b")) & (F.col("end_a") <= F.col("end_b")) & (F.levenshtein("a", "b", 1) == 1)
    # both sides hold tens of rows per word; Spark sizes them by the files of the words and would broadcast one
    pairs = left.join(right.hint("merge"), (left.key == right.key) & close)
    pairs = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return pairs.union(pairs.select("b", "a"))


def spelling_groups(words: DataFrame, factor: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for a table ``(word, n)`` of distinct words.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is
    ``factor`` times the word's at least. The root is where the forms lead. No words give no rows; other
    columns play no part.
    """
    words = store(words.select("word", "n"))
    linked = near_words(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")).hint("merge"), "b")
    best = linked.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("top")
    )
    strong = -F.col("top.less") >= factor * F.col("n")
    table = store(
        words.join(best.hint("merge"), "word", "left").select(
            "word", F.when(strong, F.col("top.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, -F.col("top.less")).alias("form_n"),
        )
    )
    # n grows along the forms, so there are no circles; pointers double their reach each round
    roots = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = store(roots.join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return table.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
