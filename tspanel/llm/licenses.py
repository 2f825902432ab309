"""License scan (operator 10): fixed phrases, and an exact set-similarity join with templates.

Blocks are windows of a text's words, over line breaks and comment marks, as sets. With c the number of
words of a template, rounded up to a power of two, its blocks have 2c words and start at every
c-th word, so that every stretch of c words lies in one. A block meets a template when it holds at
least ``percent`` of the template's distinct words. All words of the templates are put in order of
the number of texts that hold them, rare ones first; a block that meets a template must hold one of the
template's first words (prefix filter), enough words (length filter), and enough words behind the
first common one (positional filter). Candidates are verified. Texts without a first word are
not cut into blocks. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .sqltext import lowered, words
from .work import keyed, store

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# fixed values: phrases and labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: license notices and the labels they give
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}


def needed(size: int, percent: int) -> int:
    return -(-size * percent // 100)


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def may_hold(text: Column, phrase: str) -> Column:
    """Cheap tests that every text with the phrase passes, plain ones before the pattern."""
    parts = phrase.split()
    plain = F.lit(True)
    for part in parts:
        plain = plain & text.contains(part)
    return plain & text.rlike(SEPARATORS.join(parts))


def places(may: Column, phrase: str) -> Column:
    """Word numbers at which the phrase starts, in the words of column ``w``."""
    parts = phrase.split()

    def at(i: Column) -> Column:
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & F.coalesce(F.get(F.col("w"), i + k) == part, F.lit(False))
        return same

    return F.when(may, F.filter(F.sequence(F.lit(0), F.size("w")), at)).otherwise(F.array().cast("array<int>"))


# The words of all templates together; they are broadcast, and their frequencies collected.
MAX_TEMPLATE_WORDS = 20_000


def template_labels(table: DataFrame, templates: Mapping[str, str], percent: int) -> DataFrame:
    """(doc_id, text_key, method_labels, containment) of the rows of (doc_id, text_key, low) with a block that meets a template."""
    spark = table.sparkSession
    if sum(len(t.split()) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words: scan them in parts")
    sets = [(label, len(t.split()), sorted(set(t.split()))) for t, label in templates.items()]
    vocabulary = sorted({w for _, _, s in sets for w in s})
    known = F.array(*map(F.lit, vocabulary))
    texts = table.select("doc_id", "text_key", words(F.col("low"), SEPARATORS).alias("w"))
    seen = texts.select(F.explode(F.array_intersect("w", known)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r.word: r.n for r in seen.collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    rows, first, least = [], {}, {}
    for number, (label, length, s) in enumerate(sets):
        ranked = sorted(s, key=order.get)
        must = needed(len(ranked), percent)
        step = 1 << (length - 1).bit_length()
        first.setdefault(step, set()).update(ranked[: len(ranked) - must + 1])
        least[step] = min(least.get(step, must), must)
        rows += [(number, label, step, w, i, len(ranked), must, i <= len(ranked) - must) for i, w in enumerate(ranked)]
    wanted = F.broadcast(spark.createDataFrame(rows, "template int, label string, step int, word string, place int, size int, must int, prefix boolean"))
    ranks = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))

    def blocks(step: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))
        cut = F.transform(starts, lambda i: F.struct(F.lit(step).alias("step"), i.alias("at"), F.array_intersect(F.slice("w", i + 1, 2 * step), known).alias("held")))
        may = F.arrays_overlap("w", F.array(*map(F.lit, sorted(first[step]))))
        return F.when(may, F.filter(cut, lambda x: F.size(x["held"]) >= least[step])).otherwise(F.slice(cut, 1, 0))

    some = texts.filter(F.arrays_overlap("w", F.array(*map(F.lit, sorted(set().union(*first.values()))))))
    cut = some.select("doc_id", "text_key", F.explode(F.concat(*map(blocks, sorted(first)))).alias("b"))
    ranked = F.array_sort(F.transform("b.held", lambda x: F.struct(ranks[x].alias("r"), x.alias("word"))))
    each = cut.select("doc_id", "text_key", "b.step", "b.at", F.size("b.held").alias("n"), F.posexplode(ranked).alias("j", "x"))
    joined = each.select("doc_id", "text_key", "step", "at", "n", "j", F.col("x.word").alias("word")).join(wanted, ["word", "step"])
    # a row per common word; a candidate has one in the prefix, with enough room behind it
    room = F.col("prefix") & (1 + F.least(F.col("size") - F.col("place") - 1, F.col("n") - F.col("j") - 1) >= F.col("must"))
    met = joined.groupBy("doc_id", "text_key", "at", "template").agg(
        F.max(room).alias("candidate"), F.countDistinct("word").alias("common"),
        F.first("label").alias("label"), F.first("size").alias("size"), F.first("must").alias("must"),
    ).filter("candidate AND common >= must")
    return met.groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("method_labels"), F.max(F.col("common") / F.col("size")).alias("containment")
    )


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    Words are runs of digits, letters a-z (after A-Z are made small) and characters beyond ASCII. ``n_base`` counts the
    places of all phrases, ``first_word`` and ``last_word`` are the smallest and largest of their
    starts. ``labels`` adds the labels of templates of which a block holds ``percent`` or more. The
    score is 1 with a phrase, else the largest share of a template found, else 0. A missing or
    empty text has no words and no labels; label lists are then empty strings.
    """
    table = keyed(docs).select("doc_id", "text_key", lowered(F.col("text")).alias("low"))
    held = table.select(
        "doc_id", "text_key", F.regexp_count("low", F.lit(f"{WORD}+")).cast("long").alias("n_words"), "low",
        *(may_hold(F.col("low"), p).alias(f"h{i}") for i, p in enumerate(phrases)),
    )
    # only texts with a phrase are cut in words
    some = F.greatest(*(F.col(f"h{i}") for i in range(len(phrases))), F.lit(False))
    held = held.withColumn("w", F.when(some, words(F.col("low"), SEPARATORS)).otherwise(F.array().cast("array<string>")))
    base = held.select("doc_id", "text_key", "n_words", *(places(F.col(f"h{i}"), p).alias(f"p{i}") for i, p in enumerate(phrases)))
    all_of = F.concat(*(F.col(f"p{i}") for i in range(len(phrases))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    base = base.select("doc_id", "text_key", "n_words", all_of.alias("at"), labels.alias("own"))
    more = template_labels(table, templates, percent).withColumnsRenamed({"doc_id": "m_id", "text_key": "m_key"})
    on = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key"))
    out = base.join(store(more).hint("merge"), on, "left")
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union("own", F.coalesce("method_labels", none)))
    score = F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select(
        "doc_id", "text_key", "n_words", F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"),
    )
