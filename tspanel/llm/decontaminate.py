"""Benchmark decontamination (operator 1) by spaced-seed hashing; DataFrame functions only.

A seed hashes eight of twelve consecutive words; each of three fixed masks ignores other
positions, so a substituted word spoils only the seeds that look at it. Documents and benchmark
items meet on equal seeds. A hit fixes how the item lies on the document; the words around
it are then compared one by one, substitutions allowed. Items shorter than a seed meet documents as
whole phrases.

What is found: every pair that shares a seed or a short item as a whole, in particular every pair with 12
consecutive equal words. Of 30-word items with random substitutions the seeds find about 0.99 at 20 %, 0.7 at 30 %,
0.3 at 40 % and 0.05 at 50 %; ``share`` says what is reported, not what is looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .sqltext import lowered, words
from .work import keyed, store

# fixed values: the positions that a seed looks at
SPAN = 12
MASKS = ((0, 1, 3, 4, 6, 8, 9, 11), (0, 2, 3, 5, 6, 7, 10, 11), (0, 1, 2, 5, 7, 8, 10, 11))
LOCAL = 16
#: Benchmark seeds are sent to all executors up to this number (24 bytes each); beyond it both sides are shuffled.
MOST_SENT = 1_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(words(lowered(text)), lambda w: F.xxhash64(w))


def placed(table: DataFrame, keys: list[str], hashes: str, place: str) -> DataFrame:
    """One row per seed: keys, seed, place.

    Twelve shifted copies of the hashes, zipped and exploded, give rows that generated code hashes;
    a function of an array index would be interpreted for each word.
    """
    shifted = [F.slice(hashes, o + 1, F.greatest(F.size(hashes), F.lit(1))).alias(f"c{o}") for o in range(SPAN)]
    rows = table.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias(place, "z")).filter(F.col(f"z.c{SPAN - 1}").isNotNull())
    each = [F.xxhash64(F.lit(number), *(F.col(f"z.c{o}") for o in mask)) for number, mask in enumerate(MASKS)]
    return rows.select(*keys, place, F.explode(F.array(*each)).alias("seed"))


def phrase(columns: list[Column], size: int) -> Column:
    """The seed of a whole item of ``size`` words."""
    return F.xxhash64(F.lit(-size), *columns[:size])


def phrases(table: DataFrame, keys: list[str], hashes: str, place: str, sizes: list[int]) -> DataFrame:
    """One row per place and size: keys, seed, place; the seeds of all runs of so many words."""
    shifted = [F.slice(hashes, o + 1, F.greatest(F.size(hashes), F.lit(1))).alias(f"c{o}") for o in range(max(sizes))]
    rows = table.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias(place, "z"))
    columns = [F.col(f"z.c{o}") for o in range(max(sizes))]
    each = [F.when(columns[n - 1].isNotNull(), phrase(columns, n)) for n in sizes]
    return rows.select(*keys, place, F.explode(F.array(*each)).alias("seed")).filter("seed IS NOT NULL")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, local: int = 13, shortest: int = 3) -> DataFrame:
    """One row per document and item that overlap: where, how many words agree, of how many.

    ``docs``: doc_id, text; ``benchmark``: item_id, text. Words are lower-case (A-Z) runs between
    ASCII white space. Reported are pairs in which, with the item laid on the document at one
    place, at least ``share`` of the item's words agree, or ``local`` of 16 consecutive ones.
    ``start`` is the word of the document on which the item's first word lies (negative if
    it lies before), at the best place, the first of equals. Items of ``shortest`` to 11 words are found
    where they stand as a whole; shorter ones say nothing and have no rows, like missing or empty ones. Rows
    that agree in doc_id and text, or items that agree in item_id and text, give one row.
    """
    items = store(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("t"))
        .select("item_id", F.xxhash64("t").alias("item_key"), word_hashes(F.col("t")).alias("item"))
        .dropDuplicates(["item_id", "item_key"])
    )
    seeds = placed(items, ["item_id", "item_key"], "item", "at").distinct()
    table = keyed(docs).select("doc_id", "text_key", word_hashes(F.col("text")).alias("h"))
    probes = placed(table, ["doc_id", "text_key"], "h", "place")
    size = F.size("item")
    short = items.filter(size.between(shortest, SPAN - 1))
    # eleven lengths at most
    sizes = sorted(r.n for r in short.select(size.alias("n")).distinct().collect())
    if sizes:
        whole = F.coalesce(*[F.when(size == n, phrase([F.col("item")[i] for i in range(n)], n)) for n in sizes])
        seeds = seeds.unionByName(short.select("item_id", "item_key", F.lit(0).alias("at"), whole.alias("seed")))
        probes = probes.unionByName(phrases(table, ["doc_id", "text_key"], "h", "place", sizes))
    theirs = store(seeds)
    seen = F.broadcast(theirs) if theirs.count() <= MOST_SENT else theirs
    hits = (
        probes.join(seen, "seed")
        .select("doc_id", "text_key", "item_id", "item_key", (F.col("place") - F.col("at")).alias("shift"))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("item_id", "item_key", "shift")).alias("hits"))  # bounded by the document's length times equal items
    )
    hits = store(hits).withColumnsRenamed({"doc_id": "h_id", "text_key": "h_key"})
    on = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key"))
    own = table.join(hits.hint("merge"), on).dropDuplicates(["doc_id", "text_key"])
    one = own.select("doc_id", "text_key", "h", F.explode("hits").alias("x")).select("doc_id", "text_key", "h", "x.*")
    item = items.withColumnsRenamed({"item_id": "i_id", "item_key": "i_key"})
    sized = F.broadcast(item) if item.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0] <= MOST_SENT else item
    pairs = one.join(sized, F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("item_key") == F.col("i_key")))
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("item"), F.size("h") - F.col("shift")) - 1
    agree = F.transform(F.sequence(first, last), lambda q: (F.col("h")[q + F.col("shift")] == F.col("item")[q]).cast("int"))
    summed = F.aggregate("agree", F.lit(0), lambda s, x: s + x)
    near = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("agree") - (LOCAL - 1))),
        lambda s: F.aggregate(F.slice("agree", s, LOCAL), F.lit(0), lambda t, x: t + x),
    )
    measured = pairs.select("doc_id", "text_key", "item_id", "item_key", "shift", F.size("item").alias("length"), agree.alias("agree"))
    measured = measured.select("doc_id", "text_key", "item_id", "item_key", "shift", "length", summed.alias("matched"), F.array_max(near).alias("best"))
    found = measured.filter((F.col("matched") >= share * F.col("length")) | (F.col("best") >= local))
    top = found.groupBy("doc_id", "text_key", "item_id", "item_key").agg(
        F.max(F.struct("matched", "best", (-F.col("shift")).alias("back"), "length")).alias("m"), F.count(F.lit(1)).alias("n_places")
    )
    return top.select(
        "doc_id", "text_key", "item_id",
        (-F.col("m.back")).cast("long").alias("start"),
        F.col("m.matched").cast("long").alias("matched"), F.col("m.length").cast("long").alias("length"), "n_places",
    )
