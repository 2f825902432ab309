"""Near-duplicates by b-bit MinHash (operator 2).

1. Every text becomes its set of 5-word shingles, and the set a signature: the two low bits
   of each of 504 minima, packed in sixteen 64-bit words. The first 252, six at a time, also give
   42 band hashes. Equal sets are one class from here on, however many rows they have.
2. Classes with a common band hash are candidates. Each bucket has a centre, the member with
   the largest number of such meetings; members are first compared with their centres only.
3. Bit counts of two signatures estimate the similarity, corrected for the quarter of low
   bits that agree by chance. Pairs more than ``SLACK`` standard deviations below the
   threshold are dropped; the others are confirmed on the full sets.
4. Confirmed links give components. Buckets that still hold several components are compared
   in full, member against member of other components, in blocks of bounded size. So no link
   between candidates is left out, while a group of copies around one text costs one
   comparison per copy.

A pair at the threshold shares no band with probability 0.623^42 = 2e-9, and falls below the
estimate's slack with less than 4e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .text import Rolling, byte_slices, lower, mix, rows_of, word_spans
from .work import keyed, store

SHINGLE, BANDS, ROWS, BITS = 5, 42, 6, 2
MINIMA, WORDS = 2 * BANDS * ROWS, 16
SLACK = 4.0
BLOCK_MEMBERS = 1024
SIGNED = "doc_id long, text_key long, n_shingles long, k1 long, k2 long, signature array<long>, bands array<long>"

_r = np.random.default_rng(20240229)
_XOR = _r.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_TIMES = _r.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every row, in row order.

    Words are in lower case (A-Z only). A row with fewer than five words has one shingle, all
    of it; a row without words has none.
    """
    data = lower(np.asarray(data))
    starts, ends, bounds = word_spans(data, offsets)
    rolling = Rolling(Rolling(data).spans(starts, ends))
    n = np.diff(bounds)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), counts)
    first = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[row]
    value = rolling.spans(first, np.minimum(first + SHINGLE, bounds[row + 1]))
    at = np.sort(np.unique(mix(value + row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), return_index=True)[1])
    return row[at], value[at]


def signed(docs: DataFrame) -> DataFrame:
    """Set size, set key (two sums over the set), packed signature and band hashes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(2)):
                row, value = shingles(data, offsets)
                n = np.bincount(row, minlength=b - a)
                some = np.flatnonzero(n)
                low, bands = np.zeros((len(some), WORDS), np.uint64), np.zeros((len(some), BANDS), np.uint64)
                keys = np.zeros((2, b - a), np.uint64)
                if len(some):
                    begin = np.searchsorted(row, some)
                    for k, x in enumerate((value, mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
                        keys[k, some] = np.add.reduceat(x, begin)
                    small = (value >> np.uint64(32)).astype(np.uint32)
                    for i in range(MINIMA):
                        minima = np.minimum.reduceat((small ^ _XOR[i]) * _TIMES[i], begin).astype(np.uint64)
                        low[:, i // 32] |= ((minima >> np.uint64(3)) & np.uint64(3)) << np.uint64(2 * (i % 32))
                        if (band := i // ROWS) < BANDS:
                            bands[:, band] = mix(bands[:, band] * np.uint64(0x9E3779B97F4A7C15) + minima + np.uint64(band + 1))
                sizes = np.zeros(b - a, np.int64)
                sizes[some] = 1
                at = np.append(0, np.cumsum(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(n.astype(np.int64)),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array((at * WORDS).astype(np.int32)), pa.array(low.reshape(-1).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array((at * BANDS).astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64))),
                    ],
                    names=[c.split()[0] for c in SIGNED.split(", ")],
                )

    return keyed(docs).mapInArrow(run, SIGNED)


def sets_of(texts: DataFrame) -> DataFrame:
    """(node, text) to (node, hashes of its distinct shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(1)):
                row, value = shingles(data, offsets)
                ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))],
                    names=["node", "members"],
                )

    return texts.mapInArrow(run, "node long, members array<long>")


def mismatches(a: Column, b: Column) -> Column:
    """Number of minima whose low bits differ."""
    fives = F.lit(0x5555555555555555)

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(fives)).cast("int")

    return F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)


def most_mismatches(percent: int) -> int:
    """Mismatches that a pair at the threshold stays within, but for SLACK standard deviations."""
    chance = 1 / (1 << BITS)
    agree = chance + (1 - chance) * percent / 100
    return int(np.ceil(MINIMA * (1 - agree) + SLACK * np.sqrt(MINIMA * agree * (1 - agree))))


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link."""
    for side in ("a", "b"):
        pairs = pairs.join(
            classes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}")), side
        )
    return pairs.filter(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (mismatches(F.col("s_a"), F.col("s_b")) <= most_mismatches(percent))
    ).select("a", "b", "n_a", "n_b")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are links on their full sets."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = classes.join(needed, "node", "left_semi").select("node", F.col("rep.doc_id").alias("w_id"), F.col("rep.text_key").alias("w_key"))
    texts = keyed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")))
    sets = store(sets_of(texts.select("node", "text")).groupBy("node").agg(F.first("members").alias("members")))
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("members").alias(f"m_{side}")), side)
    common = F.size(F.array_intersect("m_a", "m_b"))
    return (
        pairs.select("a", "b", "n_a", "n_b", common.alias("common"))
        .filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))
        .select("a", "b")
    )


def between_components(members: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) of different components within the buckets.

    ``members``: bucket, size, node, label, n_shingles, signature, bands. A bucket of many members is
    cut in blocks by a hash of the node; each pair of blocks is a group of its own, of
    at most about 2 * BLOCK_MEMBERS members.
    """
    limit = most_mismatches(percent)
    schema = "a long, b long"

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        node, label, n = group["node"].to_numpy(), group["label"].to_numpy(), group["n_shingles"].to_numpy()
        side = group["side"].to_numpy()
        bits = np.stack(group["signature"].to_numpy()).astype(np.int64).view(np.uint64)
        bands, bucket = np.stack(group["bands"].to_numpy()).astype(np.int64), group["bucket"].iloc[0]
        left = np.flatnonzero(side <= 1)
        right = np.flatnonzero(side != 1)
        found = []
        for i in range(0, len(left), 64):
            x = left[i : i + 64]
            apart = np.zeros((len(x), len(right)), np.uint16)
            for w in range(WORDS):
                z = bits[x, w][:, None] ^ bits[right, w]
                apart += np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555))
            near = (apart <= limit) & (label[x][:, None] != label[right])
            near &= 100 * np.minimum(n[x][:, None], n[right]) >= percent * np.maximum(n[x][:, None], n[right])
            p, q = np.nonzero(near)
            p, q = x[p], right[q]
            # a pair that meets in several buckets is reported in the first of its common bands
            first = np.argmax(bands[p] == bands[q], axis=1)
            own = bands[p, first] == bucket
            p, q = node[p[own]], node[q[own]]
            found.append((np.minimum(p, q), np.maximum(p, q)))
        if not found:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])}).drop_duplicates()

    blocks = F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # side 0: within one block; 1 and 2: the two blocks of a pair
    tiles = (
        members.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
    )
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(parts, "bucket", "low", "high").groupBy("bucket", "low", "high").applyInPandas(compare, schema).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, group and kept for every row of ``docs`` (doc_id, text).

    Rows are linked when 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the smallest doc_id that links lead to, ``kept`` says that it is the
    row's own. A missing or empty text has no shingles and stays alone. Missing doc_ids take
    part but never name a component, unless no row of it has one: then component_id is
    null and the rows are kept. Repeated rows are copies of each other. ``group`` is a number for
    each component, null without shingles.
    """
    rows = store(signed(docs))
    classes = store(
        rows.filter("n_shingles > 0")
        .groupBy("k1", "k2", "n_shingles")
        .agg(
            F.min("doc_id").alias("least_doc"),
            F.min(F.struct("doc_id", "text_key")).alias("rep"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    bands = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    meetings = store(bands.join(sizes.hint("merge"), "bucket"))
    degrees = meetings.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = meetings.join(degrees.hint("merge"), "node")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top")).select("bucket", F.col("top.node").alias("b"))
    stars = meetings.join(centres.hint("merge"), "bucket").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()
    tried = store(likely(stars, classes, percent))
    links = store(confirmed(tried, classes, docs, percent))
    first = components(links)

    label = F.coalesce("label", "node").alias("label")
    labelled = meetings.join(first.hint("merge"), "node", "left").select("bucket", "size", "node", label)
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    members = labelled.join(mixed.hint("merge"), "bucket").join(classes.select("node", "n_shingles", "signature", "bands").hint("merge"), "node")
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = store(between_components(members, percent).join(known.hint("merge"), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        size = classes.select("node", "n_shingles")
        for side in ("a", "b"):
            rest = rest.join(size.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}")), side)
        more = store(confirmed(store(rest), classes, docs, percent))
        first = first if more.isEmpty() else components(links.union(more))

    named = classes.join(first.hint("merge"), "node", "left").select("k1", "k2", "n_shingles", "node", "least_doc", label)
    smallest = named.groupBy("label").agg(F.min("least_doc").alias("component_id"))
    of_class = store(named.join(smallest.hint("merge"), "label").select("k1", "k2", "n_shingles", "component_id", F.col("label").alias("group")))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        rows.select("doc_id", "text_key", "n_shingles", "k1", "k2")
        .join(of_class.hint("merge"), ["k1", "k2", "n_shingles"], "left")
        .select("doc_id", "text_key", "n_shingles", own.alias("component_id"), "group")
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    )
