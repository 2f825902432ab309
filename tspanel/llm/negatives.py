"""Hard negatives by inner product, searched as LEMP does (Teflioudi, Gemulla and Mykytiuk 2015).

Vectors are whole numbers. Rows are dealt to buckets of similar length; a length class with many rows has
many buckets, so no task holds more than a bucket. A bucket keeps, per coordinate, its unit vectors sorted by
that coordinate. For an anchor that asks for scores of ``theta`` or more:

- a length class whose longest row cannot reach theta is left out before anything is sent;
- with c = theta / (length of the anchor times the bucket's longest), a row qualifies only if each of its
  coordinates x lies within a*c -+ sqrt((1 - c^2)(1 - a^2)), a being the anchor's coordinate (above is open
  where a >= c, below where -a >= c): the ranges of a few *focus* coordinates, where the anchor is
  largest, are cut out of the sorted lists and intersected;
- what is left is scored exactly, whole buckets at once where the ranges exclude little.

Positives take two passes: an anchor's own bucket gives a first theta, all buckets the result. The
positives' scores then bound the negatives, again over all buckets. Anchors go to the buckets in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .work import store

#: Whole numbers a bucket holds, and anchors that are sent to one copy of a bucket.
BUCKET_VALUES, ANCHOR_BLOCK = 1 << 18, 1 << 14
#: Longest length over shortest within a class.
LENGTH_RATIO = 1.25
FOCUS = 4
#: Ranges that keep more of a bucket than this are not worth intersecting.
SELECTIVE = 0.5
#: Scores held at once, and sums of products up to which doubles are exact.
CHUNK_SCORES, EXACT = 1 << 20, 1 << 53
NO_ID = (1 << 63) - 1

ROW = "bucket long, block long, kind int, row long, id long, label long, length double, theta double, scores array<long>, v array<long>"
HIT = "row long, item int, score long, other long, other_id long"


def prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """``(row, id, label, v, length, dim, class)`` of the rows that take part, each with a number of its own."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("length", length).withColumn("dim", F.size("v"))
    step = F.floor(F.log("length") / math.log(LENGTH_RATIO))
    return rows.withColumn("class", F.when(F.col("length") > 0, step).otherwise(F.lit(-1 << 20)).cast("long"))


def bucketed(rows: DataFrame) -> tuple[DataFrame, list]:
    """The rows with their ``bucket``, and (dim, class, first bucket, buckets, longest) of every class.

    The driver learns one row per dimension and length class; there are a few hundred classes in the range of doubles.
    """
    sizes = rows.groupBy("dim", "class").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()
    classes, first = [], 0
    for r in sorted(sizes, key=lambda r: (r.dim, -r["class"])):
        buckets = math.ceil(r.n * max(r.dim, 1) / BUCKET_VALUES)
        classes.append((r.dim, r["class"], first, buckets, r.longest))
        first += buckets
    table = rows.sparkSession.createDataFrame(classes, "dim int, class long, first long, buckets long, longest double")
    spread = F.col("first") + F.pmod(F.xxhash64("row", "id"), F.col("buckets"))
    return rows.join(table.drop("longest"), ["dim", "class"]).withColumn("bucket", spread).drop("first", "buckets"), classes


class Bucket:
    """Rows of similar length, ordered by label, with one sorted list per coordinate."""

    def __init__(self, row, ids, label, length, v):
        order = np.argsort(label, kind="stable")
        self.row, self.ids, self.label, length, self.v = (x[order] for x in (row, ids, label, length, v))
        self.longest, self.top = length.max(), float(np.abs(v).max(initial=0))
        unit = self.v / np.where(length > 0, length, 1.0)[:, None]
        self.lists = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.lists, axis=0)
        self.doubles = self.v.astype(np.float64)

    def ranges(self, anchor: np.ndarray, length: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, ...]:
        """(focus coordinates, first, end of their lists) per anchor; a range of 0 rows where none can reach theta."""
        n, dim = anchor.shape
        reach = length * self.longest
        c = np.divide(theta, reach, out=np.where(theta > 0, np.inf, 0.0), where=reach > 0)
        unit = anchor / np.where(length > 0, length, 1.0)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        a = np.take_along_axis(unit, focus, axis=1)
        inside = np.clip(c, 0.0, 1.0)[:, None]
        spread = np.sqrt((1 - inside**2) * np.maximum(1 - a**2, 0.0)) + 1e-9
        # within the angle that c allows, the axis itself or its opposite may lie
        low = np.where(inside <= -a, -2.0, a * inside - spread)
        high = np.where(inside <= a, 2.0, a * inside + spread)
        first, end = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(self.v))
        for f in np.unique(focus):
            i, j = np.nonzero(focus == f)
            first[i, j] = np.searchsorted(self.sorted[:, f], low[i, j], "left")
            end[i, j] = np.searchsorted(self.sorted[:, f], high[i, j], "right")
        open_, shut = c <= 0, c > 1 + 1e-9
        first[open_], end[open_], end[shut] = 0, len(self.v), first[shut]
        return focus, first, end

    def candidates(self, focus: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows that lie in the ranges of all focus coordinates of one anchor."""
        hits = np.zeros(len(self.v), np.int8)
        for f, a, b in zip(focus, first, end):
            hits[self.lists[a:b, f]] += 1
        return np.flatnonzero(hits == len(focus))

    def scores(self, anchor: np.ndarray, rows) -> np.ndarray:
        """Exact inner products: doubles where they hold the sums, else 64-bit integers."""
        if float(np.abs(anchor).max(initial=0)) * self.top * max(anchor.shape[1], 1) < EXACT:
            return (anchor.astype(np.float64) @ self.doubles[rows].T).astype(np.int64)
        return anchor @ self.v[rows].T


def first_of(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k allowed scores of every row that come first: high scores, then small ids."""
    least = np.iinfo(np.int64).min
    scores = np.where(allowed, scores, least)
    if scores.shape[1] > k:
        limit = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        allowed = allowed & (scores >= limit[:, None])
    i, j = np.nonzero(allowed)
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[place < k], j[place < k]


def found(bucket: Bucket, rows: np.ndarray, label: int, part: dict, wanted: int, low: int, high: int):
    """Hits (anchor, item, score, row, id) of anchors of one label among some rows of a bucket.

    Without scores to compare with, these are the first rows of the label; with them, for each of them
    (the item) the first of the other labels whose score lies between the percentages.
    """
    first, end = np.searchsorted(bucket.label[rows], [label, label + 1])
    same = np.zeros(len(rows), bool)
    same[first:end] = True
    ids = bucket.ids[rows]
    if part["scores"] is None:
        rows, ids = rows[same], ids[same]
        score = bucket.scores(part["v"], rows)
        i, j = first_of(score, bucket.row[rows] != part["row"][:, None], ids, wanted)
        return [(i, np.zeros(len(i), np.int32), score[i, j], bucket.row[rows][j], ids[j])]
    rows, ids = rows[~same], ids[~same]
    score = bucket.scores(part["v"], rows)
    out = []
    for item in range(part["scores"].shape[1]):
        # -1 marks a missing positive; a negative positive score leaves no room between the percentages
        own = part["scores"][:, item : item + 1]
        # the percentages in whole numbers, without products beyond 64 bits
        hundreds, rest = np.divmod(own, 100)
        least, most = low * hundreds - (-low * rest) // 100, high * hundreds + high * rest // 100
        within = (score >= least) & (score <= most) & (own >= 0)
        i, j = first_of(score, within, ids, wanted)
        out.append((i, np.full(len(i), item, np.int32), score[i, j], bucket.row[rows][j], ids[j]))
    return out


def _search(bucket: Bucket, part: dict, wanted: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    focus, first, end = bucket.ranges(part["v"], part["length"], part["theta"])
    kept = (end - first).min(axis=1, initial=len(bucket.v))
    hits = []
    for label in np.unique(part["label"]):
        mine = np.flatnonzero(part["label"] == label)

        def take(which, rows):
            some = {k: None if x is None else x[which] for k, x in part.items()}
            for i, *rest in found(bucket, rows, label, some, wanted, low, high):
                hits.append((some["row"][i], *rest))

        wide = mine[kept[mine] > SELECTIVE * len(bucket.v)]
        step = max(1, CHUNK_SCORES // len(bucket.v))
        for at in range(0, len(wide), step):
            take(wide[at : at + step], np.arange(len(bucket.v)))
        for one in mine[(kept[mine] <= SELECTIVE * len(bucket.v)) & (kept[mine] > 0)]:
            take(np.array([one]), bucket.candidates(focus[one], first[one], end[one]))
    if hits:
        row, item, score, other, ids = (np.concatenate(x) for x in zip(*hits))
        columns = [pa.array(row), pa.array(item, pa.int32()), pa.array(score), pa.array(other), pa.array(ids)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HIT.split(", ")])


def _whole(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), width)


def search(rows: DataFrame, wanted: int, low: int = 0, high: int = 0) -> DataFrame:
    """Hits of the anchors (kind 1) in the rows (kind 0) of their bucket and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, bucket = None, [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(i)) for i in range(3)], 1)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(key))):
                if a == b:
                    continue
                if at != tuple(key[a, :2]):
                    at, held, bucket = tuple(key[a, :2]), [], None
                piece = batch.slice(a, b - a)
                if key[a, 2] == 0:
                    held.append([np.asarray(piece.column(i)) for i in (3, 4, 5, 6)] + [_whole(piece.column(9), len(piece.column(9)[0]))])
                    continue
                if not held:
                    continue
                bucket = bucket or Bucket(*(np.concatenate(x) for x in zip(*held)))
                scores = None if piece.column(8).null_count else _whole(piece.column(8), len(piece.column(8)[0]))
                part = {"row": np.asarray(piece.column(3)), "label": np.asarray(piece.column(5)), "length": np.asarray(piece.column(6)),
                        "theta": np.asarray(piece.column(7)), "scores": scores, "v": _whole(piece.column(9), bucket.v.shape[1])}
                yield from _search(bucket, part, wanted, low, high)

    return rows.select(*[c.split()[0] for c in ROW.split(", ")]).mapInArrow(run, HIT)


def _met(data: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Rows and anchors of one bucket and block together, the rows first. A block has a copy of the bucket."""
    nothing = {"theta": F.lit(None).cast("double"), "scores": F.lit(None).cast("array<long>")}
    rows = data.withColumns({"kind": F.lit(0), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), **nothing})
    names = [c.split()[0] for c in ROW.split(", ")]
    both = rows.select(*names).unionByName(anchors.withColumn("kind", F.lit(1)).select(*names))
    return both.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "kind")


def _towards(anchors: DataFrame, classes: list) -> DataFrame:
    """Anchors once per bucket of their dimension whose longest row can reach theta."""
    table = anchors.sparkSession.createDataFrame(classes, "dim int, class long, first long, buckets long, longest double")
    reach = F.col("length") * F.col("longest") * (1 + 1e-9) >= F.col("theta")
    far = anchors.drop("class", "bucket").join(table, "dim").filter(reach)
    return far.withColumn("bucket", F.explode(F.expr("sequence(first, first + buckets - 1)"))).drop("class", "first", "buckets", "longest")


def _best(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "other_id", "other")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for ``(vec_id, embedding, label)``.

    Components become floor(scale * x). Rows without a label or vector, or with a component that is missing or
    not finite, take no part. Anchors are the rows whose vec_id ``every`` divides; their positives the first
    ``positives`` other rows of the label, and per positive the first ``negatives`` rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's. High scores come first, then small
    vec_ids (a missing one last, and never an anchor). Repeated rows are rows of their own. Vectors meet those
    of their own dimension only. Scores have to fit 64 bits. An empty table gives an empty one.
    """
    rows, classes = bucketed(store(prepared(vectors, scale)))
    data = store(rows)
    anchors = store(data.filter((F.col("id") != NO_ID) & (F.col("id") % every == 0)))
    blocks = max(1, math.ceil(anchors.count() / ANCHOR_BLOCK))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    none = {"theta": F.lit(-math.inf), "scores": F.lit(None).cast("array<long>")}
    near = search(_met(data, anchors.withColumns(none), blocks), positives)
    start = near.groupBy(F.col("row").alias("a_row")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    theta = F.when(F.col("n") >= positives, F.col("least").cast("double")).otherwise(F.lit(-math.inf))
    seeded = anchors.join(start, F.col("row") == F.col("a_row"), "left").withColumn("theta", theta).drop("a_row", "n", "least")
    first = search(_met(data, _towards(seeded.withColumn("scores", none["scores"]), classes), blocks), positives)
    chosen = store(_best(first, ["row"], positives).select("row", "place", F.col("score").alias("positive_score"), F.col("other_id").alias("positive_id")))
    by_place = F.map_from_entries(F.collect_list(F.struct("place", "positive_score")))
    scores = chosen.groupBy(F.col("row").alias("a_row")).agg(by_place.alias("by_place"))
    # items in order of place; -1 where an anchor has fewer positives
    listed = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.col("by_place")[i], F.lit(-1).cast("long")))
    asking = anchors.join(scores, F.col("row") == F.col("a_row")).withColumn("scores", listed).drop("a_row", "by_place")
    least = F.array_min(F.filter("scores", lambda s: s >= 0))
    asking = asking.filter(least.isNotNull()).withColumn("theta", least * (low / 100))
    second = search(_met(data, _towards(asking, classes), blocks), negatives, low, high)
    best = _best(second, ["row", "item"], negatives).select(
        "row", (F.col("item") + 1).alias("place"), F.col("place").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    out = best.join(chosen, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    known = [F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("positive_id", "negative_id")]
    return out.select("anchor_id", known[0], F.col("rank").cast("int").alias("rank"), known[1], "positive_score", "negative_score")
