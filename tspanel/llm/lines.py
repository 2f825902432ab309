"""Line dedup (operator 9) by distinct-site spread; DataFrame functions only.

Every line with a word has a HyperLogLog sketch of the sites it is on; sketches merge in the
aggregation. A line on at least ``min_sites`` sites is boilerplate and leaves all documents. Where
the estimate is near the limit, the distinct sites are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .work import store

LOG_K = 12
#: Estimates within this part of the limit are counted; the sketch's standard error is 1.6 %.
NEAR = 0.15


def line_key(line: Column) -> Column:
    """128 bits for a line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2) of the lines on at least ``min_sites`` sites; ``lines``: h1, h2, site."""
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("h1", "h2")
    some = lines.join(store(often).hint("merge"), ["h1", "h2"])  # a line on fewer rows is on fewer sites
    spread = store(some.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("sites")))
    sure = spread.filter(F.col("sites") > min_sites * (1 + NEAR)).select("h1", "h2")
    near = spread.filter(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("h1", "h2")
    counted = lines.join(near.hint("merge"), ["h1", "h2"]).select("h1", "h2", "site").distinct().groupBy("h1", "h2")
    exact = counted.agg(F.count("site").alias("n")).filter(F.col("n") >= min_sites).select("h1", "h2")
    return store(sure.union(exact))


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """doc_id, text_key, n_lines, n_removed and kept_text for every row of ``docs`` (doc_id, text, site).

    Lines end at \\n. Lines without a word stay and count for nothing. A missing site adds to no
    line's spread, but boilerplate leaves such rows too. A missing or empty text has one empty line.
    """
    text = F.coalesce("text", F.lit(""))
    table = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"), F.col(site).cast("string").alias("site"))
    split = F.split("text", "\n")
    rows = table.select("doc_id", "text_key", "site", F.explode(F.array_distinct(split)).alias("line"))
    rows = rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text_key", "site", line_key(F.col("line")).alias("k"))
    rows = rows.select("doc_id", "text_key", "site", "k.h1", "k.h2")
    bad = boilerplate(rows.filter(F.col("site").isNotNull()), min_sites)
    # at most the lines of one document
    hit = rows.join(bad.hint("merge"), ["h1", "h2"]).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("h1", "h2")).alias("bad"))
    hit = hit.withColumnsRenamed({"doc_id": "b_id", "text_key": "b_key"})
    on = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key"))
    marked = table.join(hit.hint("merge"), on, "left").withColumn("lines", split)
    kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), line_key(x))))
    out = marked.select("doc_id", "text_key", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", "text_key", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))
