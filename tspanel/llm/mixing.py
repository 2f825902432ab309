"""Mixing sources to target weights (operator 3) by hierarchical budgeting; DataFrame functions only.

A budget of tokens goes down a tree, by default domain, language, source. At each node it is
shared among the children by weight, but none gets more than it can give (its tokens times
the most epochs). What a child cannot take goes to its siblings by weight; only what all of
them cannot take was never given to their parent. A leaf's budget is spent on whole epochs and
then on a prefix of one more, in an order that the seed and the epoch fix; the last document is
cut to the token.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from .sqltext import words
from .work import store

#: Documents of a leaf that are put in order by one task, about.
BUCKET_DOCS = 5000


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    known = weights.get(level)
    if not known:
        return F.lit(1).cast("decimal(12,0)")
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(table[F.col(level)], F.lit(1)).cast("decimal(12,0)")


def share_out(children: DataFrame, parent: list[str], level: str, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Adds ``given`` to (parent columns, level, capacity, budget of the parent).

    Children in order of capacity per weight; the first ones take all they have as long as
    their share is no less. The others share the rest, rounded down on running sums, so that the parts
    of a parent add up to its budget. All figures are whole numbers.
    """
    w = weight_of(level, weights)
    table = children.withColumn("w", w).withColumn("c", F.col("capacity").cast("decimal(18,0)")).withColumn("b", F.col("budget").cast("decimal(18,0)"))
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.when(F.col("w") > 0, F.col("c").cast("double") / F.col("w").cast("double")).asc_nulls_last(), level)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(18,0)")
    table = table.withColumn("w_left", F.sum("w").over(group) - F.coalesce(F.sum("w").over(earlier), zero))
    table = table.withColumn("c_before", F.coalesce(F.sum("c").over(earlier), zero))
    table = table.withColumn("full", F.expr("c * w_left <= w * (b - c_before)"))
    rest = F.when(F.col("full"), zero).otherwise(F.col("w"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("w_rest", F.sum(rest).over(group)).withColumn("w_upto", F.sum(rest).over(upto))
    table = table.withColumn("b_rest", F.col("b") - F.sum(F.when(F.col("full"), F.col("c")).otherwise(zero)).over(group))
    part = "coalesce((b_rest * {}) div nullif(w_rest, 0), 0)"
    given = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr(part.format("w_upto") + " - " + part.format("(w_upto - w)")))
    return table.withColumn("given", given.cast("long")).select(*parent, level, "capacity", "given")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Mapping, percent: int, epochs: int) -> DataFrame:
    """(levels, tokens, docs, given) for (levels, tokens, docs)."""
    wanted = F.lit(True)
    for level in levels:
        wanted = wanted & (weight_of(level, weights) > 0)
    leaves = leaves.withColumn("capacity", F.when(wanted, F.col("tokens") * epochs).otherwise(F.lit(0).cast("long")))
    given = None
    for depth, level in enumerate(levels):
        parent = levels[:depth]
        nodes = leaves.groupBy(*parent, level).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        if given is None:
            top = Window.partitionBy(F.lit(0))  # the few nodes of the highest level
            asked = F.sum("tokens").over(top) * percent
            nodes = nodes.withColumn("asked", asked).withColumn("able", F.sum("capacity").over(top))
            nodes = nodes.withColumn("budget", F.least("able", F.expr("asked div 100")))
        else:
            nodes = nodes.join(given.select(*parent, F.col("given").alias("budget")), parent)
        given = share_out(nodes, parent, level, weights)
    return leaves.join(given.select(*levels, "given"), levels)


def mix(
    docs: DataFrame,
    carry: list[str],
    weights: Mapping[str, Mapping[str, int]],
    domain: Column,
    levels: tuple[str, ...] = ("domain", "lang", "source"),
    percent: int = 100,
    epochs: int = 2,
    seed: int = 0,
) -> DataFrame:
    """``row`` (the carried columns), the levels, n_tokens, full_epochs, prefix_tokens, used_tokens for all rows.

    Tokens are words between ASCII white space. The budget is ``percent`` of all tokens, at most
    ``epochs`` times what is there. Names of weight 0 get nothing. A row is used ``full_epochs`` times as a whole, and its
    first ``prefix_tokens`` words once more. Missing level values are the name ''. Texts without
    words, missing or empty, are never used. Repeated rows count each.
    """
    names = list(levels)
    level = {n: F.coalesce((domain if n == "domain" else F.col(n)).cast("string"), F.lit("")) for n in names}
    text = F.coalesce("text", F.lit(""))
    table = docs.select(
        F.struct(*carry).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
        F.size(words(text)).cast("long").alias("n_tokens"), *(c.alias(n) for n, c in level.items()),
    )
    counts = table.select(*names, "n_tokens").filter("n_tokens > 0")
    leaves = store(counts.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    # one row per leaf; read from a table, so that its size decides how it is joined
    plan = store(
        leaf_budgets(leaves, names, weights, percent, epochs)
        .withColumn("full_epochs", F.expr("given div tokens"))
        .withColumn("rest", F.expr("given % tokens"))
        .withColumn("buckets", F.ceil(F.col("docs") / BUCKET_DOCS).cast("long"))
        .select(*names, "full_epochs", "rest", "buckets")
    )
    drawn = F.xxhash64(F.lit(seed), "full_epochs", "doc_id", "text_key")
    placed = table.join(plan, names, "left").withColumn("draw", F.shiftrightunsigned(drawn, 33))
    placed = placed.withColumn("bucket", F.coalesce(F.shiftright(F.col("draw") * F.col("buckets"), 31), F.lit(0)))
    by_leaf = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # the order of a leaf is the order of its buckets and that within them: no task holds a leaf
    sums = placed.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("n"))
    before = store(sums.select(*names, "bucket", F.coalesce(F.sum("n").over(by_leaf), F.lit(0)).alias("before")))
    inner = Window.partitionBy(*names, "bucket").orderBy("draw", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.join(before, [*names, "bucket"]).withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    prefix = F.greatest(F.lit(0), F.least("n_tokens", F.coalesce(F.col("rest"), F.lit(0)) - F.col("ahead")))
    whole = F.when(F.col("n_tokens") > 0, F.col("full_epochs")).otherwise(0).cast("long")
    return ordered.select("row", *names, "n_tokens", whole.alias("full_epochs"), prefix.cast("long").alias("prefix_tokens")).withColumn(
        "used_tokens", F.col("full_epochs") * F.col("n_tokens") + F.col("prefix_tokens")
    )


def spread(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen rows as documents: whole ones once per epoch, and the cut prefixes."""
    rows = mixed.select("row", "n_tokens", "prefix_tokens", F.explode(F.sequence(F.lit(0), F.col("full_epochs"))).alias("epoch"), "full_epochs")
    rows = rows.filter((F.col("epoch") < F.col("full_epochs")) | (F.col("prefix_tokens") > 0))
    cut = (F.col("epoch") == F.col("full_epochs")) & (F.col("prefix_tokens") < F.col("n_tokens"))
    text = F.when(cut, F.array_join(F.slice(words(F.col("row.text")), F.lit(1), F.col("prefix_tokens").cast("int")), " ")).otherwise(F.col("row.text"))
    chars = F.when(cut, F.length(text)).otherwise(F.col("row.n_chars")).cast("long")
    special = {"text": text, "n_chars": chars}
    return rows.select(*((special[c] if c in special else F.col("row")[c]).alias(c) for c in columns))
