"""URL filters: explicit rules, and an empirical-Bayes reputation of hosts.

Pages with a known outcome say how bad a host is, but most hosts have few of them. A host's rate of bad
pages is therefore shrunk towards its registered domain's, that one's towards its suffix's, and that
one's towards the rate of all pages. At each level children scatter around their parent as a
beta-binomial distribution; its concentration is estimated from the observed scatter by the method of
moments. A host's posterior is a beta distribution, and the host is blocked where the probability that
its rate exceeds the limit reaches ``certainty``, that is, where the lower posterior bound of that
certainty lies above the limit.

Everything is settled per host; pages only look up their host and the rules that fit it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tspanel.functions.distributions import beta_cdf

from .sqltext import lowered
from .work import store

#: Concentrations that the estimate is held to: a prior worth this many pages.
LEAST_PAGES, MOST_PAGES = 1.0, 1e6
#: Suffixes of two labels under which registrations take place; a single label is one otherwise.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")
OWN = "__url_"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a url that is missing or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def endings(host: Column, deepest: int) -> Column:
    """The host's last 1, 2, ... labels, ``deepest`` at most: itself and the domains above it."""
    labels = F.split(host, r"\.", -1)
    size = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(size, F.lit(deepest))), lambda i: F.array_join(F.slice(labels, size - i + 1, i), "."))


def registered(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a host without a label before its suffix is its own domain."""
    labels = F.split(host, r"\.", -1)
    size = F.size(labels)

    def tail(n: Column) -> Column:
        return F.array_join(F.slice(labels, F.greatest(size - n + 1, F.lit(1)), n), ".")

    width = F.when(tail(F.lit(2)).isin(*suffixes), 2).otherwise(1) if suffixes else F.lit(1)
    return tail(width + 1), tail(width)


def concentration(children: DataFrame) -> float:
    """Pages that the prior of a level is worth, from ``(n, bad, parent)``: the parent's rate.

    The squared deviations of ``bad`` have the expectation sum n m (1 - m) (1 + (n - 1) r); the estimate
    of r = 1 / (K + 1) is held to the bounds for K. The driver learns two sums.
    """
    spread = F.col("n") * F.col("parent") * (1 - F.col("parent"))
    sums = children.filter("n > 0").select(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("parent"), F.lit(2)) - spread).alias("excess"),
        F.sum(spread * (F.col("n") - 1)).alias("room"),
    ).first()
    r = sums.excess / sums.room if sums.room else 0.0
    return min(max(1 / r - 1, LEAST_PAGES), MOST_PAGES) if r > 0 else MOST_PAGES


def reputations(hosts: DataFrame, limit: float, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``(host, domain, suffix, n, bad, prior, posterior, p_over)`` for ``(host, n, bad)``.

    ``prior`` is the domain's rate, ``posterior`` the mean of the host's own, ``p_over`` the probability
    that it exceeds the limit (null if no page at all has an outcome).
    """
    domain, suffix = registered(F.col("host"), suffixes)
    table = store(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    domains = store(table.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    ends = store(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    rate = F.lit((total.bad + 1) / (total.n + 2))

    def shrunk(children: DataFrame) -> tuple[DataFrame, float]:
        k = concentration(children)
        return children.withColumn("rate", (F.lit(k) * F.col("parent") + F.col("bad")) / (F.lit(k) + F.col("n"))), k

    ends, _ = shrunk(ends.withColumn("parent", rate))
    above = ends.select("suffix", F.col("rate").alias("parent"))
    domains, _ = shrunk(store(domains.join(above, "suffix")))
    above = domains.select("domain", "suffix", F.col("rate").alias("parent"))
    table, k = shrunk(store(table.join(above, ["domain", "suffix"])))
    a, b = F.col("a"), F.col("b")
    return (
        table.withColumn("a", F.lit(k) * F.col("parent") + F.col("bad"))
        .withColumn("b", F.lit(k) * (1 - F.col("parent")) + F.col("n") - F.col("bad"))
        .select(
            "host", "domain", "suffix", "n", "bad", F.col("parent").alias("prior"), F.col("rate").alias("posterior"),
            (1 - beta_cdf(F.lit(limit), a, b) if total.n else F.lit(None).cast("double")).alias("p_over"),
        )
    )


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, rules)``: per host the rules (verdict, host, path) of the host itself or a domain above it."""
    table = rules.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path")).distinct()
    # no rule fits an ending of more labels than the longest of them has
    deepest = table.agg(F.max(F.size(F.split("r_host", r"\.", -1)))).first()[0] or 1
    met = hosts.select("host", F.explode(endings(F.col("host"), deepest)).alias("r_host")).join(table, "r_host")
    listed = F.collect_set(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_path").alias("path"), "verdict"))
    return met.groupBy("host").agg(listed.alias("rules"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: DataFrame, keep: Sequence[str] = ("page_id",), limit: float = 0.3, certainty: float = 0.95,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """Every page's columns ``keep`` in ``row``, ``host, path, rule, verdict`` and its host's figures.

    ``pages`` has ``page_id, url``; ``outcomes`` has ``(page_id, bad)``, any number per page, where a null
    ``bad`` says nothing; ``rules`` has ``(verdict, host, path)``: a rule fits its host and all domains
    below it where the page's path starts with the rule's. The longest rule decides (``block`` before
    ``allow`` for equal ones), else the host's reputation. Pages without a host share the empty one.
    Repeated pages are judged and counted each. A missing page_id has no outcome. An empty table gives an
    empty one; without outcomes nothing but rules can block. Very long urls are taken whole.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col("page_id").alias("id"), host.alias("host"), path.alias("path"))
    known = outcomes.filter("bad IS NOT NULL").groupBy(F.col("page_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")
    )
    labelled = named.select("id", "host").join(known, "id").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = named.select("host").distinct().join(labelled, "host", "left").select("host", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "bad")])
    hosts = store(hosts)
    table = store(reputations(hosts, limit, suffixes).join(fitting_rules(hosts, rules), "host", "left"))
    out = named.drop("id").join(table, "host")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["verdict"].alias("verdict"), r["rule"].alias("rule")))
    out = out.withColumn(f"{OWN}rule", F.array_max(ranked))
    method = F.when(F.col("p_over") >= certainty, "block").otherwise("allow")
    return out.select(
        "row", "host", "path", F.col(f"{OWN}rule.rule").alias("rule"), F.coalesce(F.col(f"{OWN}rule.verdict"), method).alias("verdict"),
        F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"), "domain", "suffix", "prior", "posterior", "p_over",
    )
