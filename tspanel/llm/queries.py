"""One query per operator over the test tables, with production parameters, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files of 16-bit ids that end texts with id 49407."""
    from .token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_path(), separator=49407)


@query()
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document from packed files, each text ended with id 1."""
    from .token_output import token_output

    out = token_output(documents(spark, sf_dir), tokenizer_path(), end_id=1)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances to the language's usual text, and the verdict on every document."""
    from .quality import quality_rules

    return quality_rules(documents(spark, sf_dir), ["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )


@query()
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingle sets have a similarity of 0.85 or more."""
    from .minhash import near_duplicates

    out = near_duplicates(documents(spark, sf_dir), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document after removal of the windows of 35 words that occur twice or more."""
    from pyspark.sql import functions as F

    from .fm_index import drop_repeated_words

    out = drop_repeated_words(documents(spark, sf_dir), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document after removal of the strings of 400 bytes that occur twice or more."""
    from pyspark.sql import functions as F

    from .suffix_array import drop_repeated_bytes

    out = drop_repeated_bytes(documents(spark, sf_dir), window=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


# domains of the test tables' sources, and weights of domains and languages
WEIGHTS = {"domain": {"web": 5, "books": 3, "reference": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}


def domain_of_source():
    from pyspark.sql import functions as F

    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return F.when(number % 3 == 0, "web").when(number % 3 == 1, "books").otherwise("reference")


@query()
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, substitutions allowed."""
    from .decontaminate import contaminated

    out = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "item_id", "start", "matched", "length", "n_places")


@query()
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used, and how much of it, when all tokens are mixed to the weights."""
    from .mixing import mix

    out = mix(documents(spark, sf_dir), ["doc_id"], WEIGHTS, domain_of_source(), percent=100, epochs=2, seed=7)
    return out.select("row.doc_id", "domain", "lang", "source", "n_tokens", "full_epochs", "prefix_tokens", "used_tokens")


@query(
    """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
boilerplate AS (
  SELECT line FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= 10)
SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
       coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS kept_text
FROM lines l LEFT JOIN boilerplate b ON l.line = b.line
GROUP BY doc_id"""
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents without the lines that ten or more sources share."""
    from .lines import drop_boilerplate

    return drop_boilerplate(documents(spark, sf_dir), "source", min_sites=10).drop("text_key")


@query()
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    from .licenses import license_scan

    return license_scan(documents(spark, sf_dir)).drop("text_key")


@query()
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent word, one code point away, that each stands for."""
    from .spelling import damaged_words, spelling_groups

    return spelling_groups(damaged_words(documents(spark, sf_dir)))


@query(
    """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3"""
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For anchors and their nearest rows of the label, the hardest rows of other labels below them."""
    from pyspark.sql import functions as F

    from .negatives import hard_negatives

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table.select("vec_id", "embedding", moved.alias("label")))


URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
BAD_LIMIT, CERTAINTY = 0.25, 0.95


def shrinkage_sql(name: str, children: str, above: str) -> str:
    """CTE ``<name>``: children ``(n, bad, parent)`` with the level's concentration k and the shrunken rate."""
    return f"""
{name}_p AS ({children} {above}),
{name}_k AS (SELECT CASE WHEN coalesce(e / nullif(w, 0), 0) > 0 THEN least(greatest(w / e - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM (
  SELECT sum(pow(bad - n * parent, 2) - n * parent * (1 - parent)) AS e,
         sum(n * parent * (1 - parent) * (n - 1)) AS w FROM {name}_p WHERE n > 0)),
{name} AS (SELECT *, (k * parent + bad) / (k + n) AS rate FROM {name}_p, {name}_k)"""


@query(
    f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id AS page_id, (coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT AS bad FROM labels
  WHERE toxic IS NOT NULL OR quality IS NOT NULL),
hosts AS (
  SELECT host, any_value(regexp_extract(host, '[^.]*\\.?[^.]*$')) AS domain, any_value(regexp_extract(host, '[^.]*$')) AS suffix,
         count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM p LEFT JOIN l USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
ends AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
{shrinkage_sql('s', 'SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM ends) AS parent', 'FROM ends')},
{shrinkage_sql('d', 'SELECT d.*, s.rate AS parent', 'FROM domains d JOIN s USING (suffix)')},
{shrinkage_sql('h', 'SELECT h.*, d.rate AS parent', 'FROM hosts h JOIN d USING (domain, suffix)')},
ab AS (SELECT *, k * parent + bad AS a, k * (1 - parent) + n - bad AS b FROM h),
-- Simpson's rule over the density, from the limit to 1
density AS (
  SELECT host, g.i, {BAD_LIMIT} + (1 - {BAD_LIMIT}) * g.i / 20000 AS x, a, b,
         CASE WHEN g.i IN (0, 20000) THEN 1 WHEN g.i % 2 = 1 THEN 4 ELSE 2 END AS w
  FROM ab, generate_series(0, 20000) AS g(i)),
over AS (
  SELECT host, sum(CASE WHEN x < 1 THEN w * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln(x) + (b - 1) * ln(1 - x)) ELSE 0 END)
         * (1 - {BAD_LIMIT}) / 60000 AS p_over
  FROM density GROUP BY host),
rules(verdict, r_host, r_path) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
fit AS (
  SELECT page_id, r_host || r_path AS rule, verdict FROM p JOIN rules
    ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC) = 1)
SELECT page_id, p.host, p.path, rule, coalesce(fit.verdict, CASE WHEN p_over >= {CERTAINTY} THEN 'block' ELSE 'allow' END) AS verdict,
       ab.n::BIGINT AS host_labelled, ab.bad::BIGINT AS host_bad, round(ab.rate, 6) + 0.0 AS posterior, round(p_over, 4) + 0.0 AS p_over
FROM p LEFT JOIN fit USING (page_id) JOIN ab ON ab.host = p.host JOIN over ON over.host = p.host"""
)
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by rules and by their hosts' reputation.

    A page's outcome is the label of the same number: bad where it is toxic or of low quality.
    """
    from pyspark.sql import functions as F

    from .urls import judge_urls

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    outcomes = labels.filter("toxic IS NOT NULL OR quality IS NOT NULL").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    out = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), outcomes, rules, limit=BAD_LIMIT, certainty=CERTAINTY)
    return out.select(
        "row.page_id", "host", "path", "rule", "verdict", "host_labelled", "host_bad", F.round("posterior", 6).alias("posterior"),
        F.round("p_over", 4).alias("p_over"),
    )
