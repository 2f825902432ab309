"""A training corpus from the documents table: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tspanel.llm.decontaminate import contaminated
from tspanel.llm.minhash import near_duplicates
from tspanel.llm.mixing import mix, spread
from tspanel.llm.quality import quality_rules
from tspanel.llm.queries import WEIGHTS, documents, domain_of_source, tokenizer_path
from tspanel.llm.token_output import token_output
from tspanel.llm.work import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, COLUMNS).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id (of repeated rows one).

    Rows without words are in no group and stay.
    """
    grouped = near_duplicates(docs, percent=85).filter(F.col("group").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first")
    chosen = grouped.groupBy("group").agg(first).select(F.col("first.doc_id").alias("r_id"), F.col("first.text_key").alias("r_key"))
    table = docs.select(*COLUMNS).withColumn("text_key", text_key())
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = table.filter(~wordless)
    right = store(chosen)
    kept = left.join(right.hint("merge"), left.doc_id.eqNullSafe(right.r_id) & (left.text_key == right.r_key), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_key"]).unionByName(table.filter(wordless)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    pairs = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    right = store(pairs.select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key")).distinct())
    left = docs.select(*COLUMNS).withColumn("text_key", text_key())
    return left.join(right, left.doc_id.eqNullSafe(right.r_id) & (left.text_key == right.r_key), "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by weight: as many tokens as come in, some texts twice, some cut, some not at all."""
    return spread(mix(docs, COLUMNS, WEIGHTS, domain_of_source(), percent=100, epochs=2, seed=7), COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files, read back: one row per document of the mix."""
    return token_output(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source mixing", mixing),
    ("token output", token_ids),
]

#: SQL has no tokenizer and no signatures: tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
