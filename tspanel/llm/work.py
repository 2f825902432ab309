"""Where intermediate tables and files go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names.

    Only a local session may go without the setting; it gets a scratch folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tspanel-llm-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The given columns; further ones, whatever their names, play no part."""
    return df.select(*[F.col(c) for c in columns])


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and ``text``; a missing text is an empty one.

    ``text_key`` is a 64-bit hash of the text: with the doc_id it names a row, also where a
    doc_id is missing or repeated. Rows that agree in both hold the same text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text"
    )
