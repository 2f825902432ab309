"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "tspanel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC dates.

    The number of shuffle partitions, memory and the checkpoint folder belong to
    the cluster; pass them through ``conf`` only for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # a panel is small next to the work each of its rows causes: keep all cores busy
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the session's checkpoint folder.

    A local session without one gets a scratch folder; on a cluster it has to be set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="tspanel-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


# Session setting: number of buckets in which panels staged by key are stored; unset or 0 for checkpoints.
BUCKETS = "spark.tspanel.panelBuckets"


def _stages(spark: SparkSession) -> str:
    """The database of this application's bucketed stages."""
    return "tspanel_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)


def stage(df: DataFrame, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Store a reduced table once so that later steps do not rescan the raw data.

    Uses a reliable checkpoint, which survives the loss of executors, in the shared folder. A
    checkpoint forgets how its rows were dealt, so each later pass over a key shuffles again.
    With ``keys`` and a number of ``buckets`` (given, or set as ``spark.tspanel.panelBuckets``) the
    table is stored there as one file per bucket, sorted by key and period: windows, groups
    and joins on these keys then need no exchange, also between tables of as many buckets.
    Choose buckets of up to some 100 MB, as they are not coalesced at run time, and no fewer than
    the shuffle partitions, or a join with a shuffled table moves this one as well. A key of the
    panel is bounded by the calendar, so no bucket is filled by one key. ``clear_stages``
    removes the stored tables; do so once their results are written.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    buckets = buckets or int(spark.conf.get(BUCKETS, "0"))
    if not keys or not buckets:
        return df.checkpoint(eager=True)
    database = _stages(spark)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}/{database}'")
    name = f"{database}.t{uuid.uuid4().hex}"
    order = [*keys, *(c for c in ("period",) if c in df.columns and c not in keys)]
    dealt = df.repartition(buckets, *[F.col(f"`{k}`") for k in keys])
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*order).saveAsTable(name)
    return spark.table(name)


def clear_stages(spark: SparkSession) -> None:
    """Remove the bucketed tables of this application, files included."""
    spark.sql(f"DROP DATABASE IF EXISTS {_stages(spark)} CASCADE")
