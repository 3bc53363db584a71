"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a written table that may be sent to all tasks.
BROADCAST_ROWS = 5_000


def local_session(cpus: int | str = 8, app: str = "seqledger") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SEQLEDGER_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without the setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "seqledger.local.dir", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="seqledger-")
    spark.conf.set("seqledger.local.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/seqledger/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Ends the lineage, so a lost executor re-reads files instead of re-running the whole
    chain, and gives the following joins column pruning and real sizes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """A written table as one side of a join: sent to all tasks if counted few, else merged.

    Left alone, Spark goes by the size of the files, and rows that compress well take tens of
    times as much once they are collected. ``counted`` is a written table of at least as many rows.
    """
    return F.broadcast(df) if is_few(df if counted is None else counted) else df.hint("merge")


def is_few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
