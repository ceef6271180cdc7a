"""A session with the settings that the library expects, and where its intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes that are broadcast at most.
MOST_BROADCAST = 1_000_000


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; further settings by their full names."""
    builder = SparkSession.builder.appName("tallyfin")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master without one (as in tests) gets a folder of this session's own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyfin-ckpt-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: read again it is not computed again, whichever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, with the size of its files.

    For loops of many rounds: a checkpoint keeps the estimate of its plan's size, and a table that is joined with what is
    made of itself squares that estimate each round, until the planner is lost in its digits.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df marked for broadcast if it has at most ``most`` rows; it is counted, so it should be cheap to read again."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
