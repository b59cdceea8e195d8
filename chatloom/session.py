"""Session set-up and the settings the operators rely on."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

#: Rows a lookup table may hold to be sent to every task; larger ones are joined by shuffles.
LOOKUP_ROWS = 1_000_000

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["chatloom"])


def build_session(app_name: str = "chatloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on. On a cluster, leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call-site capture costs milliseconds per column expression on the driver
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ready(builder.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC and make sure reliable checkpoints have a folder.

    The shared folder named in ``spark.checkpoint.dir`` is used where set; a temporary one only
    stands in for it in local runs, where driver and executors are one process.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # what an ended query shuffled goes with it, and not whenever the driver collects its garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="chatloom-checkpoint-")
        context.setCheckpointDir(folder)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ready(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str = "rows"):
    """As :func:`cut_lineage`, compressed and by column, for wide or many rows that are read several times."""
    folder = shared_path(df.sparkSession, name)
    df.write.parquet(folder, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_table(df, rows: int = LOOKUP_ROWS) -> bool:
    """Whether a table may be sent to every task; one that is derived should be stored before."""
    return df.limit(rows + 1).count() <= rows
