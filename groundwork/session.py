"""Sessions for local use, and what a session of a cluster needs from us."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session on this machine, in UTC, for tests and bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("groundwork")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_package(spark: SparkSession, folder: str) -> None:
    """Lets Python workers find this package in ``folder``, wherever the driver was started."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if folder not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = folder + (os.pathsep + known if known else "")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: in the folder that the cluster names, which outlives an executor.

    Only where ``spark.checkpoint.dir`` isn't set and the session is a local one, as in tests, a folder of our own is
    used; a cluster without that setting is an error.
    """
    context = df.sparkSession.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not (context.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="groundwork-checkpoint-"))
    return df.checkpoint(eager=True)
