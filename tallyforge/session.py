"""Session builder and the one place that cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyforge", master: str | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session with UTC, AQE and skew-join handling; cluster settings given from outside are kept."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder and go on from the files.

    The folder is the session's ``spark.checkpoint.dir``; only where none is set
    (tests, a single machine) a temporary one is made, and removed at exit. The copy
    survives the loss of executors, which localCheckpoint and cache do not.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        told = sc.getConf().get("spark.checkpoint.dir")
        if not told and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not told:
            told = tempfile.mkdtemp(prefix="tallyforge-")
            atexit.register(shutil.rmtree, told, ignore_errors=True)
        sc.setCheckpointDir(told)
    return df.checkpoint(eager=True)
