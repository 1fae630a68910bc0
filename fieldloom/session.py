"""Session defaults for local runs, the folder that a cluster shares, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "fieldloom", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and ``bench.py`` use.

    On a cluster the session comes from the submitter; nothing in the library
    sets cluster-wide options.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set on one machine
    (tests); on a cluster, whose executors don't see it, that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="fieldloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sent_whole(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, marked to be sent to every task where it has at most ``most_rows`` rows; it is counted first."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
