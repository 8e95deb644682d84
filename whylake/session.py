"""Session and lineage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "whylake") -> SparkSession:
    """A session with the settings every job here assumes.  On a cluster, pass these with spark-submit."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small enough partitions are joined by hashing instead of two sorts; decided per join at run time
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, used only inside iterative plans.

    The folder comes from ``spark.checkpoint.dir``, which the cluster sets to shared storage.  Only on a session of one
    machine may it be unset; a scratch folder is used there.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="whylake-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder beside the checkpoints, for tables that are written and read within one job."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table that is written once, beside the checkpoints, and read from there.

    Unlike a checkpoint it is compressed by columns, so a large table takes a small part of the disk, and later plans
    know its size.
    """
    folder = shared_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over tasks before work that is heavy per row, however few files hold them.

    Rebalancing lets adaptive execution split large partitions and merge small ones, so the number follows the data.
    """
    return df.hint("rebalance", *keys)
