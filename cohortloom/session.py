"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "cohortloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local master falls back to a temporary folder: on a cluster a
    machine-local folder would be lost with its machine, so the setting is
    required there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        base = os.environ.get("COHORTLOOM_TMP", tempfile.gettempdir())
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortloom-ckpt-", dir=base))
    else:
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")


def scratch_path(spark: SparkSession) -> str:
    """A path in the shared checkpoint folder that nothing uses yet."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written table.

    A table survives the loss of executors and brings its true size to the next
    plan. (``DataFrame.checkpoint`` would carry size estimates along, and those
    multiply with every join of an iteration until planning itself is slow.)
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
