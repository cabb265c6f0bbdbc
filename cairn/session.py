"""Session-level helpers: tuned sessions, table access and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution; on a cluster use the cluster's own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cairn")
    defaults = {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoints(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that this session writes to."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cairn-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path, not yet made, in a folder that driver and executors share, as a URI."""
    path = f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
    if path.startswith("/"):
        return f"file://{path}"
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` checkpointed in spark.checkpoint.dir (a temporary folder only in local mode where none is set), so lost executors cost nothing before it."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()
