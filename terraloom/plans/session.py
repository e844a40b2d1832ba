"""The session's shared folder, and cuts of lineage that leave nothing behind in shuffles."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What our own queries run with: Spark deletes a query's shuffle files when it has ended, and what goes to Python goes
#: in batches of so many bytes, so that very long texts don't meet in one.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ensure_checkpoint_dir(spark: SparkSession) -> bool:
    """Sees to it that checkpoint() has a folder: the session's own; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and end in here run with TIDY; the session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in TIDY}
    try:
        for k, v in TIDY.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that plans stay short and lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    with tidy(df.sparkSession):
        # Whether a query is tidy is settled when its DataFrame is made.
        return df.select("*").checkpoint()
