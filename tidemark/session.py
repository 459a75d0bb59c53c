"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one is made only for a local master without the setting."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(wanted)
    return wanted


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, written once to the checkpoint folder and read from there afterwards."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores, for a stage that is long in Python.

    Rows move only where the plan has fewer partitions than the session has cores. Then the input is at
    most cores times one split, so the move is small; a large input is left where it lies. Keys should
    name the rows, so that no hot value makes one partition large. `df` should be a scan: a plan with
    shuffles would run them to learn its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def small(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """The dimension table marked for broadcast if its rows, written as JSON, take at most `most_bytes`, else as it is.

    One job measures all rows, so `df` should be cheap to compute twice.
    """
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most_bytes else df


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that workers without the package can read: the value with the code of its classes."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(value: Broadcast) -> object:
    """What `share` was given."""
    return cloudpickle.loads(value.value)
