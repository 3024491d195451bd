"""Python workers must find this package too, wherever the driver was started from."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


def reach_workers(spark: SparkSession) -> SparkSession:
    """Put the package's place on the workers' path, unless it is there already.

    On a cluster whose machines don't share it, ship the package with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, paths)))
    return spark


#: Bytes of an Arrow batch: whole texts are long, so batches are bounded by size, not by rows.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def settle(spark: SparkSession) -> SparkSession:
    """For applications, before their first query: workers find the package, batches hold ``BATCH_BYTES`` unless the cluster says otherwise.

    Operators never touch a session's settings; under Spark's own bound they only use more memory.
    """
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, BATCH_BYTES)
    return reach_workers(spark)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a table as it is read, dealt out anew if it has fewer splits than the cluster has cores.

    A small table in one row group would else be one task's work.  A table worth a cluster has
    more splits than cores and stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that are sent to every task at most.
SENT_ROWS = 20_000


def sent_if_few(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """``df``, marked to be sent to every task if it has ``most`` rows at most; beyond that a join shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, reliably, in the folder that ``spark.checkpoint.dir`` names, and forget how it was made.

    Only a local session, whose machine is its cluster, gets a temporary folder where that is unset.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veritome-"))
    return df.checkpoint(eager=True)
