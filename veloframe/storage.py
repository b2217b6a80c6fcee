"""Sessions, and tables in the folder that all executors share.

Lineage is cut by writing a Parquet table into the cluster's shared folder (``spark.checkpoint.dir``), never on one machine's disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of parameters with at most this many rows are broadcast; beyond it they are joined like any other.
BROADCAST_ROWS = 100_000


def session(name: str = "veloframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides (dots written as ``__``)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster: ``spark.checkpoint.dir``. Where that is unset a temporary folder serves a local session; on a cluster,
    whose machines don't share one, it is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="veloframe-")
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` once into the shared folder and returns the table read back: lineage ends there and any executor can read it.

    The tables of an application are removed when its driver ends."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parameters(df: DataFrame) -> DataFrame:
    """A table of parameters for a join: marked for broadcast if it is counted to be small, else as it is. No row is dropped."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
