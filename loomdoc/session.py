"""Session defaults and the one way in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Broadcasts by hint are made only for tables whose row bound is below this.
BROADCAST_ROWS = 50_000


def local_session(cores: int = 8, name: str = "loomdoc", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMDOC_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset and everything runs in this one process (``local[...]``: tests) a temporary folder is
    made once and set.  On a cluster an unset folder is an error: a folder of one machine would be
    another one on every executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="loomdoc-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loomdoc-{spark.sparkContext.applicationId}"


def clear_cuts(spark: SparkSession) -> None:
    """Remove the tables that :func:`cut` has written for this application; call it once their results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Used where a result feeds more than one branch: the lineage is cut, the files survive the loss
    of executors, and later scans prune columns.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
