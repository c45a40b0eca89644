"""Session helpers for local runs; a cluster brings its own session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("itemlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Local data is small but its text expressions are not cheap: keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's checkpoint folder.

    Only where a session with a local master names none, as in tests, is a local folder made and
    set; on a cluster such a folder would be out of other executors' reach, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="itemlake-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """Unused path under the shared folder; all paths of an application lie in one directory."""
    return f"{shared_folder(spark)}/itemlake/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over as many tasks as a shuffle has, by the columns ``by`` if any.

    For rows that cost much each and come in few files or row groups, which Spark never splits.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Later branches then scan a finished table: nothing upstream runs twice, a lost executor
    costs no recomputation beyond it, and the known size lets Spark choose joins by it. With
    ``by`` the table is split into directories, which filters on these columns prune.
    """
    path = new_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
