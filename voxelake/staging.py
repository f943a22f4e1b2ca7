"""Cuts lineage by written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of one file, where their number is known before they are written.
ROWS_A_FILE = 100_000
#: What was staged, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local master gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="voxelake-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, dealt by a shuffle to as many files as they need, not one for each task that
    computes it: every file that Hadoop makes on a local file system starts processes (chmod), each of which shares its
    executor's memory as it begins."""
    return df.repartition(max(1, -(-rows // ROWS_A_FILE)))


def staged(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it again: survives lost executors, is computed once. ``by``: a column
    that deals the rows to folders, so that a filter on it reads only one."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that this application has staged so far, on whatever file system they are; gives how many were
    there. Results that stand on them can't be read afterwards, so write or collect those first."""
    gone = 0
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
    return gone
