"""Working folders in storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A folder under spark.checkpoint.dir; a temporary one only where the session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(scratch, "own", None)
        if root is None:
            root = scratch.own = tempfile.mkdtemp(prefix="skylattice-")
    return f"{root.rstrip('/')}/{name}"


def own_folder(spark: SparkSession, label: str) -> str:
    """A new folder of shared storage, which goes when the driver ends."""
    path = scratch(spark, f"{label}-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df``, written once and read back, and its folder."""
    path = own_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once and read back: later branches read it instead of computing it, and a lost executor costs no more than a part of it."""
    return kept(df, label)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """A folder that nothing reads any more goes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
