"""Helpers shared by the text operators: shared storage, word pattern, reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the query contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where none is named, one machine's own folder will do only if all of Spark runs on it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = tempfile.mkdtemp(prefix="skylattice-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _in_store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Paths of the tables that ``stored`` wrote.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of what
    stands before, and later branches read columns instead of computing them.
    The table goes with ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, at = _in_store(spark, path)
    store.deleteOnExit(at)
    again = spark.read.schema(df.schema).parquet(path)
    _paths[again] = path
    return again


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        store, at = _in_store(df.sparkSession, _paths.pop(df))
        store.delete(at, True)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(spark: SparkSession, rows: int = 512) -> str:
    """Send fewer rows at a time to Python from here on: whole texts are long rows.  Gives the setting there was."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    return before


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """As ``lean``, while the body's jobs run."""
    before = lean(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def if_small(df: DataFrame, n_bytes: float, limit: float = 8e6) -> DataFrame:
    """Broadcast ``df`` only where its measured size is under ``limit`` bytes."""
    return F.broadcast(df) if n_bytes <= limit else df


def join_skewed(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join with ``right``, which has each key once and in ``weight`` how many rows of ``left`` have it.

    Keys of more than one in ``parts`` of all ``total`` rows are joined by broadcast;
    there are fewer than ``parts`` of them.  No other key is large enough to burden a task.
    """
    hot = F.col(weight) > total / parts
    few = right.where(hot)
    rest = left.join(F.broadcast(few.select(on)), on, "left_anti").join(right.where(~hot), on)
    return left.join(F.broadcast(few), on).unionByName(rest)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``columns``."""
    while name in columns:
        name = f"_{name}"
    return name
