"""Gridding of a stream of points: extremes and counts merge in any order.

Each batch leaves its own cells in shared storage, under its number, so a batch
that runs twice after a failure replaces itself; reading merges the batches.  No
state of all cells is held anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.gridding import grid_points

#: How two rows of a cell become one.
MERGE = {"surface": F.max, "lowest": F.min, "bare": F.min, "roof": F.max, "returns": F.sum, "singles": F.sum}


def read_points(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Points from files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def merged(cells: DataFrame) -> DataFrame:
    return cells.groupBy("row", "col").agg(*[f(c).alias(c) for c, f in MERGE.items()])


def grid_stream(points: DataFrame, folder: str) -> DataFrame:
    """Grids what is there now, batch by batch, and returns the cells of all batches so far."""
    spark = points.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        grid_points(batch).write.mode("overwrite").parquet(f"{folder}/cells/batch={number}")

    query = points.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return merged(spark.read.parquet(f"{folder}/cells"))
