"""Point clouds to cells, and the local layers made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import percentiles

NOISE, GROUND, BUILDING = (7, 18), 2, 6


def grid_points(points: DataFrame, *keys: str) -> DataFrame:
    """Points (row, col, z, cls, nret) to cells: highest and lowest return, counts.

    One shuffle by cell, combined before it.  ``keys`` are further keys, as a run.
    """
    kept = points.where(~F.col("cls").isin(*NOISE))
    z = F.col("z").cast("float")
    return kept.groupBy(*keys, "row", "col").agg(
        F.max(z).alias("surface"),
        F.min(z).alias("lowest"),
        F.min(F.when(F.col("cls") == GROUND, z)).alias("bare"),
        F.max(F.when(F.col("cls") == BUILDING, z)).alias("roof"),
        F.count("*").alias("returns"),
        F.count_if(F.col("nret") <= 1).alias("singles"),
    )


def with_heights(cells: DataFrame) -> DataFrame:
    """Ground never above the surface, heights never negative."""
    ground = F.least(F.coalesce("bare", "lowest"), F.col("surface"))
    return cells.withColumn("ground", ground).withColumn("heights", F.col("surface") - ground)


def class_histogram(points: DataFrame, top: int = 8) -> DataFrame:
    return points.groupBy("cls").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cls").limit(top)


def exact_percentiles(cells: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """One row: percentiles with linear interpolation, exactly."""
    return percentiles(cells, {name: (value, q) for name, q in wanted.items()})


def outlier_ceiling(cells: DataFrame, value: str = "surface") -> DataFrame:
    """One row: p50, p99_99 and the height above which returns are taken for errors."""
    p = exact_percentiles(cells, value, {"p50": 0.5, "p99_99": 0.9999})
    return p.withColumn("ceiling", F.col("p99_99") + F.greatest(F.lit(20.0), 0.15 * (F.col("p99_99") - F.col("p50"))))


def without_outliers(cells: DataFrame, value: str = "surface") -> DataFrame:
    """Cells above the ceiling lose their value."""
    limit = outlier_ceiling(cells, value).select("ceiling")
    return cells.join(F.broadcast(limit)).withColumn(value, F.when(F.col(value) <= F.col("ceiling"), F.col(value))).drop("ceiling")


def in_metres(value: Column, unit_m: float, nodata: float = -9999.0) -> Column:
    """Metres; sentinels become null."""
    return F.when((value == nodata) | (value < -1000) | F.isnan(value), None).otherwise(value * unit_m)


def pooled(cells: DataFrame, factor: int, value: str, rows: int, cols: int) -> DataFrame:
    """Whole blocks of factor x factor cells: max, mean and min; what is left at the edge is dropped."""
    whole = cells.where((F.col("row") < rows // factor * factor) & (F.col("col") < cols // factor * factor))
    return whole.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.max(value).alias("highest"), F.avg(F.col(value).cast("double")).alias("mean"), F.min(value).alias("lowest"))


def coarse_any(cells: DataFrame, factor: int, mask: str) -> DataFrame:
    return cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.bool_or(mask).alias("any"))


def surface_summary(cells: DataFrame, foot: float = 0.3048) -> DataFrame:
    return cells.agg(F.min("surface").alias("lowest"), F.max("surface").alias("highest"), F.max("heights").alias("tallest_m"), (F.max("heights") / foot).alias("tallest_ft"))


def tiles_of_domain(tiles: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Catalog rows whose box touches the domain; join points to it to prune partitions."""
    return tiles.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))


def covered(points: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """``points`` (x, y) with the tile that covers them, null if none has it: an equi-join on the tile's key."""
    key = lambda c: F.floor(c / size).cast("long")
    named = tiles.select("name", key(F.col("xmin")).alias("tx"), key(F.col("ymin")).alias("ty"))
    return points.withColumn("tx", key(F.col("x"))).withColumn("ty", key(F.col("y"))).join(named, ["tx", "ty"], "left")


def presence_map(tiles: DataFrame, xs: list[int]) -> DataFrame:
    """Pivot of tiles by their key: one row a ty, one column a tx."""
    return tiles.groupBy("ty").pivot("tx", xs).agg(F.count(F.lit(1)))
