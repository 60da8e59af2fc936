"""Zonal statistics: one value a label, band or section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import with_percentiles


def floor_quantile(cells: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """(keys, quantile): the sorted value at index floor(q (n - 1)), without interpolation.

    Values are counted before they are shuffled and ranked by running sums over the
    distinct ones, so no zone is held in one row.
    """
    counts = cells.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    return placed.where(F.col("_upto") > F.floor(q * (F.col("_all") - 1))).groupBy(*keys).agg(F.min(value).alias("quantile"))


def label_statistics(cells: DataFrame, value: str, mask: str, q: float = 0.99, label: str = "label") -> DataFrame:
    """Per label above 0: count, median, floor-index quantile and share of ``mask``."""
    inside = cells.where(F.col(label) > 0)
    counted = inside.groupBy(label).agg(F.count("*").alias("n"), F.median(F.col(value).cast("double")).alias("median"), F.coalesce(F.avg(F.col(mask).cast("int")), F.lit(0.0)).alias("fraction"))
    return counted.join(floor_quantile(inside, value, q, label), label, "left").select(label, "n", "median", "quantile", "fraction")


def masked_statistics(cells: DataFrame, value: str, valid: Column) -> DataFrame:
    v = F.when(valid, F.col(value))
    seen = cells.select(v.alias("_value"))
    whole = seen.agg(F.min("_value").alias("least"), F.max("_value").alias("most"), F.avg("_value").alias("mean"))
    return with_percentiles(whole, seen, {"middle": ("_value", 0.5)})


def share(test: Column) -> Column:
    return F.avg(test.cast("int"))


def band_profile(cells: DataFrame, distance: Column, step: float, aggregates: list[Column], cell_ha: float, least_ha: float) -> DataFrame:
    """Half-open bands of distance; bands of less than ``least_ha`` are dropped."""
    band = F.floor(distance / step).cast("int")
    area = F.count("*") * cell_ha
    grouped = cells.groupBy(band.alias("band")).agg(area.alias("area_ha"), *aggregates)
    return grouped.where(F.col("area_ha") >= least_ha).select((F.col("band") * step).cast("int").alias("from_m"), ((F.col("band") + 1) * step).cast("int").alias("to_m"), *[c for c in grouped.columns if c != "band"])


def section_means(cells: DataFrame, value: str, size: int = 5, least: int = 12) -> DataFrame:
    """Means of size x size sections with at least ``least`` values."""
    part = lambda c: F.floor(F.col(c) / size).cast("int")
    grouped = cells.where(F.col(value).isNotNull()).groupBy(part("row").alias("srow"), part("col").alias("scol"))
    return grouped.agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean")).where(F.col("n") >= least)


def roof_levels(values: DataFrame, label: str, value: str, least_share: float = 0.10, band: float = 5.0, step: float = 0.5) -> DataFrame:
    """Per label the highest level, scanned down by ``step``, whose band holds the share; the band's median.

    Levels are tested with counts of values per step, so no value meets every level.
    """
    v = F.col(value).cast("double")
    top = values.groupBy(label).agg(F.max(v).alias("top"), F.count("*").alias("all"), F.median(v).alias("overall"))
    # A value is in the bands of levels top - k step, for k in a range that follows from the value.
    spread = values.join(top, label).withColumn("lowest_k", F.greatest(F.lit(0), F.ceil((F.col("top") - v - band) / step))).withColumn("highest_k", F.floor((F.col("top") - v + band) / step))
    spread = spread.withColumn("highest_k", F.least("highest_k", F.ceil(F.col("top") / step) - 1))
    edges = spread.where("lowest_k <= highest_k").select(label, "top", "all", F.explode(F.array(F.struct(F.col("lowest_k").alias("k"), F.lit(1).alias("d")), F.struct((F.col("highest_k") + 1).alias("k"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(label, "top", "all", F.col("e.k").alias("k")).agg(F.sum("e.d").alias("d"))
    from pyspark.sql import Window

    held = F.sum("d").over(Window.partitionBy(label).orderBy("k"))
    level = steps.withColumn("held", held).where(F.col("held") >= least_share * F.col("all")).where(F.col("k") <= F.ceil(F.col("top") / step) - 1).groupBy(label).agg(F.min("k").alias("k"))
    chosen = spread.join(level, label).where((F.col("lowest_k") <= F.col("k")) & (F.col("k") <= F.col("highest_k"))).groupBy(label).agg(F.median(v).alias("in_band"))
    return top.join(chosen, label, "left").select(label, F.coalesce("in_band", "overall").alias("roof_level"))


def facade_rollup(samples: DataFrame, value: str = "hours") -> DataFrame:
    """Per building: all walls, the lower and upper half, the four quarters (45 degrees belong to both) and the best."""
    half = F.col("height_frac") < 0.5
    toward = {"n": 0.0, "e": 90.0, "s": 180.0, "w": 270.0}
    v = F.col(value)
    near = {k: F.abs(F.pmod(F.col("bearing") - b + 180.0, F.lit(360.0)) - 180.0) <= 45.0 for k, b in toward.items()}
    quarters = {k: F.coalesce(F.avg(F.when(test, v)), F.lit(0.0)) for k, test in near.items()}
    out = samples.groupBy("label").agg(F.avg(v).alias("all_walls"), F.coalesce(F.avg(F.when(half, v)), F.lit(0.0)).alias("low"), F.coalesce(F.avg(F.when(~half, v)), F.lit(0.0)).alias("high"), *[q.alias(k) for k, q in quarters.items()])
    return out.withColumn("best", F.greatest("n", "e", "s", "w"))
