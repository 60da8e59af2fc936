"""Wind runs: choosing, resampling, comparing and scoring them; columns of voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import circular_distance, percent_change
from .ranks import with_percentiles
from .small import small


TREE_M = 2.0


def nearest_run(hours: DataFrame, runs: DataFrame) -> DataFrame:
    """Each row of ``hours`` (direction) with the run whose direction is next on the circle, the first on ties.

    ``runs`` (run, run_direction) is a catalog of directions, a handful of rows.
    """
    names = hours.columns
    gathered = F.broadcast(small(runs).agg(F.collect_list(F.struct("run", "run_direction")).alias("_runs")))
    away = F.transform("_runs", lambda r: F.struct(circular_distance(r["run_direction"], F.col("direction")).alias("away"), r["run"].alias("run")))
    return hours.join(gathered).withColumn("_best", F.array_min(away)).select(*names, F.col("_best.run").alias("run"), F.col("_best.away").alias("away"))


def noise_bar(ratios: DataFrame, quiet: Column, *keys: str) -> DataFrame:
    """Population deviation over quiet ground."""
    return ratios.where(quiet).groupBy(*keys).agg(F.stddev_pop("change").alias("noise"))


def reconciled(ratios: DataFrame, noise: DataFrame, key: str, sigmas: float = 3.0) -> DataFrame:
    """Changes that stand out of the noise; others are none."""
    kept = F.when(F.abs("change") > sigmas * F.coalesce("noise", F.lit(0.0)), F.col("change")).otherwise(0.0)
    return ratios.join(noise, key, "left").withColumn("kept", kept)


def with_percent(ratios: DataFrame) -> DataFrame:
    return ratios.withColumn("percent", percent_change(F.col("before"), F.col("after")))


def benchmark_scores(pairs: DataFrame, *keys: str, near: Column | None = None, hit: float = 0.25) -> DataFrame:
    """Scores of modelled against measured: correlation, errors, hit rate, ratio of means."""
    e = F.col("model") - F.col("measured")
    near = F.lit(True) if near is None else near
    relative = F.try_divide(F.col("model"), F.col("measured")) - 1.0
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.corr("model", "measured").alias("r"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg((F.abs(e) <= hit * F.abs("measured")).cast("int")).alias("hit_rate"),
        F.try_divide(F.avg("model"), F.avg("measured")).alias("mean_ratio"),
        F.avg(F.when(near, F.abs(e))).alias("near_mae"),
        F.count_if(near).alias("near_n"),
        F.avg(F.when(near, F.abs(relative))).alias("near_relative"),
        F.avg(relative).alias("relative_bias"),
    )


def convergence(samples: DataFrame, *keys: str) -> DataFrame:
    """Difference of the means of two halves of a run against its speed; ``samples`` has keys, row, col, half, speed."""
    cells = samples.groupBy(*keys, "row", "col").agg(F.avg(F.when(F.col("half") == 1, F.col("speed"))).alias("a"), F.avg(F.when(F.col("half") == 2, F.col("speed"))).alias("b"), F.avg("speed").alias("all"))
    both = cells.where("a is not null and b is not null").select(*keys, F.abs(F.col("a") - F.col("b")).alias("_off"), "all")
    out = with_percentiles(both.groupBy(*keys).agg(F.count("*").alias("_n")), both, {"_off": ("_off", 0.5), "_all": ("all", 0.5), "p90_change": ("_off", 0.9)}, *keys)
    return out.select(*keys, F.try_divide("_off", "_all").alias("median_change"), "p90_change")


def voxel_columns(cells: DataFrame, factor: int, dz: float, nz: int) -> DataFrame:
    """Columns of factor x factor cells: ground, building and crown heights, cover, open levels and the first of them."""
    part = lambda c: F.floor(F.col(c) / factor).cast("int")
    tree = F.col("canopy") > TREE_M
    cols = cells.groupBy(part("row").alias("j"), part("col").alias("i")).agg(
        F.avg("ground").alias("ground"), F.median(F.col("building").cast("double")).alias("bh"), F.coalesce(F.avg(F.when(tree, F.col("canopy"))), F.lit(0.0)).alias("ch"), F.avg(tree.cast("int")).alias("cover")
    )
    top = F.col("ground") + F.col("bh")
    solid = F.transform(F.sequence(F.lit(0), F.lit(nz - 1)), lambda k: (k + 0.5) * dz < top)
    first = F.array_position(solid, False)
    return cols.withColumn("kfirst", F.when(first > 0, first - 1).otherwise(nz).cast("int")).withColumn("n_solid", F.size(F.filter(solid, lambda s: s)))


def street_reference(cells: DataFrame, value: str, every: int = 3) -> DataFrame:
    """Median over every third lawn cell in scan order, of those that have a value; the rank comes from counts by row, not one sorted list."""
    from pyspark.sql import Window

    lawn = cells.where(F.col("lawn"))
    rows = lawn.groupBy("row").count().withColumn("start", F.sum("count").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.coalesce("start", F.lit(0)) + F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    third = lawn.join(rows.select("row", "start"), "row").withColumn("place", place).where(F.col("place") % every == 0).select(value)
    return with_percentiles(third.agg(F.count("*").alias("n")), third, {"reference": (value, 0.5)})


def turned_box(x: Column, y: Column, from_degrees: float, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    """Cells along and across the wind of map coordinates."""
    import math

    t = math.radians(from_degrees)
    ex, ey = (-math.sin(t), -math.cos(t)), (math.cos(t), -math.sin(t))
    dx, dy = x - x0, y - y0
    return (dx * ex[0] + dy * ex[1]) / res, (dx * ey[0] + dy * ey[1]) / res
