"""Walls: where they are, which way they face, and when the sun reaches them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.solar import clear_sky_dni, sun_vector
from .focal import BOX, _around, gaussian
from .small import small

EDGE_SKIP_M, SELF_SKIP_M, MAX_MARCH_M = 4.0, 6.0, 2500.0


def wall_cells(cells: DataFrame, mask: str = "built") -> DataFrame:
    """Mask cells that touch the rest, corners included; off the lattice counts as the rest."""
    held = _around(cells.where(F.col(mask)), BOX).groupBy("row", "col").count()
    inner = held.where(F.col("count") == len(BOX)).select("row", "col")
    return cells.where(F.col(mask)).join(inner, ["row", "col"], "left_anti")


def wall_normals(cells: DataFrame, mask: str = "built", sigma: float = 1.2) -> DataFrame:
    """Wall cells with outward unit normals (ne, nn) from the slope of the smoothed mask."""
    solid = cells.select("row", "col", F.col(mask).cast("double").alias("m"))
    smooth = gaussian(solid, "m", sigma, 0.0).select("row", "col", F.coalesce("smooth", F.lit(0.0)).alias("s"))
    side = _around(smooth, [(-1, 0), (1, 0), (0, -1), (0, 1)], "s")
    at = lambda r, c: F.coalesce(F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("s"))), F.lit(0.0))
    slope = side.groupBy("row", "col").agg(((at(0, 1) - at(0, -1)) / 2).alias("gc"), ((at(1, 0) - at(-1, 0)) / 2).alias("gr"))
    steep = F.hypot("gc", "gr")
    return wall_cells(cells, mask).join(slope.where(steep > 1e-6).withColumn("steep", steep), ["row", "col"]).withColumn("ne", -F.col("gc") / F.col("steep")).withColumn("nn", F.col("gr") / F.col("steep")).drop("gc", "gr", "steep")


def wall_samples(walls: DataFrame, levels: int = 4) -> DataFrame:
    """Samples at the middles of ``levels`` equal parts of each wall's height."""
    frac = (F.col("level") + 0.5) / levels
    spread = walls.where("heights > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return spread.withColumn("height_frac", frac).withColumn("z_above_ground", frac * F.col("heights"))


def march(samples: DataFrame, cells: DataFrame, suns: DataFrame, cell_m: float, bearing: float = 0.0, reach_m: float = MAX_MARCH_M) -> DataFrame:
    """(sample columns, sun columns, lit, gain) of walls that face the sun.

    A ray starts one cell outside the wall and climbs towards the sun; cells in
    front of the first ``EDGE_SKIP_M`` and the building's own within
    ``SELF_SKIP_M`` do not count.  ``samples`` has row, col, ne, nn, label, z0;
    ``suns`` is a handful of rows.
    """
    edge, own = max(1, round(EDGE_SKIP_M / cell_m)), max(2, round(SELF_SKIP_M / cell_m))
    top = cells.agg(F.max("surface").alias("t")).first()["t"] or 0.0
    keys = samples.columns
    sun = sun_vector(F.col("altitude"), F.pmod(F.col("azimuth") - bearing, F.lit(360.0)))
    up = suns.where("altitude > 0.5").withColumn("_to_sun", sun).withColumn("tan_alt", F.tan(F.radians("altitude")))
    facing = samples.join(small(up)).withColumn("cos_aoi", F.col("ne") * F.col("_to_sun.east") + F.col("nn") * F.col("_to_sun.north")).where("cos_aoi > 0")
    flat = F.hypot("_to_sun.east", "_to_sun.north")
    steps = F.floor(F.least(F.lit(reach_m), F.greatest(F.lit(0.0), F.lit(float(top)) - F.col("z0")) / F.col("tan_alt")) / cell_m).cast("int") + 2
    n = F.col("n")
    steps_of = facing.withColumn("n", F.explode(F.when(steps >= edge, F.sequence(F.lit(edge), steps)))).select(
        *keys, *suns.columns,
        F.rint(F.col("row") - F.col("nn") - n * F.col("_to_sun.north") / flat).cast("int").alias("r2"),
        F.rint(F.col("col") + F.col("ne") + n * F.col("_to_sun.east") / flat).cast("int").alias("c2"),
        (F.col("z0") + (n + 1) * cell_m * F.col("tan_alt")).alias("ray"),
        (n < own).alias("near"),
    )
    tops = cells.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("surface").alias("top"), F.col("label").alias("there"))
    dark = steps_of.join(tops, ["r2", "c2"]).where((F.col("top") > F.col("ray")) & ~(F.col("near") & (F.col("there") == F.col("label")))).select("sample", *suns.columns).distinct().withColumn("dark", F.lit(True))
    judged = facing.join(dark, ["sample", *suns.columns], "left").withColumn("lit", F.col("dark").isNull())
    gain = F.when(F.col("lit"), clear_sky_dni(F.col("altitude")) * F.col("cos_aoi")).otherwise(0.0)
    return judged.select(*keys, *suns.columns, "lit", gain.alias("gain"))


def bearing_of(ne: Column, nn: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(ne, nn)), F.lit(360.0))
