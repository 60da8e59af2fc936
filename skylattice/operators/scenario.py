"""Scenarios: what stood before and what stands today."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURVEY_YEAR = 2017
GROWN_M, RAISE_M, BUILT_M = 6.0, 3.0, 3.0


def scenario_heights(buildings: DataFrame, statistics: DataFrame, today: bool) -> DataFrame:
    """(label, height_m) of ``buildings`` (label, height_m, year) and label ``statistics`` (label, median, fraction outside).

    Today: the recorded roof, else the survey's median.  Before: the survey's
    median; what lies mostly outside the survey keeps its record if built before.
    """
    joined = buildings.join(statistics.select("label", "median", "fraction"), "label", "left")
    outside = F.coalesce(F.col("fraction") > 0.5, F.lit(False))
    late = outside & (F.coalesce("year", F.lit(0)) >= SURVEY_YEAR)
    height = F.coalesce("height_m", "median") if today else F.when(late, 0.0).when(outside, F.col("height_m")).otherwise(F.col("median"))
    return joined.select("label", F.greatest(F.coalesce(height, F.lit(0.0)), F.lit(0.0)).alias("height_m"))


def grown_labels(buildings: DataFrame, statistics: DataFrame) -> DataFrame:
    """Labels whose recorded roof stands well above what was surveyed, or was not measured at all."""
    s = statistics.select("label", "quantile", "fraction", "n")
    grew = F.col("quantile").isNull() | (F.col("height_m") > F.col("quantile") + GROWN_M)
    return buildings.join(s, "label").where(F.col("height_m").isNotNull() & grew & (F.col("fraction") <= 0.5) & (F.col("n") > 0)).select("label", "height_m", "quantile")


def burn(cells: DataFrame, heights: DataFrame, grown: DataFrame | None = None, cap: float | None = None) -> DataFrame:
    """Surface with building heights burnt in.

    A no-data cell of a footprint becomes a prism.  Other cells rise to
    ground + height where that is more than ``RAISE_M`` above the surface; with
    ``grown`` only for those labels.  ``cap`` lowers the cells of buildings, which
    are labels of ``BUILT_M`` and more; trees and low labels stay (see ``capped``).
    """
    target = F.col("ground") + F.col("height_m")
    joined = cells.join(heights, "label", "left")
    may = F.lit(True)
    if grown is not None:
        joined = joined.join(grown.select("label", F.lit(True).alias("is_grown")), "label", "left")
        may = F.coalesce("is_grown", F.lit(False))
    h = F.coalesce("height_m", F.lit(0.0))
    surface = F.when(F.col("nodata") & (F.col("label") > 0), F.col("ground") + h).when(may & (target > F.col("surface") + RAISE_M), target).otherwise(F.col("surface").cast("double"))
    out = joined.withColumn("burnt", surface)
    if cap is not None:
        built = (F.col("label") > 0) & (h >= BUILT_M)
        out = out.withColumn("burnt", F.when(built & (F.col("burnt") > F.col("ground") + cap), F.col("ground") + cap).otherwise(F.col("burnt")))
    return out.select(*cells.columns, "burnt")


def capped(heights: DataFrame, cap: float) -> DataFrame:
    """(label, height_m, lowered) under a height cap."""
    return heights.select("label", F.least(F.col("height_m"), F.lit(cap)).alias("height_m"), (F.col("height_m") > cap).alias("lowered"))


def hold_equal(now: Column, before: Column, differs: Column) -> Column:
    """Where nothing differs the earlier surface is today's."""
    return F.when(differs, before).otherwise(now)


def canopy(height: Column, built: Column, water: Column, distance: Column) -> Column:
    free = ~built & ~water & (distance > 4.0)
    return F.when(free & (height >= 2.0), F.least(height, F.lit(40.0))).otherwise(0.0)


def land_cover(building: Column, water: Column, park: Column) -> Column:
    """Class codes; buildings over water over grass."""
    return F.when(building, 2).when(water, 7).when(park, 5).otherwise(1)


def street(built: Column, blank: Column, resource: Column) -> Column:
    return ~(built | blank) & ~resource


def published_window(x: Column, y: Column, cx: float, cy: float, half: float) -> Column:
    return (F.abs(x - cx) <= half) & (F.abs(y - cy) <= half)


def viewer_buildings(buildings: DataFrame, ring_m: float = 200.0, tower_m: float = 100.0, reach_m: float = 1500.0, rings: int = 6000, towers: int = 250) -> DataFrame:
    """Buildings (label, height_m, distance, in_frame, file_order) classed frame, ring or tower, in this precedence; the last two capped."""
    kind = F.when(F.col("in_frame"), "frame").when(F.col("distance") <= ring_m, "ring").when((F.col("height_m") >= tower_m) & (F.col("distance") <= reach_m), "tower")
    classed = buildings.where("height_m >= 3").withColumn("kind", kind).where("kind is not null")
    part = lambda k: classed.where(F.col("kind") == k)
    return part("frame").unionByName(part("ring").orderBy("file_order").limit(rings)).unionByName(part("tower").orderBy(F.desc("height_m"), "file_order").limit(towers))


def rasterise(rings: DataFrame, grid_rows: int, grid_cols: int) -> DataFrame:
    """Label of the last feature that holds each cell's centre; ``rings`` (label, file_order, ring of (row, col) vertices).

    A ring yields the cells of its bounding rows and columns, and the crossing
    number decides; features meet cells only where their boxes do.
    """
    r = F.transform("ring", lambda p: p["row"])
    c = F.transform("ring", lambda p: p["col"])
    lo = lambda a, most: F.greatest(F.lit(0), F.ceil(F.array_min(a) - 0.5)).cast("int")
    hi = lambda a, most: F.least(F.lit(most - 1), F.floor(F.array_max(a) - 0.5)).cast("int")
    boxed = rings.select("label", "file_order", "ring", lo(r, grid_rows).alias("r0"), hi(r, grid_rows).alias("r1"), lo(c, grid_cols).alias("c0"), hi(c, grid_cols).alias("c1")).where("r0 <= r1 and c0 <= c1")
    cells = boxed.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    y, x = F.col("row") + 0.5, F.col("col") + 0.5
    shifted = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    edges = F.arrays_zip(F.col("ring").alias("a"), shifted.alias("b"))
    crosses = lambda e: ((e["a"]["row"] > y) != (e["b"]["row"] > y)) & (x < e["a"]["col"] + (y - e["a"]["row"]) * (e["b"]["col"] - e["a"]["col"]) / F.when(e["a"]["row"] != e["b"]["row"], e["b"]["row"] - e["a"]["row"]).otherwise(F.lit(1.0)))
    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return cells.where(odd).groupBy("row", "col").agg(F.max_by("label", "file_order").alias("label"))


def siblings(buildings: DataFrame, reach: float = 6e-5) -> DataFrame:
    """Pairs that are parts of one building: same number, same lot, or same roof next door.

    Neighbours are found by an equi-join on squares of the plane, not by distance alone.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    b = buildings.withColumn("gx", cell("x")).withColumn("gy", cell("y"))
    spread = b.withColumn("gx", F.explode(F.array(*[F.col("gx") + d for d in (-1, 0, 1)]))).withColumn("gy", F.explode(F.array(*[F.col("gy") + d for d in (-1, 0, 1)])))
    a, o = spread.alias("a"), b.alias("o")
    near = a.join(o, (F.col("a.gx") == F.col("o.gx")) & (F.col("a.gy") == F.col("o.gy")) & (F.col("a.label") < F.col("o.label")))
    close = F.hypot(F.col("a.x") - F.col("o.x"), F.col("a.y") - F.col("o.y")) < reach
    same = (F.col("a.bin") == F.col("o.bin")) | (F.col("a.lot") == F.col("o.lot")) | ((F.abs(F.col("a.height_m") - F.col("o.height_m")) < 1) & close)
    return near.where(same).select(F.col("a.label").alias("a"), F.col("o.label").alias("b")).distinct()
