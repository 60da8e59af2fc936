"""Reports: statistics around buildings and streets, steps of a day, ranked lists, lookups with a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bin_of
from .ranks import with_percentiles


def ring_statistics(cells: DataFrame, distance: Column, open_: Column, *keys: str, near: float = 20.0, far: float = 80.0) -> DataFrame:
    """Median and 90th percentile of ``before`` and ``after`` over open ground from ``near`` to ``far`` metres, both included."""
    ring = cells.where(open_ & distance.between(near, far))
    wanted = {f"{n}_{c}": (c, q) for c in ("before", "after") for n, q in (("median", 0.5), ("p90", 0.9))}
    out = with_percentiles(ring.groupBy(*keys).agg(F.count("*").alias("cells")), ring, wanted, *keys)
    return out.withColumn("change_pct", 100.0 * (F.try_divide("median_after", "median_before") - 1.0))


def street_wind_statistics(cells: DataFrame, cell_ha: float, *keys: str, by: float = 30.0) -> DataFrame:
    """Of ``percent`` changes and ratios ``after``: medians, 90th percentile, areas windier and calmer by ``by`` per cent."""
    p = F.col("percent")
    areas = cells.groupBy(*keys).agg((F.count_if(p >= by) * cell_ha).alias("windier_ha"), (F.count_if(p <= -by) * cell_ha).alias("calmer_ha"))
    return with_percentiles(areas, cells, {"median_ratio": ("after", 0.5), "p90_ratio": ("after", 0.9), "median_pct": ("percent", 0.5)}, *keys)


def step_summary(cells: DataFrame, cell_ha: float, *keys: str) -> DataFrame:
    """One step of a day: median felt temperature, areas colder by 2 and 5 degrees, the biggest drop.  ``cells`` has felt and du."""
    du = F.col("du")
    areas = cells.groupBy(*keys).agg(
        (F.count_if(du <= -2) * cell_ha).alias("colder_2_ha"),
        (F.count_if(du <= -5) * cell_ha).alias("colder_5_ha"),
        (-F.min(du)).alias("biggest_drop"),
    )
    return with_percentiles(areas, cells, {"felt": ("felt", 0.5)}, *keys)


def wind_part(cells: DataFrame) -> DataFrame:
    """``cells`` (d_wind, d_uniform) with the part of the change that the wind makes."""
    return cells.withColumn("wind_part", F.col("d_wind") - F.col("d_uniform"))


def wind_part_summary(cells: DataFrame, *keys: str) -> DataFrame:
    part = wind_part(cells)
    wanted = {"median": ("wind_part", 0.5)} | {f"p{p:02d}": ("wind_part", p / 100) for p in (5, 95)}
    return with_percentiles(part.groupBy(*keys).agg(F.count("*").alias("_n")), part, wanted, *keys).drop("_n")


def worst_of_day(hours: DataFrame, value: str, *keys: str) -> DataFrame:
    """The least value of each cell over the hours; what is no number does not count."""
    v = F.col(value)
    return hours.groupBy(*keys, "row", "col").agg(F.min(F.when(~F.isnan(v.cast("double")), v)).alias("worst"))


def tile_occupancy(points: DataFrame, tiles: DataFrame, block: float) -> DataFrame:
    """Of each tile: the share of its blocks with a return, and of those in its corners (an eighth of its height wide).

    ``points`` has name, x, y; ``tiles`` name, xmin, xmax, ymin, ymax.  Blocks are counted once before they travel.
    A tile without a return has shares of 0, one without an area none.
    """
    size = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo)) / block).cast("int")
    sized = tiles.select("name", "xmin", "ymax", size("xmin", "xmax").alias("nx"), size("ymin", "ymax").alias("ny"))
    place = lambda d, n: F.least(F.greatest(F.floor(d / block), F.lit(0)), F.col(n) - 1).cast("int")
    hit = points.join(sized, "name").select("name", "nx", "ny", place(F.col("x") - F.col("xmin"), "nx").alias("c"), place(F.col("ymax") - F.col("y"), "ny").alias("r")).distinct()
    k = F.greatest(F.lit(1), F.floor(F.col("ny") / 8))
    top, bottom, left, right = F.col("r") < k, F.col("r") >= F.col("ny") - k, F.col("c") < k, F.col("c") >= F.col("nx") - k
    corners = {"top_left": top & left, "top_right": top & right, "bottom_left": bottom & left, "bottom_right": bottom & right}
    counted = hit.groupBy("name").agg(F.count("*").alias("fill"), *[F.count_if(m).alias(n) for n, m in corners.items()])
    share = lambda n, of: (F.coalesce(n, F.lit(0)) / F.nullif(of, F.lit(0))).alias(n)
    all_, corner = F.col("nx") * F.col("ny"), F.least(k, F.col("ny")) * F.least(k, F.col("nx"))
    return sized.join(counted, "name", "left").select("name", share("fill", all_), *[share(n, corner) for n in corners])


def missing_tiles(cells: DataFrame, name: Column, covered: Column, most: int = 12) -> DataFrame:
    """Names of the tiles that cover no cell asked for, by how many cells they would serve, with their share of all."""
    counts = cells.groupBy(name.alias("name")).agg(F.count_if(~covered).alias("cells"), F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    ranked = counts.where("cells > 0").orderBy(F.desc("cells"), "name").limit(most)
    return ranked.join(F.broadcast(total)).select("name", "cells", (100.0 * F.col("cells") / F.col("total")).alias("share_pct"))


def ranked(df: DataFrame, by: str, tie: str, most: int) -> DataFrame:
    """The ``most`` largest, equal ones in the order of ``tie``."""
    return df.orderBy(F.desc(by), tie).limit(most)


def grown_report(cells: DataFrame, grown: DataFrame, target: Column, raised: float = 3.0) -> DataFrame:
    """Of each grown label: its height, what was surveyed, and how many cells rise by more than ``raised``."""
    rise = cells.join(grown, "label").where(target > F.col("surface") + raised)
    return rise.groupBy("label").agg(F.first("height_m").alias("height_m"), F.first("quantile").alias("quantile"), F.count("*").alias("cells_raised"))


def in_box(features: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Features whose box (xmin, ymin, xmax, ymax) touches the given one, edges included."""
    return features.where((F.col("xmax") >= west) & (F.col("xmin") <= east) & (F.col("ymax") >= south) & (F.col("ymin") <= north))


def fit_guard(features: DataFrame, selected: bool, most_degrees: float = 0.1) -> DataFrame:
    """``features`` (name, xmin, ymin, xmax, ymax), if a frame may be fitted around them: of one name unless they were selected, and not too wide."""
    found = features.agg(F.count_distinct("name").alias("names"), (F.max("xmax") - F.min("xmin")).alias("wide"), (F.max("ymax") - F.min("ymin")).alias("high")).first()
    if found["names"] > 1 and not selected:
        raise ValueError(f"{found['names']} names and no selection among them")
    if max(found["wide"] or 0, found["high"] or 0) > most_degrees:
        raise ValueError(f"features span {found['wide']} by {found['high']} degrees")
    return features


def named_near(points: DataFrame, names: DataFrame, dx: float = 5e-4, dy: float = 4e-4) -> DataFrame:
    """A row (id, name) for each of ``points`` (id, x, y): the first of ``names`` (name, nx, ny, place) less than dx and dy away, null without one.

    Points at one place have one answer, and of names at one place only the first
    can be it, so places meet places.  Both are cut into squares of dx by dy; a
    place meets the names of the nine squares around it by an equi-join.  Names
    of equal ``place`` go by name; without a place a name is never the first.
    """
    key = lambda c, d: F.floor(c / d).cast("long")
    around = lambda c, d: F.explode(F.sequence(key(c, d) - 1, key(c, d) + 1))
    places = points.select("x", "y").distinct()
    firsts = names.where("place is not null").groupBy("nx", "ny").agg(F.min(F.struct("place", "name")).alias("first"))
    spread = places.select("x", "y", around(F.col("x"), dx).alias("kx")).select("x", "y", "kx", around(F.col("y"), dy).alias("ky"))
    met = spread.join(firsts.select("nx", "ny", "first", key(F.col("nx"), dx).alias("kx"), key(F.col("ny"), dy).alias("ky")), ["kx", "ky"])
    close = met.where((F.abs(F.col("x") - F.col("nx")) < dx) & (F.abs(F.col("y") - F.col("ny")) < dy))
    found = close.groupBy("x", "y").agg(F.min("first").alias("first"))
    return points.select("id", "x", "y").join(found, ["x", "y"], "left").select("id", F.col("first.name").alias("name"))


def report_steps(days: DataFrame, times: list[str]) -> DataFrame:
    """A row a day and time of day (HH:MM), as timestamps."""
    minutes = F.array(*[F.lit(60 * int(t[:2]) + int(t[3:])) for t in times])
    return days.withColumn("minute", F.explode(minutes)).withColumn("ts", F.timestamp_add("MINUTE", F.col("minute"), F.col("day").cast("timestamp_ntz")))


def nearest_step(steps: DataFrame, targets: DataFrame, *keys: str) -> DataFrame:
    """Of each key the step (ts) next to its target, the earlier of two as near."""
    away = F.abs(F.timestamp_diff("SECOND", F.col("ts"), F.col("target")))
    return steps.join(targets, list(keys)).groupBy(*keys).agg(F.min_by("ts", F.struct(away.alias("away"), F.col("ts").alias("ts"))).alias("ts"))


def job_queue(parts: list[tuple[str, DataFrame]], only: str | None = None) -> DataFrame:
    """Jobs of all parts in the order of the parts, or of one: (part, place in the queue, columns)."""
    kept = [(k, name, df) for k, (name, df) in enumerate(parts) if only in (None, name)]
    out = None
    for k, name, df in kept:
        one = df.select(F.lit(k).alias("place"), F.lit(name).alias("part"), *df.columns)
        out = one if out is None else out.unionByName(one)
    return out


def kept_walls(walls: DataFrame, labels: DataFrame) -> DataFrame:
    """Walls of the labels that are kept."""
    return walls.join(labels.select("label"), "label", "left_semi")


def change_bin(change: Column, edges: list[float], unchanged: float) -> Column:
    """Bin of a change; the bin that starts at ``unchanged`` is a hole, 0."""
    found = bin_of(change, edges)
    return F.when(found == edges.index(unchanged) + 1, 0).otherwise(found)


def metric_factor(east: tuple[float, float], north: tuple[float, float], unit_m: float, tolerance: float = 1e-6) -> float:
    """``unit_m``, if one unit east and north on the map are just that many metres east and north: no turn, no shear."""
    for got, want in zip((*east, *north), (unit_m, 0.0, 0.0, unit_m), strict=True):
        if abs(got - want) > tolerance:
            raise ValueError("the projections differ by more than their unit")
    return unit_m


def masks(reported: Column, building: Column, water: Column, canopy: Column, tall: float = 2.0) -> dict[str, Column]:
    """Open lawn (no crown), and open ground, of what is reported."""
    ground = reported & ~building & ~water
    return {"open_lawn": ground & (canopy < tall), "open_ground": ~building & ~water, "under_trees": ground & (canopy >= tall)}


def along_avenue(x: Column, y: Column, x0: float, y0: float, bearing: float) -> tuple[Column, Column]:
    """Distance up the avenue of a bearing, and across it, from a point."""
    up = F.sin(F.radians(F.lit(bearing))), F.cos(F.radians(F.lit(bearing)))
    dx, dy = x - x0, y - y0
    return dx * up[0] + dy * up[1], dx * up[1] - dy * up[0]


def both_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells in both."""
    return a.select("row", "col").intersect(b.select("row", "col"))


def hour_cells(hours: list[DataFrame]) -> DataFrame:
    """Cells of several hours one after another, repeats kept."""
    out = hours[0]
    for more in hours[1:]:
        out = out.unionByName(more)
    return out


def first_in(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= most)


def banded_heat(changes: DataFrame, distance: Column, bands: dict[str, tuple[float, float]], thresholds: tuple[int, ...], cell_ha: float) -> DataFrame:
    """Per band of distance, [from, to): area that reaches each threshold at any hour, area-hours, and the mean change.  Bands may overlap.

    ``changes`` has row, col, hour, du, and may say in ``colder`` which hours moved to a colder category: their area-hours come, too.
    """
    colder = "colder" in changes.columns
    named = F.filter(F.array(*[F.when((distance >= lo) & (distance < hi), F.lit(name)) for name, (lo, hi) in bands.items()]), lambda b: b.isNotNull())
    cells = changes.withColumn("band", F.explode(named)).groupBy("band", "row", "col").agg(F.sum("du").alias("s"), F.count("du").alias("k"), F.min("du").alias("worst"), *[F.count_if(F.col("du") <= t).alias(f"h{-t}") for t in thresholds], *([F.count_if("colder").alias("hc")] if colder else []))
    totals = [x for t in thresholds for x in ((F.count_if(F.col("worst") <= t) * cell_ha).alias(f"any_{-t}_ha"), (F.sum(f"h{-t}") * cell_ha).alias(f"hours_{-t}_ha"))]
    totals += [(F.sum("hc") * cell_ha).alias("hours_colder_ha")] if colder else []
    return cells.groupBy("band").agg(F.count("*").alias("cells"), (F.sum("s") / F.sum("k")).alias("mean"), *totals)


def in_own_boxes(cells: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """``cells`` (row, col, x, y) with ``in_tiles``: whether some tile's own box (xmin, xmax, ymin, ymax) has the point, edges included.

    Boxes are entered in all squares of ``size`` they touch; a cell meets those of its square by an equi-join.
    """
    key = lambda c: F.floor(c / size).cast("long")
    span = lambda lo, hi: F.explode(F.sequence(key(F.col(lo)), key(F.col(hi))))
    entered = tiles.select("xmin", "xmax", "ymin", "ymax", span("xmin", "xmax").alias("kx")).select("xmin", "xmax", "ymin", "ymax", "kx", span("ymin", "ymax").alias("ky"))
    met = cells.select("row", "col", "x", "y", key(F.col("x")).alias("kx"), key(F.col("y")).alias("ky")).join(entered, ["kx", "ky"])
    hit = met.where(F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))).select("row", "col", F.lit(True).alias("in_tiles")).distinct()
    return cells.join(hit, ["row", "col"], "left").withColumn("in_tiles", F.coalesce("in_tiles", F.lit(False)))


def newest_reading(readings: DataFrame, *keys: str) -> DataFrame:
    """Of each station the latest reading (ts, direction, speed); of equal times the larger speed."""
    last = F.max_by(F.struct("ts", "direction", "speed"), F.struct("ts", "speed", "direction"))
    return readings.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.ts", "_r.direction", "_r.speed")


def live_wind(ratios: DataFrame, reading: DataFrame, runs: DataFrame, *keys: str) -> DataFrame:
    """Wind of each cell now: the ``ratios`` (run, row, col, k) of the run whose direction is next to the newest reading's, times its speed."""
    from .wind import nearest_run

    chosen = nearest_run(newest_reading(reading, *keys), runs)
    return chosen.join(ratios, "run").select(*keys, "ts", "run", "row", "col", (F.col("k") * F.col("speed")).alias("wind"))


def near_days(days: DataFrame, target: Column, reach: int = 12) -> DataFrame:
    """Candidates for a chosen day: those at most ``reach`` days from the target."""
    return days.where(F.abs(F.datediff("day", target)) <= reach)
