"""Queries on gridding, zones, scenarios, sun and shade."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalars import bin_of
from ..functions.solar import clear_sky_dni, frames, haurwitz, sun_vector, with_sun
from ..operators import focal, gridding, kernels, scenario, zonal
from ..operators.grid import Grid, north_up_index
from ..operators.ranks import with_percentiles
from .stand_ins import BUILDINGS, CELL_M, CELLS, COLS, GRID, LABELS, LAT, LON, PTS, TILES, buildings, cells, points, read, sql, sun_table, tiles

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HA = CELL_M * CELL_M / 10_000
BINS = [0.0, 10.0, 50.0, 100.0, 200.0, 400.0]
TURNED = Grid(100.0, 5000.0, 2.0, 1500, 800, unit_m=0.3048, bearing=28.9)


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def sun_sql(source: str, unix_s: str, columns: str, where: str = "") -> str:
    return f"SELECT {columns} FROM {sun_table(source, unix_s)} {where}"


@query(sql("SELECT * FROM grid", PTS, GRID))
def grid_points_max_min_count(spark, sf):
    return gridding.grid_points(points(spark, sf))


@query(sql("SELECT cls, count(*) AS n FROM pts GROUP BY cls ORDER BY n DESC, cls LIMIT 8", PTS))
def class_histogram_top(spark, sf):
    return gridding.class_histogram(points(spark, sf))


@query(sql("SELECT round(p50, 4) AS p50, round(p99, 4) AS p99_99, round(p99 + greatest(20.0, 0.15 * (p99 - p50)), 4) AS ceiling FROM (SELECT quantile_cont(surface::DOUBLE, 0.5) AS p50, quantile_cont(surface::DOUBLE, 0.9999) AS p99 FROM grid)", PTS, GRID))
def outlier_ceiling(spark, sf):
    c = gridding.grid_points(points(spark, sf)).withColumn("surface", F.col("surface").cast("double"))
    return gridding.outlier_ceiling(c).select(*[F.round(x, 4).alias(x) for x in ("p50", "p99_99", "ceiling")])


_T = math.radians(28.9)


@query(
    sql(
        f"""SELECT "row", col, round(x, 6) AS x, round(y, 6) AS y,
        floor(((x - 100) * {-math.sin(_T)!r}::DOUBLE + (y - 5000) * {-math.cos(_T)!r}::DOUBLE) / {2.0 / 0.3048!r}::DOUBLE)::INT AS back_row, floor(((x - 100) * {math.cos(_T)!r}::DOUBLE + (y - 5000) * {-math.sin(_T)!r}::DOUBLE) / {2.0 / 0.3048!r}::DOUBLE)::INT AS back_col
        FROM (SELECT "row", col, 100 + (("row" + 0.5) * {-math.sin(_T)!r}::DOUBLE + (col + 0.5) * {math.cos(_T)!r}::DOUBLE) * {2.0 / 0.3048!r}::DOUBLE AS x, 5000 + (("row" + 0.5) * {-math.cos(_T)!r}::DOUBLE + (col + 0.5) * {-math.sin(_T)!r}::DOUBLE) * {2.0 / 0.3048!r}::DOUBLE AS y FROM grid)""",
        PTS, GRID,
    )
)
def affine_roundtrip_cells(spark, sf):
    x, y = TURNED.centre(F.col("row"), F.col("col"))
    c = gridding.grid_points(points(spark, sf)).select("row", "col", x.alias("x"), y.alias("y"))
    r, q = TURNED.cell(F.col("x"), F.col("y"))
    return c.select("row", "col", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), r.alias("back_row"), q.alias("back_col"))


_CASE = " ".join(f"WHEN heights >= {a} AND heights {'<=' if b == BINS[-1] else '<'} {b} THEN {k}" for k, (a, b) in enumerate(zip(BINS[:-1], BINS[1:], strict=True), 1))


@query(sql(f"SELECT bin, count(*) AS cells, min(heights) AS least, max(heights) AS most, round(avg(heights::DOUBLE), 4) AS mean, round(median(heights::DOUBLE), 4) AS middle FROM (SELECT heights, CASE {_CASE} ELSE 0 END AS bin FROM cells WHERE NOT nodata) GROUP BY bin", PTS, GRID, CELLS))
def bin_legend_fixed_breaks(spark, sf):
    c = cells(spark, sf).where("not nodata").withColumn("bin", bin_of(F.col("heights"), BINS))
    h = F.col("heights").cast("double")
    legend = c.groupBy("bin").agg(F.count("*").alias("cells"), F.min("heights").alias("least"), F.max("heights").alias("most"), F.round(F.avg(h), 4).alias("mean"))
    return with_percentiles(legend, c, {"middle": ("heights", 0.5)}, "bin").withColumn("middle", F.round("middle", 4))


@query(sql("SELECT label, n, round(median, 4) AS median, quantile, round(fraction, 6) AS fraction FROM labels_", PTS, GRID, CELLS, LABELS))
def zonal_median_quantile_fraction(spark, sf):
    return zonal.label_statistics(cells(spark, sf), "heights", "nodata").select("label", "n", F.round("median", 4).alias("median"), "quantile", F.round("fraction", 6).alias("fraction"))


_BOTH = """SELECT b.label, round(greatest(coalesce(b.height_m, median, 0), 0), 4) AS today_m,
 round(greatest(coalesce(CASE WHEN coalesce(fraction > 0.5, false) AND coalesce(year, 0) >= 2017 THEN 0 WHEN coalesce(fraction > 0.5, false) THEN height_m ELSE median END, 0), 0), 4) AS before_m
 FROM buildings b LEFT JOIN labels_ l ON b.label = l.label"""


@query(sql(_BOTH, PTS, GRID, CELLS, LABELS, BUILDINGS))
def scenario_heights_2017_today(spark, sf):
    b, s = buildings(spark, sf), zonal.label_statistics(cells(spark, sf), "heights", "nodata")
    now, then = scenario.scenario_heights(b, s, True), scenario.scenario_heights(b, s, False)
    return now.select("label", F.round("height_m", 4).alias("today_m")).join(then.select("label", F.round("height_m", 4).alias("before_m")), "label")


_GROWN = "grown AS (SELECT b.label, b.height_m, l.quantile FROM buildings b JOIN labels_ l ON b.label = l.label WHERE b.height_m IS NOT NULL AND (l.quantile IS NULL OR b.height_m > l.quantile + 6) AND fraction <= 0.5 AND n > 0)"


@query(sql("SELECT label, round(height_m, 4) AS height_m, quantile FROM grown", PTS, GRID, CELLS, LABELS, BUILDINGS, _GROWN))
def grown_labels(spark, sf):
    g = scenario.grown_labels(buildings(spark, sf), zonal.label_statistics(cells(spark, sf), "heights", "nodata"))
    return g.withColumn("height_m", F.round("height_m", 4))


@query(
    sql(
        """SELECT "row", col, round(CASE WHEN label > 0 AND height_m >= 3 AND burnt > ground + 300 THEN ground + 300 ELSE burnt END, 3) AS burnt FROM (
  SELECT c."row", c.col, c.label, coalesce(b.height_m, 0) AS height_m, c.ground::DOUBLE AS ground, CASE WHEN nodata AND c.label > 0 THEN ground + coalesce(b.height_m, 0) WHEN g.label IS NOT NULL AND ground + b.height_m > surface + 3 THEN ground + b.height_m ELSE surface::DOUBLE END AS burnt
  FROM cells c LEFT JOIN (SELECT label, greatest(coalesce(height_m, 0), 0) AS height_m FROM buildings) b ON c.label = b.label LEFT JOIN grown g ON c.label = g.label)""",
        PTS, GRID, CELLS, LABELS, BUILDINGS, _GROWN,
    )
)
def burn_and_cap_surface(spark, sf):
    c = cells(spark, sf)
    b = buildings(spark, sf)
    grown = scenario.grown_labels(b, zonal.label_statistics(c, "heights", "nodata"))
    heights = b.select("label", F.greatest(F.coalesce("height_m", F.lit(0.0)), F.lit(0.0)).alias("height_m"))
    out = scenario.burn(c.select("row", "col", "label", F.col("ground").cast("double").alias("ground"), "surface", "nodata"), heights, grown, 300.0)
    return out.select("row", "col", F.round("burnt", 3).alias("burnt"))


@query(sql("""SELECT cover, street, count(*) AS cells FROM (SELECT CASE WHEN label > 0 THEN 2 WHEN water THEN 7 WHEN park THEN 5 ELSE 1 END AS cover, NOT (label > 0 OR blank) AND NOT park AS street FROM cells) GROUP BY ALL""", PTS, GRID, CELLS))
def landcover_classes(spark, sf):
    built = F.col("label") > 0
    c = cells(spark, sf).select(scenario.land_cover(built, F.col("water"), F.col("park")).alias("cover"), scenario.street(built, F.col("blank"), F.col("park")).alias("street"))
    return c.groupBy("cover", "street").agg(F.count("*").alias("cells"))


_DATES = "(SELECT DISTINCT o_orderdate, epoch_us(o_orderdate) / 1000000.0 + 61200.0 AS unix_s FROM orders)"


def _dated(spark, sf):
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    return read(spark, sf, "orders").select("o_orderdate").distinct().withColumn("unix_s", s + 61200.0)


@query(sun_sql(_DATES, "unix_s", "o_orderdate, round(altitude, 6) AS altitude, round(azimuth, 6) AS azimuth, round(declination, 6) AS declination, altitude > 0 AS up"))
def sun_positions(spark, sf):
    s = with_sun(_dated(spark, sf), "unix_s", LAT, LON)
    return s.select("o_orderdate", *[F.round(c, 6).alias(c) for c in ("altitude", "azimuth", "declination")], (F.col("altitude") > 0).alias("up"))


@query(
    f"""SELECT o_orderdate, round(CASE WHEN altitude <= 0.5 THEN 0 ELSE 1367 * pow(0.7, pow(least(38.0, 1 / (sin(radians(greatest(altitude, 0.5))) + 0.50572 * pow(greatest(altitude, 0.5) + 6.07995, -1.6364))), 0.678)) END, 4) AS dni,
  round(CASE WHEN sin(radians(altitude)) > 0 THEN 1098 * sin(radians(altitude)) * exp(-0.057 / sin(radians(altitude))) ELSE 0 END, 4) AS ghi, round(cos(radians(altitude)) * sin(radians(azimuth)), 6) AS east, round(sin(radians(altitude)), 6) AS up FROM ({sun_sql(_DATES, "unix_s", "*")})"""
)
def clear_sky_irradiance(spark, sf):
    s = with_sun(_dated(spark, sf), "unix_s", LAT, LON)
    a = F.col("altitude")
    v = sun_vector(a, F.col("azimuth"))
    return s.select("o_orderdate", F.round(clear_sky_dni(a), 4).alias("dni"), F.round(haurwitz(a), 4).alias("ghi"), F.round(v["east"], 6).alias("east"), F.round(v["up"], 6).alias("up"))


_FRAMES_SQL = """(SELECT o_orderdate, unnest(generate_series((ceil((340 + k % 190) / 30.0) * 30)::INT, (900 + k % 180)::INT, 30))::INT AS minute, unix_s FROM (SELECT DISTINCT o_orderdate, dayofyear(o_orderdate) AS k, epoch_us(o_orderdate) / 1000000.0 AS unix_s FROM orders))"""


@query(sun_sql(_FRAMES_SQL, "unix_s + minute * 60 + 18000.0", "o_orderdate, minute, round(altitude, 4) AS altitude, round(azimuth, 4) AS azimuth", "WHERE altitude > 0"))
def sun_frames(spark, sf):
    """Half-hour frames of each order's date, from and to a minute that follows from the day of the year."""
    k = F.dayofyear("o_orderdate")
    days = _dated(spark, sf).select("o_orderdate", (F.col("unix_s") - 61200.0).alias("unix_s"), (340 + k % 190).alias("start"), (900 + k % 180).alias("end"))
    up = with_sun(frames(days, "start", "end"), "unix_s + minute * 60 + 18000.0", LAT, LON).where("altitude > 0")
    return up.select("o_orderdate", "minute", F.round("altitude", 4).alias("altitude"), F.round("azimuth", 4).alias("azimuth"))


@query(
    """SELECT run, drow, dcol, min(step)::INT AS step, round(sqrt(drow * drow + dcol * dcol), 6) AS dist FROM (
  SELECT n_nationkey AS run, step, round_even(-step * cos(radians(n_nationkey * 22.5)), 0)::INT AS drow, round_even(step * sin(radians(n_nationkey * 22.5)), 0)::INT AS dcol
  FROM nation, generate_series(1, 40) g(step)) WHERE drow <> 0 OR dcol <> 0 GROUP BY run, drow, dcol"""
)
def ray_offsets(spark, sf):
    suns = read(spark, sf, "nation").select(F.col("n_nationkey").alias("run"), (F.col("n_nationkey") * 22.5).alias("azimuth"), F.lit(40).alias("steps"))
    return focal.ray_offsets(suns).select("run", "drow", "dcol", "step", F.round("dist", 6).alias("dist"))


#: Suns of the shade queries: name, altitude, azimuth.
SUNS = [("morning", 62.0, 115.0), ("noon", 72.0, 180.0), ("evening", 58.0, 245.0), ("night", -4.0, 310.0)]


def _suns(spark):
    return spark.createDataFrame(SUNS, "sun string, altitude double, azimuth double")


_SHADE = f"""suns(sun, altitude, azimuth) AS (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {z}::DOUBLE)" for n, a, z in SUNS)}),
 relief AS (SELECT (max(surface) - min(surface))::DOUBLE AS relief FROM cells),
 offs AS (SELECT sun, altitude, drow, dcol, (sqrt(drow * drow + dcol * dcol) * {CELL_M} * tan(radians(altitude)))::FLOAT AS climb FROM (
   SELECT DISTINCT sun, altitude, round_even(-step * cos(radians(azimuth)), 0)::INT AS drow, round_even(step * sin(radians(azimuth)), 0)::INT AS dcol FROM suns, relief, generate_series(1, 4000) g(step)
   WHERE altitude > 0 AND step <= greatest(1, least(ceil(relief / greatest(tan(radians(altitude)), 1e-6) / {CELL_M}) + 1, 4000))) WHERE drow <> 0 OR dcol <> 0),
 dark AS (SELECT DISTINCT sun, a."row", a.col FROM cells a, offs o, cells b WHERE b."row" = a."row" + o.drow AND b.col = a.col + o.dcol AND b.surface > (a.surface + o.climb)::FLOAT),
 shade AS (SELECT s.sun, a."row", a.col, s.altitude > 0 AND d.sun IS NULL AS lit, a.park, a.label, a.blank FROM cells a CROSS JOIN suns s LEFT JOIN dark d ON d.sun = s.sun AND d."row" = a."row" AND d.col = a.col)"""


@query(sql('SELECT sun, "row", col, lit FROM shade', PTS, GRID, CELLS, _SHADE))
def shadow_sweep_join(spark, sf):
    return kernels.shadows(cells(spark, sf), _suns(spark), CELL_M).select("sun", "row", "col", "lit")


@query(sql('SELECT sun, "row", col, lit FROM shade WHERE sun = \'noon\'', PTS, GRID, CELLS, _SHADE))
def shadow_sweep_blocks(spark, sf):
    name, altitude, azimuth = SUNS[1]
    return kernels.shadows_blocked(cells(spark, sf), altitude, azimuth, CELL_M).select(F.lit(name).alias("sun"), "row", "col", "lit")


@query(sql('SELECT "row", col, count(*) FILTER (lit) * 0.5::DOUBLE AS sun_hours FROM shade GROUP BY ALL', PTS, GRID, CELLS, _SHADE))
def sun_hours_accumulate(spark, sf):
    return kernels.sun_counts(cells(spark, sf), [(a, z) for _, a, z in SUNS], CELL_M).select("row", "col", (F.col("lit_steps") * 0.5).alias("sun_hours"))


_VIEW = f"""offs AS (SELECT DISTINCT k, drow, dcol, sqrt(drow * drow + dcol * dcol) * {CELL_M} AS dist FROM (SELECT k, round_even(-step * cos(radians(k * 22.5)), 0)::INT AS drow, round_even(step * sin(radians(k * 22.5)), 0)::INT AS dcol FROM generate_series(0, 15) a(k), generate_series(1, 5) b(step)) WHERE drow <> 0 OR dcol <> 0),
 steep AS (SELECT a."row", a.col, k, greatest(0, max((b.surface::DOUBLE - a.surface::DOUBLE) / dist)) AS t FROM cells a, offs o, cells b WHERE b."row" = a."row" + drow AND b.col = a.col + dcol GROUP BY a."row", a.col, k),
 seen AS (SELECT "row", col, sum(1 / (1 + t * t)) AS s, count(*) AS k FROM steep GROUP BY ALL)"""


@query(sql('SELECT c."row", c.col, round((coalesce(s, 0) + 16 - coalesce(k, 0)) / 16, 5) AS svf FROM cells c LEFT JOIN seen e ON c."row" = e."row" AND c.col = e.col', PTS, GRID, CELLS, _VIEW))
def sky_view_factor(spark, sf):
    v = kernels.sky_view_blocked(cells(spark, sf), CELL_M, 100.0)
    return v.select("row", "col", F.round("svf", 5).alias("svf"))


@query(
    sql(
        f"""SELECT CASE WHEN park THEN 'resource' ELSE 'street' END AS zone, count(*) AS cells, round(count(*) * {HA}::DOUBLE, 6) AS area_ha, round(avg((h < 0.25)::INT), 6) AS never, round(avg((h < 1)::INT), 6) AS under_one, round(avg((h > 0.75)::INT), 6) AS over_half, round(median(h), 4) AS middle, round(avg(h), 6) AS mean, round(sum(h) * {HA}::DOUBLE, 6) AS sunlit_ha_h
  FROM (SELECT "row", col, park, label, blank, count(*) FILTER (lit) * 0.5::DOUBLE AS h FROM shade GROUP BY ALL) WHERE park OR NOT (label > 0 OR blank) GROUP BY park""",
        PTS, GRID, CELLS, _SHADE,
    )
)
def street_and_resource_stats(spark, sf):
    c = cells(spark, sf)
    hours = kernels.sun_counts(c, [(a, z) for _, a, z in SUNS], CELL_M).join(c.select("row", "col", "park", "label", "blank"), ["row", "col"])
    h = F.col("lit_steps") * F.lit(0.5)
    kept = hours.where(F.col("park") | scenario.street(F.col("label") > 0, F.col("blank"), F.col("park")))
    return kept.groupBy(F.when(F.col("park"), "resource").otherwise("street").alias("zone")).agg(
        F.count("*").alias("cells"),
        F.round(F.count("*") * HA, 6).alias("area_ha"),
        F.round(zonal.share(h < 0.25), 6).alias("never"),
        F.round(zonal.share(h < 1), 6).alias("under_one"),
        F.round(zonal.share(h > 0.75), 6).alias("over_half"),
        F.round(F.median(h), 4).alias("middle"),
        F.round(F.avg(h), 6).alias("mean"),
        F.round(F.sum(h) * HA, 6).alias("sunlit_ha_h"),
    )


@query(sql(f"""SELECT (band * 250)::INT AS from_m, ((band + 1) * 250)::INT AS to_m, round(count(*) * {HA}::DOUBLE, 6) AS area_ha, round(avg((heights < 5)::INT), 6) AS low, round(avg(heights::DOUBLE), 4) AS mean FROM (SELECT *, floor(col * {CELL_M} / 250)::INT AS band FROM cells) GROUP BY band HAVING count(*) * {HA} >= 0.5""", PTS, GRID, CELLS))
def band_profile(spark, sf):
    c = cells(spark, sf)
    b = zonal.band_profile(c, F.col("col") * CELL_M, 250.0, [zonal.share(F.col("heights") < 5).alias("low"), F.avg(F.col("heights").cast("double")).alias("mean")], HA, 0.5)
    return b.select("from_m", "to_m", F.round("area_ha", 6).alias("area_ha"), F.round("low", 6).alias("low"), F.round("mean", 4).alias("mean"))


@query(sql("""SELECT "row" // 4 AS "row", col // 4 AS col, max(v) AS highest, round(avg(v::DOUBLE), 6) AS mean, min(v) AS lowest, vec_id FROM tiles GROUP BY vec_id, "row" // 4, col // 4""", TILES))
def pooled_tiles(spark, sf):
    t = tiles(spark, sf)
    wide = t.withColumn("row", F.col("row") + F.col("vec_id") * 8)
    n = 8 * (t.agg(F.max("vec_id")).first()[0] + 1)
    p = gridding.pooled(wide, 4, "v", n, 8)
    return p.select((F.col("row") % 2).cast("int").alias("row"), "col", "highest", F.round("mean", 6).alias("mean"), "lowest", F.floor(F.col("row") / 2).cast("long").alias("vec_id"))


@query(
    sql(
        f"""SELECT g.py, g.px, CASE WHEN r >= 0 AND r < 1500 AND c >= 0 AND c < 800 THEN r::BIGINT * 800 + c ELSE -1 END AS cell, k.surface FROM (
  SELECT py, px, floor(((x - 100) * {-math.sin(_T)!r}::DOUBLE + (y - 5000) * {-math.cos(_T)!r}::DOUBLE) / {2.0 / 0.3048!r}::DOUBLE)::INT AS r, floor(((x - 100) * {math.cos(_T)!r}::DOUBLE + (y - 5000) * {-math.sin(_T)!r}::DOUBLE) / {2.0 / 0.3048!r}::DOUBLE)::INT AS c
  FROM (SELECT py, px, (100 + px * 13.0)::DOUBLE AS x, (5000 - py * 13.0)::DOUBLE AS y FROM generate_series(0, 99) a(py), generate_series(0, 99) b(px))) g LEFT JOIN grid k ON k."row" = g.r AND k.col = g.c AND r < 1500 AND c < 800""",
        PTS, GRID,
    )
)
def northup_resample(spark, sf):
    at = F.col("id")
    pixels = spark.range(10_000).select(F.floor(at / 100).alias("py"), (at % 100).alias("px"))
    pixels = pixels.select("py", "px", (100 + F.col("px") * 13.0).alias("x"), (5000 - F.col("py") * 13.0).alias("y"))
    indexed = north_up_index(pixels, TURNED)
    c = gridding.grid_points(points(spark, sf)).where(TURNED.in_frame(F.col("row"), F.col("col"))).select(TURNED.flat(F.col("row"), F.col("col")).alias("cell"), "surface")
    return indexed.join(c, "cell", "left").select("py", "px", "cell", "surface")
