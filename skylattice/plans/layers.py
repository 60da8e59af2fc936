"""Queries on cell layers, profiles, names, masks and windows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars, solar
from ..operators import compare, gates, grid, gridding, lines, parts, scenario, weather, wind, zonal
from .stand_ins import CELL_M, CELLS, GRID, HALVES, LAT, LON, PTS, TILES, WEATHER, cells, halves, points, read, sql, sun_table, tiles
from .stand_ins import weather as weather_rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


@query(
    sql(
        """SELECT "row", col, round(CASE WHEN abs(surface - ground) > 50 THEN ground ELSE surface END::DOUBLE, 4) AS held, round(CASE WHEN label = 0 AND NOT water AND col % 9 > 4 AND heights >= 2 THEN least(heights, 40) ELSE 0 END::DOUBLE, 4) AS canopy,
  (abs(col - 60) <= 25 AND abs("row" - 20) <= 25) AS published, (surface >= 3 AND heights::DOUBLE / tan(radians(30.0::DOUBLE)) >= abs(col - 60) * 20.0) AS reaches, ("row" BETWEEN 0 AND 39 AND col BETWEEN 0 AND 99) AS inside, "row" // 16 AS brow, col // 16 AS bcol,
  round_even(heights::DOUBLE * 2, 0)::INT AS halves, least(32767, greatest(-32767, round_even(surface::DOUBLE * 10, 0)))::SMALLINT AS decimetres, substr(sha1(concat_ws('|', label::VARCHAR, park::VARCHAR)), 1, 16) AS key FROM cells""",
        PTS, GRID, CELLS,
    )
)
def cell_layers(spark, sf):
    c = cells(spark, sf)
    r, q, h = F.col("row"), F.col("col"), F.col("heights")
    lattice = grid.Grid(0.0, 0.0, CELL_M, 40, 100)
    out = grid.with_block(c, 16)
    return out.select(
        "row", "col",
        F.round(scenario.hold_equal(F.col("surface"), F.col("ground"), F.abs(F.col("surface") - F.col("ground")) > 50).cast("double"), 4).alias("held"),
        F.round(scenario.canopy(h, F.col("label") > 0, F.col("water"), q % 9).cast("double"), 4).alias("canopy"),
        scenario.published_window(q, r, 60, 20, 25).alias("published"),
        parts.may_reach(h.cast("double"), F.abs(q - 60) * CELL_M, F.lit(30.0), F.col("surface")).alias("reaches"),
        lattice.inside(r, q).alias("inside"),
        "brow", "bcol",
        scalars.half_degrees(h.cast("double")).alias("halves"),
        scalars.decimetres(F.col("surface").cast("double")).alias("decimetres"),
        scalars.cache_key(F.col("label").cast("string"), F.col("park").cast("string")).alias("key"),
    )


@query(
    """SELECT o_orderkey, round(o_totalprice / 100000 * pow(o_orderkey % 60 / 10.0::DOUBLE, 0.28), 6) AS profile, round(pow(0.41 / ln(1 + (1 + o_orderkey % 9) / 0.5::DOUBLE), 2), 6) AS drag, (o_custkey % 360 - 29.0::DOUBLE) - 360 * floor((o_custkey % 360 - 29.0::DOUBLE) / 360) AS grid_azimuth,
  make_date(CASE WHEN month(o_orderdate) = 1 THEN 2027 ELSE 2026 END, month(o_orderdate), least(28, day(o_orderdate)))::VARCHAR AS canonical, printf('%02d:%02d', (o_orderkey % 1440) // 60, o_orderkey % 60) AS hhmm,
  round(least(17, greatest(0.5, coalesce(CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 40 / 10.0::DOUBLE END, 1) * (o_orderkey % 11))), 6) AS felt_wind, ((o_custkey % 360 - o_orderkey % 360 + 180.0::DOUBLE) - 360 * floor((o_custkey % 360 - o_orderkey % 360 + 180.0::DOUBLE) / 360)) - 180 AS turn,
  printf('%03d%03d', floor(floor(o_custkey % 1000 * 731 / 2500.0::DOUBLE) * 2500 / 1000)::BIGINT, floor(floor(o_orderkey % 9000 * 37 / 2500.0::DOUBLE) * 2500 / 1000)::BIGINT) AS tile FROM orders"""
)
def profiles_and_names(spark, sf):
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    ratio = F.when(c % 5 > 0, c % 40 / 10.0)
    return read(spark, sf, "orders").select(
        "o_orderkey",
        F.round(scalars.power_profile(k % 60, F.col("o_totalprice") / 100000), 6).alias("profile"),
        F.round(scalars.wall_drag(1 + k % 9, 0.5), 6).alias("drag"),
        solar.to_grid_azimuth((c % 360).cast("double"), 29.0).alias("grid_azimuth"),
        solar.canonical_day(F.month(d), F.least(F.lit(28), F.dayofmonth(d))).cast("string").alias("canonical"),
        scalars.hours_minutes(k % 1440).alias("hhmm"),
        F.round(scalars.felt_wind(ratio, (k % 11).cast("double")), 6).alias("felt_wind"),
        scalars.angle_difference((c % 360).cast("double"), (k % 360).cast("double")).alias("turn"),
        scalars.tile_name(c % 1000 * 731, k % 9000 * 37).alias("tile"),
    )


@query(
    sql(
        """SELECT s_suppkey, round((n + h) * cos(p) * cos(l), 3) AS x, round((n + h) * cos(p) * sin(l), 3) AS y, round((n * (1 - e2) + h) * sin(p), 3) AS z FROM (SELECT *, 6378137.0 / sqrt(1 - e2 * sin(p) * sin(p)) AS n FROM (
  SELECT s_suppkey, radians(-73.979 + s_suppkey % 50 * 0.001::DOUBLE) AS l, radians(40.7645 + s_suppkey % 70 * 0.001::DOUBLE) AS p, s_acctbal / 10 AS h, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM supplier))"""
    )
)
def earth_centred_coordinates(spark, sf):
    k = F.col("s_suppkey")
    xyz = scalars.ecef(F.lit(-73.979) + k % 50 * F.lit(0.001), F.lit(40.7645) + k % 70 * F.lit(0.001), F.col("s_acctbal") / 10)
    return read(spark, sf, "supplier").select("s_suppkey", *[F.round(v, 3).alias(n) for n, v in zip("xyz", xyz, strict=True)])


@query(sql("SELECT min(heights) AS least, max(heights) AS most, round(avg(heights::DOUBLE), 5) AS mean, round(median(heights::DOUBLE), 5) AS middle FROM cells WHERE NOT nodata AND NOT blank", PTS, GRID, CELLS))
def masked_layer_statistics(spark, sf):
    c = cells(spark, sf).withColumn("h", F.col("heights").cast("double"))
    got = zonal.masked_statistics(c, "h", ~F.col("nodata") & ~F.col("blank"))
    return got.select(F.col("least").cast("float").alias("least"), F.col("most").cast("float").alias("most"), F.round("mean", 5).alias("mean"), F.round("middle", 5).alias("middle"))


@query(sql("SELECT min(surface) AS lowest, max(surface) AS highest, max(heights) AS tallest_m, round(max(heights)::DOUBLE / 0.3048, 4) AS tallest_ft FROM cells WHERE NOT nodata", PTS, GRID, CELLS))
def surface_summary(spark, sf):
    s = gridding.surface_summary(cells(spark, sf).where("not nodata"))
    return s.select("lowest", "highest", "tallest_m", F.round(F.col("tallest_m").cast("double") / 0.3048, 4).alias("tallest_ft"))


@query(sql("SELECT round(avg((abs(before - after) <= 1.5)::INT), 6) AS agree, round(abs(sum(before) - sum(after)) / sum(after), 6) AS area_change FROM pairs", PTS, HALVES))
def engine_agreement(spark, sf):
    p = compare.paired(*halves(spark, sf), "v", ["row", "col", "zone"]).withColumnsRenamed({"before": "a", "after": "b"})
    return gates.agreement(p, 1.5).select(F.round("agree", 6).alias("agree"), F.round("area_change", 6).alias("area_change"))


@query(sql('SELECT "row" // 10 AS "row", col // 10 AS col, bool_or(water) AS "any" FROM cells GROUP BY ALL', PTS, GRID, CELLS))
def coarse_any_water(spark, sf):
    return gridding.coarse_any(cells(spark, sf), 10, "water")


@query(sql("""SELECT "row" // 40 AS ty, count(*) FILTER (col // 30 = 0) AS x0, count(*) FILTER (col // 30 = 1) AS x1, count(*) FILTER (col // 30 = 2) AS x2, count(*) FILTER (col // 30 = 3) AS x3 FROM (SELECT DISTINCT "row" // 40 * 40 AS "row", col // 30 * 30 AS col FROM cells) GROUP BY ALL""", PTS, GRID, CELLS))
def tile_presence(spark, sf):
    t = cells(spark, sf).select(F.floor(F.col("row") / 40).cast("int").alias("ty"), F.floor(F.col("col") / 30).cast("int").alias("tx")).distinct()
    got = gridding.presence_map(t, [0, 1, 2, 3])
    return got.select("ty", *[F.coalesce(F.col(str(k)), F.lit(0)).cast("long").alias(f"x{k}") for k in range(4)])


@query(sql("SELECT name FROM (SELECT 't' || s_suppkey AS name, s_suppkey % 40 * 10.0::DOUBLE AS x, s_suppkey % 30 * 10.0::DOUBLE AS y FROM supplier) WHERE x <= 150 AND x + 10 >= 50 AND y <= 200 AND y + 10 >= 100"))
def tiles_of_domain(spark, sf):
    k = F.col("s_suppkey")
    t = read(spark, sf, "supplier").select(F.concat(F.lit("t"), k).alias("name"), (k % 40 * 10.0).alias("xmin"), (k % 30 * 10.0).alias("ymin"))
    t = t.select("name", "xmin", (F.col("xmin") + 10).alias("xmax"), "ymin", (F.col("ymin") + 10).alias("ymax"))
    return gridding.tiles_of_domain(t, 50.0, 150.0, 100.0, 200.0).select("name")


@query(sql('SELECT "row", col, heights FROM cells WHERE "row" BETWEEN 5 AND 24 AND col BETWEEN 40 AND 59', PTS, GRID, CELLS))
def cropped_window(spark, sf):
    return grid.crop(cells(spark, sf), 15, 50, 20).select("row", "col", "heights")


@query(sql('SELECT a."row", a.col FROM cells a WHERE a.heights > 50 AND NOT EXISTS (SELECT 1 FROM cells b WHERE b."row" = a."row" AND b.col = a.col AND (b.nodata OR b.label > 0))', PTS, GRID, CELLS))
def changed_but_unexplained(spark, sf):
    c = cells(spark, sf)
    return compare.unexplained(c.where("heights > 50").select("row", "col"), c.where("nodata or label > 0").select("row", "col"), ["row", "col"])


@query(sql('SELECT label, "row", col FROM (SELECT label, "row", col, row_number() OVER (PARTITION BY label ORDER BY "row", col) AS k FROM cells WHERE label > 0) WHERE k <= 3', PTS, GRID, CELLS))
def north_most_cells(spark, sf):
    return compare.north_most(cells(spark, sf).where("label > 0").select("label", "row", "col"), ["label"], F.struct("row", "col"), 3)


@query(sql("""SELECT t.ts, w.hour, round(greatest(w.ws, 0.5), 6) AS ws, round(CASE WHEN w.hour % 5 > 0 THEN (90000 + w.hour * 100) / 100.0::DOUBLE ELSE 1013.25 END, 4) AS pressure_hpa FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events WHERE hour(ts) % 6 = 0) t
  JOIN weather w ON w.day = (CASE WHEN hour(t.ts) = 0 THEN t.ts::DATE - 1 ELSE t.ts::DATE END) AND w.hour = CASE WHEN hour(t.ts) = 0 THEN 24 ELSE hour(t.ts) END""", PTS, WEATHER))
def solver_weather_at_steps(spark, sf):
    w = weather_rows(spark, sf)
    by = w.select(F.month("day").alias("month"), F.dayofmonth("day").alias("day"), "hour", "ws", F.when(F.col("hour") % 5 > 0, 90000.0 + F.col("hour") * 100).alias("pressure_pa"))
    t = read(spark, sf, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).where(F.hour("ts") % 6 == 0).distinct()
    got = weather.solver_records(weather.weather_at(t, by)).where("ws is not null and hour is not null")
    known = got.join(by.select("month", "day", "hour"), ["month", "day", "hour"], "left_semi")
    return known.select("ts", "hour", F.round("ws", 6).alias("ws"), F.round("pressure_hpa", 4).alias("pressure_hpa"))


_TURN = math.radians(292.5)


@query(sql(f"""SELECT "row", col, round(((col * 20 - 100) * {-math.sin(_TURN)!r}::DOUBLE + (-"row" * 20 - 50) * {-math.cos(_TURN)!r}::DOUBLE) / 8, 6) AS along, round(((col * 20 - 100) * {math.cos(_TURN)!r}::DOUBLE + (-"row" * 20 - 50) * {-math.sin(_TURN)!r}::DOUBLE) / 8, 6) AS across FROM cells""", PTS, GRID, CELLS))
def turned_wind_box(spark, sf):
    along, across = wind.turned_box(F.col("col") * CELL_M, -F.col("row") * CELL_M, 292.5, 100.0, 50.0, 8.0)
    return cells(spark, sf).select("row", "col", F.round(along, 6).alias("along"), F.round(across, 6).alias("across"))


@query(sql('SELECT vec_id AS col, (i - 0.5) * 2 AS z, v AS speed FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 2)'))
def vertical_section(spark, sf):
    v = read(spark, sf, "embeddings").select(F.col("label").alias("row"), F.col("vec_id").alias("col"), F.col("embedding").alias("speeds"))
    return lines.section(v, 2, 2.0)


@query(sql(f"""SELECT day::VARCHAR AS day, hour, round(CASE WHEN altitude <= 0.5 THEN 0 ELSE 1367 * pow(0.7, pow(least(38.0, 1 / (sin(radians(greatest(altitude, 0.5))) + 0.50572 * pow(greatest(altitude, 0.5) + 6.07995, -1.6364))), 0.678)) END
  * greatest(0, cos(radians(altitude)) * cos(radians(azimuth - 209.0::DOUBLE))), 3) AS gain FROM {sun_table("(SELECT * FROM weather)", "unix_s + (hour - 0.5) * 3600 + 18000.0")}""", PTS, WEATHER))
def wall_incidence_gain(spark, sf):
    """Beam on a wall that faces 209 degrees, at the middle of every hour."""
    s = solar.with_sun(weather_rows(spark, sf), "unix_s + (hour - 0.5) * 3600 + 18000.0", LAT, LON)
    facing = math.sin(math.radians(209.0)), math.cos(math.radians(209.0))
    gain = solar.incidence_gain(solar.clear_sky_dni(F.col("altitude")), F.lit(facing[0]), F.lit(facing[1]), solar.sun_vector(F.col("altitude"), F.col("azimuth")))
    return s.select(F.col("day").cast("string").alias("day"), "hour", F.round(gain, 3).alias("gain"))
