"""Queries on rings, streets, steps of a day, tiles, lookups, single buildings and estimated ground."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import percent_change, stress_category
from ..functions.solar import local_day
from ..operators import compare, nearest, reports, scenario, sweep, zonal
from ..sources.scratch import stored
from .stand_ins import BUILDINGS, CELL_M, CELLS, CHANGES, GRID, HALVES, LABELS, LAT, LON, PTS, WEATHER, buildings, cells, changes, halves, points, read, sql, sun_table
from .stand_ins import weather as weather_rows
from .surface import SUNS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HA = CELL_M * CELL_M / 10_000


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def rounded(df, digits: int, *names: str):
    """``df`` with the named columns rounded."""
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def _pairs(spark, sf):
    return compare.paired(*halves(spark, sf), "v", ["row", "col", "zone"])


@query(sql(f"""SELECT zone, count(*) AS cells, round(median(before), 6) AS median_before, round(quantile_cont(before, 0.9), 6) AS p90_before, round(median(after), 6) AS median_after, round(quantile_cont(after, 0.9), 6) AS p90_after,
  round(100 * (median(after) / nullif(median(before), 0) - 1), 6) AS change_pct FROM pairs WHERE "row" % 7 <> 0 AND abs(col % 15 - 7) * {CELL_M} BETWEEN 20 AND 80 GROUP BY zone""", PTS, HALVES))
def ring_statistics(spark, sf):
    out = reports.ring_statistics(_pairs(spark, sf), F.abs(F.col("col") % 15 - 7) * CELL_M, F.col("row") % 7 != 0, "zone")
    return rounded(out, 6, "median_before", "p90_before", "median_after", "p90_after", "change_pct")


@query(sql(f"""SELECT zone, round(median(after), 6) AS median_ratio, round(quantile_cont(after, 0.9), 6) AS p90_ratio, round(median(p), 5) AS median_pct, round(count(*) FILTER (p >= 30) * {HA}::DOUBLE, 6) AS windier_ha, round(count(*) FILTER (p <= -30) * {HA}::DOUBLE, 6) AS calmer_ha
  FROM (SELECT *, least(399.0, greatest(-99.0, (after / greatest(before, 0.02) - 1) * 100)) AS p FROM pairs) GROUP BY zone""", PTS, HALVES))
def street_wind_statistics(spark, sf):
    p = _pairs(spark, sf).withColumn("percent", percent_change(F.col("before"), F.col("after")))
    out = reports.street_wind_statistics(p, HA, "zone")
    return rounded(rounded(out, 6, "median_ratio", "p90_ratio", "windier_ha", "calmer_ha"), 5, "median_pct")


@query(sql(f"SELECT hour, round(median(felt), 6) AS felt, round(count(*) FILTER (du <= -2) * {HA}::DOUBLE, 6) AS colder_2_ha, round(count(*) FILTER (du <= -5) * {HA}::DOUBLE, 6) AS colder_5_ha, round(-min(du), 6) AS biggest_drop FROM changes GROUP BY hour", PTS, CHANGES))
def felt_step_summary(spark, sf):
    return rounded(reports.step_summary(changes(spark, sf), HA, "hour"), 6, "felt", "colder_2_ha", "colder_5_ha", "biggest_drop")


@query(sql("SELECT hour, round(median(felt - 9 - du), 9) AS median, round(quantile_cont(felt - 9 - du, 0.05), 9) AS p05, round(quantile_cont(felt - 9 - du, 0.95), 9) AS p95 FROM changes GROUP BY hour", PTS, CHANGES))
def wind_part_summary(spark, sf):
    c = changes(spark, sf).select("hour", (F.col("felt") - 9).alias("d_wind"), F.col("du").alias("d_uniform"))
    return rounded(reports.wind_part_summary(c, "hour"), 9, "median", "p05", "p95")


@query(sql('SELECT zone, "row", col, round(min(du), 6) AS worst FROM changes WHERE hour <> 3 GROUP BY ALL UNION ALL SELECT zone, "row", col, NULL FROM changes GROUP BY ALL HAVING bool_and(hour = 3)', PTS, CHANGES))
def worst_value_of_day(spark, sf):
    c = changes(spark, sf).withColumn("v", F.when(F.col("hour") == 3, float("nan")).otherwise(F.col("du")))
    return rounded(reports.worst_of_day(c, "v", "zone"), 6, "worst")


_TILED = """tiles AS (SELECT DISTINCT 't' || (s_suppkey % 60) || '_' || (s_suppkey // 20) AS name, (s_suppkey % 60) * 48.0::DOUBLE AS xmin, (s_suppkey // 20) * 40.0::DOUBLE AS ymin FROM supplier),
 hit AS (SELECT DISTINCT t.name, least(31, floor((hours - xmin) / 1.5)::INT) AS c, least(26, floor((ymin + 40 - "row") / 1.5::DOUBLE)::INT) AS r FROM pts JOIN tiles t ON t.name = 't' || floor(hours / 48)::BIGINT || '_' || ("row" // 40))"""


@query(
    sql(
        """SELECT name, round(count(c) / 864.0::DOUBLE, 6) AS fill, round(count(*) FILTER (r < 3 AND c < 3) / 9.0::DOUBLE, 6) AS top_left, round(count(*) FILTER (r < 3 AND c >= 29) / 9.0::DOUBLE, 6) AS top_right, round(count(*) FILTER (r >= 24 AND c < 3) / 9.0::DOUBLE, 6) AS bottom_left,
  round(count(*) FILTER (r >= 24 AND c >= 29) / 9.0::DOUBLE, 6) AS bottom_right FROM tiles LEFT JOIN hit USING (name) GROUP BY name""",
        PTS, _TILED,
    )
)
def tile_occupancy(spark, sf):
    """Catalogued tiles, one a supplier, of 48 hours by 40 rows in blocks of 1.5: 32 columns and 27 rows of them, corners of three."""
    p = points(spark, sf)
    name = lambda i, j: F.concat(F.lit("t"), i, F.lit("_"), j).alias("name")
    k = F.col("s_suppkey")
    i, j = k % 60, F.floor(k / 20)
    tiles = read(spark, sf, "supplier").select(name(i, j), (i * 48.0).alias("xmin"), (i * 48.0 + 48).alias("xmax"), (j * 40.0).alias("ymin"), (j * 40.0 + 40).alias("ymax")).distinct()
    named = p.select(name(F.floor(F.col("hours") / 48), F.floor(F.col("row") / 40)), F.col("hours").alias("x"), F.col("row").cast("double").alias("y"))
    out = reports.tile_occupancy(named, tiles, 1.5)
    return rounded(out, 6, "fill", "top_left", "top_right", "bottom_left", "bottom_right")


@query(sql("SELECT name, cells, round(100.0 * cells / (SELECT count(*) FROM cells), 6) AS share_pct FROM (SELECT 'b' || (col // 10) || '_' || (\"row\" // 10) AS name, count(*) FILTER (nodata) AS cells FROM cells GROUP BY 1) WHERE cells > 0 ORDER BY cells DESC, name LIMIT 12", PTS, GRID, CELLS))
def missing_tiles_ranked(spark, sf):
    name = F.concat(F.lit("b"), F.floor(F.col("col") / 10), F.lit("_"), F.floor(F.col("row") / 10))
    return rounded(reports.missing_tiles(cells(spark, sf), name, ~F.col("nodata")), 6, "share_pct")


_FEATURES = "feats AS (SELECT s_suppkey AS id, 'f' || s_suppkey % 9 AS name, s_suppkey % 83 * 0.01::DOUBLE AS xmin, s_suppkey % 83 * 0.01::DOUBLE + 0.02 AS xmax, s_suppkey % 71 * 0.01::DOUBLE AS ymin, s_suppkey % 71 * 0.01::DOUBLE + 0.02 AS ymax FROM supplier)"


@query(sql("SELECT id, name FROM feats WHERE xmax >= 0.1::DOUBLE AND xmin <= 0.4::DOUBLE AND ymax >= 0.05::DOUBLE AND ymin <= 0.5::DOUBLE", _FEATURES))
def features_in_box(spark, sf):
    k = F.col("s_suppkey")
    at = lambda m: k % m * F.lit(0.01)
    f = read(spark, sf, "supplier").select(k.alias("id"), F.concat(F.lit("f"), k % 9).alias("name"), at(83).alias("xmin"), (at(83) + 0.02).alias("xmax"), at(71).alias("ymin"), (at(71) + 0.02).alias("ymax"))
    return reports.in_box(f, 0.1, 0.05, 0.4, 0.5).select("id", "name")


@query(sql("""SELECT p.id, n.name FROM (SELECT c_custkey AS id, c_custkey % 131 * 0.0003::DOUBLE AS x, c_custkey % 47 * 0.0005::DOUBLE AS y FROM customer) p LEFT JOIN (
  SELECT id, name FROM (SELECT p.id, n.name, row_number() OVER (PARTITION BY p.id ORDER BY n.place) AS k FROM (SELECT c_custkey AS id, c_custkey % 131 * 0.0003::DOUBLE AS x, c_custkey % 47 * 0.0005::DOUBLE AS y FROM customer) p
  JOIN (SELECT s_name AS name, s_suppkey AS place, s_suppkey % 29 * 0.0012::DOUBLE AS nx, s_suppkey % 19 * 0.0011::DOUBLE AS ny FROM supplier) n ON abs(p.x - n.nx) < 5e-4 AND abs(p.y - n.ny) < 4e-4) WHERE k = 1) n ON n.id = p.id"""))
def names_within_tolerance(spark, sf):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    p = read(spark, sf, "customer").select(c.alias("id"), (c % 131 * F.lit(0.0003)).alias("x"), (c % 47 * F.lit(0.0005)).alias("y"))
    n = read(spark, sf, "supplier").select(F.col("s_name").alias("name"), s.alias("place"), (s % 29 * F.lit(0.0012)).alias("nx"), (s % 19 * F.lit(0.0011)).alias("ny"))
    return reports.named_near(p, n)


_TIMES = ["09:30", "11:00", "12:30", "14:00"]


@query(sql("""SELECT day::VARCHAR AS day, ts FROM (SELECT s.day, s.ts, row_number() OVER (PARTITION BY s.day ORDER BY abs(epoch(s.ts) - epoch(t.target)), s.ts) AS k FROM (
  SELECT DISTINCT day, day::TIMESTAMP + INTERVAL 1 MINUTE * m AS ts FROM weather, (VALUES (570), (660), (750), (840)) v(m)) s JOIN (SELECT day, day::TIMESTAMP + INTERVAL 1 HOUR * arg_min(hour, -ghi) AS target FROM weather GROUP BY day) t ON t.day = s.day) WHERE k = 1""", PTS, WEATHER))
def report_step_nearest_to_peak(spark, sf):
    w = weather_rows(spark, sf)
    steps = reports.report_steps(w.select("day").distinct(), _TIMES).select("day", "ts")
    peak = w.groupBy("day").agg(F.min_by("hour", -F.col("ghi")).alias("h")).select("day", F.timestamp_add("HOUR", F.col("h"), F.col("day").cast("timestamp_ntz")).alias("target"))
    return reports.nearest_step(steps, peak, "day").select(F.col("day").cast("string").alias("day"), "ts")


@query(sql("""SELECT count(*) FILTER (park AND NOT built AND NOT water AND singles < 2) AS open_lawn, count(*) FILTER (NOT built AND NOT water) AS open_ground, count(*) FILTER (park AND NOT built AND NOT water AND singles >= 2) AS under_trees, floor(a / 400)::INT AS band FROM (
  SELECT *, label > 0 AS built, col * 20 * sin(radians(29.0::DOUBLE)) - "row" * 20 * cos(radians(29.0::DOUBLE)) AS a FROM cells) GROUP BY band""", PTS, GRID, CELLS))
def ground_masks_along_avenue(spark, sf):
    up, _ = reports.along_avenue(F.col("col") * CELL_M, -F.col("row") * CELL_M, 0.0, 0.0, 29.0)
    kinds = reports.masks(F.col("park"), F.col("label") > 0, F.col("water"), F.col("singles"))
    return cells(spark, sf).groupBy(F.floor(up / 400).cast("int").alias("band")).agg(*[F.count_if(m).alias(k) for k, m in kinds.items()])


_GROWN = "grown AS (SELECT b.label, b.height_m, l.quantile FROM buildings b JOIN labels_ l ON b.label = l.label WHERE b.height_m IS NOT NULL AND (l.quantile IS NULL OR b.height_m > l.quantile + 6) AND fraction <= 0.5 AND n > 0)"


def _grown(spark, sf):
    c = cells(spark, sf)
    return c, scenario.grown_labels(buildings(spark, sf), zonal.label_statistics(c, "heights", "nodata"))


@query(sql("SELECT label, round(height_m, 4) AS height_m, quantile, count(*) AS cells_raised FROM cells JOIN grown USING (label) WHERE ground + height_m > surface + 3 GROUP BY ALL ORDER BY height_m DESC, label LIMIT 15", PTS, GRID, CELLS, LABELS, BUILDINGS, _GROWN))
def grown_buildings_report(spark, sf):
    c, grown = _grown(spark, sf)
    out = reports.grown_report(c, grown, F.col("ground").cast("double") + F.col("height_m"))
    return rounded(reports.ranked(out, "height_m", "label", 15), 4, "height_m")


_SWEEP = f"""suns(hour, altitude, azimuth) AS (VALUES {", ".join(f"({k}, {a}::DOUBLE, {z}::DOUBLE)" for k, (_, a, z) in enumerate(SUNS))}),
 raised AS (SELECT "row", col, "row"::BIGINT * 1048576 + col AS id, surface::FLOAT AS was, (ground + height_m)::FLOAT AS top, height_m FROM cells JOIN grown USING (label) WHERE ground + height_m > surface + 3),
 spread AS (SELECT "row", col, id, id AS name FROM raised UNION SELECT p."row", p.col, p.id, s.name FROM spread s JOIN raised p ON p."row" BETWEEN s."row" - 1 AND s."row" + 1 AND p.col BETWEEN s.col - 1 AND s.col + 1 WHERE s.name < p.id),
 every AS (SELECT id, min(name) AS component FROM spread GROUP BY id),
 boxes AS (SELECT component, max(top - was) AS rise, max(height_m) AS high, (min("row") + max("row") + 1) / 2.0::DOUBLE AS r, (min(col) + max(col) + 1) / 2.0::DOUBLE AS c FROM raised JOIN every USING (id) GROUP BY component),
 parts AS (SELECT component, "row", col, was, top FROM raised JOIN every USING (id) JOIN boxes USING (component)
   WHERE rise >= 3 AND high / tan(radians((SELECT min(altitude) FROM suns WHERE altitude > 0))) >= {CELL_M} * sqrt(pow(greatest(0, -r, r - 40), 2) + pow(greatest(0, 20 - c, c - 90), 2))),
 reach AS (SELECT greatest((SELECT max(top) FROM parts), (SELECT max(surface) FROM cells))::DOUBLE - (SELECT min(surface) FROM cells)::DOUBLE AS far),
 offs AS (SELECT hour, drow, dcol, (sqrt(drow * drow + dcol * dcol) * tan(radians(altitude)) * {CELL_M})::FLOAT AS climb FROM (
   SELECT DISTINCT hour, altitude, round_even(-step * cos(radians(azimuth)), 0)::INT AS drow, round_even(step * sin(radians(azimuth)), 0)::INT AS dcol FROM suns, reach, generate_series(1, 400) g(step)
   WHERE altitude > 0 AND step <= greatest(1, ceil(far / (tan(radians(altitude)) * {CELL_M})) + 1)) WHERE drow <> 0 OR dcol <> 0),
 base AS (SELECT DISTINCT o.hour, c."row", c.col FROM cells c, offs o, cells b WHERE b."row" = c."row" + o.drow AND b.col = c.col + o.dcol AND b.surface > (c.surface + o.climb)::FLOAT),
 shaded AS (SELECT DISTINCT p.component, o.hour, c."row", c.col FROM parts p, offs o, cells c LEFT JOIN parts m ON m."row" = c."row" AND m.col = c.col
   WHERE c."row" = p."row" - o.drow AND c.col = p.col - o.dcol AND p.top > ((CASE WHEN m.component = p.component THEN m.top ELSE c.surface END) + o.climb)::FLOAT
   AND NOT EXISTS (SELECT 1 FROM base WHERE base.hour = o.hour AND base."row" = c."row" AND base.col = c.col))"""


@query(
    sql(
        """SELECT k.component, coalesce(any_2, 0)::BIGINT AS any_2, coalesce(h2, 0)::BIGINT AS hours_2, coalesce(any_5, 0)::BIGINT AS any_5, coalesce(h5, 0)::BIGINT AS hours_5 FROM (SELECT DISTINCT component FROM parts) k LEFT JOIN (
  SELECT component, count(*) FILTER (c2 > 0) AS any_2, sum(c2) AS h2, count(*) FILTER (c5 > 0) AS any_5, sum(c5) AS h5 FROM (
   SELECT s.component, s."row", s.col, count(*) FILTER (du <= -2) AS c2, count(*) FILTER (du <= -5) AS c5 FROM shaded s JOIN changes d ON d."row" = s."row" AND d.col = s.col AND d.hour = s.hour GROUP BY ALL) GROUP BY component) a ON a.component = k.component""",
        PTS, GRID, CELLS, LABELS, BUILDINGS, CHANGES, _GROWN, _SWEEP,
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def attribution_by_own_sweep(spark, sf):
    """What each connected change shades that lay in no shade before, against the hourly changes; those too low for the reported window are left out."""
    c = stored(cells(spark, sf), "cells")
    grown = scenario.grown_labels(buildings(spark, sf), zonal.label_statistics(c, "heights", "nodata"))
    top = F.col("ground").cast("double") + F.col("height_m")
    raised = c.join(grown, "label").where(top > F.col("surface") + 3).select("row", "col", F.col("surface").cast("float").alias("top_before"), top.cast("float").alias("top_now"), "height_m")
    parts = sweep.changed_components(raised)
    parts = stored(sweep.worth_a_sweep(parts, min(a for _, a, _ in SUNS if a > 0), (0, 40, 20, 90), CELL_M), "parts")
    suns = spark.createDataFrame([(k, a, z) for k, (_, a, z) in enumerate(SUNS)], "hour int, altitude double, azimuth double")
    newly = sweep.newly_shaded(parts, c, suns, CELL_M).select("component", "hour", "row", "col")
    return compare.attribution(parts.select("component"), changes(spark, sf).select("row", "col", "hour", "du"), newly)


_VOIDS = """lat AS MATERIALIZED (SELECT r::INT AS "row", q::INT AS col, NOT (r // 9 % 2 = 1 AND q // 12 % 3 = 1) AND (c."row" IS NOT NULL OR (r * 7 + q * 3) % 2 = 0) AS valid, (r // 20 + q // 30) % 3 <> 0 AS tiled
   FROM (SELECT unnest(range((SELECT max("row") + 1 FROM cells))) AS r) a, range(120) b(q) LEFT JOIN cells c ON c."row" = r AND c.col = q),
 voids AS (SELECT *, NOT EXISTS (SELECT 1 FROM lat n WHERE n.valid AND n."row" BETWEEN l."row" - 1 AND l."row" + 1 AND n.col BETWEEN l.col - 1 AND l.col + 1) AS void FROM lat l),
 coarse AS MATERIALIZED (SELECT "row" // 5 AS r, col // 5 AS c, bool_or(valid) AS shut FROM lat GROUP BY ALL),
 out_ AS (SELECT r, c FROM coarse WHERE NOT shut AND (r = 0 OR c = 0 OR r = (SELECT max(r) FROM coarse) OR c = (SELECT max(c) FROM coarse))
   UNION SELECT n.r, n.c FROM out_ o JOIN coarse n ON abs(n.r - o.r) + abs(n.c - o.c) = 1 WHERE NOT n.shut)"""


@query(sql('SELECT "row", col, void AND tiled AND o.r IS NULL AS water, void AND NOT (tiled AND o.r IS NULL) AS nodata FROM voids LEFT JOIN out_ o ON o.r = "row" // 5 AND o.c = col // 5', PTS, GRID, CELLS, _VOIDS).replace("WITH ", "WITH RECURSIVE ", 1))
def voids_split(spark, sf):
    """Cells farther than 6 m from a return, at 4 m a cell: water inside tiles where returns enclose them, else no data."""
    c = cells(spark, sf).select("row", "col", F.lit(True).alias("has"))
    rows = (c.agg(F.max("row")).first()[0] or 0) + 1
    r, q = F.col("row"), F.col("col")
    lattice = spark.range(rows * 120).select(F.expr("int(id div 120)").alias("row"), F.expr("int(id % 120)").alias("col")).join(c, ["row", "col"], "left")
    gap = (F.floor(r / 9) % 2 == 1) & (F.floor(q / 12) % 3 == 1)
    valid = ~gap & (F.coalesce("has", F.lit(False)) | ((r * 7 + q * 3) % 2 == 0))
    tiled = (F.floor(r / 20) + F.floor(q / 30)) % 3 != 0
    return sweep.voids(lattice.select("row", "col", valid.alias("valid"), tiled.alias("tiled")), rows, 120, 4.0, "tiled")


_GAPS = 'gaps AS (SELECT "row", col, CASE WHEN NOT nodata AND NOT ("row" BETWEEN 10 AND 40 AND col BETWEEN 15 AND 95) THEN heights::DOUBLE END AS v FROM cells)'
_SCAN = "row_number() OVER (PARTITION BY a.\"row\", a.col ORDER BY (a.\"row\" - b.\"row\") * (a.\"row\" - b.\"row\") + (a.col - b.col) * (a.col - b.col), b.\"row\", b.col) AS k"


@query(sql(f"""SELECT "row", col, v, round(distance, 9) AS distance FROM (SELECT "row", col, v, 0.0::DOUBLE AS distance FROM gaps WHERE v IS NOT NULL UNION ALL
  SELECT "row", col, v, distance FROM (SELECT a."row", a.col, b.v, sqrt((a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col)) AS distance, {_SCAN} FROM gaps a, gaps b WHERE a.v IS NULL AND b.v IS NOT NULL) WHERE k = 1)""", PTS, GRID, CELLS, _GAPS))
def nearest_value_anywhere(spark, sf):
    """Cells without a value take the nearest one's; a gap is wider than any block."""
    hole = F.col("row").between(10, 40) & F.col("col").between(15, 95)
    c = stored(cells(spark, sf).select("row", "col", F.when(~F.col("nodata") & ~hole, F.col("heights").cast("double")).alias("v")), "gaps")
    return rounded(nearest.filled(c, "v", size=16), 9, "distance")


@query(sql(f"""SELECT id, "row", col, open_row, open_col FROM (SELECT a.id, a."row", a.col, b."row" AS open_row, b.col AS open_col, {_SCAN.replace('a."row", a.col ORDER', 'a.id ORDER')}
  FROM (SELECT c_custkey AS id, (c_custkey * 7 % 61)::INT AS "row", (c_custkey * 13 % 119)::INT AS col FROM customer) a, (SELECT * FROM cells WHERE label = 0 AND NOT water AND park) b) WHERE k = 1""", PTS, GRID, CELLS))
def probes_to_open_ground(spark, sf):
    """Probes, one a customer, that stand in a building or in water go to the nearest open cell of the park."""
    k = F.col("c_custkey")
    probes = read(spark, sf, "customer").select(k.alias("id"), (k * 7 % 61).cast("int").alias("row"), (k * 13 % 119).cast("int").alias("col"))
    ground = stored(cells(spark, sf).withColumn("open", (F.col("label") == 0) & ~F.col("water") & F.col("park")).select("row", "col", "open"), "open")
    return nearest.moved_to_open(probes, ground, "open").select("id", "row", "col", "open_row", "open_col")


_GROUND = """lat AS (SELECT r::INT AS "row", q::INT AS col, ((r * 37 + q * 53 + r * q) % 97)::DOUBLE AS surface FROM generate_series(0, 59) a(r), (SELECT DISTINCT n_nationkey AS q FROM nation)),
 coarse AS (SELECT "row" // 5 AS r, col // 5 AS c, min(surface) AS least FROM lat GROUP BY ALL),
 smooth AS (SELECT a.r, a.c, avg(b.least) AS g FROM coarse a, generate_series(-1, 1) x(dr), generate_series(-1, 1) y(dc), coarse b WHERE b.r = least(11, greatest(0, a.r + dr)) AND b.c = least(4, greatest(0, a.c + dc)) GROUP BY ALL),
 frac AS (SELECT *, "row" * (11 / 59.0::DOUBLE) AS fr, col * (4 / 24.0::DOUBLE) AS fc FROM lat)"""


@query(sql("""SELECT f."row", f.col, round(least(sum(s.g * (CASE WHEN a = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN b = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END)), any_value(surface)), 5) AS ground
  FROM frac f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b), smooth s WHERE s.r = least(11, floor(fr) + a) AND s.c = least(4, floor(fc) + b) GROUP BY f."row", f.col""", _GROUND))
def estimated_ground(spark, sf):
    """A lattice of 60 rows and as many columns as there are nations."""
    q = read(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("col"))
    lat = q.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(59))))
    lat = lat.withColumn("surface", ((F.col("row") * 37 + F.col("col") * 53 + F.col("row") * F.col("col")) % 97).cast("double"))
    return rounded(sweep.estimated_ground(lat, 60, 25, 5), 5, "ground")


_BREAKS = [-99.0, -30.0, -10.0, 10.0, 30.0, 399.0]


@query(sql('SELECT bin, count(*) AS cells FROM (SELECT CASE WHEN p >= -99 AND p < -30 THEN 1 WHEN p >= -30 AND p < -10 THEN 2 WHEN p >= 10 AND p < 30 THEN 4 WHEN p >= 30 AND p <= 399 THEN 5 ELSE 0 END AS bin FROM (SELECT least(399.0, greatest(-99.0, (after / greatest(before, 0.02) - 1) * 100)) AS p FROM pairs)) GROUP BY bin', PTS, HALVES))
def change_palette_with_hole(spark, sf):
    p = _pairs(spark, sf).select(percent_change(F.col("before"), F.col("after")).alias("p"))
    return p.groupBy(reports.change_bin(F.col("p"), _BREAKS, -10.0).alias("bin")).agg(F.count("*").alias("cells"))


@query(sql("SELECT place, part, run FROM (SELECT 0 AS place, 'pairs' AS part, n_nationkey AS run FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1, 'seasons', n_nationkey FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 2, 'tests', r_regionkey FROM region)"))
def job_queue(spark, sf):
    n = read(spark, sf, "nation")
    of = lambda k: n.where(F.col("n_regionkey") == k).select(F.col("n_nationkey").alias("run"))
    return reports.job_queue([("pairs", of(1)), ("seasons", of(3)), ("tests", read(spark, sf, "region").select(F.col("r_regionkey").alias("run")))])


@query(sql('SELECT DISTINCT a."row", a.col FROM cells a JOIN cells b ON a."row" = b."row" AND a.col = b.col WHERE a.park AND NOT b.nodata', PTS, GRID, CELLS))
def masks_in_common(spark, sf):
    c = cells(spark, sf)
    return reports.both_masks(c.where("park"), c.where("not nodata"))


@query(sql("SELECT zone, count(*) AS cell_hours, round(avg(du), 6) AS mean FROM changes WHERE hour IN (2, 4, 5) GROUP BY zone", PTS, CHANGES))
def hour_cells_together(spark, sf):
    c = changes(spark, sf)
    return rounded(reports.hour_cells([c.where(F.col("hour") == h) for h in (2, 4, 5)]).groupBy("zone").agg(F.count("*").alias("cell_hours"), F.avg("du").alias("mean")), 6, "mean")


@query(sql(f"""SELECT c."row", c.col FROM cells c JOIN grown USING (label) WHERE (SELECT count(*) FROM cells n, (VALUES {", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))}) o(dr, dc) WHERE n.label > 0 AND n."row" = c."row" + dr AND n.col = c.col + dc) < 9""", PTS, GRID, CELLS, LABELS, BUILDINGS, _GROWN))
def walls_of_grown_labels(spark, sf):
    from ..operators import facade

    c, grown = _grown(spark, sf)
    return reports.kept_walls(facade.wall_cells(c.withColumn("built", F.col("label") > 0)), grown).select("row", "col")


_CATEGORY = "(" + " + ".join("({v} >= " + f"{e})::INT" for e in (-40, -27, -13, 0, 9, 26, 32, 38, 46)) + ")"
_BANDS = {"south300": (0.0, 300.0), "south800": (0.0, 800.0), "rest": (800.0, 1e9)}


@query(sql(f"""SELECT band, count(*) AS cells, round(sum(s) / sum(k), 6) AS mean, round(count(*) FILTER (worst <= -2) * {HA}::DOUBLE, 6) AS any_2_ha, round(sum(h2) * {HA}::DOUBLE, 6) AS hours_2_ha, round(count(*) FILTER (worst <= -5) * {HA}::DOUBLE, 6) AS any_5_ha, round(sum(h5) * {HA}::DOUBLE, 6) AS hours_5_ha, round(sum(hc) * {HA}::DOUBLE, 6) AS hours_colder_ha FROM (
  SELECT band, "row", col, sum(du) AS s, count(*) AS k, min(du) AS worst, count(*) FILTER (du <= -2) AS h2, count(*) FILTER (du <= -5) AS h5, count(*) FILTER ({_CATEGORY.format(v='felt')} < {_CATEGORY.format(v='(felt - du)')}) AS hc FROM changes, (VALUES ('south300', 0, 300), ('south800', 0, 800), ('rest', 800, 1000000000)) b(band, lo, hi) WHERE col * 20 >= lo AND col * 20 < hi GROUP BY ALL) GROUP BY band""", PTS, CHANGES))
def banded_heat(spark, sf):
    ch = changes(spark, sf)
    ch = ch.withColumn("colder", stress_category(F.col("felt")) < stress_category(F.col("felt") - F.col("du")))
    out = reports.banded_heat(ch, F.col("col") * CELL_M, _BANDS, (-2, -5), HA)
    return rounded(out, 6, "mean", "any_2_ha", "hours_2_ha", "any_5_ha", "hours_5_ha", "hours_colder_ha")


@query(sql('SELECT c."row", c.col, EXISTS (SELECT 1 FROM supplier WHERE c.col * 20 BETWEEN s_suppkey % 41 * 50 AND s_suppkey % 41 * 50 + 90 + s_suppkey % 3 * 40 AND c."row" * 20 BETWEEN s_suppkey % 23 * 80 AND s_suppkey % 23 * 80 + 110) AS in_tiles FROM cells c', PTS, GRID, CELLS))
def own_box_mask(spark, sf):
    s = F.col("s_suppkey")
    x, y = s % 41 * F.lit(50.0), s % 23 * F.lit(80.0)
    t = read(spark, sf, "supplier").select(x.alias("xmin"), (x + 90 + s % 3 * 40).alias("xmax"), y.alias("ymin"), (y + 110).alias("ymax"))
    c = cells(spark, sf).select("row", "col", (F.col("col") * CELL_M).alias("x"), (F.col("row") * CELL_M).alias("y"))
    return reports.in_own_boxes(c, t, 100.0).select("row", "col", "in_tiles")


@query(sql("""SELECT station, r.ts, run, p."row", p.col, round(p.before * speed, 6) AS wind FROM (SELECT * FROM (SELECT station, ts, speed, n_nationkey AS run, row_number() OVER (PARTITION BY station ORDER BY d.away, n_nationkey) AS k FROM (
   SELECT event_type AS station, arg_max(ts, (ts, value / 100, user_id * 7 % 360)) AS ts, arg_max(value / 100, (ts, value / 100, user_id * 7 % 360)) AS speed, arg_max(user_id * 7 % 360, (ts, value / 100, user_id * 7 % 360))::DOUBLE AS dir FROM events GROUP BY event_type) r, nation,
   LATERAL (SELECT abs((r.dir - n_nationkey * 14.4::DOUBLE + 180) - 360 * floor((r.dir - n_nationkey * 14.4::DOUBLE + 180) / 360) - 180) AS away) d) WHERE k = 1) r JOIN pairs p ON p."row" % 25 = r.run""", PTS, HALVES))
def live_wind(spark, sf):
    """Newest reading of each station, the run next to it, and that run's cells scaled."""
    n = F.col("n_nationkey")
    runs = read(spark, sf, "nation").select(n.alias("run"), (n * F.lit(14.4)).alias("run_direction"))
    readings = read(spark, sf, "events").select(F.col("event_type").alias("station"), "ts", (F.col("user_id") * 7 % 360).cast("double").alias("direction"), (F.col("value") / 100).alias("speed"))
    ratios = _pairs(spark, sf).select((F.col("row") % 25).cast(dict(read(spark, sf, "nation").dtypes)["n_nationkey"]).alias("run"), "row", "col", F.col("before").alias("k"))
    return rounded(reports.live_wind(ratios, readings, runs, "station"), 6, "wind").select("station", "ts", "run", "row", "col", "wind")


@query(f"""SELECT day::VARCHAR AS day, hour, round(altitude, 6) AS altitude, round(azimuth, 6) AS azimuth FROM {sun_table("(SELECT day, h::INT AS hour, epoch(day::TIMESTAMP) AS unix_s FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), generate_series(0, 23) g(h))", "unix_s + (hour + 5) * 3600.0")} WHERE altitude > 0""")
def hourly_local_day(spark, sf):
    days = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    out = local_day(days, LAT, LON)
    return rounded(out.withColumn("day", F.col("day").cast("string")), 6, "altitude", "azimuth")
