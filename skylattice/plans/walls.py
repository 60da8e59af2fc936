"""Queries on neighbourhoods, components, walls and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, facade, focal, gridding, scenario
from .stand_ins import BUILDINGS, CELL_M, CELLS, CHANGES, COLS, GRID, PTS, TILES, buildings, cells, changes, points, read, sql, tiles
from .surface import SUNS, _suns

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


_BOX = "(VALUES " + ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1)) + ") o(dr, dc)"


@query(sql(f"""SELECT c."row", c.col FROM cells c WHERE label > 0 AND (SELECT count(*) FROM cells n, {_BOX} WHERE n.label > 0 AND n."row" = c."row" + dr AND n.col = c.col + dc) < 9""", PTS, GRID, CELLS))
def wall_cells(spark, sf):
    c = cells(spark, sf).withColumn("built", F.col("label") > 0)
    return facade.wall_cells(c).select("row", "col")


@query(
    sql(
        f"""SELECT c."row", c.col, coalesce(e.n = 9, false) AS closed FROM cells c LEFT JOIN (
  SELECT d."row" + dr AS "row", d.col + dc AS col, count(*) AS n FROM (SELECT DISTINCT x."row", x.col FROM (SELECT "row" + dr AS "row", col + dc AS col FROM cells, {_BOX} WHERE park) x JOIN cells k ON k."row" = x."row" AND k.col = x.col) d, {_BOX} GROUP BY ALL) e ON e."row" = c."row" AND e.col = c.col""",
        PTS, GRID, CELLS,
    )
)
def morphology_closing(spark, sf):
    return focal.closed(cells(spark, sf).select("row", "col", F.col("park").alias("closed")), "closed")


def _size(c):
    e = c.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    return (e["r"] or 0) + 1, (e["c"] or 0) + 1


_CLAMP = """m AS (SELECT t.vec_id, t."row", t.col, avg(n.v::DOUBLE) AS mean, avg(n.v::DOUBLE * n.v::DOUBLE) AS sq FROM tiles t, generate_series(-1, 1) a(dr), generate_series(-1, 1) b(dc), tiles n
 WHERE n.vec_id = t.vec_id AND n."row" = least(7, greatest(0, t."row" + dr)) AND n.col = least(7, greatest(0, t.col + dc)) GROUP BY ALL)"""


@query(sql('SELECT vec_id, "row", col, round(mean, 6) AS mean, round(sqrt(greatest(0, sq - mean * mean)), 6) AS roughness FROM m', TILES, _CLAMP))
def roughness_tiles(spark, sf):
    out = focal.moving_moments(tiles(spark, sf), "v", 1, 8, 8, "vec_id")
    return out.select("vec_id", "row", "col", F.round("mean", 6).alias("mean"), F.round("roughness", 6).alias("roughness"))


@query(
    sql(
        """SELECT c."row", c.col, coalesce(k.comp, c.id) AS component FROM ids c LEFT JOIN (SELECT a AS id, min(b) AS comp FROM reach GROUP BY a) k ON k.id = c.id""",
        "RECURSIVE " + PTS, GRID, CELLS,
        'ids AS (SELECT "row", col, "row"::BIGINT * 1048576 + col AS id FROM cells WHERE label > 0 AND heights > 150)',
        """reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, n.id FROM reach r JOIN ids n ON n.id IN (r.b - 1, r.b + 1, r.b - 1048576, r.b + 1048576))""",
    )
)
def connected_components(spark, sf):
    c = cells(spark, sf).where((F.col("label") > 0) & (F.col("heights") > 150)).select("row", "col")
    return focal.connected(c)


@query(sql('SELECT "row", col, round(value, 4) AS value, round(distance, 6) AS distance FROM (SELECT c."row", c.col, coalesce(c.x, n.x) AS value, CASE WHEN c.x IS NOT NULL THEN 0 ELSE sqrt(n.d2) END AS distance FROM e c LEFT JOIN LATERAL (SELECT x, d2 FROM (SELECT x, (k."row" - c."row") ** 2 + (k.col - c.col) ** 2 AS d2, k."row" AS r, k.col AS q FROM e k WHERE x IS NOT NULL AND k."row" BETWEEN c."row" - 3 AND c."row" + 3 AND k.col BETWEEN c.col - 3 AND c.col + 3) WHERE d2 <= 9 ORDER BY d2, r, q LIMIT 1) n ON c.x IS NULL)', PTS, GRID, CELLS, 'e AS (SELECT "row", col, CASE WHEN NOT nodata THEN surface::DOUBLE END AS x FROM cells)'))
def nearest_fill(spark, sf):
    c = cells(spark, sf).select("row", "col", F.when(~F.col("nodata"), F.col("surface").cast("double")).alias("value"))
    return focal.nearest_fill(c, "value", 3).select("row", "col", F.round("value", 4).alias("value"), F.round("distance", 6).alias("distance"))


@query(
    sql(
        """SELECT c."row", c.col, round(CASE WHEN c.x IS NOT NULL AND den > 0.2 THEN num / den END, 5) AS smooth FROM field c LEFT JOIN (
  SELECT t."row", t.col, sum(w.w * u.w * f.x) AS num, sum(w.w * u.w) FILTER (f.x IS NOT NULL) AS den FROM field t, kern w, kern u, extent e, field f
  WHERE f."row" = (CASE WHEN t."row" + w.k < 0 THEN -1 - t."row" - w.k WHEN t."row" + w.k > e.r THEN 2 * e.r + 1 - t."row" - w.k ELSE t."row" + w.k END)
    AND f.col = (CASE WHEN t.col + u.k < 0 THEN -1 - t.col - u.k WHEN t.col + u.k > e.c THEN 2 * e.c + 1 - t.col - u.k ELSE t.col + u.k END) GROUP BY ALL) s ON s."row" = c."row" AND s.col = c.col""",
        PTS, GRID, CELLS,
        'field AS (SELECT "row", col, CASE WHEN NOT nodata THEN heights::DOUBLE END AS x FROM cells)',
        'extent AS (SELECT max("row") AS r, max(col) AS c FROM cells)',
        "kern AS (SELECT k, exp(-k * k / 2.0) / sum(exp(-k * k / 2.0)) OVER () AS w FROM generate_series(-4, 4) g(k))",
    )
)
def gaussian_smooth(spark, sf):
    c = cells(spark, sf).select("row", "col", F.when(~F.col("nodata"), F.col("heights").cast("double")).alias("h"))
    return focal.gaussian(c, "h", 1.0, size=_size(c)).select("row", "col", F.round("smooth", 5).alias("smooth"))


def _samples(spark, sf):
    c = cells(spark, sf).withColumn("built", F.col("label") > 0)
    walls = facade.wall_normals(c.select("row", "col", "built", "label", "ground", "heights"))
    s = facade.wall_samples(walls, 2)
    key = F.col("row").cast("long") * 1_000_000 + F.col("col") * 10 + F.col("level")
    return c, s.select(key.alias("sample"), "row", "col", "ne", "nn", "label", "height_frac", (F.col("ground") + F.col("z_above_ground")).cast("double").alias("z0"))


#: Walls, their normals, two samples a wall and the march, written out: weights of the smoothed mask, then one row a ray step.
_MARCH = f"""kern AS (SELECT k, exp(-k * k / (2 * 1.2 * 1.2)) / sum(exp(-k * k / (2 * 1.2 * 1.2))) OVER () AS w FROM generate_series(-5, 5) g(k)),
 soft AS (SELECT c."row" + a.k AS "row", c.col + b.k AS col, sum(a.w * b.w * (c.label > 0)::INT) / sum(a.w * b.w) AS s FROM cells c, kern a, kern b GROUP BY ALL),
 inlat AS (SELECT s.* FROM soft s JOIN cells c ON c."row" = s."row" AND c.col = s.col),
 wall AS (SELECT * FROM cells c WHERE label > 0 AND (SELECT count(*) FROM cells n, {_BOX} WHERE n.label > 0 AND n."row" = c."row" + dr AND n.col = c.col + dc) < 9),
 slope AS (SELECT w.*, (coalesce(e.s, 0) - coalesce(v.s, 0)) / 2 AS gc, (coalesce(d.s, 0) - coalesce(u.s, 0)) / 2 AS gr FROM wall w
   LEFT JOIN inlat e ON e."row" = w."row" AND e.col = w.col + 1 LEFT JOIN inlat v ON v."row" = w."row" AND v.col = w.col - 1
   LEFT JOIN inlat d ON d.col = w.col AND d."row" = w."row" + 1 LEFT JOIN inlat u ON u.col = w.col AND u."row" = w."row" - 1),
 samp AS (SELECT "row"::BIGINT * 1000000 + col * 10 + level AS sample, "row", col, label, -gc / sqrt(gc * gc + gr * gr) AS ne, gr / sqrt(gc * gc + gr * gr) AS nn, (ground + (level + 0.5) / 2 * heights)::DOUBLE AS z0 FROM slope, (VALUES (0), (1)) l(level) WHERE sqrt(gc * gc + gr * gr) > 1e-6 AND heights > 0),
 face AS (SELECT s.*, u.sun, u.altitude, tan(radians(u.altitude)) AS ta, sin(radians(u.azimuth)) AS se, cos(radians(u.azimuth)) AS sn, (ne * sin(radians(u.azimuth)) + nn * cos(radians(u.azimuth))) * cos(radians(u.altitude)) AS aoi FROM samp s, (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {z}::DOUBLE)" for n, a, z in SUNS)}) u(sun, altitude, azimuth) WHERE u.altitude > 0.5),
 steps AS (SELECT f.*, n, round_even(f."row" - nn - n * sn, 0)::INT AS r2, round_even(f.col + ne + n * se, 0)::INT AS c2, z0 + (n + 1) * {CELL_M} * ta AS ray FROM face f, (SELECT max(surface)::DOUBLE AS top FROM cells), generate_series(1, 200) g(n) WHERE aoi > 0 AND n <= floor(least(2500, greatest(0, top - z0) / ta) / {CELL_M}) + 2),
 dark AS (SELECT DISTINCT s.sample, s.sun FROM steps s JOIN cells t ON t."row" = s.r2 AND t.col = s.c2 WHERE t.surface > s.ray AND NOT (s.n < 2 AND t.label = s.label))"""


@query(
    sql(
        """SELECT f.sample, f.sun, d.sample IS NULL AS lit, round(CASE WHEN d.sample IS NULL THEN 1367 * pow(0.7, pow(least(38.0, 1 / (sin(radians(altitude)) + 0.50572 * pow(altitude + 6.07995, -1.6364))), 0.678)) * aoi ELSE 0 END, 3) AS gain
  FROM face f LEFT JOIN dark d ON d.sample = f.sample AND d.sun = f.sun WHERE f.aoi > 0""",
        PTS, GRID, CELLS, _MARCH,
    )
)
def facade_march(spark, sf):
    c, s = _samples(spark, sf)
    out = facade.march(s, c.select("row", "col", "surface", "label"), _suns(spark), CELL_M)
    return out.select("sample", "sun", "lit", F.round("gain", 3).alias("gain"))


_NEAR = " , ".join(f"coalesce(avg(h) FILTER (abs((b - {a} + 180) - 360 * floor((b - {a} + 180) / 360) - 180) <= 45), 0) AS {k}" for k, a in (("n", 0), ("e", 90), ("s", 180), ("w", 270)))


@query(sql(f"SELECT label, round(all_walls, 6) AS all_walls, round(low, 6) AS low, round(high, 6) AS high, round(n, 6) AS n, round(e, 6) AS e, round(s, 6) AS s, round(w, 6) AS w, round(greatest(n, e, s, w), 6) AS best FROM (SELECT label, avg(h) AS all_walls, coalesce(avg(h) FILTER (f < 0.5), 0) AS low, coalesce(avg(h) FILTER (f >= 0.5), 0) AS high, {_NEAR} FROM (SELECT l_suppkey AS label, l_quantity AS h, l_discount * 8 AS f, (l_partkey % 24) * 15.0::DOUBLE AS b FROM lineitem) GROUP BY label)"))
def facade_rollup(spark, sf):
    from ..operators.zonal import facade_rollup as rollup

    li = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_quantity").alias("hours"), (F.col("l_discount") * 8).alias("height_frac"), (F.col("l_partkey") % 24 * F.lit(15.0)).alias("bearing"))
    return rollup(li).select("label", *[F.round(c, 6).alias(c) for c in ("all_walls", "low", "high", "n", "e", "s", "w", "best")])


@query(
    sql(
        """SELECT label, kind, round(height_m, 4) AS height_m FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'tower' THEN -height_m ELSE 0 END, file_order) AS k FROM (
  SELECT *, CASE WHEN in_frame THEN 'frame' WHEN distance <= 200 THEN 'ring' WHEN height_m >= 100 AND distance <= 1500 THEN 'tower' END AS kind FROM buildings WHERE height_m >= 3) WHERE kind IS NOT NULL) WHERE k <= CASE kind WHEN 'tower' THEN 250 WHEN 'ring' THEN 6000 ELSE k END""",
        BUILDINGS,
    )
)
def tower_topk_with_caps(spark, sf):
    return scenario.viewer_buildings(buildings(spark, sf)).select("label", "kind", F.round("height_m", 4).alias("height_m"))


@query(
    sql(
        """SELECT tx, ty, t.name, count(*) AS points FROM (SELECT floor(hours / 24)::BIGINT AS tx, ("row" // 10)::BIGINT AS ty FROM pts) p LEFT JOIN (SELECT DISTINCT floor(x / 24)::BIGINT AS kx, floor(y / 10)::BIGINT AS ky, 'tile_' || floor(x / 24)::BIGINT || '_' || floor(y / 10)::BIGINT AS name FROM (SELECT s_suppkey % 30 * 24.0::DOUBLE AS x, s_suppkey % 13 * 10.0::DOUBLE AS y FROM supplier)) t ON t.kx = p.tx AND t.ky = p.ty GROUP BY ALL""",
        PTS,
    )
)
def tile_coverage_missing(spark, sf):
    s = F.col("s_suppkey")
    have = read(spark, sf, "supplier").select((s % 30).alias("kx"), (s % 13).alias("ky")).distinct()
    catalog = have.select(F.concat_ws("_", F.lit("tile"), "kx", "ky").alias("name"), (F.col("kx") * 24.0).alias("xmin"), (F.col("ky") * 24.0).alias("ymin"))
    p = points(spark, sf).select(F.col("hours").alias("x"), (F.floor(F.col("row") / 10) * 24.0).alias("y"))
    return gridding.covered(p, catalog, 24.0).groupBy("tx", "ty", "name").agg(F.count("*").alias("points"))


_SHAPES = """shapes AS (SELECT s_suppkey AS label, s_suppkey % 97 * 1.5::DOUBLE AS r, s_suppkey * 7 % 110 * 1.0::DOUBLE AS c, 3 + s_suppkey % 6 AS h, 4 + s_suppkey % 9 AS w FROM supplier)"""


@query(sql('SELECT "row", col, max(label) AS label FROM (SELECT label, y::INT AS "row", x::INT AS col FROM shapes, generate_series(0, 200) g(y), generate_series(0, 200) k(x) WHERE y + 0.5 >= r AND y + 0.5 < r + h AND x + 0.5 > c AND x + 0.5 < c + w AND (x + 0.5 - c) < w * (1 - (y + 0.5 - r) / h / 2)) GROUP BY ALL', _SHAPES))
def rasterise_polygons(spark, sf):
    """Trapezes over the lattice; the later feature wins."""
    s = F.col("s_suppkey")
    r, c, h, w = s % 97 * F.lit(1.5), (s * 7 % 110) * F.lit(1.0), 3 + s % 6, 4 + s % 9
    point = lambda a, b: F.struct(a.cast("double").alias("row"), b.cast("double").alias("col"))
    rings = read(spark, sf, "supplier").select(s.alias("label"), s.alias("file_order"), F.array(point(r, c), point(r, c + w), point(r + h, c + w / 2), point(r + h, c)).alias("ring"))
    return scenario.rasterise(rings, 201, 201)


@query(
    sql(
        """SELECT k.component, coalesce(any_2, 0)::BIGINT AS any_2, coalesce(h2, 0)::BIGINT AS hours_2, coalesce(any_5, 0)::BIGINT AS any_5, coalesce(h5, 0)::BIGINT AS hours_5 FROM (SELECT DISTINCT component FROM comps) k LEFT JOIN (
  SELECT component, count(*) FILTER (c2 > 0) AS any_2, sum(c2) AS h2, count(*) FILTER (c5 > 0) AS any_5, sum(c5) AS h5 FROM (
   SELECT n.component, n."row", n.col, count(*) FILTER (du <= -2) AS c2, count(*) FILTER (du <= -5) AS c5 FROM newly n JOIN changes d ON d."row" = n."row" AND d.col = n.col AND d.hour = n.hour GROUP BY ALL) GROUP BY component) a ON a.component = k.component""",
        PTS, GRID, CELLS, CHANGES,
        'comps AS (SELECT "row", col, label AS component FROM cells WHERE label > 0 AND heights > 100)',
        'newly AS (SELECT DISTINCT c.component, h::INT AS hour, c."row" + h::INT - 4 AS "row", c.col + 1 AS col FROM comps c, generate_series(0, 7) g(h))',
    )
)
def attribution_by_component(spark, sf):
    comps = cells(spark, sf).where((F.col("label") > 0) & (F.col("heights") > 100)).select("row", "col", F.col("label").alias("component"))
    newly = comps.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("component", "hour", (F.col("row") + F.col("hour") - 4).alias("row"), (F.col("col") + 1).alias("col")).distinct()
    return compare.attribution(comps, changes(spark, sf).select("row", "col", "hour", "du"), newly)
