"""Queries that write the tables' points and cells as files of their own formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gridding
from ..operators.grid import Grid
from ..sources import las, tiff
from ..sources.scratch import own_folder
from .stand_ins import CELLS, CHANGES, GRID, PTS, cells, changes, points, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Hours, users and values as a tile's whole numbers.
STEPS = {"scale_x": 1e-5, "scale_y": 1.0, "scale_z": 0.001}
TILE_HOURS = 168


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return keep


def tiles(spark, sf) -> str:
    """Folder of the events as point tiles: a tile a week, unit the US survey foot."""
    p = points(spark, sf)
    name = F.concat(F.lit("week_"), F.floor(F.col("hours") / TILE_HOURS))
    path = own_folder(spark, "tiles")
    las.write_points(p.select(F.col("hours").alias("x"), F.col("row").cast("double").alias("y"), "z", "cls", "nret", name.alias("tile")), path, epsg=2263, **STEPS)
    return path


_RAW = PTS.replace("pts AS", "raw AS", 1)
_TILED = "tiled AS (SELECT 'week_' || floor(hours / 168)::INT AS tile, floor(hours / 1e-5 + 0.5) * 1e-5 AS x, \"row\"::DOUBLE AS y, floor(z / 0.001 + 0.5) * 0.001 AS z, cls, nret FROM raw)"


@query(sql("SELECT tile, count(*) AS points, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax, 1200 / 3937.0::DOUBLE AS unit_m, true AS projected FROM tiled GROUP BY tile", _RAW, _TILED))
def las_tiles_probe(spark, sf):
    return las.probe(spark, tiles(spark, sf)).drop("packed")


@query(sql("SELECT * FROM grid", _RAW, _TILED, 'pts AS (SELECT y::INT AS "row", floor(x / 6)::INT AS col, z, cls, nret FROM tiled WHERE x >= 100 AND x <= 1000)', GRID))
def las_points_gridded(spark, sf):
    p = las.read_points(spark, tiles(spark, sf), box={"x": (100.0, 1000.0)}, chunk=20_000)
    return gridding.grid_points(p.select(F.col("y").cast("int").alias("row"), F.floor(F.col("x") / 6).cast("int").alias("col"), "z", "cls", "nret"))


_TURNED = 'placed AS (SELECT floor(0.5 * (x - 300) - 0.8660254037844386 * (y - 20)) AS c, floor(-0.8660254037844386 * (x - 300) - 0.5 * (y - 20)) AS r, z, cls, nret FROM tiled), pts AS (SELECT r::INT AS "row", c::INT AS col, z, cls, nret FROM placed WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 149)'


def turned() -> Grid:
    return Grid(300.0, 20.0, 1200 / 3937, 100, 150, unit_m=1200 / 3937, bearing=60.0)


def grid_of(df) -> Grid:
    """A lattice that holds all cells of ``df``."""
    n = df.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    return Grid(1000.0, 5000.0, 20.0, (n["r"] or 0) + 1, (n["c"] or 0) + 1, bearing=29.0)


@query(sql('SELECT name, "row", col, v FROM (UNPIVOT (SELECT "row", col, surface::DOUBLE AS surface, ground::DOUBLE AS ground, CASE WHEN NOT nodata THEN heights::DOUBLE END AS heights FROM cells) ON surface, ground, heights INTO NAME name VALUE v)', PTS, GRID, CELLS))
def raster_layer_set(spark, sf):
    """Layers written as a mosaic of bands and read back on the grid; the third has gaps."""
    c = cells(spark, sf)
    grid, path = grid_of(c), own_folder(spark, "layers")
    tiff.write_layer_set(c, path, grid, {"surface": "surface", "ground": "ground", "heights": F.when(~F.col("nodata"), F.col("heights"))}, {"water": "water", "park": "park"})
    return tiff.on_grid(tiff.read_rasters(spark, f"{path}/layers"), grid).select("name", "row", "col", "v")


@query(sql('SELECT "row" - 10 AS "row", col - 30 AS col, heights::DOUBLE AS v FROM cells WHERE "row" BETWEEN 10 AND 59 AND col BETWEEN 30 AND 129', PTS, GRID, CELLS))
def raster_window_rewritten(spark, sf):
    """A window of a raster, of which only its strips are read, as a raster of its own."""
    c = cells(spark, sf)
    grid, path, own = grid_of(c), own_folder(spark, "whole"), own_folder(spark, "window")
    tiff.write_rasters(tiff.layers_long(c, {"heights": "heights"}), path, grid, band_rows=1 << 20)
    part = tiff.read_rasters(spark, path, window=(10, 30, 60, 130))
    x, y = grid.affine.place(10, 30)
    small = Grid(x, y, grid.res_m, 50, 100, bearing=grid.bearing)
    tiff.write_rasters(tiff.on_grid(part, small), own, small, deflate=False)
    return tiff.read_rasters(spark, own).select("row", "col", "v")


@query(sql("""SELECT 'du_' || lpad(hour::VARCHAR, 2, '0') AS name, "row", col, du::FLOAT::DOUBLE AS v FROM changes UNION ALL SELECT 'felt_' || lpad(hour::VARCHAR, 2, '0'), "row", col, felt::FLOAT::DOUBLE FROM changes""", PTS, CHANGES))
def raster_changes_by_hour(spark, sf):
    ch = changes(spark, sf)
    grid, path = grid_of(ch), own_folder(spark, "changes")
    tiff.write_changes(ch, path, grid, ["du", "felt"])
    return tiff.on_grid(tiff.read_rasters(spark, path), grid).select("name", "row", "col", "v")


@query(sql("SELECT * FROM grid", _RAW, _TILED, _TURNED, GRID))
def las_points_on_turned_grid(spark, sf):
    """Only tiles that touch the turned domain are read."""
    grid = turned()
    return gridding.grid_points(las.points_on(las.read_points(spark, tiles(spark, sf), grid), grid))
