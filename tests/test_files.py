"""Point tiles and raster files: round trips, what is opened, what fails."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators.grid import Grid
from skylattice.sources import las, tiff

PUSH = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture(scope="module")
def cloud(spark, tmp_path_factory):
    """Four tiles of 100 x 100 with 900 points each."""
    path = str(tmp_path_factory.mktemp("cloud"))
    n = F.col("id")
    x, y = (n % 60) * (200 / 60) + 0.25, F.floor(n / 60) * (200 / 60) + 0.5
    points = spark.range(3600).select(x.alias("x"), y.alias("y"), (n % 97 * 0.5).alias("z"), (n % 7).alias("cls"), (n % 3 + 1).alias("nret"))
    points = points.withColumn("tile", F.concat_ws("_", F.lit("t"), F.floor(F.col("x") / 100), F.floor(F.col("y") / 100)))
    las.write_points(points, path, epsg=2263, scale_x=0.001, scale_y=0.001, scale_z=0.01)
    return path, points


def opened(path, **options):
    return las.TileReader({"path": path} | options).partitions()


def test_points_come_back(spark, cloud):
    path, points = cloud
    got = las.read_points(spark, path)
    rounded = lambda df: sorted((round(r["x"], 3), r["y"] and round(r["y"], 3), r["z"], r["cls"], r["nret"], r["tile"]) for r in df.collect())
    assert rounded(got) == rounded(points)
    heads = {r["tile"]: r for r in las.probe(spark, path).collect()}
    assert set(heads) == {"t_0_0", "t_0_1", "t_1_0", "t_1_1"} and sum(r["points"] for r in heads.values()) == 3600
    assert all(r["projected"] and not r["packed"] and abs(r["unit_m"] - 1200 / 3937) < 1e-15 for r in heads.values())


def test_only_needed_runs_are_opened(spark, cloud):
    path, points = cloud
    assert len(opened(path)) == 4 and len(opened(path, chunk="250")) == 16
    assert [p.count for p in opened(path, chunk="250")[:4]] == [250, 250, 250, 150]
    foot = 1200 / 3937
    grid = Grid(30.0, 60.0, 20 * foot, 2, 2, unit_m=foot, bearing=45.0)
    assert {p.tile.name for p in opened(path, domain=str([list(c) for c in grid.corners()]))} == {"t_0_0"}
    # The box of this turned grid touches three tiles, the grid itself two.
    far = Grid(95.0, 95.0, 10 * foot, 9, 1, unit_m=foot, bearing=-45.0)
    xs, ys = zip(*far.corners(), strict=True)
    boxed = {p.tile.name for p in opened(path, box=f'{{"x": [{min(xs)}, {max(xs)}], "y": [{min(ys)}, {max(ys)}]}}')}
    turned = {p.tile.name for p in opened(path, domain=str([list(c) for c in far.corners()]))}
    assert turned < boxed or turned == boxed == {"t_0_0"}
    inside = las.points_on(las.read_points(spark, path, grid), grid)
    row, col = grid.cell(F.col("x"), F.col("y"))
    assert inside.count() == points.where(grid.inside(row, col)).count() > 0
    assert las.read_points(spark, path, box={"x": (500.0, 600.0)}).count() == 0


def test_filters_reach_the_reader(spark, cloud):
    path, points = cloud
    spark.conf.set(PUSH, "true")
    try:
        one = las.read_points(spark, path).where("x < 50 and y > 120.0")
        assert one.rdd.getNumPartitions() == 1
        assert one.count() == points.where("x < 50 and y > 120.0").count()
    finally:
        spark.conf.unset(PUSH)


def test_tiles_that_cannot_be_read_fail(spark, cloud, tmp_path):
    path, points = cloud
    few = points.limit(5)
    las.write_points(few, str(tmp_path / "bare"))
    with pytest.raises(Exception, match="names no projection"):
        las.read_points(spark, str(tmp_path / "bare")).count()
    las.write_points(few, str(tmp_path / "odd"), epsg=4326)
    with pytest.raises(Exception, match="cannot be worked out"):
        las.read_points(spark, str(tmp_path / "odd")).count()
    with pytest.raises(Exception, match="disagree"):
        las.read_points(spark, path, Grid(0.0, 0.0, 1.0, 9, 9)).count()
    with pytest.raises(Exception, match="does not fit|missing"):
        las.write_points(few.withColumn("z", F.lit(1e9)), str(tmp_path / "high"), epsg=2263)
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no point tiles"):
        las.read_points(spark, str(tmp_path / "none")).count()


def test_units():
    assert las.unit_of_text('PROJCS["a",GEOGCS["b",UNIT["degree",0.0174532925199433]],PROJECTION["c"],UNIT["US survey foot",0.304800609601219]]') == 0.304800609601219
    assert las.unit_of_text('GEOGCS["b",UNIT["degree",0.0174532925199433]]') is None
    assert [las.unit_of_keys(k) for k in ({3072: 2263}, {3072: 32618}, {3072: 9, 3076: 9002}, {})] == [1200 / 3937, 1.0, 0.3048, None]


def test_boxes_meet_polygons():
    diamond = [(0.0, -2.0), (2.0, 0.0), (0.0, 2.0), (-2.0, 0.0)]
    assert las.meets((1.0, 1.0, 0), (3.0, 3.0, 0), diamond) and not las.meets((1.01, 1.0, 0), (3.0, 3.0, 0), diamond)
    assert las.meets((-9.0, -9.0, 0), (9.0, 9.0, 0), diamond) and las.meets((-0.1, -0.1, 0), (0.1, 0.1, 0), diamond)


GRID = Grid(1000.0, 2000.0, 2.0, 300, 90, bearing=29.0)


def lattice(spark):
    n = F.col("id")
    v = F.when(n % 11 != 0, F.sin(n.cast("double")) * 100)
    return spark.range(300 * 90).select(F.lit("z").alias("name"), F.expr("int(id div 90)").alias("row"), (n % 90).cast("int").alias("col"), v.alias("v"))


@pytest.mark.parametrize("deflate", [True, False])
@pytest.mark.parametrize("band", [64, 100, 4096])
def test_cells_come_back(spark, tmp_path, deflate, band):
    cells = lattice(spark)
    tiff.write_rasters(cells, str(tmp_path / "r"), GRID, kind="f8", deflate=deflate, band_rows=band)
    assert len(tiff.rasters_of(str(tmp_path / "r"))) == -(-300 // band)
    want = {(r["row"], r["col"]): r["v"] for r in cells.collect()}
    got = tiff.on_grid(tiff.read_rasters(spark, str(tmp_path / "r")), GRID).collect()
    assert {(r["row"], r["col"]): r["v"] for r in got} == {k: v for k, v in want.items() if v is not None}
    x, y = GRID.affine.place(got[0]["row"] + 0.5, got[0]["col"] + 0.5)
    assert abs(got[0]["x"] - x) < 1e-9 and abs(got[0]["y"] - y) < 1e-9 and got[0]["name"] == "z"
    every = tiff.on_grid(tiff.read_rasters(spark, str(tmp_path / "r"), empty=True), GRID).collect()
    assert {(r["row"], r["col"]): r["v"] for r in every} == want


def test_a_window_opens_its_strips_only(spark, tmp_path):
    path = str(tmp_path / "r")
    tiff.write_rasters(lattice(spark), path, GRID, band_rows=4096)
    found = tiff.RasterReader({"path": path, "window": "[70, 5, 130, 20]", "cells": "1"}).partitions()
    assert [p.numbers for p in found] == [[1], [2]]
    assert len(tiff.RasterReader({"path": path, "cells": "1"}).partitions()) == 5
    got = tiff.read_rasters(spark, path, (70, 5, 130, 20), empty=True)
    assert got.count() == 60 * 15
    assert tiff.read_rasters(spark, path, (300, 0, 400, 9)).count() == 0 and tiff.read_rasters(spark, path, names=["other"]).count() == 0
    spark.conf.set(PUSH, "true")
    try:
        some = tiff.read_rasters(spark, path, empty=True).where("row >= 128 and row < 192 and col = 3")
        assert some.rdd.getNumPartitions() == 1 and some.count() == 64
    finally:
        spark.conf.unset(PUSH)


def tiled_file(path, order, predictor, compression=8, bands=1):
    """A raster of 40 x 50 cells of 16 bits in tiles of 16 x 32, with a scale and a tie point."""
    z = (np.arange(2000).reshape(40, 50) * 7 % 1000).astype(order + "u2")
    parts = []
    for r in range(0, 48, 16):
        for c in range(0, 64, 32):
            t = np.zeros((16, 32), z.dtype)
            piece = z[r : r + 16, c : c + 32]
            t[: piece.shape[0], : piece.shape[1]] = piece
            if predictor == 2:
                t[:, 1:] = np.diff(t, axis=1)
            parts.append(zlib.compress(t.tobytes()))
    offsets = [8 + sum(map(len, parts[:k])) for k in range(len(parts))]
    fields = [(256, 3, [50]), (257, 3, [40]), (258, 3, [16]), (259, 3, [compression]), (277, 3, [bands]), (317, 3, [predictor]), (322, 3, [32]), (323, 3, [16]), (324, 4, offsets), (325, 4, [len(p) for p in parts]), (339, 3, [1]), (33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 500.0, 0.0]), (42113, 2, b"7\0")]
    start = 8 + sum(map(len, parts))
    after = start + 2 + 12 * len(fields) + 4
    entries, more = b"", b""
    for tag, code, values in fields:
        body = values if code == 2 else struct.pack(f"{order}{len(values)}{tiff.TYPES[code]}", *values)
        head = struct.pack(order + "HHI", tag, code, len(values))
        entries += head + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", after + len(more)))
        more += body if len(body) > 4 else b""
    mark = b"II" if order == "<" else b"MM"
    path.write_bytes(mark + struct.pack(order + "HI", 42, start) + b"".join(parts) + struct.pack(order + "H", len(fields)) + entries + b"\0" * 4 + more)
    return z


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiled_rasters_of_other_programs(spark, tmp_path, order, predictor):
    z = tiled_file(tmp_path / "city.tif", order, predictor)
    rows = tiff.read_rasters(spark, str(tmp_path / "city.tif")).collect()
    assert {(r["row"], r["col"]): r["v"] for r in rows} == {(r, c): float(z[r, c]) for r in range(40) for c in range(50) if z[r, c] != 7}
    assert all(r["x"] == 101.0 + 2 * r["col"] and r["y"] == 499.0 - 2 * r["row"] and r["name"] == "city" for r in rows)
    assert [p.numbers for p in tiff.RasterReader({"path": str(tmp_path), "window": "[17, 33, 18, 50]", "cells": "1"}).partitions()] == [[3]]


def test_rasters_that_cannot_be_read_fail(spark, tmp_path):
    tiled_file(tmp_path / "lzw.tif", "<", 1, compression=5)
    with pytest.raises(Exception, match="method 5"):
        tiff.read_rasters(spark, str(tmp_path / "lzw.tif")).count()
    tiled_file(tmp_path / "rgb.tif", "<", 1, bands=3)
    with pytest.raises(Exception, match="3 bands"):
        tiff.read_rasters(spark, str(tmp_path / "rgb.tif")).count()
    (tmp_path / "no.tif").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="no TIFF"):
        tiff.read_rasters(spark, str(tmp_path / "no.tif")).count()


def test_layer_set_and_hours(spark, tmp_path):
    cells = lattice(spark).select("row", "col", F.coalesce("v", F.lit(0.0)).alias("height"), (F.col("col") % 2 == 0).alias("wet"))
    tiff.write_layer_set(cells, str(tmp_path / "s"), GRID, {"height": "height"}, {"wet": "wet"})
    masks = tiff.on_grid(tiff.read_rasters(spark, str(tmp_path / "s/masks")), GRID)
    assert masks.count() == 27_000 and masks.where("v = 1").count() == 13_500
    assert spark.read.json(str(tmp_path / "s/domain")).first()["rows"] == 300
    hours = cells.withColumn("hour", F.col("row") % 3).withColumnRenamed("height", "du")
    tiff.write_changes(hours, str(tmp_path / "h"), GRID, ["du"])
    assert {r["name"]: r["count"] for r in tiff.read_rasters(spark, str(tmp_path / "h")).groupBy("name").count().collect()} == {f"du_0{k}": 9000 for k in range(3)}
