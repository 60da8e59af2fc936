"""The cone against known points, and there and back."""

import math

import pytest
from pyspark.sql import functions as F

from skylattice.functions.projection import LONG_ISLAND, LONG_ISLAND_FEET, Cone, bounds_lonlat, corners_lonlat, polygons_lonlat
from skylattice.operators.grid import Grid


def mapped(spark, cone, places):
    df = spark.createDataFrame(places, "lon double, lat double")
    x, y = cone.forward(F.col("lon"), F.col("lat"))
    df = df.withColumn("x", x).withColumn("y", y).withColumn("k", cone.scale(F.col("lat")))
    lon, lat = cone.inverse(F.col("x"), F.col("y"))
    return df.withColumn("lon2", lon).withColumn("lat2", lat).collect()


def test_worked_example(spark):
    """Snyder's example on the ellipsoid of 1866: parallels 33 and 45, origin 23 N 96 W, the place 35 N 75 W."""
    cone = Cone(33.0, 45.0, 23.0, -96.0, axis=6378206.4, flattening=1 - math.sqrt(1 - 0.00676866))
    r = mapped(spark, cone, [(-75.0, 35.0)])[0]
    assert abs(r["x"] - 1894410.9) < 0.1 and abs(r["y"] - 1564649.5) < 0.1 and abs(r["k"] - 0.9970171) < 1e-6


@pytest.mark.parametrize("cone", [LONG_ISLAND, LONG_ISLAND_FEET, Cone(-30.0, -40.0, -35.0, 140.0), Cone(45.0, 45.0, 45.0, 3.0)])
def test_there_and_back(spark, cone):
    places = [(cone.lon0 + dx, cone.lat0 + dy) for dx in (-8.0, -1.0, 0.0, 0.37, 9.0) for dy in (-7.0, -0.5, 0.0, 0.61, 8.0)]
    for r in mapped(spark, cone, places):
        assert abs(r["lon2"] - r["lon"]) < 1e-11 and abs(r["lat2"] - r["lat"]) < 1e-11


def test_origin_parallels_and_feet(spark):
    r = mapped(spark, LONG_ISLAND, [(-74.0, LONG_ISLAND.lat0), (-73.0, LONG_ISLAND.south), (-73.0, LONG_ISLAND.north)])
    assert abs(r[0]["x"] - 300_000) < 1e-6 and abs(r[0]["y"]) < 1e-6
    assert all(abs(x["k"] - 1) < 1e-12 for x in r[1:])
    feet = mapped(spark, LONG_ISLAND_FEET, [(-73.979, 40.7645)])[0]
    metres = mapped(spark, LONG_ISLAND, [(-73.979, 40.7645)])[0]
    assert abs(feet["x"] * 1200 / 3937 - metres["x"]) < 1e-6 and abs(feet["x"] - 990_000) < 2_000 and abs(feet["y"] - 218_000) < 2_000


def test_window_of_a_turned_grid(spark):
    grid = Grid(300_000.0, 66_000.0, 2.0, 100, 50, bearing=29.0, frame=(10, 90, 5, 45))
    corners = corners_lonlat(spark, grid, LONG_ISLAND)
    rows = sorted(corners.collect())
    b = bounds_lonlat(corners, pad_deg=0.5).first()
    assert b["west"] == min(r["lon"] for r in rows) - 0.5 and b["north"] == max(r["lat"] for r in rows) + 0.5
    x, y = LONG_ISLAND.forward(F.col("lon"), F.col("lat"))
    back = [tuple(r) for r in corners.orderBy("nth").select(x, y).collect()]
    want = [grid.affine.place(r, c) for r, c in ((10, 5), (10, 45), (90, 45), (90, 5))]
    assert all(abs(a - b) < 1e-6 for p, q in zip(back, want, strict=True) for a, b in zip(p, q, strict=True))
    text = polygons_lonlat(corners.withColumn("id", F.lit(1)), "id").first()["polygon"]
    assert text.startswith('{"type":"Polygon","coordinates":[[[') and text.count("],[") == 4


def test_no_cylinder():
    with pytest.raises(ValueError, match="cylinder"):
        Cone(-20.0, 20.0, 0.0, 0.0)
