"""Analytic cases: shadows, sky view, walls, grids, sun."""

import math
import random

import numpy as np
import pytest
from measures import most_rows
from pyspark.sql import functions as F

from skylattice.functions.solar import with_sun
from skylattice.operators import facade, focal, kernels
from skylattice.operators.grid import Grid, around, square
from skylattice.plans import catalogue
from skylattice.sources.readers import synthetic_city


def tower(spark, n=60, height=30.0):
    return synthetic_city(spark, n, n, [(n // 2, n // 2, 2, height)], ground=0.0)


@pytest.mark.parametrize("height, altitude", [(30.0, 45.0), (30.0, 30.0), (60.0, 60.0)])
def test_shadow_length(spark, height, altitude):
    """H / tan(a) within a cell, towards smaller rows with the sun in the south."""
    n = 60
    suns = spark.createDataFrame([(altitude, 180.0)], "altitude double, azimuth double")
    lit = focal.shadows(tower(spark, n, height), suns, 2.0)
    column = [r["row"] for r in lit.where(f"not lit and col = {n // 2}").collect()]
    assert column and max(column) < n // 2 - 1
    assert abs(len(column) * 2.0 - height / math.tan(math.radians(altitude))) <= 2.0 * 1.001


@pytest.mark.parametrize("azimuth, side", [(90.0, -1), (270.0, 1)])
def test_shadow_direction(spark, azimuth, side):
    suns = spark.createDataFrame([(30.0, azimuth)], "altitude double, azimuth double")
    dark = [r["col"] for r in focal.shadows(tower(spark), suns, 2.0).where("not lit").collect()]
    assert sum((c - 30) * side > 2 for c in dark) > 10 and sum((c - 30) * side < -2 for c in dark) == 0


def test_a_cell_travels_a_few_times_only():
    halo = kernels.halo_of(kernels.offsets(151.0, 486))
    size = kernels.block_size(halo)
    assert max(halo) > 400 and min(halo) == 0
    copies = (1 + sum(halo[:2]) / size) * (1 + sum(halo[2:]) / size)
    assert copies <= 5


def test_counts_of_suns_are_those_of_single_suns(spark):
    cells = synthetic_city(spark, 40, 50, [(10, 12, 2, 22.0), (25, 30, 3, 35.0), (33, 8, 1, 12.0)])
    suns = [(40.0, 100.0), (35.0, 217.0), (-2.0, 10.0), (55.0, 301.0)]
    want = {}
    for altitude, azimuth in suns:
        for r in kernels.shadows_blocked(cells, altitude, azimuth, 2.0).collect():
            want[r["row"], r["col"]] = want.get((r["row"], r["col"]), 0) + r["lit"]
    for size in (9, None):
        assert {(r["row"], r["col"]): r["lit_steps"] for r in kernels.sun_counts(cells, suns, 2.0, size=size).collect()} == want


def test_canyon_closes_the_sky(spark):
    views = []
    for height in (0.0, 10.0, 40.0):
        cells = synthetic_city(spark, 61, 41, []).withColumn("surface", F.when((F.col("col") < 16) | (F.col("col") >= 26), height).otherwise(0.0).cast("float"))
        views.append(kernels.sky_view_blocked(cells, 2.0, 60.0).where("row = 30 and col = 20").first()["svf"])
    assert views[0] == 1.0 and views[0] > views[1] > views[2] > 0


def test_distance_in_blocks(spark):
    rnd = random.Random(4)
    marks = {(rnd.randrange(50), rnd.randrange(70)) for _ in range(25)}
    cells = spark.createDataFrame([(r, c, (r, c) in marks) for r in range(50) for c in range(70)], "row int, col int, m boolean")
    for size in (16, None):
        got = {(r["row"], r["col"]): r["distance"] for r in kernels.distance_blocked(cells, "m", 9, size).collect()}
        for (r, c), d in got.items():
            near = min(math.hypot(r - a, c - b) for a, b in marks)
            assert d is None if near > 9 else abs(d - near) < 1e-9


@pytest.mark.parametrize("azimuth", [90.0, 217.0, 301.0])
def test_forms_agree_for_any_block_size(spark, azimuth):
    cells = synthetic_city(spark, 40, 50, [(10, 12, 2, 22.0), (25, 30, 3, 35.0), (33, 8, 1, 12.0)])
    suns = spark.createDataFrame([(40.0, azimuth)], "altitude double, azimuth double")
    join = {(r["row"], r["col"]): r["lit"] for r in focal.shadows(cells, suns, 2.0).collect()}
    for size in (7, 16, 64):
        assert {(r["row"], r["col"]): r["lit"] for r in kernels.shadows_blocked(cells, 40.0, azimuth, 2.0, size=size).collect()} == join


def test_window_is_the_cropped_whole(spark):
    cells = tower(spark)
    suns = spark.createDataFrame([(30.0, 200.0)], "altitude double, azimuth double")
    frame = F.col("row").between(5, 25) & F.col("col").between(10, 50)
    part = {tuple(r) for r in focal.shadows(cells, suns, 2.0, frame=frame).collect()}
    whole = {tuple(r) for r in focal.shadows(cells, suns, 2.0).where(frame).collect()}
    assert part == whole and any(not r[-1] for r in part)


def test_night_and_overhead(spark):
    suns = spark.createDataFrame([(-3.0, 10.0), (89.9, 10.0)], "altitude double, azimuth double")
    n = dict(focal.shadows(tower(spark, 30), suns, 2.0).groupBy("altitude").agg(F.avg(F.col("lit").cast("int"))).collect())
    assert n[-3.0] == 0 and n[89.9] > 0.99


def test_sky_view(spark):
    wall = synthetic_city(spark, 41, 41, []).withColumn("surface", F.when(F.col("col") >= 20, 4000.0).otherwise(0.0).cast("float"))
    views = {(r["row"], r["col"]): r["svf"] for r in focal.sky_view(wall, spark, 2.0, 30.0).collect()}
    assert abs(views[20, 19] - 0.5) < 0.07 and views[20, 2] == 1.0
    blocked = {(r["row"], r["col"]): r["svf"] for r in kernels.sky_view_blocked(wall, 2.0, 30.0, size=13).collect()}
    assert all(abs(blocked[k] - v) < 1e-6 for k, v in views.items())


def test_wall_normals_face_outward(spark):
    cells = tower(spark, 30).withColumn("built", F.col("heights") > 0)
    found = {(r["row"], r["col"]): (r["ne"], r["nn"]) for r in facade.wall_normals(cells).collect()}
    assert len(found) == 16
    assert found[15, 17][0] > 0.99 and found[15, 13][0] < -0.99 and found[13, 15][1] > 0.99


def _facing(spark, bearing, day):
    """Mean hours of sun of each wall of a lone tower turned by 29 degrees, or straight on a grid turned so, and what its normal faces."""
    import datetime

    n, t = 120, math.radians(29.0 if not bearing else 0.0)
    inside = lambda r, c: abs((c - n / 2) * math.cos(t) + (r - n / 2) * math.sin(t)) < 20 and abs((c - n / 2) * math.sin(t) - (r - n / 2) * math.cos(t)) < 12
    cells = spark.createDataFrame([(r, c, inside(r, c)) for r in range(n) for c in range(n)], "row int, col int, built boolean")
    height = F.when(F.col("built"), 200.0).otherwise(0.0).cast("float")
    cells = cells.select("row", "col", "built", F.col("built").cast("int").alias("label"), height.alias("surface"), height.alias("heights"))
    start = int(datetime.datetime(*day, 13, tzinfo=datetime.timezone.utc).timestamp())
    suns = with_sun(spark.createDataFrame([(str(h), start + 3600 * h) for h in range(9)], "sun string, t long"), "t", 40.7645, -73.979).where("altitude > 0").select("sun", "altitude", "azimuth")
    s = facade.wall_samples(facade.wall_normals(cells), 4).withColumn("sample", F.monotonically_increasing_id()).withColumn("z0", F.col("z_above_ground").cast("double"))
    s = s.select("sample", "row", "col", "ne", "nn", "label", "z0")
    out = facade.march(s, cells.select("row", "col", "surface", "label"), suns, 2.0, bearing)
    hours = {(r["row"], r["col"], r["z0"]): r["h"] for r in out.groupBy("row", "col", "z0").agg(F.count_if("lit").alias("h")).collect()}
    walls = {}
    for r in s.collect():
        way = (math.degrees(math.atan2(r["ne"], r["nn"])) + bearing) % 360
        for name, normal in (("N", 29), ("E", 119), ("S", 209), ("W", 299)):
            if abs((way - normal + 180) % 360 - 180) <= 40:  # corner cells face neither wall
                walls.setdefault(name, []).append(hours.get((r["row"], r["col"], r["z0"]), 0))
    azimuths = [r["azimuth"] for r in suns.collect()]
    return {name: (sum(h) / len(h), sum(math.cos(math.radians(a - normal)) > 0.02 for a in azimuths)) for (name, h), normal in ((x, dict(N=29, E=119, S=209, W=299)[x[0]]) for x in walls.items())}


@pytest.mark.parametrize("bearing", [0.0, 29.0])
@pytest.mark.parametrize("day", [(2026, 3, 21), (2026, 6, 21), (2026, 12, 21)])
def test_walls_are_lit_while_they_face_the_sun(spark, bearing, day):
    found = _facing(spark, bearing, day)
    assert set(found) == {"N", "E", "S", "W"}
    # Walls of whole cells face a few degrees off, which costs a wall part of the hour in which it is grazed.
    assert all(abs(got - expected) <= 0.65 for got, expected in found.values()), found


def test_grid_round_trip(spark):
    g = Grid(1000.0, 9000.0, 2.0, 300, 200, unit_m=1200 / 3937, bearing=28.9)
    x, y = g.centre(F.col("r"), F.col("c"))
    df = spark.range(200).select((F.col("id") % 300).alias("r"), (F.col("id") * 7 % 200).alias("c"))
    r, c = g.cell(x, y)
    assert df.where((r != F.col("r")) | (c != F.col("c"))).count() == 0
    wide = g.with_buffer(100.0)
    assert wide.rows == 400 and wide.frame == (50, 350, 50, 250)
    assert square(0.0, 0.0, 700.0, 2.0).rows == 350
    assert around(df.select(F.col("r").cast("double").alias("x"), F.col("c").cast("double").alias("y")), 0.0, 1.0).rows > 150
    with pytest.raises(ValueError):
        Grid(0, 0, 1.0, 1, 1, unit_m=0)


@pytest.mark.parametrize("day, expected", [("2026-12-21", 25.8), ("2026-06-21", 72.67)])
def test_noon_altitude(spark, day, expected):
    df = spark.sql(f"SELECT unix_timestamp(timestamp'{day} 00:00:00') + m * 60 AS t FROM (SELECT explode(sequence(900, 1100)) AS m)")
    assert abs(with_sun(df, "t", 40.7645, -73.979).agg(F.max("altitude")).first()[0] - expected) < 0.1


@pytest.mark.parametrize("lat", [31.2001, 29.9187, 0.0])
@pytest.mark.parametrize("day, declination, within", [("2026-06-21", 23.44, 0.2), ("2026-12-21", -23.44, 0.2), ("2026-03-20", 0.0, 0.6), ("2026-09-23", 0.0, 0.6)])
def test_declination_peak_and_azimuth(spark, lat, day, declination, within):
    df = spark.sql(f"SELECT unix_timestamp(timestamp'{day} 00:00:00') + m * 60 AS t FROM (SELECT explode(sequence(500, 900)) AS m)")
    peak = with_sun(df, "t", lat, 29.9).orderBy(F.desc("altitude")).first()
    assert abs(peak["declination"] - declination) <= within
    assert abs(peak["altitude"] - (90 - abs(lat - peak["declination"]))) <= 0.35
    if abs(lat - declination) > 5:
        assert abs((peak["azimuth"] - (180 if lat > declination else 0) + 180) % 360 - 180) <= 1


ODD = [float("nan"), float("inf"), float("-inf"), None]


def odd_cells(spark):
    """A lattice with values that are no numbers, values that are missing, and cells without a row or column."""
    rnd = random.Random(11)
    rows = [(r, c, rnd.choice(ODD) if rnd.random() < 0.02 else rnd.uniform(0, 90)) for r in range(30) for c in range(40) if rnd.random() < 0.9]
    rows += [(None, 3, 5.0), (4, None, float("nan")), (None, None, None)]
    return spark.createDataFrame(rows, "row int, col int, surface float")


def same(a, b) -> bool:
    return a == b or a != a and b != b or None not in (a, b) and abs(a - b) < 1e-9


def test_sky_view_of_odd_cells(spark):
    cells = odd_cells(spark)
    join = {(r["row"], r["col"]): r["svf"] for r in focal.sky_view(cells, spark, 2.0, 10.0).collect()}
    for size in (9, None):
        got = {(r["row"], r["col"]): r["svf"] for r in kernels.sky_view_blocked(cells, 2.0, 10.0, size=size).collect()}
        assert got.keys() == join.keys() and all(same(got[k], v) for k, v in join.items())
    assert any(v != v for v in join.values()) and join[None, 3] == 1.0


def test_sky_view_query_sends_a_cell_to_few_blocks(spark, sf):
    df = catalogue.QUERIES["sky_view_factor"](spark, sf)
    found = df.collect()
    assert most_rows(df) <= 5 * len(found)


def test_shadows_of_several_suns_in_blocks(spark):
    cells = odd_cells(spark).withColumn("surface", F.when(F.abs("surface") < 100, F.col("surface")))
    suns = spark.createDataFrame([("a", 40.0, 115.0), ("b", 55.0, 245.0), ("night", -4.0, 310.0), ("unknown", None, 10.0)], "sun string, altitude double, azimuth double")
    join = {tuple(r) for r in focal.shadows(cells, suns, 2.0).collect()}
    for size in (9, None):
        df = kernels.shadows(cells, suns, 2.0, size=size)
        assert df.columns == ["sun", "altitude", "azimuth", "row", "col", "lit"]
        assert {tuple(r) for r in df.collect()} == join
    assert kernels.shadows(cells, suns.limit(0), 2.0).count() == 0


def test_what_is_no_number_stands_above_all_numbers():
    z = np.array([[5.0, np.nan, np.inf, np.nan]], np.float32)
    nans = np.array([[False, True, False, False]])
    lit = kernels.lit_block(np.pad(z, 4, constant_values=np.nan), 4, 4, 4, [(0, 1, 1.0)], 1.0, 1.0, np.pad(nans, 4))
    assert lit[0].tolist() == [False, True, True, True]
    assert focal.ray_steps(float("nan"), 2.0, 40.0) == focal.ray_steps(float("inf"), 2.0, 40.0) == focal.MAX_STEPS
    assert focal.ray_steps(float("inf"), 2.0, 40.0, reach=10.0) == 6


def test_shadow_query_sends_a_cell_to_few_blocks(spark, sf):
    df = catalogue.QUERIES["shadow_sweep_join"](spark, sf)
    found = df.collect()
    assert most_rows(df) <= 2 * len(found)
