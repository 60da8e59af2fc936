"""Guards, catalogs, files and voids by round trip and brute force."""

import datetime
import json
import math
import random

import pytest
from measures import most_rows
from pyspark.sql import functions as F

from skylattice.operators import reports, scenario, sweep
from skylattice.sources import readers, sinks


def test_fit_guard(spark):
    f = lambda rows: spark.createDataFrame(rows, "name string, xmin double, ymin double, xmax double, ymax double")
    one = f([("a", 0.0, 0.0, 0.05, 0.05), ("a", 0.01, 0.0, 0.06, 0.05)])
    assert reports.fit_guard(one, False).count() == 2
    two = f([("a", 0.0, 0.0, 0.05, 0.05), ("b", 0.01, 0.0, 0.06, 0.05)])
    with pytest.raises(ValueError, match="names"):
        reports.fit_guard(two, False)
    assert reports.fit_guard(two, True).count() == 2
    with pytest.raises(ValueError, match="span"):
        reports.fit_guard(f([("a", 0.0, 0.0, 0.2, 0.05)]), True)


def test_metric_factor():
    assert reports.metric_factor((0.3048, 0.0), (0.0, 0.3048), 0.3048) == 0.3048
    with pytest.raises(ValueError):
        reports.metric_factor((0.3, 0.01), (-0.01, 0.3), 0.3)


def test_caps_leave_trees_and_low_labels(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0.0, 90.0, False), (0, 1, 1, 0.0, 90.0, False), (0, 2, 2, 0.0, 90.0, False)], "row int, col int, label int, ground double, surface float, nodata boolean")
    heights = spark.createDataFrame([(1, 80.0), (2, 2.0)], "label int, height_m double")
    out = {r["col"]: r["burnt"] for r in scenario.burn(cells, heights, None, 30.0).collect()}
    assert out == {0: 90.0, 1: 30.0, 2: 90.0}
    assert [tuple(r) for r in scenario.capped(heights, 30.0).orderBy("label").collect()] == [(1, 30.0, True), (2, 2.0, False)]


def test_run_catalog_and_parent(spark, tmp_path):
    for name, season, nx in (("today_dec", "dec", 5), ("2017_dec", "dec", 5), ("x_test", "dec", 5), ("today_jun", "jun", 7)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(json.dumps({"scenario": name.split("_")[0], "season": season, "theta_from_deg": 315.0, "res_m": 8.0, "box": {"nx": nx, "ny": 4, "nz": 3}}))
    (tmp_path / "empty").mkdir()
    runs = readers.run_catalog(spark, str(tmp_path))
    assert [r["name"] for r in runs.collect()] == ["2017_dec", "today_dec", "today_jun"]
    assert readers.parent_of(runs, "today", "dec", 315.0, 8.0, (5, 4, 3)).first()["name"] == "today_dec"
    with pytest.raises(Exception, match="another box"):
        readers.parent_of(runs, "today", "jun", 315.0, 8.0, (5, 4, 3)).collect()
    cells = spark.createDataFrame([(1.0, False), (float("nan"), False), (2.0, True), (None, False), (float("inf"), False)], "street_speed double, roof boolean")
    assert [r["ok"] for r in readers.usable_cells(cells).collect()] == [True, False, False, False, False]


def test_day_config_gives_report_steps(spark, tmp_path):
    path = tmp_path / "days.json"
    path.write_text(json.dumps({"seasons": {"dec": {"chosen": {"date": "2026-12-20"}, "report_timestamps": ["10:00", "14:30"]}}, "epw": "a.epw"}))
    row = readers.day_config(spark, str(path)).first()
    assert (row["season"], row["day"], row["epw"]) == ("dec", datetime.date(2026, 12, 20), "a.epw")
    steps = reports.report_steps(readers.day_config(spark, str(path)).select("season", "day"), row["times"])
    assert sorted(r["ts"] for r in steps.collect()) == [datetime.datetime(2026, 12, 20, 10), datetime.datetime(2026, 12, 20, 14, 30)]


def test_context_numbers(spark):
    a = spark.createDataFrame([("n", 3, "cells", "")], "key string, value int, unit string, note string")
    got = readers.context_numbers({"inputs": a, "gates": a}).collect()
    assert [(r["scope"], r["value"], r["status"]) for r in got] == [("inputs", 3.0, "internal"), ("gates", 3.0, "internal")]


def test_weather_file(spark, tmp_path):
    w = spark.createDataFrame([(datetime.datetime(2026, 3, 1, 5), 2.5, 40.0, 11.0, 101325.0, 300.0, None, 120.25)], "ts timestamp_ntz, ws double, rh double, ta double, pressure_pa double, ghi double, dhi double, dni double")
    sinks.write_met(w, str(tmp_path / "met"))
    head, row = next((tmp_path / "met").glob("part-*")).read_text().splitlines()
    assert head.split() == sinks.MET.split() and len(row.split()) == 24
    got = dict(zip(head.split(), row.split(), strict=True))
    assert [got[k] for k in ("%iy", "id", "it", "imin", "U", "RH", "Tair", "pres", "kdown", "kdiff", "kdir", "qn")] == ["2026", "60", "5", "0", "2.5", "40", "11", "101.325", "300", "-999", "120.25", "-999"]


def test_voids_are_water_only_where_enclosed(spark):
    rnd = random.Random(3)
    n, cell = 40, 2.0
    shut = lambda r, c: 8 <= r < 24 and 8 <= c < 24
    away = lambda r, c: c >= 34
    gaps = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(30)}
    rows = [(r, c, not (shut(r, c) or away(r, c) or (r, c) in gaps), c < 38) for r in range(n) for c in range(n)]
    got = {(r["row"], r["col"]): (r["water"], r["nodata"]) for r in sweep.voids(spark.createDataFrame(rows, "row int, col int, valid boolean, tiled boolean"), n, n, cell, "tiled").collect()}
    valid = {(r, c) for r, c, v, _ in rows if v}
    k = 10
    closed = {(r // k, c // k) for r, c in valid}
    out = {(a, b) for a in range(4) for b in range(4) if (a, b) not in closed and (a in (0, 3) or b in (0, 3))}
    while more := {(a, b) for a in range(4) for b in range(4) if (a, b) not in closed and (a, b) not in out and any((a + i, b + j) in out for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))}:
        out |= more
    for r, c, _, tiled in rows:
        void = min((r - a) ** 2 + (c - b) ** 2 for a, b in valid) ** 0.5 * cell > 6.0
        water = void and tiled and (r // k, c // k) not in out
        assert got[r, c] == (water, void and not water)
    assert any(w for w, _ in got.values())


def test_jobs_of_one_part(spark):
    jobs = [("a", spark.range(2)), ("b", spark.range(3))]
    assert reports.job_queue(jobs, "b").count() == 3 and [r["part"] for r in reports.job_queue(jobs).orderBy("place", "id").collect()] == ["a", "a", "b", "b", "b"]


def test_first_in_each(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2)], "k string, v int")
    assert sorted((r["k"], r["v"]) for r in reports.first_in(df, ["k"], [F.col("v")], 1).collect()) == [("x", 1), ("y", 2)]


def test_only_shade_that_was_none_before_is_credited(spark):
    """A low house in a tower's shade grows: nothing behind it was ever in the sun, but beside the tower's shade a lone house's is new."""
    surface = {(r, c): 0.0 for r in range(30) for c in range(12)}
    surface |= {(5, c): 100.0 for c in range(4)} | {(4, 1): 10.0}
    before = [(r, c, z) for (r, c), z in surface.items()]
    cells = spark.createDataFrame(before, "row int, col int, surface double")
    changed = spark.createDataFrame([(4, 1, 10.0, 60.0, 60.0), (20, 8, 0.0, 40.0, 40.0), (21, 9, 0.0, 40.0, 40.0), (28, 2, 0.0, 2.0, 2.0)], "row int, col int, top_before double, top_now double, height_m double")
    suns = spark.createDataFrame([(1, 44.0, 180.0), (2, -5.0, 180.0), (3, 30.0, 200.0)], "hour int, altitude double, azimuth double")
    parts = sweep.changed_components(changed)
    assert parts.select("component").distinct().count() == 3  # corners touch
    got = {(r["component"], r["hour"], r["row"], r["col"]) for r in sweep.newly_shaded(parts, cells, suns, 10.0).collect()}
    brute = set()

    def shade(z, hour):
        altitude, azimuth = {1: (44.0, 180.0), 3: (30.0, 200.0)}[hour]
        dark = set()
        for (r, c), low in z.items():
            for n in range(1, 60):
                a, b = r + round(-n * math.cos(math.radians(azimuth))), c + round(n * math.sin(math.radians(azimuth)))
                far = math.hypot(a - r, b - c) * 10.0
                if (a, b) != (r, c) and (a, b) in z and z[a, b] > low + far * math.tan(math.radians(altitude)):
                    dark.add((r, c))
        return dark

    for component, places in {4 << 20 | 1: [(4, 1)], 20 << 20 | 8: [(20, 8), (21, 9)], 28 << 20 | 2: [(28, 2)]}.items():
        now = surface | {p: t for p, t in {(4, 1): 60.0, (20, 8): 40.0, (21, 9): 40.0, (28, 2): 2.0}.items() if p in places}
        for hour in (1, 3):
            brute |= {(component, hour, r, c) for r, c in shade(now, hour) - shade(surface, hour)}
    assert got == brute and any(k == 20 << 20 | 8 for k, *_ in got)
    assert not any(h == 1 and k == 4 << 20 | 1 and r < 4 for k, h, r, _ in got)
    kept = lambda window: {r["component"] >> 20 for r in sweep.worth_a_sweep(parts, 30.0, window, 10.0).collect()}
    assert kept((0, 30, 0, 12)) == {4, 20} and kept((0, 8, 0, 12)) == {4} and kept((15, 30, 0, 12)) == {20}


@pytest.mark.parametrize("cell", [1.0, 2.0, 4.0, 5.0, 7.0])
def test_voids_at_any_cell_size(spark, cell):
    """A void is farther than 6 m from a return, whatever the cells measure."""
    n = 40
    valid = {(r, c): not (12 <= r < 26 and 10 <= c < 29) for r in range(n) for c in range(n)}
    rows = [(r, c, v, True) for (r, c), v in valid.items()]
    got = {(r["row"], r["col"]) for r in sweep.voids(spark.createDataFrame(rows, "row int, col int, valid boolean, tiled boolean"), n, n, cell, "tiled").where("water or nodata").collect()}
    returns = [p for p, v in valid.items() if v]
    assert got == {p for p in valid if min(math.hypot(p[0] - a, p[1] - b) for a, b in returns) * cell > 6.0}


def test_a_tile_without_a_return_is_listed(spark):
    tiles = spark.createDataFrame([("a", 0.0, 10.0, 0.0, 10.0), ("b", 10.0, 20.0, 0.0, 10.0), ("c", 5.0, 5.0, 0.0, 1.0)], "name string, xmin double, xmax double, ymin double, ymax double")
    points = spark.createDataFrame([("a", 0.5, 9.5), ("a", 9.5, 0.5), ("a", 0.4, 9.9)], "name string, x double, y double")
    got = {r["name"]: tuple(r)[1:] for r in reports.tile_occupancy(points, tiles, 1.0).collect()}
    assert got == {"a": (0.02, 1.0, 0.0, 0.0, 1.0), "b": (0.0,) * 5, "c": (None,) * 5}


def test_copies_of_points_and_names_do_not_multiply(spark):
    rnd = random.Random(7)
    spots = [(rnd.randrange(40) * 1e-4, rnd.randrange(40) * 1e-4) for _ in range(6)]
    points = [(i, *spots[i % 6]) for i in range(300)] + [(300, None, 1e-3), (301, 9.0, 9.0)]
    names = [(f"n{i}", *spots[i % 3], (i * 37) % 300) for i in range(300)] + [("nowhere", None, None, -1), ("no place", *spots[0], None)]
    df = reports.named_near(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(names, "name string, nx double, ny double, place long"))
    got = {r["id"]: r["name"] for r in df.collect()}
    want = {}
    for i, x, y in points:
        met = [(p, n) for n, nx, ny, p in names if None not in (x, y, nx, ny, p) and abs(x - nx) < 5e-4 and abs(y - ny) < 4e-4]
        want[i] = min(met)[1] if met else None
    assert got == want and len(set(want.values())) > 2
    assert most_rows(df) <= 302
