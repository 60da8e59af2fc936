"""Nearest values against brute force, over voids wider than any block."""

import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import nearest


def brute(asked, known):
    return {p: min(((p[0] - r) ** 2 + (p[1] - c) ** 2, r, c, v) for (r, c), v in known.items()) for p in asked}


def check(spark, asked, known, size):
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in known.items()], "row int, col int, z double")
    got = nearest.nearest_cells(spark.createDataFrame(asked, "row int, col int"), cells, "z", size).collect()
    assert {(r["row"], r["col"]): (r["d2"], r["near_row"], r["near_col"], r["value"]) for r in got} == brute(set(asked), known)
    assert len(got) == len(set(asked))


@pytest.mark.parametrize("size", [4, 16, 64])
def test_a_wide_void(spark, size):
    """A square ring of values around a void of 90 cells; ties everywhere."""
    known = {(r, c): float(r * 1000 + c) for r in range(-50, 50) for c in range(-50, 50) if max(abs(r + 0.5), abs(c + 0.5)) > 45}
    asked = [(r, c) for r in range(-45, 45, 3) for c in range(-45, 45, 4)] + [(0, 0), (0, 0), (-50, -50)]
    check(spark, asked, known, size)


@pytest.mark.parametrize("size", [4, 32])
def test_scattered_and_far(spark, size):
    rnd = random.Random(4)
    known = {(rnd.randrange(300), rnd.randrange(300)): rnd.random() for _ in range(60)} | {(5000, -3000): 1.0}
    asked = [(rnd.randrange(-400, 700), rnd.randrange(-400, 700)) for _ in range(300)] + [(4000, -2900), (100_000, 100_000)]
    check(spark, asked, known, size)


def test_one_value_none_and_nulls(spark):
    check(spark, [(0, 0), (9, 9)], {(3, 3): 2.0}, 8)
    none = spark.createDataFrame([(1, 1, None)], "row int, col int, z double")
    assert nearest.nearest_cells(none, none, "z").collect() == []
    assert nearest.nearest_cells(none.limit(0), none.withColumn("z", F.lit(1.0)), "z").collect() == []
    assert [tuple(r) for r in nearest.filled(none, "z").collect()] == [(1, 1, None, None)]


def test_filled_keeps_what_there_is(spark):
    rnd = random.Random(6)
    rows = [(r, c, round(rnd.random(), 3) if rnd.random() < 0.2 else None, "k") for r in range(40) for c in range(30)]
    df = spark.createDataFrame(rows, "row int, col int, z float, k string")
    got = {(r["row"], r["col"]): r for r in nearest.filled(df, "z", 8).collect()}
    known = {(r["row"], r["col"]): r["z"] for r in df.collect() if r["z"] is not None}
    for p, (d2, _, _, v) in brute([(r, c) for r, c, _, _ in rows], known).items():
        assert got[p]["z"] == v and got[p]["distance"] == pytest.approx(d2**0.5) and got[p]["k"] == "k"
