"""Streamlines, height parts, growth, casters, colours."""

from pyspark.sql import functions as F

from skylattice.functions import colour
from skylattice.operators import kernels, lines, parts
from skylattice.sources.readers import synthetic_city


def test_streamlines_keep_apart_and_stop_at_walls(spark):
    cells = spark.range(40 * 60).select(F.lit("r").alias("run"), F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"), F.lit(0.0).alias("vr"), F.lit(1.0).alias("vc"))
    cells = cells.withColumn("open", ~((F.col("col") >= 40) & (F.col("row") < 20)))
    seeds = spark.createDataFrame([("r", 1, 10.0, 20.0), ("r", 2, 11.0, 25.0), ("r", 3, 30.0, 20.0), ("r", 4, 5.0, 50.0)], "run string, line_id long, r double, c double")
    found = lines.streamlines(cells, seeds)
    ends = {r["line_id"]: r["most"] for r in found.groupBy("line_id").agg(F.max("c").alias("most")).collect()}
    assert set(ends) == {1, 3} and ends[1] < 40 < 57 < ends[3]
    free = lines.longest_runs(found, ~F.col("vertex").isin(3, 4))
    assert free.groupBy("line_id").agg(F.min("vertex")).where("`min(vertex)` = 5").count() == 2
    assert lines.shuffled(found).select("order").distinct().count() == 2


def test_spread_out(spark):
    spots = spark.createDataFrame([("r", 0, 0, 9.0), ("r", 0, 1, 8.0), ("r", 0, 5, 7.0), ("r", 9, 9, 7.0)], "run string, row int, col int, score double")
    assert {(r["row"], r["col"]) for r in lines.spread_out(spots, k=2).collect()} == {(0, 0), (0, 5)}


def test_height_parts(spark):
    city = synthetic_city(spark, 40, 40, [(10, 10, 3, 20.0), (10, 14, 3, 30.0), (30, 30, 2, 21.0), (5, 35, 0, 50.0)])
    got = sorted((r["band"], r["cells"], r["height_m"]) for r in parts.height_parts(city, 2.0).collect())
    assert got == [(2, 25, 21.0), (2, 28, 20.0), (3, 49, 30.0)]


def test_growth_and_casters(spark):
    before = synthetic_city(spark, 20, 20, [(5, 5, 2, 40.0)])
    now = synthetic_city(spark, 20, 20, [(5, 5, 3, 40.0), (14, 14, 1, 60.0)])
    assert {(r["row"], r["col"]) for r in parts.really_grew(before, now, 2.0).collect()} == {(r, c) for r in (13, 14, 15) for c in (13, 14, 15)}
    ring = lambda x, y: [(x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10)]
    b = spark.createDataFrame([(1, 50.0, ring(0.0, 0.0)), (2, 50.0, ring(0.0, 200.0)), (3, 5.0, ring(0.0, 0.0))], "label int, height_m double, ring array<struct<x:double,y:double>>")
    assert [r["label"] for r in parts.casters(b, [(30.0, 180.0)], [(0.0, 60.0), (10.0, 60.0), (10.0, 80.0), (0.0, 80.0)]).collect()] == [1]
    assert parts.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_most_open(spark):
    lawn = spark.createDataFrame([(r, c, not (3 <= r <= 9 and 2 <= c <= 10)) for r in range(14) for c in range(14)], "row int, col int, shut boolean")
    d = kernels.distance_blocked(lawn, "shut", 8, size=5)
    assert tuple(parts.most_open(d, 6, 6, 10.0).first())[:2] == (6, 5)


def test_colours(spark):
    df = spark.createDataFrame([("#000000", "#ffffff"), ("#ff0000", "#0000ff")], "a string, b string")
    got = [tuple(r) for r in df.select(colour.between(F.col("a"), F.col("b"), F.lit(0.0)), colour.between(F.col("a"), F.col("b"), F.lit(1.0)), F.bround(colour.to_oklab(F.col("b"))[0], 3)).collect()]
    assert got == [("#000000", "#ffffff", 1.0), ("#ff0000", "#0000ff", 0.452)]
