"""The driver's tables read as points, cells, buildings, weather and runs; and the same readings in SQL.

``events`` is a point cloud: x is hours since 2024-01-01, y the user, z the
value, the class follows from the type.  Cells are users by six hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gridding import grid_points, with_heights

CELL_M = 20.0
COLS = 120
LAT, LON = 40.7645, -73.9790
CLASSES = {"view": 2, "purchase": 6, "click": 1, "signup": 5, "error": 7}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    cls = F.lit(0)
    for name, code in CLASSES.items():
        cls = F.when(F.col("event_type") == name, code).otherwise(cls)
    k = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, sf, "events").select((micros / 3.6e9).alias("hours"), F.col("user_id").cast("int").alias("row"), F.col("value").alias("z"), cls.alias("cls"), (k % 3 + 1).alias("nret"))
    return e.select("row", F.floor(F.col("hours") / 6).cast("int").alias("col"), "z", "cls", "nret", "hours")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Gridded points with the layers made from them and masks that follow from the place."""
    c = with_heights(grid_points(points(spark, sf)))
    r, q = F.col("row"), F.col("col")
    label = F.when((r + q) % 3 == 0, 0).otherwise(1 + (F.floor(r / 5) * 20 + F.floor(q / 6)) % 100).cast("int")
    return c.select(
        "*",
        label.alias("label"),
        ((r * 31 + q * 17) % 11 == 0).alias("nodata"),
        ((r % 13 == 5) & (q % 7 < 2)).alias("water"),
        (F.floor(q / 30) % 2 == 0).alias("park"),
        ((r < 2) | (q < 2)).alias("blank"),
    )


def buildings(spark: SparkSession, sf: str) -> DataFrame:
    s, k = F.col("s_acctbal"), F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        (k + 1).cast("int").alias("label"), F.when(s > 0, s / 25).alias("height_m"), F.when(k % 7 != 0, 1990 + k % 35).cast("int").alias("year"), k.alias("file_order"), (k % 37 * 50.0).alias("distance"), (k % 11 == 0).alias("in_frame")
    )


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two runs: sums by cell of the first and the second half of each six hours, capped like hours of sun."""
    p = points(spark, sf).withColumn("half", F.when(F.pmod("hours", F.lit(6.0)) < 3, 1).otherwise(2))
    by = p.groupBy("row", "col", "half").agg(F.least(F.lit(12.0), F.max("z") / 40).alias("v"))
    one = lambda h: by.where(F.col("half") == h).select("row", "col", F.floor(F.col("col") / 30).cast("int").alias("zone"), "v")
    return one(1), one(2)


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """(zone, row, col, hour, du): hourly differences, one a cell and hour of the day."""
    p = points(spark, sf).withColumn("hour", F.floor(F.pmod("hours", F.lit(24.0)) / 3).cast("int"))
    return p.groupBy("row", "col", "hour").agg((F.min("z") / 40 - 7).alias("du"), (F.max("z") / 20 - 9).alias("felt")).withColumn("zone", F.floor(F.col("col") / 30).cast("int"))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """(day, hour 1-24, ghi, ws, wd): hourly rows that end at the hour."""
    p = points(spark, sf)
    n = F.floor("hours").cast("long")
    w = p.groupBy(F.floor(n / 24).cast("int").alias("d"), (n % 24 + 1).cast("int").alias("hour"))
    w = w.agg((F.avg("z") * 3).alias("ghi"), (F.max("z") / 60).alias("ws"), (F.sum("nret") * 7 % 360).cast("double").alias("wd"))
    return w.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("day"), (1704067200 + F.col("d") * 86400).cast("double").alias("unix_s"), "hour", "ghi", "ws", "wd")


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8 x 8 tiles side by side, one row of tiles a label."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", "label", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), "v")


_HOURS = "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000.0)"
_CLS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CLASSES.items()) + " ELSE 0 END"

#: Common table expressions, to be put before a query.
PTS = f"pts AS (SELECT user_id::INT AS \"row\", floor({_HOURS} / 6)::INT AS col, value AS z, {_CLS} AS cls, (json_extract_string(props, '$.k')::INT % 3) + 1 AS nret, {_HOURS} AS hours FROM events)"
GRID = """grid AS (SELECT "row", col, max(z::FLOAT) AS surface, min(z::FLOAT) AS lowest, min(z::FLOAT) FILTER (cls = 2) AS bare,
  max(z::FLOAT) FILTER (cls = 6) AS roof, count(*) AS returns, count(*) FILTER (nret <= 1) AS singles FROM pts WHERE cls NOT IN (7, 18) GROUP BY ALL)"""
CELLS = """cells AS (SELECT *, surface - ground AS heights, CASE WHEN ("row" + col) % 3 = 0 THEN 0 ELSE 1 + (("row" // 5) * 20 + col // 6) % 100 END AS label,
  ("row" * 31 + col * 17) % 11 = 0 AS nodata, ("row" % 13 = 5 AND col % 7 < 2) AS water, (col // 30) % 2 = 0 AS park, ("row" < 2 OR col < 2) AS blank
  FROM (SELECT *, least(coalesce(bare, lowest), surface) AS ground FROM grid))"""
BUILDINGS = """buildings AS (SELECT (s_suppkey + 1)::INT AS label, CASE WHEN s_acctbal > 0 THEN s_acctbal / 25 END AS height_m, CASE WHEN s_suppkey % 7 <> 0 THEN 1990 + s_suppkey % 35 END AS year,
  s_suppkey AS file_order, s_suppkey % 37 * 50.0 AS distance, s_suppkey % 11 = 0 AS in_frame FROM supplier)"""
LABELS = """labels_ AS (SELECT label, count(*) AS n, median(heights::DOUBLE) AS median, list_sort(list(heights))[floor(0.99 * (count(*) - 1))::INT + 1] AS quantile, avg(nodata::INT) AS fraction FROM cells WHERE label > 0 GROUP BY label)"""
HALVES = """halves AS (SELECT "row", col, CASE WHEN hours - 6 * floor(hours / 6) < 3 THEN 1 ELSE 2 END AS half, least(12.0, max(z) / 40) AS v FROM pts GROUP BY ALL),
 pairs AS (SELECT a."row", a.col, a.col // 30 AS zone, a.v AS before, b.v AS after FROM halves a JOIN halves b ON a."row" = b."row" AND a.col = b.col AND a.half = 1 AND b.half = 2)"""
CHANGES = """changes AS (SELECT "row", col, floor((hours - 24 * floor(hours / 24)) / 3)::INT AS hour, min(z) / 40 - 7 AS du, max(z) / 20 - 9 AS felt, (col // 30) AS zone FROM pts GROUP BY ALL)"""
WEATHER = """weather AS (SELECT DATE '2024-01-01' + floor(floor(hours) / 24)::INT AS day, 1704067200.0 + floor(floor(hours) / 24) * 86400 AS unix_s, (floor(hours)::INT % 24) + 1 AS hour,
  avg(z) * 3 AS ghi, max(z) / 60 AS ws, (sum(nret) * 7 % 360)::DOUBLE AS wd FROM pts GROUP BY ALL)"""
TILES = """tiles AS (SELECT vec_id, label, ((i - 1) // 8)::INT AS "row", ((i - 1) % 8)::INT AS col, v FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def sql(query: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)} {query}" if parts else query


def sun_table(source: str, unix_s: str) -> str:
    """``source`` with altitude, azimuth and declination in SQL of its own: Meeus' low-accuracy sun in degrees, by arcsine and arctangent."""
    t = f"(({unix_s}) / 86400.0::DOUBLE - 10957.5) / 36525.0"
    mean = "280.46646 + 36000.76983 * t + 0.0003032 * t * t AS l0, 357.52911 + 35999.05029 * t - 0.0001537 * t * t AS m, 125.04 - 1934.136 * t AS om, 0.016708634 - 0.000042037 * t - 0.0000001267 * t * t AS ec"
    true = "l0 + (1.914602 - 0.004817 * t - 0.000014 * t * t) * sin(radians(m)) + (0.019993 - 0.000101 * t) * sin(radians(2 * m)) + 0.000289 * sin(radians(3 * m)) - 0.00569 - 0.00478 * sin(radians(om)) AS lambda_"
    axis = "(84381.448 - 46.815 * t - 0.00059 * t * t + 0.001813 * t * t * t) / 3600.0 + 0.00256 * cos(radians(om)) AS ep"
    eot = "degrees(y * sin(radians(2 * l0)) - 2 * ec * sin(radians(m)) + 4 * ec * y * sin(radians(m)) * cos(radians(2 * l0)) - y * y / 2 * sin(radians(4 * l0)) - 1.25 * ec * ec * sin(radians(2 * m)))"
    turn = f"(({unix_s}) - 86400.0 * floor(({unix_s}) / 86400.0)) / 240.0 + {eot} + ({LON}) - 180.0 AS ha"
    one = f"(SELECT *, {t} AS t FROM {source})"
    two = f"(SELECT *, {mean} FROM {one})"
    three = f"(SELECT *, {true}, {axis} FROM {two})"
    four = f"(SELECT *, degrees(asin(sin(radians(ep)) * sin(radians(lambda_)))) AS declination, pow(tan(radians(ep / 2)), 2) AS y FROM {three})"
    five = f"(SELECT *, {turn} FROM {four})"
    up = f"degrees(asin(sin(radians({LAT})) * sin(radians(declination)) + cos(radians({LAT})) * cos(radians(declination)) * cos(radians(ha))))"
    way = f"180.0 + degrees(atan2(sin(radians(ha)), cos(radians(ha)) * sin(radians({LAT})) - tan(radians(declination)) * cos(radians({LAT}))))"
    return f"(SELECT * EXCLUDE (t, l0, m, om, ec, lambda_, ep, y, ha), {up} AS altitude, ({way}) - 360.0 * floor(({way}) / 360.0) AS azimuth FROM {five})"
