"""Queries on places on the ellipsoid and on the map; their SQL goes by the isometric latitude instead."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.projection import LONG_ISLAND, LONG_ISLAND_FEET, ROUNDS, bounds_lonlat, polygons_lonlat
from .stand_ins import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BEARING = 29.0


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return keep


def _iso(lat: str) -> str:
    return f"(asinh(tan(radians({lat}))) - e * atanh(e * sin(radians({lat}))))"


def _parallel(lat: str) -> str:
    return f"(cos(radians({lat})) / sqrt(1 - pow(e * sin(radians({lat})), 2)))"


_S, _N, _O = "(40 + 40 / 60.0::DOUBLE)", "(41 + 2 / 60.0::DOUBLE)", "(40 + 10 / 60.0::DOUBLE)"
#: One row of the cone's numbers.
_CONE = f"""cone AS (SELECT *, 6378137.0::DOUBLE * {_parallel(_S)} * exp(n * {_iso(_S)}) / n AS big, 6378137.0::DOUBLE * {_parallel(_S)} * exp(n * ({_iso(_S)} - {_iso(_O)})) / n AS apex
  FROM (SELECT *, ln({_parallel(_S)} / {_parallel(_N)}) / ({_iso(_N)} - {_iso(_S)}) AS n FROM (SELECT sqrt((2 - 1 / 298.257222101::DOUBLE) / 298.257222101::DOUBLE) AS e)))"""


def _to_map(source: str) -> str:
    return f"(SELECT *, 300000.0::DOUBLE + big * exp(-n * {_iso('lat')}) * sin(n * radians(lon + 74)) AS x, apex - big * exp(-n * {_iso('lat')}) * cos(n * radians(lon + 74)) AS y FROM {source}, cone)"


def _to_place(source: str) -> str:
    phi = "asin(tanh(psi))"
    for _ in range(ROUNDS):
        phi = f"asin(tanh(psi + e * atanh(e * sin({phi}))))"
    far = "sqrt(pow(x - 300000.0, 2) + pow(apex - y, 2))"
    return f"(SELECT *, degrees(atan2(x - 300000.0, apex - y) / n) - 74 AS lon2, degrees({phi}) AS lat2 FROM (SELECT *, -ln({far} / big) / n AS psi FROM {source}))"


_PLACES = "places AS (SELECT c_custkey AS id, -74.3 + (c_custkey * 61 % 9973) * 0.00006::DOUBLE AS lon, 40.4 + (c_custkey * 37 % 9967) * 0.00006::DOUBLE AS lat FROM customer)"


@query(f"WITH {_PLACES}, {_CONE} SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(x / (1200 / 3937.0::DOUBLE), 3) AS x_ft, round(n * (lon + 74), 9) AS convergence, round(lon2, 8) AS lon, round(lat2, 8) AS lat, true AS returns FROM {_to_place(_to_map('places'))}")
def projected_places(spark, sf):
    """Places to the map in metres and feet and back; ``returns`` says that the way back ends within a micrometre."""
    k = F.col("c_custkey")
    places = read(spark, sf, "customer").select(k.alias("id"), (F.lit(-74.3) + k * 61 % 9973 * 0.00006).alias("lon"), (F.lit(40.4) + k * 37 % 9967 * 0.00006).alias("lat"))
    x, y = LONG_ISLAND.forward(F.col("lon"), F.col("lat"))
    mapped = places.withColumn("x", x).withColumn("y", y)
    lon, lat = LONG_ISLAND.inverse(F.col("x"), F.col("y"))
    back = mapped.withColumn("lon2", lon).withColumn("lat2", lat)
    off = F.greatest(F.abs(F.col("lon2") - F.col("lon")), F.abs(F.col("lat2") - F.col("lat")))
    feet = LONG_ISLAND_FEET.forward(F.col("lon"), F.col("lat"))[0]
    return back.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(feet, 3).alias("x_ft"), F.round(LONG_ISLAND.convergence(F.col("lon")), 9).alias("convergence"), F.round("lon2", 8).alias("lon"), F.round("lat2", 8).alias("lat"), (off < 9e-12).alias("returns"))


_C, _SN = math.cos(math.radians(BEARING)), math.sin(math.radians(BEARING))
_WINDOWS = f"""corners AS (SELECT id, nth, 298000 + id % 89 * 40.0::DOUBLE + (c * w * {_C!r} - r * h * {_SN!r}) AS x, 64000 + id % 97 * 40.0::DOUBLE - (c * w * {_SN!r} + r * h * {_C!r}) AS y
  FROM (SELECT s_suppkey AS id, 50.0::DOUBLE + s_suppkey % 13 * 10 AS w, 30.0::DOUBLE + s_suppkey % 7 * 10 AS h FROM supplier), (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) k(nth, r, c))"""


def _windows(spark, sf):
    """Corners of turned windows, one a supplier, in metres, with longitude and latitude."""
    k = F.col("s_suppkey")
    nth = F.explode(F.array(*[F.struct(F.lit(n).alias("nth"), F.lit(float(r)).alias("r"), F.lit(float(c)).alias("c")) for n, (r, c) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0)])]))
    w = read(spark, sf, "supplier").select(k.alias("id"), (50.0 + k % 13 * 10).alias("w"), (30.0 + k % 7 * 10).alias("h"), nth.alias("k"))
    east, south = F.col("k.c") * F.col("w"), F.col("k.r") * F.col("h")
    x = 298000 + F.col("id") % 89 * 40.0 + (east * _C - south * _SN)
    y = 64000 + F.col("id") % 97 * 40.0 - (east * _SN + south * _C)
    lon, lat = LONG_ISLAND.inverse(F.col("x"), F.col("y"))
    return w.select("id", "k.nth", x.alias("x"), y.alias("y")).select("id", "nth", lon.alias("lon"), lat.alias("lat"))


@query(f"WITH {_WINDOWS}, {_CONE} SELECT id, round(min(lon2) - 0.001, 8) AS west, round(min(lat2) - 0.001, 8) AS south, round(max(lon2) + 0.001, 8) AS east, round(max(lat2) + 0.001, 8) AS north FROM {_to_place('(SELECT * FROM corners, cone)')} GROUP BY id")
def window_bounds_lonlat(spark, sf):
    found = bounds_lonlat(_windows(spark, sf), "id", pad_deg=0.001)
    return found.select("id", *[F.round(c, 8).alias(c) for c in ("west", "south", "east", "north")])


@query(f"""WITH {_WINDOWS}, {_CONE}, p AS (SELECT id, nth, round(lon2, 6) AS lon, round(lat2, 6) AS lat FROM {_to_place('(SELECT * FROM corners, cone)')}),
 r AS (SELECT * FROM p UNION ALL SELECT id, 4, lon, lat FROM p WHERE nth = 0)
SELECT id, nth::INT AS nth, lon, lat FROM r""")
def window_polygons_lonlat(spark, sf):
    """Rings of the windows as GeoJSON, read back point by point."""
    rings = polygons_lonlat(_windows(spark, sf), "id")
    ring = F.from_json("polygon", "type string, coordinates array<array<array<double>>>")["coordinates"][0]
    return rings.select("id", F.posexplode(ring).alias("nth", "p")).select("id", "nth", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
