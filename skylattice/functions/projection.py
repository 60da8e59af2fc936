"""The conformal cone with two parallels as column expressions: places on the ellipsoid to map coordinates and back."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid

#: Half axis and flattening of the ellipsoid.  Fixed values.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
#: Rounds in which the latitude settles below 1e-15; each takes off a factor of 150 or better.
ROUNDS = 8


@dataclass(frozen=True)
class Cone:
    """Angles in degrees, false coordinates in metres, coordinates in units of ``unit_m`` metres."""

    south: float  # the parallels of true length
    north: float
    lat0: float
    lon0: float
    east0_m: float = 0.0
    north0_m: float = 0.0
    unit_m: float = 1.0
    axis: float = AXIS
    flattening: float = FLATTENING

    def __post_init__(self) -> None:
        if abs(self.south + self.north) < 1e-9:
            raise ValueError("parallels that mirror each other make a cylinder, no cone")

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def _narrow(self, lat: float) -> float:
        """Radius of a parallel over the axis."""
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - (self.e * s) ** 2)

    def _t(self, lat: float) -> float:
        s = self.e * math.sin(math.radians(lat))
        return math.tan(math.pi / 4 - math.radians(lat) / 2) * ((1 + s) / (1 - s)) ** (self.e / 2)

    @cached_property
    def n(self) -> float:
        """Sine of the cone's latitude."""
        if self.south == self.north:
            return math.sin(math.radians(self.south))
        return math.log(self._narrow(self.south) / self._narrow(self.north)) / math.log(self._t(self.south) / self._t(self.north))

    @cached_property
    def reach(self) -> float:
        """Metres from the apex where t is 1."""
        return self.axis * self._narrow(self.south) / (self.n * self._t(self.south) ** self.n)

    @cached_property
    def apex(self) -> float:
        """Metres from the apex to the origin's parallel."""
        return self.reach * self._t(self.lat0) ** self.n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(x, y) of places in degrees."""
        phi = F.radians(lat)
        s = self.e * F.sin(phi)
        t = F.tan(math.pi / 4 - phi / 2) * F.pow((1 + s) / (1 - s), F.lit(self.e / 2))
        far, turn = self.reach * F.pow(t, F.lit(self.n)), self.n * F.radians(lon - self.lon0)
        return (self.east0_m + far * F.sin(turn)) / self.unit_m, (self.north0_m + self.apex - far * F.cos(turn)) / self.unit_m

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lon, lat) in degrees of map coordinates; the latitude by a fixed number of rounds."""
        side = math.copysign(1.0, self.n)
        east, down = (x * self.unit_m - self.east0_m) * side, (self.apex + self.north0_m - y * self.unit_m) * side
        t = F.pow(side * F.sqrt(east * east + down * down) / self.reach, F.lit(1 / self.n))
        half = lambda q: math.pi / 2 - 2 * F.atan(q)
        better = lambda phi, _: half(t * F.pow((1 - self.e * F.sin(phi)) / (1 + self.e * F.sin(phi)), F.lit(self.e / 2)))
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), half(t), better)
        return F.degrees(F.atan2(east, down) / self.n) + self.lon0, F.degrees(phi)

    def convergence(self, lon: Column) -> Column:
        """Degrees from the grid's north to true north."""
        return self.n * (lon - self.lon0)

    def scale(self, lat: Column) -> Column:
        """Metres on the map for a metre on the ellipsoid."""
        phi = F.radians(lat)
        s = self.e * F.sin(phi)
        t = F.tan(math.pi / 4 - phi / 2) * F.pow((1 + s) / (1 - s), F.lit(self.e / 2))
        return self.reach * self.n * F.pow(t, F.lit(self.n)) * F.sqrt(1 - s * s) / (self.axis * F.cos(phi))


# New York, Long Island, in metres and in US survey feet.
LONG_ISLAND = Cone(south=40 + 40 / 60, north=41 + 2 / 60, lat0=40 + 10 / 60, lon0=-74.0, east0_m=300_000.0)
LONG_ISLAND_FEET = Cone(south=40 + 40 / 60, north=41 + 2 / 60, lat0=40 + 10 / 60, lon0=-74.0, east0_m=300_000.0, unit_m=1200 / 3937)


def corners_lonlat(spark: SparkSession, grid: Grid, cone: Cone, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(nth, lon, lat) of a window's corners (first row, end row, first column, end column; the frame's by default), around it."""
    r0, r1, c0, c1 = window or grid.frame or (0, grid.rows, 0, grid.cols)
    places = [(k, *grid.affine.place(float(r), float(c))) for k, (r, c) in enumerate([(r0, c0), (r0, c1), (r1, c1), (r1, c0)])]
    lon, lat = cone.inverse(F.col("x"), F.col("y"))
    return spark.createDataFrame(places, "nth int, x double, y double").select("nth", lon.alias("lon"), lat.alias("lat"))


def bounds_lonlat(corners: DataFrame, *keys: str, pad_deg: float = 0.0) -> DataFrame:
    """(west, south, east, north) of ``corners`` (lon, lat), by ``keys``."""
    return corners.groupBy(*keys).agg((F.min("lon") - pad_deg).alias("west"), (F.min("lat") - pad_deg).alias("south"), (F.max("lon") + pad_deg).alias("east"), (F.max("lat") + pad_deg).alias("north"))


def polygons_lonlat(corners: DataFrame, *keys: str) -> DataFrame:
    """(keys, polygon): closed rings as GeoJSON of ``corners`` (nth, lon, lat), six digits after the point."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("nth", "lon", "lat"))), lambda p: F.array(F.round(p["lon"], 6), F.round(p["lat"], 6)))
    rings = corners.groupBy(*keys).agg(ring.alias("ring"))
    return rings.select(*keys, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.concat("ring", F.slice("ring", 1, 1))).alias("coordinates"))).alias("polygon"))
