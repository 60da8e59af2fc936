"""Scalar functions of the lattice engine as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_SURVEY_FOOT = 1200.0 / 3937.0
#: Edges of the thermal stress categories, degrees C.  Fixed values.
STRESS_EDGES = (-40.0, -27.0, -13.0, 0.0, 9.0, 26.0, 32.0, 38.0, 46.0)


def angle_difference(a: Column, b: Column) -> Column:
    """Signed a - b in [-180, 180)."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def circular_distance(a: Column, b: Column) -> Column:
    return F.abs(angle_difference(a, b))


def stress_category(felt: Column, edges: tuple[float, ...] = STRESS_EDGES) -> Column:
    """Number of edges at or below ``felt``."""
    total = F.lit(0)
    for e in edges:
        total = total + (felt >= e).cast("int")
    return total


def thermal_stress(felt: Column, low: float = 9.0, high: float = 26.0) -> Column:
    """Distance outside the comfortable range."""
    return F.greatest(low - felt, felt - high, F.lit(0.0))


def felt_wind(ratio: Column, station: Column) -> Column:
    """Local wind within the range of the felt-temperature model; no ratio means the station's."""
    return F.least(F.greatest(F.coalesce(ratio, F.lit(1.0)) * station, F.lit(0.5)), F.lit(17.0))


def percent_change(before: Column, after: Column) -> Column:
    """Change in per cent of what was, taken as 0.02 at least, within [-99, 399]."""
    return F.least(F.greatest(100.0 * (after / F.greatest(before, F.lit(0.02)) - 1.0), F.lit(-99.0)), F.lit(399.0))


def bin_of(value: Column, edges: list[float]) -> Column:
    """1-based bin in [lo, hi), the last closed; 0 outside and for null."""
    case = F.when(value.isNull() | F.isnan(value.cast("double")), 0)
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1):
        case = case.when((value >= lo) & ((value <= hi) if k == len(edges) - 1 else (value < hi)), k)
    return case.otherwise(0)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def first_number(props: Column, keys: list[str]) -> Column:
    """The first of several spellings of a field that is a number."""
    return F.coalesce(*[F.element_at(props, F.lit(k)).try_cast("double") for k in keys])


def tile_name(x: Column, y: Column, size: float = 2500.0) -> Column:
    part = lambda v, n: F.lpad(F.floor(F.floor(v / size) * size / 1000.0).cast("string"), n, "0")
    return F.concat(part(x, 3), part(y, 3))


def power_profile(z: Column, reference: Column, height: float = 10.0, alpha: float = 0.28) -> Column:
    return reference * F.pow(F.greatest(z, F.lit(0.0)) / height, F.lit(alpha))


def wall_drag(distance: Column, roughness: float, kappa: float = 0.41) -> Column:
    """Drag coefficient of the logarithmic law."""
    return F.pow(kappa / F.ln(1.0 + distance / roughness), F.lit(2.0))


def hours_minutes(minute: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), F.pmod(minute, F.lit(60)).cast("int"))


def run_name(scenario: Column, season: Column, direction: Column, res: Column) -> Column:
    return F.format_string("%s_%s_%05.1f_%gm", scenario, season, direction.cast("double"), res.cast("double"))


def cache_key(*parts: Column) -> Column:
    """16 hex digits naming the inputs of a gridding."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def ecef(lon: Column, lat: Column, height: Column) -> list[Column]:
    """Earth-centred coordinates on the WGS 84 ellipsoid."""
    major, flat = 6378137.0, 1 / 298.257223563
    e2 = flat * (2 - flat)
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = major / F.sqrt(1 - e2 * s * s)
    return [(n + height) * c * F.cos(F.radians(lon)), (n + height) * c * F.sin(F.radians(lon)), (n * (1 - e2) + height) * s]


def enu(lon: Column, lat: Column, height: Column, lon0: float, lat0: float, height0: float = 0.0) -> list[Column]:
    """East, north and up of a point, in metres from an origin."""
    d = [a - b for a, b in zip(ecef(lon, lat, height), ecef(F.lit(lon0), F.lit(lat0), F.lit(height0)), strict=True)]
    sl, cl, sp, cp = F.sin(F.radians(F.lit(lon0))), F.cos(F.radians(F.lit(lon0))), F.sin(F.radians(F.lit(lat0))), F.cos(F.radians(F.lit(lat0)))
    return [-sl * d[0] + cl * d[1], -sp * cl * d[0] - sp * sl * d[1] + cp * d[2], cp * cl * d[0] + cp * sl * d[1] + sp * d[2]]


def half_degrees(value: Column) -> Column:
    return F.bround(value * 2).cast("int")


def decimetres(value: Column) -> Column:
    return F.least(F.greatest(F.bround(value * 10), F.lit(-32767)), F.lit(32767)).cast("smallint")
