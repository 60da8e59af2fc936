"""Sun position and clear-sky irradiance as Spark columns.

The formulas are NOAA's solar calculator, the air mass of Kasten and Young, the
attenuation of Meinel and Meinel, and Haurwitz.  Each is a chain of named SQL
expressions, which Catalyst folds into one stage.  Angles are degrees, instants
are seconds since 1970 in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap(x: str, period: str = "360.0") -> str:
    """``x`` in [0, period), also for negative x."""
    return f"(({x}) - {period} * floor(({x}) / {period}))"


def sun_steps(unix_s: str, lat: float, lon: float) -> list[tuple[str, str]]:
    """(name, expression) steps ending with altitude, azimuth and declination."""
    unix_s = f"CAST({unix_s} AS DOUBLE)"
    day_minutes = wrap(f"({unix_s}) / 60.0", "1440.0")
    return [
        ("jc", f"(({unix_s}) / 86400.0 + 2440587.5 - 2451545.0) / 36525.0"),
        ("mean_long", wrap("280.46646 + jc * (36000.76983 + jc * 0.0003032)")),
        ("anomaly", "radians(357.52911 + jc * (35999.05029 - 0.0001537 * jc))"),
        ("node", "radians(125.04 - 1934.136 * jc)"),
        ("centre", "sin(anomaly) * (1.914602 - jc * (0.004817 + 0.000014 * jc)) + sin(2 * anomaly) * (0.019993 - 0.000101 * jc) + sin(3 * anomaly) * 0.000289"),
        ("app_long", "radians(mean_long + centre - 0.00569 - 0.00478 * sin(node))"),
        ("tilt", "radians(23.0 + (26.0 + (21.448 - jc * (46.815 + jc * (0.00059 - jc * 0.001813))) / 60.0) / 60.0 + 0.00256 * cos(node))"),
        ("decl", "asin(sin(tilt) * sin(app_long))"),
        ("tilt2", "tan(tilt / 2) * tan(tilt / 2)"),
        ("ecc", "0.016708634 - jc * (0.000042037 + 0.0000001267 * jc)"),
        ("long2", "2 * radians(mean_long)"),
        ("eq_time", "4 * degrees(tilt2 * sin(long2) - 2 * ecc * sin(anomaly) + 4 * ecc * tilt2 * sin(anomaly) * cos(long2) - 0.5 * tilt2 * tilt2 * sin(2 * long2) - 1.25 * ecc * ecc * sin(2 * anomaly))"),
        ("hour_angle", wrap(f"{day_minutes} + eq_time + 4.0 * ({lon})", "1440.0") + " / 4.0 - 180.0"),
        ("cz", f"greatest(-1.0, least(1.0, sin(radians({lat})) * sin(decl) + cos(radians({lat})) * cos(decl) * cos(radians(hour_angle))))"),
        ("altitude", "90.0 - degrees(acos(cz))"),
        ("sz", "sin(acos(cz))"),
        ("south", f"CASE WHEN abs(sz) < 1e-9 THEN 0.0 ELSE degrees(acos(greatest(-1.0, least(1.0, (sin(radians({lat})) * cz - sin(decl)) / (cos(radians({lat})) * CASE WHEN abs(sz) < 1e-9 THEN 1.0 ELSE sz END))))) END"),
        ("azimuth", f"CASE WHEN abs(sz) < 1e-9 THEN 180.0 WHEN hour_angle > 0 THEN {wrap('south + 180.0')} ELSE {wrap('540.0 - south')} END"),
        ("declination", "degrees(decl)"),
    ]


def with_sun(df: DataFrame, unix_s: str, lat: float, lon: float) -> DataFrame:
    """``df`` with altitude, azimuth and declination of the sun at the instant ``unix_s``."""
    out = df
    for name, step in sun_steps(unix_s, lat, lon):
        out = out.withColumn(name, F.expr(step))
    # A generator of one row: filters on the result stay above it, so no step is computed twice.
    return out.select(*df.columns, F.inline(F.array(F.struct("altitude", "azimuth", "declination"))))


def clear_sky_dni(altitude: Column) -> Column:
    """Direct normal irradiance, W/m2; 0 up to half a degree."""
    a = F.greatest(altitude, F.lit(0.5))
    mass = F.least(F.lit(38.0), 1.0 / (F.sin(F.radians(a)) + 0.50572 * F.pow(a + 6.07995, F.lit(-1.6364))))
    return F.when(altitude <= 0.5, 0.0).otherwise(1367.0 * F.pow(F.lit(0.7), F.pow(mass, F.lit(0.678))))


def haurwitz(altitude: Column) -> Column:
    """Clear-sky global horizontal irradiance, W/m2; 0 with the sun down."""
    cz = F.sin(F.radians(altitude))
    return F.when(cz > 0, 1098.0 * cz * F.exp(F.lit(-0.057) / F.when(cz > 0, cz))).otherwise(0.0)


def sun_vector(altitude: Column, azimuth: Column) -> Column:
    """Unit vector to the sun: east, north, up."""
    a, z = F.radians(altitude), F.radians(azimuth)
    return F.struct((F.cos(a) * F.sin(z)).alias("east"), (F.cos(a) * F.cos(z)).alias("north"), F.sin(a).alias("up"))


def incidence_gain(dni: Column, normal_east: Column, normal_north: Column, sun: Column) -> Column:
    """Beam on a wall whose normal is horizontal."""
    return dni * F.greatest(F.lit(0.0), normal_east * sun["east"] + normal_north * sun["north"])


def to_grid_azimuth(azimuth: Column, bearing: float) -> Column:
    return F.pmod(azimuth - bearing, F.lit(360.0))


def frames(df: DataFrame, start: str, end: str, minutes: int = 30) -> DataFrame:
    """``df`` with a row for each whole ``minutes`` step from ``start`` to ``end`` (minute columns of a day)."""
    first = F.ceil(F.col(start) / minutes).cast("int") * minutes
    return df.withColumn("minute", F.explode(F.when(first <= F.col(end), F.sequence(first, F.col(end).cast("int"), F.lit(minutes)))))


def canonical_day(month: Column, day: Column) -> Column:
    """A month and day in the winter from 2026 to 2027."""
    return F.make_date(F.when(month == 1, 2027).otherwise(2026), month, day)


def local_day(days: DataFrame, lat: float, lon: float, offset_h: float = -5.0) -> DataFrame:
    """Sun positions at the whole hours of each local ``day`` (a date), while the sun is up: (day, hour, altitude, azimuth)."""
    hours = days.select("day").withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return with_sun(hours, f"unix_date(day) * 86400.0D + (hour - ({offset_h})) * 3600.0D", lat, lon).where("altitude > 0").select("day", "hour", "altitude", "azimuth")
