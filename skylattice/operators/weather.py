"""Weather of typical years: rows by hour, the clearest day, sun crossings, spin-up series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.solar import haurwitz, with_sun

SUNRISE = -0.833


def hour_ending_key(ts: Column) -> list[Column]:
    """(month, day, hour) of the row that ends at ``ts``: midnight is hour 24 of the day before."""
    midnight = F.hour(ts) == 0
    day = F.when(midnight, F.date_sub(F.to_date(ts), 1)).otherwise(F.to_date(ts))
    return [F.month(day).alias("month"), F.dayofmonth(day).alias("day"), F.when(midnight, 24).otherwise(F.hour(ts)).alias("hour")]


def weather_at(times: DataFrame, weather: DataFrame, ts: str = "ts") -> DataFrame:
    keyed = times.select("*", *hour_ending_key(F.col(ts)))
    return keyed.join(weather, ["month", "day", "hour"], "left")


def spin_up(days: DataFrame, hours: int = 48) -> DataFrame:
    """Hourly instants from midnight before each ``day``."""
    start = F.date_sub("day", 1).cast("timestamp_ntz")
    return days.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))).withColumn("ts", start + F.make_dt_interval(F.lit(0), F.col("k")))


def crossings(days: DataFrame, lat: float, lon: float, offset_h: float = -5.0, minutes: int = 1) -> DataFrame:
    """(day, sunrise, sunset) in minutes of the local day: first way up, last way down, on whole steps.

    ``days`` (day, unix_s of its local midnight, as if UTC).
    """
    steps = days.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(1440), F.lit(minutes))))
    sun = with_sun(steps, f"unix_s + minute * 60 - ({offset_h}) * 3600", lat, lon)
    before = F.lag("altitude").over(Window.partitionBy("day").orderBy("minute"))
    turned = sun.withColumn("before", before)
    up = (F.col("before") < SUNRISE) & (F.col("altitude") >= SUNRISE)
    down = (F.col("before") >= SUNRISE) & (F.col("altitude") < SUNRISE)
    return turned.groupBy("day").agg(F.min(F.when(up, F.col("minute"))).alias("sunrise"), F.max(F.when(down, F.col("minute"))).alias("sunset"))


def clearness(measured: DataFrame, lat: float, lon: float, offset_h: float = -5.0) -> DataFrame:
    """(day, measured, clear, ratio) of ``measured`` (day, unix_s, hour 1-24, ghi): measured and clear-sky energy, and their ratio to four digits."""
    sun = with_sun(measured, f"unix_s + (hour - 0.5) * 3600 - ({offset_h}) * 3600", lat, lon).withColumn("clear", haurwitz(F.col("altitude")))
    daily = sun.where("clear > 0").groupBy("day").agg(F.sum(F.coalesce("ghi", F.lit(0.0))).alias("measured"), F.sum("clear").alias("clear"))
    return daily.withColumn("ratio", F.bround(F.try_divide("measured", "clear"), 4))


def clearest_day(measured: DataFrame, lat: float, lon: float, offset_h: float = -5.0) -> DataFrame:
    """Ranked days of ``measured``, the clearest first; a day is one row, so the ranking is small."""
    return clearness(measured, lat, lon, offset_h).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ratio"), "day")))


def chosen_days(measured: DataFrame, targets: DataFrame, lat: float, lon: float, offset_h: float = -5.0, reach: int = 12, top: int = 6) -> DataFrame:
    """(target, day, offset, ratio, rank): of the days at most ``reach`` from each ``target`` the ``top`` clearest; the first is the chosen one.

    Equal ratios go to the earlier day.  Days without weather are no candidates.
    """
    near = targets.select("target", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")).withColumn("day", F.expr("date_add(target, offset)"))
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("ratio"), "offset"))
    return near.join(clearness(measured, lat, lon, offset_h).select("day", "ratio"), "day").withColumn("rank", place).where(F.col("rank") <= top)


def solver_records(weather: DataFrame) -> DataFrame:
    return weather.withColumn("ws", F.greatest("ws", F.lit(0.5))).withColumn("pressure_hpa", F.coalesce(F.col("pressure_pa") / 100.0, F.lit(1013.25)))
