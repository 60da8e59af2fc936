"""Comparing runs: before and after on the same frame, tables of numbers, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import with_percentiles


def paired(before: DataFrame, after: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Both runs of the cells that both have: one equi-join on the cell."""
    return before.select(*keys, F.col(value).alias("before")).join(after.select(*keys, F.col(value).alias("after")), keys)


def before_after(pairs: DataFrame, zone: str, cell_ha: float, never: float = 0.25, lost: float = 1.0) -> DataFrame:
    b, a = F.col("before"), F.col("after")
    return pairs.groupBy(zone).agg(
        F.count("*").alias("cells"),
        F.avg((b < never).cast("int")).alias("never_before"),
        F.avg((a < never).cast("int")).alias("never_after"),
        F.count_if((a < never) & (b >= never)).alias("newly_dark"),
        (F.count_if(b - a >= lost) * cell_ha).alias("lost_ha"),
        F.avg(a - b).alias("mean_change"),
    )


def any_hour(changes: DataFrame, thresholds: tuple[int, ...], zone: str) -> DataFrame:
    """Per zone and threshold: cells that reach it at any hour, and cell-hours.  ``changes`` has row, col, hour, du."""
    cells = changes.groupBy(zone, "row", "col").agg(F.min("du").alias("worst"), *[F.count_if(F.col("du") <= t).alias(f"h{-t}") for t in thresholds])
    totals = [x for t in thresholds for x in (F.count_if(F.col("worst") <= t).alias(f"any_{-t}"), F.sum(f"h{-t}").alias(f"hours_{-t}"))]
    return cells.groupBy(zone).agg(*totals)


def worst_hour(changes: DataFrame, threshold: float, zone: str) -> DataFrame:
    counts = changes.groupBy(zone, "hour").agg(F.count_if(F.col("du") <= threshold).alias("cells"))
    return counts.groupBy(zone).agg(F.max_by("hour", F.struct(F.col("cells"), -F.col("hour"))).alias("hour"), F.max("cells").alias("most"))


def moved_percentiles(changes: DataFrame, zone: str, least: float = 0.1) -> DataFrame:
    moved = changes.where(F.abs("du") >= least)
    return with_percentiles(moved.groupBy(zone).agg(F.count("*").alias("moved")), moved, {f"p{p:02d}": ("du", p / 100) for p in (1, 5, 50, 95, 99)}, zone)


def numbers_table(wide: DataFrame, scope: str, keys: list[str], internal: list[str], validated: Column) -> DataFrame:
    """Long (scope, key, value, status): values to 4 digits; not publishable until validated, and some never."""
    long = wide.select(F.col(scope).cast("string").alias("scope"), *[F.col(k).cast("double").alias(k) for k in keys]).unpivot("scope", keys, "key", "value")
    status = F.when(F.col("key").isin(internal) | ~validated, "internal").otherwise("publishable")
    return long.select("scope", "key", F.bround("value", 4).alias("value"), status.alias("status"))


def published(numbers: DataFrame, key: str) -> DataFrame:
    """The rows of a key; asking for one that may not be published fails the job."""
    ok = F.when(F.col("status") == "publishable", F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not publishable: "), "key")))
    return numbers.where(F.col("key") == key).withColumn("value", ok)


def attribution(components: DataFrame, changes: DataFrame, newly: DataFrame, thresholds: tuple[int, ...] = (-2, -5)) -> DataFrame:
    """Per changed component: cells it newly shades that grew colder, at any hour and in cell-hours.

    ``newly`` has (component, hour, row, col); shade of two components credits both.
    """
    hit = newly.join(changes, ["hour", "row", "col"])
    cells = hit.groupBy("component", "row", "col").agg(*[F.count_if(F.col("du") <= t).alias(f"h{-t}") for t in thresholds])
    got = cells.groupBy("component").agg(*[x for t in thresholds for x in (F.count_if(F.col(f"h{-t}") > 0).alias(f"any_{-t}"), F.sum(f"h{-t}").alias(f"hours_{-t}"))])
    none = {c: 0 for c in got.columns if c != "component"}
    return components.select("component").distinct().join(got, "component", "left").fillna(none)


def unexplained(changed: DataFrame, explained: DataFrame, keys: list[str]) -> DataFrame:
    return changed.join(explained, keys, "left_anti")


def north_most(df: DataFrame, keys: list[str], order: Column, k: int) -> DataFrame:
    """The first ``k`` rows of each key in an order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_rank") <= k).drop("_rank")
