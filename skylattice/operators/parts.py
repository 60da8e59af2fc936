"""Buildings from heights, what grew, and what can shade a target."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .focal import connected, dilated_max


def height_parts(cells: DataFrame, cell_m: float, band_m: float = 8.0, least_m2: float = 60.0, least_m: float = 4.0, most: int = 2500) -> DataFrame:
    """Connected parts within bands of height: (band, component, cells, height_m), the largest first, at most ``most``.

    Bands are kept apart by spacing them out in the lattice, so one pass finds the parts of all.
    """
    gap = 1 << 14
    banded = cells.where(F.col("heights") >= least_m).select((F.col("row") + F.floor(F.col("heights") / band_m).cast("int") * gap).alias("row"), "col", "heights")
    parts = connected(banded.select("row", "col"), width=1 << 14).join(banded, ["row", "col"])
    sized = parts.groupBy("component").agg(F.count("*").alias("cells"), F.median(F.col("heights").cast("double")).alias("height_m"), F.floor(F.min("row") / gap).cast("int").alias("band"))
    return sized.where(F.col("cells") * cell_m * cell_m >= least_m2).orderBy(F.desc("cells"), "component").limit(most)


def really_grew(before: DataFrame, now: DataFrame, cell_m: float, margin: float = 15.0, around_m: float = 10.0) -> DataFrame:
    """Cells that stand more than ``margin`` above all that stood within ``around_m`` before."""
    reach = dilated_max(before.select("row", "col", "surface"), "surface", max(1, int(around_m / cell_m)))
    return now.select("row", "col", F.col("surface").alias("top")).join(reach, ["row", "col"]).where(F.col("top") - F.col("neighbourhood_max") > margin).select("row", "col", (F.col("top") - F.col("neighbourhood_max")).alias("rise"))


def may_reach(height: Column, distance: Column, least_altitude: Column, rise: Column) -> Column:
    """Whether a change is worth a shadow test: high enough, and its longest shadow reaches ``distance`` (all in metres)."""
    return (rise >= 3.0) & (height / F.tan(F.radians(least_altitude)) >= distance)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counterclockwise, by sorted chains."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def chain(q: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    return chain(p) + chain(p[::-1])


def touch(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> bool:
    """Whether convex polygons meet: no edge's normal keeps them apart."""
    for shape in (a, b):
        for (x0, y0), (x1, y1) in zip(shape, shape[1:] + shape[:1], strict=True):
            nx, ny = y1 - y0, x0 - x1
            sa, sb = ([nx * x + ny * y for x, y in s] for s in (a, b))
            if max(sa) < min(sb) or max(sb) < min(sa):
                return False
    return True


def casters(buildings: DataFrame, suns: list[tuple[float, float]], target: list[tuple[float, float]], stretch: float = 1.1) -> DataFrame:
    """Buildings (label, height_m, ring of (x, y)) whose swept shadow meets the convex ``target`` for some sun (altitude, azimuth)."""
    reach = hull(target)

    def shades(ring: list, height: float) -> bool:
        base = [(p["x"], p["y"]) for p in ring]
        for altitude, azimuth in suns:
            if altitude <= 0 or not height:
                continue
            far = stretch * height / math.tan(math.radians(altitude))
            dx, dy = -far * math.sin(math.radians(azimuth)), -far * math.cos(math.radians(azimuth))
            if touch(hull(base + [(x + dx, y + dy) for x, y in base]), reach):
                return True
        return False

    @F.pandas_udf("boolean")
    def reaches(ring: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([shades(r, h) for r, h in zip(ring, height, strict=True)])

    return buildings.where(reaches("ring", "height_m"))


def most_open(distances: DataFrame, row: int, col: int, reach: float) -> DataFrame:
    """The cell farthest from what is not open, within ``reach`` cells; the first in scan order of equal ones."""
    near = F.hypot(F.col("row") - row, F.col("col") - col) <= reach
    best = F.struct(F.col("distance"), -F.col("row"), -F.col("col"))
    return distances.where(near & F.col("distance").isNotNull()).agg(F.max_by(F.struct("row", "col", "distance"), best).alias("x")).select("x.*")
