"""Rotated grids: the frozen description and its column expressions.

"Up" on a grid has a compass bearing; rows grow down, columns grow right.  The
*frame* is the part that gets answers, the *domain* also holds a buffer that
only casts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Affine:
    """x = ox + xr r + xc c, y = oy + yr r + yc c, and back."""

    ox: float
    oy: float
    xr: float
    xc: float
    yr: float
    yc: float

    @classmethod
    def turned(cls, ox: float, oy: float, size: float, degrees: float) -> Affine:
        """Square cells whose upward axis has the given bearing: the north-up axes, (0, -1) and (1, 0), turned clockwise."""
        s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
        clockwise = lambda x, y: (size * (x * c + y * s), size * (y * c - x * s))
        (xr, yr), (xc, yc) = clockwise(0.0, -1.0), clockwise(1.0, 0.0)
        return cls(ox, oy, xr, xc, yr, yc)

    def place(self, r, c):
        """Map coordinates of lattice coordinates, numbers or columns."""
        return self.ox + (r * self.xr + c * self.xc), self.oy + (r * self.yr + c * self.yc)

    def inverse(self) -> Affine:
        """The map from (x, y) to (r, c), by Cramer's rule."""
        det = self.xr * self.yc - self.xc * self.yr
        rx, ry, cx, cy = self.yc / det, -self.xc / det, -self.yr / det, self.xr / det
        return Affine(-(rx * self.ox + ry * self.oy), -(cx * self.ox + cy * self.oy), rx, ry, cx, cy)


@dataclass(frozen=True)
class Grid:
    x0: float  # corner of cell (0, 0), in units of the projection
    y0: float
    res_m: float
    rows: int
    cols: int
    unit_m: float = 1.0
    bearing: float = 0.0
    convergence: float = 0.0
    frame: tuple[int, int, int, int] | None = None  # r0, r1, c0, c1

    def __post_init__(self) -> None:
        if not self.unit_m > 0:
            raise ValueError("a grid needs the length of its unit in metres")

    @cached_property
    def affine(self) -> Affine:
        return Affine.turned(self.x0, self.y0, self.res_m / self.unit_m, self.bearing + self.convergence)

    @cached_property
    def to_lattice(self) -> Affine:
        return replace(self.affine, ox=0.0, oy=0.0).inverse()

    def fractional(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional (row, col) of map coordinates, taken from the corner so that large coordinates lose no digits."""
        return self.to_lattice.place(x - self.x0, y - self.y0)

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        row, col = self.fractional(x, y)
        return F.floor(row).cast("int"), F.floor(col).cast("int")

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.affine.place(row + 0.5, col + 0.5)

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.rows - 1) & col.between(0, self.cols - 1)

    def in_frame(self, row: Column, col: Column) -> Column:
        r0, r1, c0, c1 = self.frame or (0, self.rows, 0, self.cols)
        return (row >= r0) & (row < r1) & (col >= c0) & (col < c1)

    def flat(self, row: Column, col: Column) -> Column:
        return row.cast("long") * self.cols + col

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells with the coordinates of their centres."""
        n = F.col("id")
        df = spark.range(self.rows * self.cols).select(F.expr(f"int(id div {self.cols})").alias("row"), F.pmod(n, F.lit(self.cols)).cast("int").alias("col"))
        x, y = self.centre(F.col("row"), F.col("col"))
        return df.select("row", "col", x.alias("x"), y.alias("y"))

    def corners(self) -> list[tuple[float, float]]:
        """Map coordinates of the lattice's corners, around it."""
        return [self.affine.place(r, c) for r, c in ((0, 0), (0, self.cols), (self.rows, self.cols), (self.rows, 0))]

    def with_buffer(self, metres: float) -> Grid:
        """The same frame inside a domain that is wider by ``metres`` all around."""
        k = math.ceil(metres / self.res_m)
        x, y = self.affine.place(-k, -k)
        return replace(self, x0=x, y0=y, rows=self.rows + 2 * k, cols=self.cols + 2 * k, frame=(k, k + self.rows, k, k + self.cols))

    def describe(self, spark: SparkSession) -> DataFrame:
        r0, r1, c0, c1 = self.frame or (0, self.rows, 0, self.cols)
        return spark.createDataFrame([(self.res_m, self.unit_m, self.bearing, self.convergence, self.x0, self.y0, self.rows, self.cols, r0, r1, c0, c1)], "res_m double, unit_m double, bearing double, convergence double, x0 double, y0 double, rows int, cols int, r0 int, r1 int, c0 int, c1 int")


def square(x: float, y: float, span_m: float, res_m: float, unit_m: float = 1.0) -> Grid:
    """North-up square around a point."""
    n = int(round(span_m / res_m))
    half = n * res_m / unit_m / 2
    return Grid(x - half, y + half, res_m, n, n, unit_m)


def around(points: DataFrame, bearing: float, res_m: float, margin_m: float = 0.0, unit_m: float = 1.0, convergence: float = 0.0) -> Grid:
    """Tightest grid on a bearing around ``points`` (x, y): two running extremes, no hull needed."""
    probe = Grid(0.0, 0.0, res_m, 1, 1, unit_m, bearing, convergence)
    row, col = probe.fractional(F.col("x"), F.col("y"))
    ends = points.agg(*[f(x).alias(f"{n}{k}") for n, x in (("r", row), ("c", col)) for k, f in ((0, F.min), (1, F.max))]).first()
    margin = margin_m / res_m
    first = ends["r0"] - margin, ends["c0"] - margin
    x, y = probe.affine.place(*first)
    count = [max(1, math.ceil(ends[f"{n}1"] + margin - low)) for n, low in zip("rc", first, strict=True)]
    return replace(probe, x0=x, y0=y, rows=count[0], cols=count[1])


def north_up_index(pixels: DataFrame, grid: Grid) -> DataFrame:
    """``pixels`` (py, px, x, y) with the flat id of the frame cell under them, -1 outside."""
    row, col = grid.cell(F.col("x"), F.col("y"))
    return pixels.withColumn("cell", F.when(grid.in_frame(row, col), grid.flat(row, col)).otherwise(F.lit(-1).cast("long")))


def with_block(cells: DataFrame, size: int) -> DataFrame:
    """Block keys, for operators that work on whole blocks."""
    return cells.withColumn("brow", F.floor(F.col("row") / size).cast("int")).withColumn("bcol", F.floor(F.col("col") / size).cast("int"))


def crop(cells: DataFrame, row: int, col: int, span: int) -> DataFrame:
    """Cells of a square window around one; pushed down to the scan."""
    half = span // 2
    return cells.where(F.col("row").between(row - half, row - half + span - 1) & F.col("col").between(col - half, col - half + span - 1))
