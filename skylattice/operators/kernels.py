"""Block forms: whole blocks of cells with a halo, worked on in NumPy.

``blocks`` cuts a lattice into square blocks and hands each its neighbours'
cells up to a halo, so a kernel sees all that can reach it and nothing else; no
task holds the lattice.  Kernels return rows for the block's own cells only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .small import small


Halo = tuple[int, int, int, int]
#: Blocks are at least this many times as wide as their halo, and as wide as these bounds allow.
WIDTHS, LEAST_SIZE, MOST_SIZE = 2, 64, 512
ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "float": pa.float32(), "double": pa.float64()}


def block_size(halo: Halo) -> int:
    """Width of blocks for a halo: each cell then travels a few times at most, and a block fits a task."""
    wide = WIDTHS * max(halo)
    return min(MOST_SIZE, max(LEAST_SIZE, 1 << max(0, (wide - 1).bit_length())))


def blocks(cells: DataFrame, value: str, size: int | None, halo: int | Halo, kernel: Callable[..., np.ndarray], out: str = "value", kind: str = "float", rays: bool = False) -> DataFrame:
    """(row, col, ``out``): ``kernel(array, r, c, size)`` of each block with its halo; NaN where there is no cell.

    ``halo`` is how far a kernel looks to smaller and larger rows and columns;
    cells travel to a neighbour block only if it looks at them.  (r, c) is where the
    block's own cells begin in the array.  Without ``size`` the halo sets it.  A
    kernel of ``rays`` asks what stands around a cell: cells without a row or column
    come back as cells with nothing around them, and a fifth argument says where
    values are no numbers (None if they all are), which is not where none are.
    """
    up, down, left, right = (halo,) * 4 if isinstance(halo, int) else halo
    size = size or block_size((up, down, left, right))
    own = cells.select("row", "col", F.col(value).cast("float").alias("z"))
    placed = F.col("row").isNotNull() & F.col("col").isNotNull()
    # The blocks that hold a cell or look at it.
    span = lambda c, before, after: F.sequence(F.floor((F.col(c) - before) / size).cast("int"), F.floor((F.col(c) + after) / size).cast("int"))
    brow, bcol = F.when(placed, span("row", down, up)), F.when(placed, span("col", right, left))
    if rays:
        sent = own.withColumn("brow", F.explode_outer(brow)).withColumn("bcol", F.explode(F.when(placed, bcol).otherwise(F.array(F.pmod(F.hash("row", "col"), F.lit(64))))))
    else:
        sent = own.withColumn("brow", F.explode(brow)).withColumn("bcol", F.explode(bcol))

    item = ARROW[kind.removeprefix("array<").removesuffix(">")]

    def answer(row, col, got: np.ndarray) -> pa.Table:
        found = pa.array(got.ravel(), item)
        if kind.startswith("array"):
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * got.shape[1], pa.int32()), found)
        return pa.table({"row": pa.array(row, pa.int32()), "col": pa.array(col, pa.int32()), out: found})

    def work(part: pa.Table) -> pa.Table:
        z = np.full((size + up + down, size + left + right), np.nan, np.float32)
        extra = (None,) if rays else ()
        if part["brow"][0].as_py() is None:
            one = kernel(z[: 1 + up + down, : 1 + left + right], up, left, 1, *extra)[0, 0]
            return answer(part["row"].to_pylist(), part["col"].to_pylist(), np.array([one] * part.num_rows))
        r0, c0 = part["brow"][0].as_py() * size - up, part["bcol"][0].as_py() * size - left
        rows, cols = part["row"].to_numpy() - r0, part["col"].to_numpy() - c0
        mine = (rows >= up) & (rows < up + size) & (cols >= left) & (cols < left + size)
        if not mine.any():
            return pa.table({"row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), out: pa.array([], pa.list_(item) if kind.startswith("array") else item)})
        z[rows, cols] = values = part["z"].to_numpy()
        strange = np.isnan(values) & part["z"].is_valid().to_numpy()
        if rays and strange.any():
            nans = np.zeros(z.shape, bool)
            nans[rows, cols] = strange
            extra = (nans,)
        got = kernel(z, up, left, size, *extra)
        return answer(rows[mine] + r0, cols[mine] + c0, got[rows[mine] - up, cols[mine] - left])

    return sent.groupBy("brow", "bcol").applyInArrow(work, f"row int, col int, {out} {kind}")


def offsets(azimuth: float, steps: int) -> list[tuple[int, int, float]]:
    """Whole-cell offsets along a bearing, each once, nearest first."""
    n = np.arange(1, steps + 1)
    a = math.radians(azimuth)
    pairs = dict.fromkeys(zip(np.rint(-n * math.cos(a)).astype(int).tolist(), np.rint(n * math.sin(a)).astype(int).tolist(), strict=True))
    return [(r, c, math.hypot(r, c)) for r, c in pairs if r or c]


def halo_of(rays: list[tuple[int, int, float]]) -> Halo:
    """How far the rays look up, down, left and right."""
    rows, cols = [r for r, _, _ in rays] or [0], [c for _, c, _ in rays] or [0]
    return max(0, -min(rows)), max(0, max(rows)), max(0, -min(cols)), max(0, max(cols))


def lit_block(z: np.ndarray, up: int, left: int, size: int, rays: list[tuple[int, int, float]], cell: float, tan: float, nans: np.ndarray | None = None) -> np.ndarray:
    """Which cells no other stands above along the ray; what is no number stands above all numbers, as in SQL."""
    own = z[up : up + size, left : left + size]
    dark = np.zeros(own.shape, bool)
    for r, c, d in rays:
        ahead = z[up + r : up + r + size, left + c : left + c + size]
        ray = own + np.float32(d * cell * tan)
        dark |= ahead > ray
        if nans is not None:
            dark |= nans[up + r : up + r + size, left + c : left + c + size] & (ray == ray)
    return ~dark


def shadows_blocked(cells: DataFrame, altitude: float, azimuth: float, cell_m: float, value: str = "surface", size: int | None = None, relief: float | None = None) -> DataFrame:
    """(row, col, lit) for one sun: the block form of ``focal.shadows``.  Cells are sent towards the shadow only."""
    from .focal import ray_steps

    if altitude <= 0:
        return cells.select("row", "col", F.lit(False).alias("lit"))
    if relief is None:
        relief = relief_of(cells, value)
    rays = offsets(azimuth, ray_steps(relief, cell_m, altitude))
    tan = math.tan(math.radians(altitude))
    return blocks(cells, value, size, halo_of(rays), lambda z, r, c, n, nans: lit_block(z, r, c, n, rays, cell_m, tan, nans), "lit", "boolean", rays=True)


def relief_of(cells: DataFrame, value: str = "surface") -> float:
    ends = cells.agg(F.max(value).alias("most"), F.min(value).alias("least")).first()
    return float((ends["most"] or 0) - (ends["least"] or 0))


def _looks(cells: DataFrame, suns: list[tuple[float, float]], cell_m: float, value: str) -> tuple[list, Halo]:
    """Rays and slope of each of ``suns`` (altitude, azimuth) over the relief of ``cells``, None for those that are not up, and their common halo."""
    from .focal import ray_steps

    relief = relief_of(cells, value)
    looks = [(offsets(azimuth, ray_steps(relief, cell_m, altitude)), math.tan(math.radians(altitude))) if altitude is not None and altitude > 0 else None for altitude, azimuth in suns]
    return looks, halo_of([ray for look in looks if look for ray in look[0]])


def sun_counts(cells: DataFrame, suns: list[tuple[float, float]], cell_m: float, value: str = "surface", size: int | None = None) -> DataFrame:
    """(row, col, lit_steps): how many of ``suns`` (altitude, azimuth) reach each cell.  One shuffle for all of them."""
    looks, halo = _looks(cells, suns, cell_m, value)

    def kernel(z: np.ndarray, r: int, c: int, n: int, nans: np.ndarray | None) -> np.ndarray:
        total = np.zeros((n, n), np.int32)
        for rays, tan in filter(None, looks):
            total += lit_block(z, r, c, n, rays, cell_m, tan, nans)
        return total

    return blocks(cells, value, size, halo, kernel, "lit_steps", "int", rays=True)


def shadows(cells: DataFrame, suns: DataFrame, cell_m: float, value: str = "surface", size: int | None = None) -> DataFrame:
    """(sun keys, row, col, lit) of ``cells`` for ``suns`` (altitude, azimuth, ...): the block form of ``focal.shadows``.

    One shuffle for all suns, which are a handful of rows.
    """
    some = small(suns).collect()
    if not some:
        return suns.join(cells.select("row", "col", F.lit(None).cast("boolean").alias("lit")))
    looks, halo = _looks(cells, [(x["altitude"], x["azimuth"]) for x in some], cell_m, value)

    def kernel(z: np.ndarray, r: int, c: int, n: int, nans: np.ndarray | None) -> np.ndarray:
        return np.stack([lit_block(z, r, c, n, look[0], cell_m, look[1], nans) if look else np.ones((n, n), bool) for look in looks], axis=-1)

    reached = blocks(cells, value, size, halo, kernel, "reached", "array<boolean>", rays=True).select("row", "col", F.posexplode("reached").alias("_sun", "_lit"))
    numbered = suns.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(some)], T.StructType([T.StructField("_sun", T.IntegerType()), *suns.schema]))
    return reached.join(F.broadcast(numbered), "_sun").select(*suns.columns, "row", "col", ((F.col("altitude") > 0) & F.col("_lit")).alias("lit"))


def sky_view_blocked(cells: DataFrame, cell_m: float, reach_m: float, azimuths: int = 16, value: str = "surface", size: int | None = None) -> DataFrame:
    """(row, col, svf): the block form of ``focal.sky_view``."""
    steps = max(1, math.ceil(reach_m / cell_m))
    rays = [offsets(k * 360.0 / azimuths, steps) for k in range(azimuths)]

    def kernel(z: np.ndarray, up: int, left: int, size: int, nans: np.ndarray | None) -> np.ndarray:
        view = lambda of, r=0, c=0: of[up + r : up + r + size, left + c : left + c + size]
        own = view(z).astype(np.float64)
        known = None if nans is None else ~np.isnan(z) | nans
        total = np.zeros(own.shape)
        for direction in rays:
            steep = np.zeros(own.shape)
            for r, c, d in direction:
                rise = (view(z, r, c) - own) / (d * cell_m)
                if known is None:
                    steep = np.fmax(steep, rise)
                else:  # what is no number makes the horizon none, as in SQL
                    steep = np.where(view(known, r, c) & view(known), np.maximum(steep, rise), steep)
            total += 1 / (1 + steep * steep)
        return total / len(rays)

    return blocks(cells, value, size, halo_of([ray for d in rays for ray in d]), kernel, "svf", "double", rays=True)


def squared_distance(valid: np.ndarray, reach: int) -> np.ndarray:
    """Squared distance to the nearest True cell of each cell, inf beyond ``reach``: the nearest in each column, then over columns within reach."""
    rows, cols = valid.shape
    g = np.where(valid, 0.0, np.inf)
    for r in range(1, rows):
        g[r] = np.minimum(g[r], g[r - 1] + 1)
    for r in range(rows - 2, -1, -1):
        g[r] = np.minimum(g[r], g[r + 1] + 1)
    g *= g
    best = g.copy()
    for k in range(1, min(reach, cols - 1) + 1):  # memory stays at two lattices, whatever the reach
        best[:, k:] = np.minimum(best[:, k:], g[:, :-k] + k * k)
        best[:, :-k] = np.minimum(best[:, :-k], g[:, k:] + k * k)
    best[best > reach * reach] = np.inf
    return best


def local_labels(mask: np.ndarray, corners: bool) -> np.ndarray:
    """Of each cell where ``mask`` the least place, in scan order, that it is connected to inside the array."""
    high, wide = mask.shape
    none = mask.size
    labels = np.full((high + 2, wide + 2), none)
    own = labels[1:-1, 1:-1]
    own[mask] = np.flatnonzero(mask)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0), *([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])]
    while True:
        low = own.copy()
        for r, c in steps:
            np.minimum(low, labels[1 + r : 1 + r + high, 1 + c : 1 + c + wide], out=low)
        found = np.append(low.ravel(), none)
        found = found[low[mask]]  # a label's own label
        if (found == own[mask]).all():
            return own
        own[mask] = found


def labelled_blocks(cells: DataFrame, corners: bool, width: int, size: int = 256) -> DataFrame:
    """(row, col, label) of ``cells``: the least node, row * ``width`` + col, that each is connected to inside its block."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["row"].to_numpy(), part["col"].to_numpy()
        r0, c0 = r.min(), c.min()
        mask = np.zeros((r.max() - r0 + 1, c.max() - c0 + 1), bool)
        mask[r - r0, c - c0] = True
        first = local_labels(mask, corners)[r - r0, c - c0]
        return pd.DataFrame({"row": r, "col": c, "label": (first // mask.shape[1] + r0).astype(np.int64) * width + first % mask.shape[1] + c0})

    block = lambda c: F.floor(F.col(c) / size)
    keyed = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()
    return keyed.groupBy(block("row").alias("_r"), block("col").alias("_c")).applyInPandas(work, "row int, col int, label long")


def distance_blocked(cells: DataFrame, valid: str, reach: int, size: int | None = None) -> DataFrame:
    """(row, col, distance) in cells to the nearest cell where ``valid``, null beyond ``reach``."""

    def kernel(z: np.ndarray, up: int, left: int, size: int) -> np.ndarray:
        d = np.sqrt(squared_distance(z == 1, reach))[up : up + size, left : left + size]
        return np.where(np.isfinite(d), d, np.nan)

    marked = cells.withColumn("_valid", F.col(valid).cast("int"))
    got = blocks(marked, "_valid", size, reach, kernel, "distance", "double")
    return got.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))


# Velocities and weights of the 9-speed lattice in the plane.
SPEEDS = np.array([(0, 0), (1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (-1, -1), (1, -1)])
WEIGHTS = np.array([4 / 9] + [1 / 9] * 4 + [1 / 36] * 4)


def _equilibrium(rho: np.ndarray, u: np.ndarray, v: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Weights of the nine speeds for a density and velocities, into ``out`` if given."""
    along = np.empty((9, *u.shape))
    along[0] = 0
    along[1], along[2], along[5] = u, v, u + v
    np.subtract(v, u, out=along[6])
    for k, back in ((3, 1), (4, 2), (7, 5), (8, 6)):
        np.negative(along[back], out=along[k])
    out = np.multiply(along, 3, out=out)
    out += 1
    along *= along
    along *= 4.5
    out += along
    out -= 1.5 * (u * u + v * v)
    out *= WEIGHTS[:, None, None] * rho
    return out


def _sources(solid: np.ndarray) -> np.ndarray:
    """Where each cell's nine parts come from in a step: the cell against the wind, off walls the other way; the last column and row repeat the one before."""
    opposite = [0, 3, 4, 1, 2, 7, 8, 5, 6]
    at = np.arange(9 * solid.size).reshape(9, *solid.shape)
    at = np.stack([np.roll(at[k], (SPEEDS[k, 1], SPEEDS[k, 0]), axis=(0, 1)) for k in range(9)])
    at = np.where(solid, at[opposite], at)
    at[:, :, -1] = at[:, :, -2]
    at[:, -1, :] = at[:, -2, :]
    return at


def flow(solid: np.ndarray, inlet: np.ndarray, steps: int, relaxation: float = 0.8, average_from: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Mean velocities of lattice-Boltzmann flow through a section: wind enters left, leaves right, walls bounce back."""
    u = np.repeat(inlet[:, None], solid.shape[1], axis=1) * ~solid
    v = np.zeros_like(u)
    f = _equilibrium(np.ones_like(u), u, v)
    entering = _equilibrium(np.ones((len(inlet), 1)), inlet[:, None], np.zeros((len(inlet), 1)))[:, :, 0]
    entering[:, -1] = entering[:, -2]
    sources, moved, rho = _sources(solid), np.empty_like(f), np.empty_like(u)
    along, across = (np.ascontiguousarray(SPEEDS[:, k], float).reshape(1, 9) for k in (0, 1))
    mean = [np.zeros_like(u), np.zeros_like(u)]
    counted = 0
    for step in range(steps):
        np.take(f.reshape(-1), sources, out=moved, mode="clip")  # within bounds; the mode that needs no buffer
        moved[:, :, 0] = entering
        np.add.reduce(moved, axis=0, out=rho)
        u, v = (np.dot(speeds, moved.reshape(9, -1)).reshape(solid.shape) for speeds in (along, across))
        for w in (u, v):
            w /= rho
            w[solid] = 0
        _equilibrium(rho, u, v, out=f)
        f -= moved
        f /= relaxation
        f += moved
        np.copyto(f, moved, where=solid)
        if step >= steps * average_from:
            mean[0] += u
            mean[1] += v
            counted += 1
    return mean[0] / max(1, counted), mean[1] / max(1, counted)


def flow_runs(runs: DataFrame, steps: int = 200) -> DataFrame:
    """Mean flow over each run's skyline: ``runs`` (run, k, height) gives the height of column k in cells.

    A run's section is bounded by its lattice, never by the table.  Runs are few
    bytes and long work, so they are dealt to a fixed number of tasks: by their size
    alone they would be put into one.
    """

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        heights = part["height"].to_numpy()
        nx, nz = len(heights) + 20, int(heights.max()) * 2 + 12
        solid = np.zeros((nz, nx), bool)
        for i, h in enumerate(heights, 10):
            solid[: int(h), i] = True
        solid[0] = True
        inlet = 0.09 * ((np.arange(nz) + 0.5) / nz) ** 0.28
        u, _ = flow(solid, inlet, steps)
        first_open = solid[:, 10:-10].argmin(axis=0)
        speed = u[first_open, np.arange(10, nx - 10)]
        return pd.DataFrame({"run": part["run"].to_numpy(), "k": part["k"].to_numpy(), "speed": np.round(speed, 9)})

    spark = runs.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return runs.select("run", "k", "height").repartition(tasks, "run").groupBy("run").applyInPandas(work, "run long, k int, speed double")
