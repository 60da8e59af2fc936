"""Streamlines of flow runs, and choices among them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP, MOST, LEAST, SLOW, APART = 1.5, 160, 10, 0.05, 2.4


def _at(field: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Bilinear value of (2, rows, cols) at a fractional (row, col)."""
    r, c = np.floor(p).astype(int)
    a, b = p - (r, c)
    corner = field[:, r : r + 2, c : c + 2]
    return (corner * np.outer([1 - a, a], [1 - b, b])).sum(axis=(1, 2))


def traced(field: np.ndarray, open_: np.ndarray, start: tuple[float, float], least_speed: float) -> np.ndarray:
    """Vertices of the line through ``start``, downwind and upwind, by midpoint steps of ``STEP`` cells.

    It ends at walls, at the edge, where the air hardly moves, or with ``MOST`` vertices.
    """
    edge = np.array(open_.shape) - 1.0

    def walk(sign: float) -> list[np.ndarray]:
        out, p = [], np.array(start, float)
        while len(out) < MOST // 2:
            v = _at(field, p)
            speed = np.hypot(*v)
            if speed < least_speed:
                break
            half = p + sign * v / speed * STEP / 2
            if (half < 0).any() or (half >= edge).any():
                break
            v = _at(field, half)
            speed = np.hypot(*v)
            if speed < least_speed:
                break
            p = p + sign * v / speed * STEP
            if (p < 0).any() or (p >= edge).any() or not open_[tuple(np.rint(p).astype(int))]:
                break
            out.append(p)
        return out

    return np.array([*walk(-1.0)[::-1], np.array(start, float), *walk(1.0)])


def streamlines(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """(run, line_id, vertex, r, c): lines of ``cells`` (run, row, col, vr, vc, open) through ``seeds`` (run, line_id, r, c).

    Seeds are taken in the order of line_id; one within ``APART`` cells of an
    accepted line is passed over, which makes a run's lines one task's work.
    """

    def work(part: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"run": [], "line_id": [], "vertex": [], "r": [], "c": []})
        if part.empty or starts.empty:
            return out
        shape = (int(part["row"].max()) + 2, int(part["col"].max()) + 2)
        field, open_, taken = np.zeros((2, *shape)), np.zeros(shape, bool), np.zeros(shape, bool)
        field[:, part["row"], part["col"]] = part[["vr", "vc"]].to_numpy().T
        open_[part["row"], part["col"]] = part["open"]
        field[:, ~open_] = 0
        least = SLOW * np.hypot(*field).max()
        near = int(np.ceil(APART))
        disc = [(a, b) for a in range(-near, near + 1) for b in range(-near, near + 1) if np.hypot(a, b) <= APART]
        found = []
        for s in starts.sort_values("line_id").itertuples():
            if not (0 <= s.r < shape[0] - 1 and 0 <= s.c < shape[1] - 1) or taken[round(s.r), round(s.c)] or not open_[round(s.r), round(s.c)]:
                continue
            line = traced(field, open_, (s.r, s.c), least)
            if len(line) < LEAST:
                continue
            at = np.rint(line).astype(int)
            for a, b in disc:
                rows, cols = np.clip(at[:, 0] + a, 0, shape[0] - 1), np.clip(at[:, 1] + b, 0, shape[1] - 1)
                taken[rows, cols] = True
            found.append(pd.DataFrame({"run": s.run, "line_id": s.line_id, "vertex": np.arange(len(line)), "r": line[:, 0], "c": line[:, 1]}))
        return pd.concat(found) if found else out

    a = cells.select("run", "row", "col", "vr", "vc", "open").groupBy("run")
    return a.cogroup(seeds.select("run", "line_id", "r", "c").groupBy("run")).applyInPandas(work, "run string, line_id long, vertex int, r double, c double")


def longest_runs(vertices: DataFrame, free: Column) -> DataFrame:
    """Of each line its longest stretch of vertices where ``free``, the first of equal ones."""
    line = ["run", "line_id"]
    turn = F.sum((~free).cast("int")).over(Window.partitionBy(*line).orderBy("vertex"))
    parts = vertices.withColumn("_part", turn).where(free)
    sizes = parts.groupBy(*line, "_part").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*line).agg(F.max_by("_part", F.struct(F.col("n"), -F.col("_part"))).alias("_part"))
    return parts.join(best, [*line, "_part"]).drop("_part")


def spread_out(spots: DataFrame, k: int = 12, apart: float = 2.0) -> DataFrame:
    """Up to ``k`` spots (run, row, col, score) a run, best first, none within ``apart`` cells of a better one taken."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for s in part.sort_values(["score", "row", "col"], ascending=[False, True, True]).itertuples():
            if len(kept) == k:
                break
            if all(np.hypot(s.row - o.row, s.col - o.col) > apart for o in kept):
                kept.append(s)
        return part.loc[[s.Index for s in kept]]

    return spots.select("run", "row", "col", "score").groupBy("run").applyInPandas(work, "run string, row int, col int, score double")


def shuffled(lines: DataFrame, seed: int = 7) -> DataFrame:
    """A fixed arbitrary order by a hash of the line."""
    return lines.withColumn("order", F.xxhash64("run", "line_id", F.lit(seed)))


def section(voxels: DataFrame, row: int, dz: float) -> DataFrame:
    """One row of columns as (col, z, speed): ``voxels`` has an array of speeds by height."""
    return voxels.where(F.col("row") == row).select("col", F.posexplode("speeds").alias("k", "speed")).select("col", ((F.col("k") + 0.5) * dz).alias("z"), "speed")
