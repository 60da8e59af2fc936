"""The nearest cell that has a value, however far it is.

Cells are kept in blocks, and blocks in a pyramid of ever larger ones, each with the box
of the valued cells in it.  From the top down a block of asked cells keeps the pyramid's
blocks that may hold a nearest cell: those no farther from it than the least distance
within which some block is sure to have one.  What is left at the bottom is a ring of
blocks around each, whose cells are compared exactly.  Only cells beside one without a
value can be nearest, since from any other a step towards the asked cell leads to a
nearer one.  Equal distances go to the first cell in scan order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, kept

SIZE = 64
PAIRS = 4_000_000  # distances held at a time
BOX = ["r0", "r1", "c0", "c1"]


def _block(c: str, size: int) -> Column:
    return F.floor(F.col(c) / size).cast("int")


def rim(cells: DataFrame, value: str, size: int) -> DataFrame:
    """(brow, bcol, row, col, value) of cells that lack one of their four neighbours in their block; those at the block's edge always count."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(part["brow"].iloc[0]) * size, int(part["bcol"].iloc[0]) * size
        has = np.zeros((size + 2, size + 2), bool)
        r, c = part["row"].to_numpy() - r0 + 1, part["col"].to_numpy() - c0 + 1
        has[r, c] = True
        inner = has[r - 1, c] & has[r + 1, c] & has[r, c - 1] & has[r, c + 1]
        return part[~inner]

    keyed = cells.select(_block("row", size).alias("brow"), _block("col", size).alias("bcol"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("value"))
    return keyed.groupBy("brow", "bcol").applyInPandas(work, "brow int, bcol int, row int, col int, value double")


def _boxes(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


def nearest_cells(asked: DataFrame, cells: DataFrame, value: str, size: int = SIZE) -> DataFrame:
    """(row, col, near_row, near_col, d2, value): of each distinct ``asked`` (row, col) the nearest of ``cells`` whose ``value`` is not null.

    ``d2`` is the squared distance in cells.  Without any value nothing is found.
    """
    known = cells.where(F.col(value).isNotNull())
    wanted = asked.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()
    own = wanted.join(known.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("value")), ["row", "col"], "left")
    own, _ = kept(own.select("row", "col", "value", _block("row", size).alias("hrow"), _block("col", size).alias("hcol")), "asked")
    here = own.where("value is not null").select("row", "col", F.col("row").alias("near_row"), F.col("col").alias("near_col"), F.lit(0).cast("long").alias("d2"), "value")
    homes = own.where("value is null")
    edge, _ = kept(rim(known, value, size), "rim")
    pairs = _near_blocks(_boxes(homes, "hrow", "hcol"), _boxes(edge, "brow", "bcol"))
    if pairs is None:
        return here
    met = pairs.join(edge, ["brow", "bcol"]).select("hrow", "hcol", F.col("row").alias("near_row"), F.col("col").alias("near_col"), "value")

    def work(mine: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        around = around.sort_values(["near_row", "near_col"])
        r, c = around["near_row"].to_numpy(np.int64), around["near_col"].to_numpy(np.int64)
        p, q = mine["row"].to_numpy(np.int64), mine["col"].to_numpy(np.int64)
        if not len(r) or not len(p):
            return pd.DataFrame({"row": [], "col": [], "near_row": [], "near_col": [], "d2": [], "value": []})
        step = max(1, PAIRS // len(r))
        first, d2 = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
        for k in range(0, len(p), step):
            far = (p[k : k + step, None] - r) ** 2 + (q[k : k + step, None] - c) ** 2
            first[k : k + step] = far.argmin(axis=1)
            d2[k : k + step] = far.min(axis=1)
        return pd.DataFrame({"row": p, "col": q, "near_row": r[first], "near_col": c[first], "d2": d2, "value": around["value"].to_numpy()[first]})

    found = homes.select("hrow", "hcol", "row", "col").groupBy("hrow", "hcol").cogroup(met.groupBy("hrow", "hcol")).applyInPandas(work, "row int, col int, near_row int, near_col int, d2 long, value double")
    return here.unionByName(found)


def _near_blocks(homes: DataFrame, boxes: DataFrame) -> DataFrame | None:
    """(hrow, hcol, brow, bcol): of each home the blocks that may hold a nearest cell; None where there is no block."""
    spark = homes.sparkSession
    homes, _ = kept(homes.select("hrow", "hcol", *[F.col(b).alias(f"h{b}") for b in BOX]), "homes")
    level, _ = kept(boxes.select("brow", "bcol", *BOX), "pyramid")
    pyramid = [level]
    while True:
        if level.limit(5).count() <= 4:
            break
        up = level.groupBy(F.floor(F.col("brow") / 2).cast("int").alias("brow"), F.floor(F.col("bcol") / 2).cast("int").alias("bcol"))
        level, _ = kept(up.agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1")), "pyramid")
        pyramid.append(level)
    roots = [(r["brow"], r["bcol"]) for r in level.collect()]  # four at most
    if not roots:
        return None
    path = None
    pairs = homes.withColumn("b", F.explode(F.array(*[F.struct(F.lit(r).alias("brow"), F.lit(c).alias("bcol")) for r, c in roots]))).select(*homes.columns, "b.brow", "b.bcol")
    for depth in range(len(pyramid) - 1, -1, -1):
        if depth < len(pyramid) - 1:
            child = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1))
            pairs = pairs.withColumn("brow", child("brow")).withColumn("bcol", child("bcol"))
        met = pairs.join(pyramid[depth], ["brow", "bcol"])
        apart = lambda a, b: F.greatest(F.col(f"h{a}") - F.col(b), F.col(a) - F.col(f"h{b}"), F.lit(0)).cast("long")
        across = lambda a, b: F.greatest(F.col(f"h{b}") - F.col(a), F.col(b) - F.col(f"h{a}")).cast("long")
        close, far = (f("r0", "r1") * f("r0", "r1") + f("c0", "c1") * f("c0", "c1") for f in (apart, across))
        met = met.select(*homes.columns, "brow", "bcol", close.alias("close"), far.alias("far"))
        sure = met.groupBy("hrow", "hcol").agg(F.min("far").alias("sure"))
        before = path
        pairs, path = kept(met.join(sure, ["hrow", "hcol"]).where("close <= sure").select(*homes.columns, "brow", "bcol"), "pairs")
        if before:
            dropped(spark, before)
    return pairs.select("hrow", "hcol", "brow", "bcol")


def filled(cells: DataFrame, value: str, size: int = SIZE) -> DataFrame:
    """``cells`` with every missing ``value`` taken from the nearest cell that has one, and how far that is in cells."""
    near = nearest_cells(cells.where(F.col(value).isNull()), cells, value, size).select("row", "col", F.col("value").alias("_near"), F.sqrt(F.col("d2").cast("double")).alias("_far"))
    kind = cells.schema[value].dataType
    met = cells.join(near, ["row", "col"], "left")
    return met.withColumn("distance", F.when(F.col(value).isNotNull(), F.lit(0.0)).otherwise(F.col("_far"))).withColumn(value, F.coalesce(F.col(value), F.col("_near").cast(kind))).drop("_near", "_far")


def moved_to_open(probes: DataFrame, cells: DataFrame, open_: str, size: int = SIZE) -> DataFrame:
    """``probes`` (row, col, ...) with open_row and open_col, where they stand if they may stand on open cells only."""
    ground = cells.where(F.col(open_)).select("row", "col", F.lit(1.0).alias("_open"))
    near = nearest_cells(probes, ground, "_open", size).select("row", "col", F.col("near_row").alias("open_row"), F.col("near_col").alias("open_col"))
    return probes.join(near, ["row", "col"], "left")
