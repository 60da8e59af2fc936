"""What a single changed building does: its own shadow, before and after, and the ground under a missing survey."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .focal import MAX_STEPS, connected, moving_moments, ray_offsets, ray_steps
from .kernels import blocks, halo_of, lit_block, offsets
from .parts import may_reach
from .small import small

#: Suns of one report, and those that share a shuffle of the surface.
MOST_SUNS, SHARED = 500, 31


def changed_components(changed: DataFrame) -> DataFrame:
    """``changed`` cells with the component they belong to, corners included."""
    return changed.join(connected(changed.select("row", "col"), corners=True), ["row", "col"])


def worth_a_sweep(parts: DataFrame, least_altitude: float, window: tuple[int, int, int, int], cell_m: float) -> DataFrame:
    """``parts`` (component, row, col, top_before, top_now, height_m) of the components whose shadow may matter in ``window`` (first and end row, first and end column).

    Left out are those that rise by less than 3 m, and those too low for the distance from their middle to the window.
    """
    ends = parts.groupBy("component").agg(F.max(F.col("top_now") - F.col("top_before")).alias("rise"), F.max("height_m").alias("high"), *[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))])
    middle = lambda c: (F.col(f"lo_{c}") + F.col(f"hi_{c}") + 1) / 2
    gap = lambda m, lo, hi: F.greatest(F.lit(lo) - m, F.lit(0.0), m - F.lit(hi))
    r0, r1, c0, c1 = map(float, window)
    far = F.hypot(gap(middle("row"), r0, r1), gap(middle("col"), c0, c1)) * cell_m
    return parts.join(ends.where(may_reach(F.col("high"), far, F.lit(least_altitude), F.col("rise"))), "component", "left_semi")


def newly_shaded(parts: DataFrame, cells: DataFrame, suns: DataFrame, cell_m: float) -> DataFrame:
    """(component, sun columns, row, col): cells that lie in shade once a component alone has changed, and lay in none before.

    ``parts`` (component, row, col, top_now) are the changed cells, ``cells`` (row, col, surface) the whole earlier
    surface, ``suns`` (altitude, azimuth, ...) a few instants.  A changed cell looks down each ray as far as its
    height above the lowest ground carries, and meets the cells there by an equi-join; its component's own cells
    stand at their new height.  What the earlier surface shades, by the block form, is taken out.
    """
    keys = suns.columns
    ends = cells.agg(F.min("surface").alias("low"), F.max("surface").alias("top")).first()
    low, high = ends["low"], parts.agg(F.max("top_now")).first()[0]
    if low is None or high is None:
        return parts.join(F.broadcast(suns.limit(0))).select("component", *keys, "row", "col")
    up = suns.where("altitude > 0").withColumn("climb_m", F.tan(F.radians("altitude")) * cell_m)
    steps = F.greatest(F.lit(1), F.least(F.ceil(F.lit(float(high - low)) / F.col("climb_m")) + 1, F.lit(MAX_STEPS))).cast("int")
    looks_at = ray_offsets(up.withColumn("steps", steps)).withColumn("climb", (F.col("dist") * F.col("climb_m")).cast("float"))
    near = F.col("top_now") - F.lit(float(low)) > F.col("climb")
    looks = parts.join(small(looks_at), near).select("component", *keys, "climb", "top_now", (F.col("row") - F.col("drow")).alias("row"), (F.col("col") - F.col("dcol")).alias("col"))
    # How high a ray must start to pass all that the component has in its way; cells beside it are met once each.
    least = looks.groupBy("component", *keys, "row", "col").agg(F.collect_set(F.struct("top_now", "climb")).alias("ways"))
    own = parts.select("component", "row", "col", F.col("top_now").alias("own"))
    met = least.join(cells.select("row", "col", F.col("surface").cast("float").alias("z")), ["row", "col"]).join(own, ["component", "row", "col"], "left")
    start = F.coalesce(F.col("own"), F.col("z"))
    blocked = F.exists("ways", lambda w: w["top_now"] > (start + w["climb"]).cast("float"))
    now = met.where(blocked).select("component", *keys, "row", "col")
    dark = earlier_shade(cells, suns, cell_m, float(ends["top"] - low))
    return now.join(dark, [*keys, "row", "col"], "left_anti").select("component", *keys, "row", "col")


def earlier_shade(cells: DataFrame, suns: DataFrame, cell_m: float, relief: float) -> DataFrame:
    """(sun columns, row, col): the cells in shade, for each of a few suns; suns share a shuffle, ``SHARED`` at a time."""
    known = small(suns.where("altitude > 0"), MOST_SUNS).collect()
    out = suns.limit(0).join(F.broadcast(cells.limit(0).select("row", "col")))
    for k in range(0, len(known), SHARED):
        some = known[k : k + SHARED]
        looks = [(offsets(x["azimuth"], ray_steps(relief, cell_m, x["altitude"])), math.tan(math.radians(x["altitude"]))) for x in some]

        def kernel(z: np.ndarray, r: int, c: int, n: int, looks: list = looks) -> np.ndarray:
            return sum((~lit_block(z, r, c, n, rays, cell_m, tan)).astype(np.int32) << bit for bit, (rays, tan) in enumerate(looks))

        marked = blocks(cells, "surface", None, halo_of([ray for rays, _ in looks for ray in rays]), kernel, "dark", "int")
        bits = F.filter(F.array(*[F.lit(bit) for bit in range(len(some))]), lambda bit: F.expr("dark").bitwiseAND(F.call_function("shiftleft", F.lit(1), bit)) != 0)
        named = suns.sparkSession.createDataFrame([(bit, *x) for bit, x in enumerate(some)], T.StructType([T.StructField("_bit", T.IntegerType()), *suns.schema.fields]))
        dark = marked.select("row", "col", F.explode(bits).alias("_bit")).join(F.broadcast(named), "_bit")
        out = out.unionByName(dark.select(*suns.columns, "row", "col"))
    return out


def estimated_ground(cells: DataFrame, rows: int, cols: int, block: int) -> DataFrame:
    """(row, col, ground) without a bare-earth survey: least surface of whole blocks, smoothed over 3 x 3 blocks, stretched back linearly, never above the surface."""
    nr, nc = rows // block, cols // block
    part = lambda c: F.floor(F.col(c) / block).cast("int")
    whole = cells.where((F.col("row") < nr * block) & (F.col("col") < nc * block))
    coarse = whole.groupBy(part("row").alias("row"), part("col").alias("col")).agg(F.min(F.col("surface").cast("double")).alias("least"))
    smooth = moving_moments(coarse, "least", 1, nr, nc).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("mean").alias("g"))
    at = lambda c, n, k: F.col(c) * ((k - 1) / (n - 1) if n > 1 else 0.0)
    fr, fc = at("row", rows, nr), at("col", cols, nc)
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o")
    spread = cells.select("row", "col", F.col("surface").cast("double").alias("z"), fr.alias("fr"), fc.alias("fc"), corner)
    weight = F.when(F.col("o.a") == 1, F.col("fr") - F.floor("fr")).otherwise(1 - (F.col("fr") - F.floor("fr"))) * F.when(F.col("o.b") == 1, F.col("fc") - F.floor("fc")).otherwise(1 - (F.col("fc") - F.floor("fc")))
    asked = spread.select("row", "col", "z", weight.alias("w"), F.least(F.floor("fr") + F.col("o.a"), F.lit(nr - 1)).cast("int").alias("r"), F.least(F.floor("fc") + F.col("o.b"), F.lit(nc - 1)).cast("int").alias("c"))
    return asked.join(smooth, ["r", "c"]).groupBy("row", "col").agg(F.least(F.sum(F.col("w") * F.col("g")), F.first("z")).alias("ground"))


def voids(cells: DataFrame, rows: int, cols: int, cell_m: float, in_tiles: str, far_m: float = 6.0, block_m: float = 20.0) -> DataFrame:
    """(row, col, water, nodata) of ``cells`` (row, col, valid, ``in_tiles``), all of a rows x cols lattice.

    A void is farther than ``far_m`` from any return.  It is water where tiles cover it and returns enclose it
    (on blocks of ``block_m``), and no data elsewhere; smaller gaps are neither.
    """
    from .focal import holes_filled
    from .gridding import coarse_any
    from .kernels import distance_blocked

    reach = math.ceil(far_m / cell_m)
    distance = distance_blocked(cells.select("row", "col", "valid"), "valid", reach)
    k = max(1, round(block_m / cell_m))
    coarse = holes_filled(coarse_any(cells, k, "valid").withColumnRenamed("any", "closed"), "closed", -(-rows // k), -(-cols // k))
    placed = cells.join(distance, ["row", "col"]).withColumn("_r", F.floor(F.col("row") / k).cast("int")).withColumn("_c", F.floor(F.col("col") / k).cast("int"))
    both = placed.join(coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "closed"), ["_r", "_c"])
    void = F.col("distance").isNull() | (F.col("distance") * cell_m > far_m)
    water = void & F.col(in_tiles) & F.col("closed")
    return both.select("row", "col", water.alias("water"), (void & ~water).alias("nodata"))
