"""Neighbourhood operators as joins of cells with shifted cells.

These forms are exact and plain SQL; their cost is cells times offsets, so they
suit small reaches.  ``kernels`` has block forms with the same results for long
shadows, sky view over large radii and unbounded distances.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .labels import propagate
from .small import small

MAX_STEPS = 4000


def ray_steps(relief: float, cell: float, altitude: float, reach: float | None = None) -> int:
    """Steps of a ray until it has climbed ``relief`` or gone as far as ``reach``; all there may be where the relief is no finite number."""
    far = relief / max(math.tan(math.radians(altitude)), 1e-6)
    far = min(far if math.isfinite(far) else math.inf, math.inf if reach is None else reach, MAX_STEPS * cell)
    return max(1, min(math.ceil(far / cell) + 1, MAX_STEPS))


def ray_offsets(suns: DataFrame) -> DataFrame:
    """Offsets (step, drow, dcol, dist) along the ray of each row of ``suns`` (azimuth, steps): whole cells, each once.

    Rounds half to even; the first of steps that fall on one cell stays.
    """
    keys = [c for c in suns.columns if c != "steps"]
    n = F.col("step")
    az = F.radians("azimuth")
    all_ = suns.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps")))).select(*keys, "step", F.rint(-n * F.cos(az)).cast("int").alias("drow"), F.rint(n * F.sin(az)).cast("int").alias("dcol"))
    first = all_.where("drow <> 0 or dcol <> 0").groupBy(*keys, "drow", "dcol").agg(F.min("step").alias("step"))
    return first.withColumn("dist", F.hypot(F.col("drow").cast("double"), F.col("dcol").cast("double")))


def shadows(cells: DataFrame, suns: DataFrame, cell_m: float, value: str = "surface", frame: Column | None = None) -> DataFrame:
    """(sun keys, row, col, lit) of ``cells`` for ``suns`` (altitude, azimuth, ...): join form.

    A cell is dark when some cell along the ray stands above it by more than the
    ray has climbed, compared in 32-bit floats.  Suns at or under the horizon
    light nothing.  The number of steps follows from the relief.  ``suns`` is a
    handful of rows, so its offsets are broadcast.
    """
    keys = suns.columns
    asked = cells if frame is None else cells.where(frame)
    ends = cells.agg(F.max(value).alias("most")).first(), asked.agg(F.min(value).alias("least")).first()
    relief = float((ends[0]["most"] or 0) - (ends[1]["least"] or 0))
    up = suns.where("altitude > 0")
    far = F.lit(relief) / F.greatest(F.tan(F.radians("altitude")), F.lit(1e-6))
    steps = F.greatest(F.lit(1), F.least(F.ceil(far / cell_m) + 1, F.lit(MAX_STEPS))).cast("int")
    offsets = ray_offsets(up.withColumn("steps", steps)).withColumn("climb", (F.col("dist") * cell_m * F.tan(F.radians("altitude"))).cast("float"))
    looks = asked.select("row", "col", F.col(value).cast("float").alias("z")).join(small(offsets)).select(*keys, "row", "col", (F.col("z") + F.col("climb")).cast("float").alias("ray"), (F.col("row") + F.col("drow")).alias("r2"), (F.col("col") + F.col("dcol")).alias("c2"))
    blockers = cells.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col(value).cast("float").alias("top"))
    dark = looks.join(blockers, ["r2", "c2"]).where("top > ray").select(*keys, "row", "col").distinct()
    every = asked.select("row", "col").join(small(suns))
    return every.join(dark.withColumn("dark", F.lit(True)), [*keys, "row", "col"], "left").select(*keys, "row", "col", ((F.col("altitude") > 0) & F.col("dark").isNull()).alias("lit"))


def sun_hours(lit: DataFrame, step_h: float, *keys: str) -> DataFrame:
    return lit.groupBy(*keys, "row", "col").agg((F.count_if("lit") * step_h).alias("sun_hours"))


def sky_view(cells: DataFrame, spark: SparkSession, cell_m: float, reach_m: float, azimuths: int = 16, value: str = "surface") -> DataFrame:
    """(row, col, svf): mean over directions of 1 / (1 + t^2) with t the steepest horizon, at least 0."""
    steps = max(1, math.ceil(reach_m / cell_m))
    directions = spark.range(azimuths).select((F.col("id") * (360.0 / azimuths)).alias("azimuth"), F.lit(steps).alias("steps"))
    offsets = ray_offsets(directions)
    z = F.col(value).cast("double")
    looks = cells.select("row", "col", z.alias("z")).join(small(offsets)).select("azimuth", "row", "col", "z", "dist", (F.col("row") + F.col("drow")).alias("r2"), (F.col("col") + F.col("dcol")).alias("c2"))
    tops = cells.select(F.col("row").alias("r2"), F.col("col").alias("c2"), z.alias("top"))
    steep = looks.join(tops, ["r2", "c2"]).groupBy("row", "col", "azimuth").agg(F.greatest(F.lit(0.0), F.max((F.col("top") - F.col("z")) / (F.col("dist") * cell_m))).alias("t"))
    seen = steep.groupBy("row", "col").agg(F.sum(1 / (1 + F.col("t") * F.col("t"))).alias("s"), F.count("*").alias("k"))
    # A direction with nothing in it is open sky.
    return cells.select("row", "col").join(seen, ["row", "col"], "left").select("row", "col", ((F.coalesce("s", F.lit(0.0)) + azimuths - F.coalesce("k", F.lit(0))) / azimuths).alias("svf"))


def _around(cells: DataFrame, offsets: list[tuple[int, int]], *values: str) -> DataFrame:
    """Each cell's values at the cells they are offset to: (row, col, dr, dc, values)."""
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])).alias("o")
    return cells.select("row", "col", *values, shifts).select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), *values)


CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]
BOX = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def dilated(cells: DataFrame, mask: str, offsets: list[tuple[int, int]] = BOX) -> DataFrame:
    """Mask cells and their neighbours, within the lattice."""
    grown = _around(cells.where(F.col(mask)), offsets).select("row", "col").distinct().withColumn("grown", F.lit(True))
    return cells.join(grown, ["row", "col"], "left").withColumn(mask, F.coalesce("grown", F.lit(False))).drop("grown")


def eroded(cells: DataFrame, mask: str, offsets: list[tuple[int, int]] = BOX) -> DataFrame:
    """Mask cells all of whose neighbours are in the mask; off the lattice counts as out."""
    held = _around(cells.where(F.col(mask)), offsets).groupBy("row", "col").count().where(F.col("count") == len(offsets)).select("row", "col", F.lit(True).alias("held"))
    return cells.join(held, ["row", "col"], "left").withColumn(mask, F.coalesce("held", F.lit(False))).drop("held")


def closed(cells: DataFrame, mask: str) -> DataFrame:
    return eroded(dilated(cells, mask), mask)


def dilated_max(cells: DataFrame, value: str, rounds: int) -> DataFrame:
    """Maximum over the cells within ``rounds`` four-neighbour steps."""
    reach = [(a, b) for a in range(-rounds, rounds + 1) for b in range(-rounds, rounds + 1) if abs(a) + abs(b) <= rounds]
    most = _around(cells, reach, value).groupBy("row", "col").agg(F.max(value).alias("neighbourhood_max"))
    return cells.join(most, ["row", "col"])


def moving_moments(cells: DataFrame, value: str, radius: int, rows: int, cols: int, *keys: str) -> DataFrame:
    """Mean and roughness over a square window, of each lattice of ``keys``; cells beyond the edge repeat the nearest one.

    Two passes of windows, by row and by column; an edge cell counts as often as it is repeated.
    """
    v = F.col(value).cast("double")
    out = cells.select(*keys, "row", "col", v.alias("s1"), (v * v).alias("s2"))
    for along, across, n in (("col", "row", cols), ("row", "col", rows)):
        w = Window.partitionBy(*keys, across).orderBy(along).rangeBetween(-radius, radius)
        ends = Window.partitionBy(*keys, across).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before, after = F.greatest(F.lit(0), radius - F.col(along)), F.greatest(F.lit(0), F.col(along) + radius - (n - 1))
        summed = [(F.sum(c).over(w) + before * F.first(c).over(ends) + after * F.last(c).over(ends)).alias(c) for c in ("s1", "s2")]
        out = out.select(*keys, "row", "col", *summed)
    k = float((2 * radius + 1) ** 2)
    mean = F.col("s1") / k
    return out.select(*keys, "row", "col", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / k - mean * mean)).alias("roughness"))


def buildings_without_classes(cells: DataFrame, rows: int, cols: int, least_cells: int = 4) -> DataFrame:
    """(row, col, building): tall, not plant-like cells, closed, without small parts.

    ``cells`` has heights, returns and singles.  Plants let light through (few
    single returns) and are rough.
    """
    rough = moving_moments(cells, "heights", 3, rows, cols)
    plant = (F.col("singles") < 0.55 * F.col("returns")) & (F.col("roughness") > 3.0)
    mask = cells.join(rough, ["row", "col"]).select("row", "col", ((F.col("heights") > 3.0) & ~plant).alias("building"))
    shut = closed(mask, "building")
    parts = connected(shut.where("building"))
    big = parts.groupBy("component").count().where(F.col("count") >= least_cells)
    kept = parts.join(big, "component").select("row", "col", F.lit(True).alias("kept"))
    return shut.select("row", "col").join(kept, ["row", "col"], "left").select("row", "col", F.coalesce("kept", F.lit(False)).alias("building"))


def connected(cells: DataFrame, corners: bool = False, width: int = 1 << 20, size: int = 256) -> DataFrame:
    """(row, col, component) of connected ``cells``; a component is named by its first cell in scan order.

    Cells are labelled inside blocks first; only labels that touch across the blocks' edges are linked and joined.
    """
    from .kernels import labelled_blocks

    inside = stored(labelled_blocks(cells, corners, width, size), "blocks")
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if corners else [])]
    r, c = F.pmod("row", F.lit(size)), F.pmod("col", F.lit(size))
    edge = inside.where((r == 0) | (r == size - 1) | (c == 0) | (c == size - 1))
    block = lambda v: F.floor(v / size)
    to = F.explode(F.array(*[F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a, b in steps]))
    reach = edge.select(F.col("label").alias("a"), "row", "col", to.alias("to")).where((block(F.col("row")) != block(F.col("to.row"))) | (block(F.col("col")) != block(F.col("to.col"))))
    met = edge.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("label").alias("b"))
    links = reach.join(met, (F.col("to.row") == F.col("_r")) & (F.col("to.col") == F.col("_c"))).select("a", "b").distinct()
    named = propagate(links).withColumnRenamed("node", "label")
    return inside.join(named, "label", "left").select("row", "col", F.coalesce("component", "label").alias("component"))


def numbered(components: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Components numbered from 1 in scan order: counted by lattice row, and ranked within each row."""
    names = components.select("component").distinct().withColumn("_line", F.floor(F.col("component") / width))
    lines = names.groupBy("_line").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = names.join(lines.select("_line", before.alias("_before")), "_line")
    number = (F.col("_before") + F.row_number().over(Window.partitionBy("_line").orderBy("component"))).cast("int")
    return components.join(order.select("component", number.alias("number")), "component").select("row", "col", "number")


def nearest_fill(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """Cells without a value take that of the nearest cell that has one, within ``radius`` cells; ties to the first in scan order."""
    around = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if 0 < a * a + b * b <= radius * radius]
    empty = cells.where(F.col(value).isNull()).select("row", "col")
    near = _around(cells.where(F.col(value).isNotNull()), around, value).withColumn("d2", F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc"))
    order = F.struct("d2", (F.col("row") + F.col("dr")).alias("r"), (F.col("col") + F.col("dc")).alias("c"))
    found = near.join(empty, ["row", "col"], "left_semi").groupBy("row", "col").agg(F.min_by(value, order).alias("fill"), F.min("d2").alias("d2"))
    return cells.join(found, ["row", "col"], "left").select(*[c for c in cells.columns if c != value], F.coalesce(value, "fill").alias(value), F.when(F.col(value).isNotNull(), 0.0).otherwise(F.sqrt(F.col("d2").cast("double"))).alias("distance"))


def holes_filled(cells: DataFrame, mask: str, rows: int, cols: int) -> DataFrame:
    """The mask and what it encloses: parts of the rest that do not touch the edge."""
    outside = connected(cells.where(~F.col(mask)))
    edge = F.bool_or((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == rows - 1) | (F.col("col") == cols - 1))
    open_ = outside.groupBy("component").agg(edge.alias("open")).where("open")
    kept = outside.join(open_, "component", "left_semi").select("row", "col", F.lit(True).alias("open"))
    return cells.join(kept, ["row", "col"], "left").withColumn(mask, F.col("open").isNull()).drop("open")


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian(cells: DataFrame, value: str, sigma: float, least_weight: float = 0.2, size: tuple[int, int] | None = None) -> DataFrame:
    """Smoothed value of cells that have one: weighted sum over weights; null without a value or with too little weight.

    ``size`` (rows, columns) is that of the lattice: beyond its edges the cells are
    mirrored, the edge cell itself included.  Without it nothing lies beyond.
    """
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    table = F.array(*[F.lit(w) for w in weights])
    have = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("double").alias("num"), F.lit(1.0).alias("den"))
    for at, (axis, other) in enumerate((("row", "col"), ("col", "row"))):
        k = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("k")
        spread = have.select("row", "col", "num", "den", k)
        w = F.element_at(table, F.col("k") + radius + 1)
        to = F.array((F.col(axis) + F.col("k")).cast("int"))
        if size is not None:
            # A cell is also seen as its image before the first and behind the last one: both are aimed at what is inside.
            last = size[at] - 1
            images = F.array(F.col(axis), -1 - F.col(axis), 2 * last + 1 - F.col(axis))
            to = F.filter(F.transform(images, lambda x: (x + F.col("k")).cast("int")), lambda x: (x >= 0) & (x <= last))
        have = spread.select(F.explode(to).alias(axis), other, (w * F.col("num")).alias("num"), (w * F.col("den")).alias("den")).groupBy("row", "col").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    smooth = F.when(F.col(value).isNotNull() & (F.col("den") > least_weight), F.col("num") / F.col("den"))
    return cells.join(have, ["row", "col"], "left").select(*cells.columns, smooth.alias("smooth"))


def bilinear(points: DataFrame, cells: DataFrame, value: str, least_weight: float = 0.25) -> DataFrame:
    """Value of ``cells`` at fractional ``points`` (id, fr, fc) from the corners that have one, null if they weigh too little."""
    r0, c0 = F.floor("fr"), F.floor("fc")
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o")
    spread = points.select("id", (F.col("fr") - r0).alias("u"), (F.col("fc") - c0).alias("v"), r0.alias("r0"), c0.alias("c0"), corner)
    weight = F.when(F.col("o.a") == 1, F.col("u")).otherwise(1 - F.col("u")) * F.when(F.col("o.b") == 1, F.col("v")).otherwise(1 - F.col("v"))
    asked = spread.select("id", (F.col("r0") + F.col("o.a")).cast("int").alias("row"), (F.col("c0") + F.col("o.b")).cast("int").alias("col"), weight.alias("w"))
    got = asked.join(cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("double").alias("x")), ["row", "col"]).groupBy("id").agg(F.sum(F.col("w") * F.col("x")).alias("num"), F.sum("w").alias("den"))
    return points.select("id").join(got, "id", "left").select("id", F.when(F.col("den") > least_weight, F.col("num") / F.col("den")).alias("value"))
