"""Exact percentiles of large groups: ranks are found between splitters taken from the data.

A sketch of each group (of bounded size, merged as sums are) gives values a little below
and above each percentile.  They only part the values: how many lie between two of them
is counted exactly, and only the values between the two that hold a wanted rank, some
thousandth of the group, are counted one by one.  So the result does not depend on the
sketch, and no task sees a group whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Rank error of the sketch is one in ``ACCURACY``; splitters stand ``MARGIN`` of the ranks off.
ACCURACY, MARGIN = 10_000, 0.0005
#: Groups whose splitters every executor gets; of more groups, splitters and values are shuffled.
MOST_GROUPS = 50_000


def percentiles(df: DataFrame, wanted: dict[str, tuple[str, float]], *keys: str) -> DataFrame:
    """(keys, names): for each name of ``wanted`` the percentile q (0 to 1, between ranks linearly) of a column, by ``keys``.

    Nulls do not count; a group without values in any column is not in the result, and
    a column without values gives null.  Without keys one row comes back, or none.
    """
    series = list(dict.fromkeys(c for c, _ in wanted.values()))
    values = F.array(*[F.struct(F.lit(i).alias("_s"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(series)])
    long = stored(df.select(*keys, F.explode(values).alias("_x")).select(*keys, "_x._s", "_x._v").where("_v is not null"), "ranks")
    at = sorted({min(1.0, max(0.0, q + d)) for _, q in wanted.values() for d in (-MARGIN, MARGIN)})
    cuts = F.array_sort(F.array_distinct(F.percentile_approx("_v", at, ACCURACY)))
    marks = stored(long.groupBy(*keys, "_s").agg(cuts.alias("_cuts")).withColumn("_g", F.monotonically_increasing_id()), "splitters")
    sent = F.broadcast(marks) if marks.count() <= MOST_GROUPS else marks
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in (*keys, "_s")])
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    placed = long.alias("l").join(sent.alias("m"), same).select("_g", F.col("l._s").alias("_s"), "_v", part.alias("_part"))

    counted = placed.groupBy("_g", "_s", "_part").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranged = counted.select("_g", "_s", "_part", (upto - F.col("_n")).alias("_start"), upto.alias("_end"), F.sum("_n").over(Window.partitionBy("_g")).alias("_all"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(series.index(c)).alias("s"), F.lit(q).alias("q")) for name, (c, q) in wanted.items()]))
    ranks = ranged.withColumn("_w", asked).where("_w.s = _s").withColumn("_at", F.col("_w.q") * (F.col("_all") - 1))
    ranks = ranks.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).where("_rank >= _start and _rank < _end")
    need = stored(ranks.select("_g", "_part", "_start", F.col("_w.name").alias("_name"), "_at", "_rank"), "wanted-ranks")
    few = F.broadcast if need.count() <= 2 * len(wanted) * MOST_GROUPS else (lambda x: x)

    fine = placed.join(few(need.select("_g", "_part").distinct()), ["_g", "_part"], "left_semi").groupBy("_g", "_part", "_v").agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fine = fine.select("_g", "_part", "_v", (run - F.col("_n")).alias("_low"), run.alias("_high"))
    met = fine.join(few(need), ["_g", "_part"]).where((F.col("_rank") - F.col("_start") >= F.col("_low")) & (F.col("_rank") - F.col("_start") < F.col("_high")))
    share = F.when(F.col("_rank") == F.floor("_at"), F.floor("_at") + 1 - F.col("_at")).otherwise(F.col("_at") - F.floor("_at"))
    found = met.groupBy("_g").agg(*[F.sum(F.when(F.col("_name") == name, F.col("_v") * share)).alias(f"_p{i}") for i, name in enumerate(wanted)])
    named = marks.select("_g", *keys).join(found, "_g", "left")
    return named.groupBy(*keys).agg(*[F.max(f"_p{i}").alias(name) for i, name in enumerate(wanted)]) if keys else named.agg(F.count("*").alias("_n"), *[F.max(f"_p{i}").alias(name) for i, name in enumerate(wanted)]).where("_n > 0").drop("_n")


def with_percentiles(grouped: DataFrame, df: DataFrame, wanted: dict[str, tuple[str, float]], *keys: str) -> DataFrame:
    """``grouped`` (keys, ...) with percentiles of ``df`` by the same keys."""
    found = percentiles(df, wanted, *keys)
    if not keys:
        grouped, found, keys = grouped.withColumn("_one", F.lit(0)), found.withColumn("_one", F.lit(0)), ("_one",)
    same = reduce(lambda a, b: a & b, [F.col(f"g.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
    kept = [F.col(f"g.{c}") for c in grouped.columns if c != "_one"]
    return grouped.alias("g").join(found.alias("p"), same, "left").select(*kept, *[F.col(f"p.{n}") for n in wanted])
