"""Gates: checks with thresholds fixed beforehand, whose records decide what may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """One record a name, the latest; ``new`` wins where times are equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("name").orderBy(F.desc("when"), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_new")


def validated(gates: DataFrame, names: tuple[str, ...] = ("V1", "V2", "V3")) -> DataFrame:
    """One row: whether every one of ``names`` passed; a missing gate did not."""
    return gates.where(F.col("name").isin(*names) & F.col("pass")).agg((F.count_distinct("name") == len(names)).alias("validated"))


def invariants(cells: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, pass, failures) of predicates that every cell must meet; null counts as failure."""
    bad = [F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in checks.items()]
    return cells.agg(*bad).unpivot([], list(checks), "name", "failures").select("name", (F.col("failures") == 0).alias("pass"), "failures")


def agreement(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Share of cells on which two engines agree, and the difference of their areas."""
    same = F.abs(F.col("a") - F.col("b")) <= tolerance
    return pairs.agg(F.avg(same.cast("int")).alias("agree"), F.try_divide(F.abs(F.sum("a") - F.sum("b")), F.sum("b")).alias("area_change"))
