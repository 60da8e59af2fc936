"""Mixing sources to target weights: capped water-filling and seeded repetitions.

A budget of words is shared over the sources by weight.  No source may be read
more than ``max_epochs`` times; what a capped source leaves is shared again by
weight among the others, until none is above its cap.  That fixpoint is the
water level: with sources ordered by cap / weight, the level is the first one
that the next source's cap does not undercut, found with two running sums over
the table of sources (one row a source).

A source's share is then ``whole`` full passes over its documents and a
fractional one.  The fractional pass goes through the source's documents in the
order of a seeded hash until its words are spent; the last document is taken in
part, so each source's words equal its target but for rounding.  The order is
found without sorting a source in one place: words are summed by hash bucket and
by ranges of buckets, and only the bucket in which the pass ends is put in order.

Defined cases: a null text has size 0.  A null source is a source of its own,
ranked last.  A source of size 0 has target 0.  A null doc_id is an id like
others: the order goes by id and text.  Rows of one id and text are counted
together and share alike what is taken of them; where that does not go up in whole
words, some of them give one more.  Other columns are not read, or kept as they are by ``repeated``, whatever their names.  Empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, fresh, join_skewed, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 20_240_801
#: Documents a hash bucket should hold; buckets are counted from the table.
BUCKET_ROWS = 500
#: Buckets in a range.
RANGE = 4096


def n_words(text: Column) -> Column:
    """Number of words: each is replaced by one mark and white space removed."""
    marks = F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (src, source_size) with target added.  One row a source, so its windows are small."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    nth = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sources.withColumn("weight", nth).withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = share * F.sum("source_size").over(everything)
    levels = ranked.withColumn("level", (budget - before) / rest)
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything)
    return levels.withColumn("water", level).select(
        "src", "source_size", F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap")).otherwise(F.col("weight") * F.col("water")).alias("target")
    )


def mix(docs: DataFrame, text: str = "text", share: float = SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of ``docs`` (doc_id, source, ``text``)."""
    return _taken(docs, text, share, max_epochs, weights, seed).drop("src", "rank")


def rank_of(text: str, seed: int) -> Column:
    """A row's place in the seeded order."""
    return F.xxhash64("doc_id", F.xxhash64(F.col(text)), F.lit(seed))


def _starts(cells: DataFrame) -> DataFrame:
    """``cells`` (name, bucket, words) with start, the words of the source's buckets before: summed by ranges of buckets, then within each."""
    ranged = cells.withColumn("range", F.floor(F.col("bucket") / RANGE))
    ranges = ranged.groupBy("name", "range").agg(F.sum("words").alias("range_words"))
    before = F.sum("range_words").over(Window.partitionBy("name").orderBy("range")) - F.col("range_words")
    ranges = ranges.select("name", "range", before.alias("range_start"))
    inside = F.sum("words").over(Window.partitionBy("name", "range").orderBy("bucket")) - F.col("words")
    return ranged.join(ranges, ["name", "range"]).withColumn("start", F.col("range_start") + inside).drop("range", "range_start")


def _taken(docs: DataFrame, text: str, share: float, max_epochs: float, weights: tuple[float, ...], seed: int) -> DataFrame:
    """As ``mix``, with the source as src and the row's place in the order as rank."""
    sized = stored(docs.select("doc_id", F.col("source").alias("src"), n_words(F.col(text)).alias("size"), rank_of(text, seed).alias("rank"), F.spark_partition_id().alias("lot")), "mix-sizes")
    buckets = max(16, sized.count() // BUCKET_ROWS)
    named = F.coalesce(F.concat(F.lit("="), F.col("src")), F.lit("")).alias("name")  # null-safe key
    sized = sized.select("*", named, F.pmod("rank", F.lit(buckets)).alias("bucket"))
    cells = stored(sized.groupBy("name", "src", "bucket").agg(F.sum("size").alias("words")), "mix-cells")
    targets = water_fill(cells.groupBy("src").agg(F.sum("words").alias("source_size")), share, max_epochs, weights)

    goal = F.round(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("part", F.greatest(F.lit(0), goal - F.col("whole") * F.col("source_size")))
    plan = _starts(cells.drop("src")).join(targets.select(named, "source_size", "target", "whole", "part"), "name")
    plan = stored(plan.select("name", "bucket", "words", "start", "source_size", "target", "whole", "part"), "mix-plan")
    discard(cells)

    placed = sized.join(plan, ["name", "bucket"])
    left = F.col("part") - F.col("start")
    at_end = (left > 0) & (left < F.col("words"))
    plain = placed.where(~at_end).withColumn("extra", F.when(left > 0, F.col("size")).otherwise(F.lit(0)).cast("long"))
    ended = _shared(placed.where(at_end).withColumn("left", left))
    columns = ["doc_id", "src", "rank", "size", "lot", "source_size", "target", "whole", "extra"]
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return plain.select(*columns).unionByName(ended.select(*columns)).select("doc_id", "src", "rank", "size", "source_size", "target", taken.alias("taken"))


def _shared(ends: DataFrame) -> DataFrame:
    """Rows of the few buckets in which a pass ends, with ``extra``, the words of that pass that each gives.

    Rows that are alike share what their class gives, the first of them a word more each
    where it does not go up.  Only their numbers are moved, by class and lot, the part of
    the table they were read from; rows are made from them again.
    """
    of_class = ["name", "src", "doc_id", "rank", "size"]
    lots = ends.groupBy(*of_class, "lot").agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("left", "source_size", "target", "whole")])
    alike, ordered = Window.partitionBy(*of_class), Window.partitionBy("name").orderBy("rank", "size", "doc_id", "lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("rows") * F.col("size")
    lots = lots.withColumn("before", F.sum(words).over(ordered) - words)
    lots = lots.withColumn("start", F.min("before").over(alike)).withColumn("all", F.sum("rows").over(alike))
    lots = lots.withColumn("ahead", F.sum("rows").over(alike.orderBy("lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows"))
    gives = F.least(F.col("all") * F.col("size"), F.greatest(F.lit(0), F.col("left") - F.col("start")))
    lots = lots.withColumn("each", F.floor(gives / F.col("all")).cast("long")).withColumn("more", gives - F.col("each") * F.col("all"))
    first = F.least(F.col("rows"), F.greatest(F.lit(0), F.col("more") - F.col("ahead")))
    kinds = F.array(F.struct(first.alias("n"), (F.col("each") + 1).alias("extra")), F.struct((F.col("rows") - first).alias("n"), F.col("each").alias("extra")))
    made = lots.withColumn("kind", F.explode(kinds)).where("kind.n > 0")
    return made.withColumn("extra", F.col("kind.extra")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("kind.n"))))


def repeated(docs: DataFrame, text: str = "text", share: float = SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; a part of half or more counts as one.  Rows without words stay as they are."""
    taken = _taken(docs, text, share, max_epochs, weights, seed)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(1)).cast("int")
    rank, n, rows, more, lot, at, copy = (fresh(f"_{x}", docs.columns) for x in ("rank", "times", "rows", "more", "lot", "at", "copy"))
    source = fresh("_source", docs.columns)
    key = F.xxhash64("rank", F.coalesce("src", F.lit("")))
    counted = taken.groupBy(key.alias(rank), times.alias(n)).agg(F.count("*").alias(rows))
    # Of rows that are alike the first ``more`` repeat once more than the others.
    of_row = stored(counted.groupBy(rank).agg(F.min(n).alias(n), F.sum(rows).alias(rows), (F.sum(F.col(n) * F.col(rows)) - F.min(n) * F.sum(rows)).alias(more)), "mix-times")
    total = of_row.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    keyed = docs.withColumn(source, rank_of(text, seed)).withColumn(rank, F.xxhash64(F.col(source), F.coalesce("source", F.lit("")))).drop(source)
    met = join_skewed(keyed, of_row.where((F.col(n) > 0) | (F.col(more) > 0)), rank, rows, total)
    mixed = stored(met.where(F.col(more) > 0).withColumn(lot, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "mix-uneven")
    lots = mixed.groupBy(rank, lot).agg(F.count("*").alias("here"))
    ahead = F.sum("here").over(Window.partitionBy(rank).orderBy(lot).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")
    lots = lots.select(F.col(rank), F.col(lot), ahead.alias(copy))
    numbered = mixed.withColumn(at, F.row_number().over(Window.partitionBy(rank, lot).orderBy(at))).join(lots, [rank, lot])
    uneven = numbered.withColumn(n, F.col(n) + (F.col(at) + F.col(copy) <= F.col(more)).cast("int")).where(F.col(n) > 0)
    given = [F.col(f"`{c}`") for c in docs.columns]
    all_rows = met.where(F.col(more) == 0).select(*given, n).union(uneven.select(*given, n))
    return all_rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*given)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
