"""Document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by their counts.  For each of
``SAMPLES`` hash functions a term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from
hashes of the term, and with its weight w

    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1).

The sample is the (term, t) of the smallest a.  Two documents agree in a sample
with a probability equal to their generalised Jaccard similarity.  Draws come
from 21-bit slices of two 64-bit hashes; ln a (40 bits) and a hash of (term, t)
are packed into one long, so that a sample is a plain ``min``.

Everything is DataFrame expressions.  Text is shuffled once, by document; the
counts and the samples are aggregated where it lies.

Defined cases: a null text is empty.  A text without words has the fingerprint
of no terms (all ``f``), which is like itself only.  Rows without a doc_id come
after all others.  Of rows that share an id, or have none, each has its own
fingerprint, and the one whose text has the smallest hash stands for the id as
another's next document, with its head and its fingerprint.  A single document is
its own next.  Other columns are not read, so none can clash.  An empty table
gives an empty result.  With ``SAMPLES`` samples the standard error of a likeness
p is sqrt(p (1 - p) / SAMPLES): 0.077 at p = 0.75 and 0.088 at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

SAMPLES = 32
SPACE = r"[\x20\x09-\x0D]+"
LAST = -(2**63)  # stands for a null doc_id
SLICE = (1 << 21) - 1
SALTS = 64  # parts that rows without an id are dealt to


def samples(term: Column, log_weights: list[Column], n: int = SAMPLES) -> list[list[Column]]:
    """For each of ``log_weights`` the packed (ln a, term, t) of each hash function; null where the weight is null.

    The draws depend on the term alone: all weights share them.
    """
    out: list[list[Column]] = [[] for _ in log_weights]
    for k in range(n):
        one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
        u = lambda h, at: (F.shiftrightunsigned(h, at).bitwiseAND(SLICE) + 0.5) / float(SLICE + 1)
        r = -F.ln(u(one, 0) * u(one, 21))
        ln_c = F.ln(-F.ln(u(two, 0) * u(two, 21)))
        b = u(one, 42)
        for mine, log_weight in zip(out, log_weights, strict=True):
            t = F.floor(log_weight / r + b)
            ln_a = ln_c - r * (t - b + 1.0)  # from -100 to 5
            rank = ((ln_a + 200.0) * float(1 << 31)).cast("long")
            mine.append(F.shiftleft(rank, 23).bitwiseOR(F.xxhash64(term, t).bitwiseAND((1 << 23) - 1)))
    return out


def as_text(packed: list[Column]) -> Column:
    """Eight hex digits a sample."""
    return F.concat(*[F.coalesce(F.lpad(F.lower(F.hex(p.bitwiseAND((1 << 32) - 1))), 8, "0"), F.lit("f" * 8)) for p in packed])


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int") for k in range(n)]
    return reduce(lambda x, y: x + y, same) / float(n)


def _terms(texts: DataFrame, keys: list[str], text: str, *more: str) -> DataFrame:
    """(``keys``, ``more``, term) of each word of ``text``; a text without words has one term, null."""
    words = texts.select(*keys, *more, F.explode(F.split(text, SPACE)).alias("word"))
    return words.select(*keys, *more, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))


def _log(count: Column) -> Column:
    """The logarithm of a count; null where there is none."""
    return F.ln(F.when((count > 0) & F.col("term").isNotNull(), count))


def fingerprints(texts: DataFrame, keys: list[str], text: str, n: int = SAMPLES) -> DataFrame:
    """(``keys``, fingerprint) of each row of ``texts``; ``keys`` name a row.

    Where ``texts`` is already dealt out by some of ``keys``, nothing is shuffled.
    """
    counts = _terms(texts, keys, text).groupBy(*keys, "term").agg(F.count("*").alias("count"))
    weighted = counts.select(*keys, "term", _log(F.col("count")).alias("weight"))
    mins = [F.min(s).alias(f"s{k}") for k, s in enumerate(samples(F.col("term"), [F.col("weight")], n)[0])]
    return weighted.groupBy(*keys).agg(*mins).select(*keys, as_text([F.col(f"s{k}") for k in range(n)]).alias("fingerprint"))


def edited_fingerprints(pairs: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """(``keys``, fingerprint, edited_fingerprint) of each row of ``pairs`` (``keys``, text, edited, same).

    The first ``same`` characters of both texts are alike, and a word ends with them: their
    words are split and counted once, and a term of both texts is drawn for once.
    """
    after = lambda c: F.substring(c, F.col("same") + 1, F.length(c))
    pieces = F.array(
        F.struct(F.left("text", F.col("same")).alias("body"), F.lit(1).alias("old"), F.lit(1).alias("new")),
        F.struct(after(F.col("text")).alias("body"), F.lit(1).alias("old"), F.lit(0).alias("new")),
        F.struct(after(F.col("edited")).alias("body"), F.lit(0).alias("old"), F.lit(1).alias("new")),
    )
    sides = pairs.select(*keys, F.explode(pieces).alias("x")).select(*keys, "x.body", "x.old", "x.new")
    counts = _terms(sides, keys, "body", "old", "new").groupBy(*keys, "term").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    weighted = counts.select(*keys, "term", _log(F.col("old")).alias("old"), _log(F.col("new")).alias("new"))
    both = samples(F.col("term"), [F.col("old"), F.col("new")], n)
    mins = [F.min(s).alias(f"{side}{k}") for side, found in zip("sz", both, strict=True) for k, s in enumerate(found)]
    text = lambda side: as_text([F.col(f"{side}{k}") for k in range(n)])
    return weighted.groupBy(*keys).agg(*mins).select(*keys, text("s").alias("fingerprint"), text("z").alias("edited_fingerprint"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, next_key, n) of distinct ``ids`` (key, n): the next smaller key; for the smallest the largest.

    Keys are dealt out by range; a range's neighbours come from the table of its ends.
    """
    ranged = stored(ids.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "ranges")
    by_range = Window.partitionBy("range").orderBy("key")
    ends = ranged.groupBy("range").agg(F.max("key").alias("top"))
    below = F.lag("top").over(Window.partitionBy().orderBy("range"))
    largest = F.max("top").over(Window.partitionBy())
    ends = ends.select("range", F.coalesce(below, largest).alias("below"))
    return ranged.withColumn("next_key", F.lag("key").over(by_range)).join(F.broadcast(ends), "range").select("key", F.coalesce("next_key", "below").alias("next_key"), "n")


def _salted(one: DataFrame) -> DataFrame:
    """``one`` row a key, with the salts its key's rows may have: rows without an id, which may be very many, have ``SALTS``."""
    return one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("key") == LAST, SALTS - 1).otherwise(0))))


def edited_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, salt, row, text, edited, same) of ``docs`` (doc_id, text), and the links (key, next_key, n)."""
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("salt", F.when(F.col("key") == LAST, F.pmod("row", F.lit(SALTS)).cast("int")).otherwise(0))
    sizes = stored(rows.groupBy("key").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows")), "fingerprint-ids")
    links = stored(next_ids(sizes.select("key", "n")), "fingerprint-links")
    wanted = links.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    # The row number is asked for, too, so that this side's shuffle is the one of ``rows`` below.
    need = F.when(F.col("row") >= 0, F.col("need"))
    if sizes.where("rows > 1").limit(1).count():
        heads = rows.join(_salted(wanted), ["key", "salt"]).select(F.col("for_key").alias("key"), F.left("text", need).alias("head"), F.xxhash64("text").alias("mark"))
        heads = heads.groupBy("key").agg(F.min_by("head", "mark").alias("head"))
    else:
        heads = rows.join(_salted(wanted), ["key", "salt"]).select(F.col("for_key").alias("key"), F.left("text", need).alias("head"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("head", half))
    # What both have, up to its last space.
    left = F.left("text", n - half)
    same = F.length(left) - F.length(F.substring_index(left, " ", -1))
    return rows.join(_salted(heads), ["key", "salt"]).select("key", "salt", "row", "text", edited.alias("edited"), same.alias("same")), links


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    pairs, links = edited_pairs(docs)
    name = ["key", "salt", "row"]
    prints = edited_fingerprints(pairs, name)
    # Facts of the texts go with the fingerprints, so that the texts are shuffled for one job only.
    facts = pairs.select(*name, F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("mark"))
    values = ["fingerprint", "edited_fingerprint", "edited_sha256", "n_chars", "mark"]
    both = stored(prints.unionByName(facts, allowMissingColumns=True).groupBy(*name).agg(*[F.max(v).alias(v) for v in values]), "fingerprints")
    of_next = both.groupBy("key").agg(F.min_by("fingerprint", "mark").alias("next_print")).join(links.select(F.col("next_key").alias("key"), F.col("key").alias("for_key")), "key").select(F.col("for_key").alias("key"), "next_print")
    return both.join(_salted(of_next), ["key", "salt"]).select(
        F.when(F.col("key") != LAST, F.col("key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
