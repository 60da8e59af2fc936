"""URL filter: blocked Bloom filter of listed prefixes, then an exact hash join.

A listed rule is a host and a path prefix with an action.  Its canonical key is
``host + path``.  Every url is expanded to the few keys a rule could have: for
each *shape* (number of host labels, length of path) that occurs in the list,
one key.  Keys run through a blocked Bloom filter (blocks of eight 64-bit
words, one bit in each); what misses it ends there, and only possible hits go
to an exact join with the list, which removes the false positives.  The longest
rule of a row comes back to it by its row number; rows without a hit never enter
that join's other side.  Only DataFrame functions are used.

Defined cases: a null url, or one without ``://``, has empty host and path, fits
no rule and takes the default verdict.  Repeated urls and repeated page ids are
judged row by row.  An empty list gives every row the default verdict.  Repeated
rules count once; of rules with the same key, ``block`` wins over ``allow``.
Other columns of ``pages`` are not read, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, if_small, stored, table

#: The list of the query contract: action, host, path prefix.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

WORDS = 8
BITS_PER_KEY = 16
#: Bytes up to which the filter or the list is sent to every executor.
BROADCAST = 8_000_000
#: Tasks that the probes of one hot key are dealt to where the list is joined by a shuffle.
SALTS = 16
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """Lower-cased host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def bloom_masks(key: Column) -> list[Column]:
    """One bit in each of the block's words, from six bits of a second hash each."""
    second = F.xxhash64(key, F.lit(0x5BD1E995))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, w0..w7) of the filter over the column ``key``."""
    masks = bloom_masks(F.col("key"))
    return keys.groupBy(bloom_block(F.col("key"), blocks).alias("block")).agg(*[F.bit_or(m).alias(f"w{i}") for i, m in enumerate(masks)])


def possible(probes: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``probes`` (key, ...) without those whose key the filter does not hold."""
    masks = bloom_masks(F.col("key"))
    may = F.lit(True)
    for i, m in enumerate(masks):
        may = may & (F.col(f"w{i}").bitwiseAND(m) == m)
    names = probes.columns
    if 72 * blocks <= BROADCAST:
        met = probes.withColumn("block", bloom_block(F.col("key"), blocks)).join(F.broadcast(bloom), "block")
    else:
        met = _salted(probes.withColumn("block", bloom_block(F.col("key"), blocks)), bloom, "block")
    return met.where(may).select(*names)


def _salted(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Join by ``on`` in ``SALTS`` copies of ``right``: a hot key's rows of ``left`` (row, ...) go to as many tasks."""
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(copies, [on, "salt"]).drop("salt")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Judge ``pages`` (page_id, url) by ``rules`` (action, host, path); longest rule wins."""
    listed = rules.select("action", ascii_lower(F.col("host")).alias("host"), "path", F.concat(ascii_lower(F.col("host")), "path").alias("key")).where("key is not null")
    shapes = [(r["labels"], r["chars"]) for r in listed.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()]
    by_key = listed.groupBy("key").agg(F.max("action").alias("action"))
    size = by_key.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("chars")).first()
    blocks = 1 << max(0, (size["n"] * BITS_PER_KEY // (64 * WORDS)).bit_length())

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row"))
    host, path = F.col("host"), F.col("path")
    keys = [F.when((host != "") & (F.length(path) >= chars), F.concat(F.substring_index(host, ".", -labels), F.left(path, F.lit(chars)))) for labels, chars in shapes]
    if not keys:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    split = stored(split, "urls")  # row numbers are written down, so that both branches below have the same
    probes = split.select("row", F.explode(F.array_compact(F.array(*keys))).alias("key"))

    passed = possible(probes, bloom_filter(by_key, blocks), blocks)
    n_bytes = 2 * size["chars"] + 32 * size["n"]
    hits = passed.join(F.broadcast(by_key), "key") if n_bytes <= BROADCAST else _salted(passed, by_key, "key")
    best = F.max(F.struct(F.length("key").alias("chars"), F.col("key").alias("rule"), F.col("action").alias("action")))
    judged = stored(hits.groupBy("row").agg(best.alias("best")).select("row", "best.rule", "best.action"), "url-hits")
    found = if_small(judged, judged.agg(F.coalesce(F.sum(F.length("rule") * 2 + 40), F.lit(0))).first()[0])
    return split.join(found, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


_FITS = " ".join(f"""
    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{a} {h}{p}'""" for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))

ORACLE = {
    "op6_url_filters": f"""
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (SELECT *, CASE {_FITS} END AS fit FROM parts)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), 'allow') AS verdict FROM judged
"""
}
