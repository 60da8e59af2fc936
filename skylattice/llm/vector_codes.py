"""Vector codes: a codebook for each part of the vectors, learnt in integers, so that every run gives the same bytes.

A component x becomes floor(4096 x).  Vectors are cut into ``PARTS`` equal parts;
each part position has a codebook of ``ENTRIES`` entries, which begins as that part
of the first vectors by id.  In each of ``ROUNDS`` rounds the codebooks, which are
small whatever the table's size, are broadcast; Arrow batches compute all distances
by |x|^2 - 2 x.c + |c|^2 with exact 64-bit integer matrix products and take the
first smallest; the sums of each entry's parts leave a task as one row a component
and are merged by a grouped shuffle.  What comes back to the driver has the size of
the codebooks.

Defined cases: vectors that are null or hold null or non-finite components take no
part.  Vectors shorter than the longest, and all if the longest cannot be cut into
``PARTS`` equal parts, count as if filled up with zeros.  Rows without an id are
coded but begin no entry; of rows that share an id each is a row of its own, in the
order of their vectors.  With fewer vectors than entries the codebooks have as many
entries as there are vectors with an id; with none, one entry of zeros.  Where
distances could pass 64 bits, Python's integers take the place of NumPy's; an error
beyond 2^63 - 1, or a label's sum beyond it, is given as 2^63 - 1.  An empty table
gives an empty result.  Other columns are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, join_skewed, stored, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096.0
MOST = 2**63 - 1
LIMB = 32  # bits of a sum that one row carries
#: Bytes that a label's row is taken to have where a broadcast is weighed.
LABEL_BYTES = 64


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the vectors that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(x.isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("v"))


def whole(rows: np.ndarray) -> np.ndarray:
    """floor(4096 x) of finite doubles: 64-bit integers where they are sure to do, else Python's."""
    if not rows.size or np.abs(rows).max() < 2.0**40:
        return np.floor(rows * SCALE).astype(np.int64)
    big = lambda x: int(x) * int(SCALE) if abs(x) >= 2.0**53 else int(np.floor(x * SCALE))
    return np.array([big(float(x)) for x in rows.flat], object).reshape(rows.shape)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, whole, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return whole(out)


def exact(*values: np.ndarray) -> list[np.ndarray]:
    """Arrays in which no distance between their rows can pass 64 bits."""
    most = max((int(max(abs(int(v.max())), abs(int(v.min())))) for v in values if v.size), default=0)
    kind = np.int64 if 4 * max(1, values[0].shape[-1]) * most * most < 2**62 else object
    return [v.astype(kind) for v in values]


def nearest(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances), a column a part, of ``rows`` for ``books`` (part, entry, component)."""
    parts, entries, wide = books.shape
    rows, books = exact(rows, books)
    codes = np.zeros((len(rows), parts), np.int64)
    far = np.zeros((len(rows), parts), rows.dtype)
    for p in range(parts if wide else 0):
        x, c = rows[:, p * wide : (p + 1) * wide], books[p]
        distances = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        codes[:, p] = distances.argmin(axis=1)
        far[:, p] = distances[np.arange(len(x)), codes[:, p]]
    return codes, far


def sums(rows: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """(part, entry, 1 + component) of how many parts each entry has and their sums; Python integers."""
    n, parts = codes.shape
    wide = rows.shape[1] // parts
    out = np.zeros((parts, entries, 1 + wide), object)
    for p in range(parts):
        mine = (codes[:, p][None, :] == np.arange(entries)[:, None]).astype(rows.dtype if rows.dtype == object else np.int64)
        out[p, :, 0] = mine.sum(axis=1)
        out[p, :, 1:] = mine @ rows[:, p * wide : (p + 1) * wide]
    return out


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as the sum of part << (LIMB * place): only the last part may be negative."""
    place = 0
    while not -(2**31) <= value < 2**31:
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    yield place, value


def round_of(rows: DataFrame, width: int, books: np.ndarray) -> np.ndarray:
    """The codebooks after one more round over all ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros((known.shape[0], known.shape[1], 1 + known.shape[2]), object)
        for batch in batches:
            x = matrix(batch.column("v"), width)
            total += sums(x, nearest(x, known)[0], known.shape[1])
        found = [(p, e, at, place, part) for (p, e, at), value in np.ndenumerate(total) if value for place, part in limbs(int(value))]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True) if found else [()] * 5, [pa.int32()] * 4 + [pa.int64()], strict=True)], ["part", "entry", "at", "place", "total"])

    made = rows.select("v").mapInArrow(kernel, "part int, entry int, at int, place int, total long")
    total = np.zeros((books.shape[0], books.shape[1], 1 + books.shape[2]), object)
    for r in made.groupBy("part", "entry", "at", "place").agg(F.sum("total").alias("total")).collect():
        total[r["part"], r["entry"], r["at"]] += r["total"] << (LIMB * r["place"])
    shared.unpersist()
    used = total[:, :, 0] > 0
    out = books.copy()
    out[used] = total[used][:, 1:] // total[used][:, :1]
    return out


def learnt(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of ``rows`` (vec_id, v), as Python integers."""
    first = rows.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "v").limit(entries).select("v").toArrow()
    found = [matrix(c, width) for c in first.column("v").chunks if len(c)]
    start = np.concatenate(found).astype(object) if found else np.zeros((1, width), object)
    books = start.reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = round_of(rows, width, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.flat).encode()).hexdigest()


def coded(rows: DataFrame, width: int, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of ``rows`` (vec_id, label, v)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{e:02x}" for e in range(shared.value.shape[1])], object)
        for batch in batches:
            codes, far = nearest(matrix(batch.column("v"), width), shared.value)
            errors = [min(MOST, int(e)) for e in far.sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(list(names[codes].sum(axis=1)), pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(kernel, f"vec_id long, label {label}, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, embedding, label)."""
    rows = stored(usable(vectors), "code-vectors")
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts) * parts
    books = learnt(rows, width, parts, entries, rounds)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")  # null-safe
    codes = stored(coded(rows, width, books).select("*", key), "codes")
    most = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)"))
    by_label = stored(codes.groupBy("key").agg(most.cast("long").alias("label_error"), F.count("*").alias("rows")), "code-labels")
    size = by_label.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    if size["n"] * LABEL_BYTES <= 8e6:
        met = codes.join(if_small(by_label, size["n"] * LABEL_BYTES), "key")
    else:
        met = join_skewed(codes, by_label, "key", "rows", size["rows"])
    return met.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("label")


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds one after another; sums of integers stay under 2^53 in doubles."""

    def assigned(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (SELECT x.r, x.p, min((list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v))::HUGEINT * {entries} + b.e) AS best
        FROM x JOIN b{k} b ON x.p = b.p GROUP BY x.r, x.p)"""

    steps = []
    for k in range(rounds):
        steps += [
            assigned(k),
            f"""
s{k} AS MATERIALIZED (SELECT p, e, j, floor(sum(c) / count(*)) AS c
        FROM (SELECT x.p, (a.best % {entries})::INT AS e, unnest(x.v) AS c, generate_subscripts(x.v, 1) AS j FROM x JOIN a{k} a ON x.r = a.r AND x.p = a.p) GROUP BY ALL)""",
            f"""
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v
        FROM b{k} b LEFT JOIN (SELECT p, e, list(c ORDER BY j) AS v FROM s{k} GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)""",
        ]
    return f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda q: floor(4096 * q::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda q: q IS NULL OR NOT isfinite(q))) = 0),
x AS MATERIALIZED (SELECT r, vec_id, p::INT AS p, v[(p * len(v) // {parts} + 1)::INT:((p + 1) * len(v) // {parts})::INT] AS v FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, (r - 1)::INT AS e, v FROM x WHERE r <= {entries} AND vec_id IS NOT NULL),{",".join([*steps, assigned(rounds)])},
books AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM b{rounds})),
coded AS (SELECT r, string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256 FROM kept k JOIN coded c ON k.r = c.r, books
"""


ORACLE = {"op13_vector_codes": _sql()}
