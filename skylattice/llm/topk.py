"""Exact top-k search by a three-phase uniform threshold.

A score is the sum of ``LISTS`` partial scores, one for each slice of the
vectors' components.  Queries are taken in blocks of bounded size; for a block

1. every task gathers, for each query, the k best entries of each of its local
   score lists and scores only these whole; the k-th best of all tasks is a lower
   bound of the final k-th score;
2. that cutoff is broadcast.  An entry that reaches it has an equal share of it in
   at least one list, so each list is read down to that depth only: the entries
   above it are *seen*.  What a seen entry can reach (its known scores, and for
   each other list less than the depth) must reach the task's own k-th best as
   well, which rises as entries are resolved; the rest is dropped unresolved;
3. the remaining entries' missing scores are looked up, exactly, and those that
   reach the cutoff are ranked.

Vectors are turned into integers, floor(64 x).  Products are made by matrix
multiplication in 64-bit floats where all sums stay under 2^53, else in integers;
where a sum could pass 64 bits the job fails instead of giving a wrong score.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows with a null id.  Vectors shorter than the longest count as
if filled up with zeros.  A query's own row is every row of its id.  Other rows
that repeat an id are candidates of their own.  Ties go to the smaller id.  With
fewer than k candidates all are returned.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

K = 20
LISTS = 4
SCALE = 64
#: Bytes of a block of queries: what is sent to the driver and broadcast at once.
BLOCK_BYTES = 8_000_000
ROWS = 2048  # candidates scored at a time
CELLS = 4_000_000  # scores held at a time
LOWEST = np.iinfo(np.int64).min


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v) with integer components, of the vectors that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.where("vec_id is not null and embedding is not null").where(fine)
    scaled = lambda e: e.cast("double") * SCALE
    whole = lambda e: F.when(F.abs(scaled(e)) < 2.0**62, F.floor(scaled(e))).otherwise(F.raise_error(F.lit("a component passes 64 bits")).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, whole).cast("array<long>").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of integers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def partial_scores(queries: np.ndarray, rows: np.ndarray, lists: int) -> list[np.ndarray]:
    """Of each list: scores of ``queries`` against ``rows``."""
    edge = np.linspace(0, queries.shape[1], lists + 1).astype(int)
    top = max(1, *(abs(int(f(queries, initial=0))) for f in (np.max, np.min))) * max(1, *(abs(int(f(rows, initial=0))) for f in (np.max, np.min))) * max(1, queries.shape[1])
    if top >= 2**63:
        raise OverflowError("an inner product could pass 64 bits")
    if top < 2**53:
        q, r = queries.astype(np.float64), rows.astype(np.float64).T
        return [q[:, a:b] @ r[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return [queries[:, a:b] @ rows[:, a:b].T for a, b in zip(edge[:-1], edge[1:], strict=True)]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(vectors: DataFrame, k: int = K, every: int = 20, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every`` its k best others."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    size = rows.agg(F.max(F.size("v")).alias("width"), F.count_if(F.col("id") % every == 0).alias("queries")).first()
    width, n = size["width"] or 1, size["queries"]
    per_block = max(1, BLOCK_BYTES // (8 * width + 8))
    blocks = -(-n // per_block)
    asked = rows.where(F.col("id") % every == 0)
    results = []
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        got = mine.toArrow().sort_by("id")
        if not got.num_rows:
            continue
        names = got.column("id").to_numpy()
        column = got.column("v").combine_chunks()
        shared = spark.sparkContext.broadcast((names, matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, width)))
        first = _gathered(rows, shared, width, k, lists)
        cutoff = np.full(len(names), LOWEST)
        for r in first.groupBy("at").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("kth")).where("size(kth) > 0").select("at", F.col("kth")[0].alias("kth")).collect():
            cutoff[r["at"]] = r["kth"]
        results.append(_collected(rows, shared, spark.sparkContext.broadcast(cutoff), width, k, lists))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    order = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _tiles(batches: Iterator[pa.RecordBatch], queries: np.ndarray, width: int, lists: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(first query, ids of rows, partial scores) of all queries against all rows, piece by piece."""
    wide = max(1, CELLS // (ROWS * lists))
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            ids, values = part.column("id").to_numpy(), matrix(part.column("v"), width)
            for at in range(0, len(queries), wide):
                yield at, ids, partial_scores(queries[at : at + wide], values, lists)


class Lists:
    """The score lists of a tile: of each query, its partial scores against some rows."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        self.resolved = 0  # entries whose whole score was made

    def whole(self, query: int, places: np.ndarray) -> np.ndarray:
        """Whole scores of the entries at ``places``: the lists looked up one by one."""
        self.resolved += len(places)
        return sum(p[query, places] for p in self.parts).astype(np.int64)

    def heads(self, k: int) -> np.ndarray:
        """Places of the k best entries of each list, a row a query."""
        n = self.parts[0].shape[1]
        return np.concatenate([np.argpartition(p, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(p), 1)) for p in self.parts], axis=1)

    def down_to(self, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries that some list has at its query's depth or above (a matrix), and what they can reach at most.

        An entry's unseen scores are below the depth; depths are whole numbers or -inf.
        """
        depth = depths[:, None]
        seen = np.zeros(self.parts[0].shape, bool)
        most = np.zeros(self.parts[0].shape)
        for p in self.parts:
            at = p >= depth
            seen |= at
            most += np.where(at, p, depth - 1)
        return seen, most


def _gathered(rows: DataFrame, shared, width: int, k: int, lists: int) -> DataFrame:
    """Phase 1: (at, score), of each task the k best whole scores among the best entries of each list."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        held = [np.empty(0, np.int64)] * len(names)
        for at, ids, parts in _tiles(batches, queries, width, lists):
            tile = Lists(parts)
            for i, places in enumerate(tile.heads(k)):
                p = np.unique(places)
                s = np.concatenate([held[at + i], tile.whole(i, p[ids[p] != names[at + i]])])
                held[at + i] = np.partition(s, len(s) - k)[len(s) - k :] if len(s) > k else s
        sizes = [len(s) for s in held]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(names)), sizes).astype(np.int32)), pa.array(np.concatenate(held))], ["at", "score"])

    return rows.mapInArrow(gather, "at int, score long")


def sufficient(tile: Lists, ids: np.ndarray, names: np.ndarray, cutoff: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
    """Phases 2 and 3 for a tile: adds to ``held`` (ids, scores) of each query its entries that reach ``cutoff``, the k best at most."""
    lists = len(tile.parts)
    known = np.array([max(int(c), int(s.min())) if len(s) >= k else int(c) for c, (_, s) in zip(cutoff, held, strict=True)], np.int64)
    some = known != LOWEST  # of a query without k candidates every entry counts
    depth = np.where(some, -(-known // lists), -np.inf)
    seen, most = tile.down_to(depth)
    seen &= most >= np.where(some, known, -np.inf)[:, None]
    seen &= ids[None, :] != names[:, None]
    for i in np.flatnonzero(seen.any(axis=1)):
        p = np.flatnonzero(seen[i])
        a, b = held[i]
        s = tile.whole(i, p)
        fit = s >= known[i]
        a, b = np.concatenate([a, ids[p[fit]]]), np.concatenate([b, s[fit]])
        keep = best(a, b, k)
        held[i] = (a[keep], b[keep])


def _collected(rows: DataFrame, shared, cutoffs, width: int, k: int, lists: int) -> DataFrame:
    """Phases 2 and 3: (query_id, copy, vec_id, score) of entries that reach the cutoff, each task's k best at most."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        cutoff = cutoffs.value
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        held = [none] * len(names)
        for at, ids, parts in _tiles(batches, queries, width, lists):
            end = at + len(parts[0])
            mine = held[at:end]
            sufficient(Lists(parts), ids, names[at:end], cutoff[at:end], mine, k)
            held[at:end] = mine
        sizes = [len(a) for a, _ in held]
        if sum(sizes):
            first = np.searchsorted(names, names)  # ids that repeat among the queries
            copy = np.repeat(np.arange(len(names)) - first, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes)), pa.array(copy.astype(np.int32)), pa.array(np.concatenate([a for a, _ in held])), pa.array(np.concatenate([b for _, b in held]))], ["query_id", "copy", "vec_id", "score"])

    return rows.mapInArrow(collect, "query_id long, copy int, vec_id long, score long")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = {
    "op10_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
}
