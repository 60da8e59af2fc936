"""Exact ranked lexical search with dual-sorted wavelet trees, one a shard of documents.

A shard is a run of documents in the order of their ids.  Its postings stand list
after list, one list a term, each in falling order of impact.  Over the documents'
places in the shard a wavelet tree is built (the kind that parts the whole sequence
stably by one bit a level), so every list can be followed down to any range of
documents, and in every node a list's postings are still in falling order: the first
one is the greatest.  A node's bound, the sum over the query's terms of weight times
first impact, is thus a true one, and at a leaf it is the document's score.

A query starts at the root; the nodes of the highest bounds are opened, many at a
time, until no unopened node's bound reaches the k-th best score, which a task
carries on from shard to shard.  Nodes whose bound equals it are opened, too, so ties
are settled by id.  Each task gives its k best a query; the k best of those are kept.

An impact is (1000000000 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L; a term's
weight is floor(1000 ln((2 N + 2) / (2 df + 1))).  N, L and df come from all documents.

Defined cases: a null text, or one without terms, is in no list and not counted in N.
Rows without an id, or that repeat one, are documents of their own; those without an
id come after all others in ties and are given with a null id.  Each row of the items
is asked by itself, whatever its id; one without terms finds nothing.  An empty table
of documents or items gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table

K = 20
#: Postings after which a shard is closed; a single document is never cut.
SHARD_POSTINGS = 1_000_000
#: Bytes of the texts of a block of items: what is sent to the driver and broadcast at once.
BLOCK_BYTES = 4_000_000
#: Nodes times terms opened at once, and nodes.
OPENED = 4096
NODES = 128
NO_ID = 2**63 - 1  # stands for a null doc_id
#: Bytes of a term stay, A-Z become small; all others part terms.
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: letters beyond ASCII have bytes from 128 only."""
    return text.translate(_PARTS).split() if text else []


def _bytes(column: pa.Array) -> Iterator[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (x.as_py() for x in column.cast(kind))


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(N, L): the documents with a term, and all their terms."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [n for n in (len(terms(t)) for t in _bytes(batch.column("text"))) if n]
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), pa.array([sum(found)], pa.int64())], ["docs", "terms"])

    r = docs.select("text").mapInArrow(kernel, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return r["docs"] or 0, r["terms"] or 0


class Shard:
    """Postings of some documents: lists by term, impacts in falling order, bits of the tree."""

    SCHEMA = "ids binary, terms array<binary>, starts binary, impacts binary, bits binary"

    def __init__(self, ids: np.ndarray, names: list[bytes], starts: np.ndarray, impacts: np.ndarray, bits: np.ndarray):
        self.ids, self.names, self.starts, self.impacts, self.bits = ids, names, starts, impacts, bits

    @staticmethod
    def build(ids: list[int], found: list[Counter], total_docs: int, total_terms: int) -> Shard:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        known: dict[bytes, int] = {}
        term, doc, often = [], [], []
        lengths = np.zeros(len(ids), np.int64)
        for place, i in enumerate(order):
            c = found[i]
            term += [known.setdefault(t, len(known)) for t in c]
            often += c.values()
            doc.append(len(c))
            lengths[place] = c.total()
        term, often = np.array(term, np.int64), np.array(often, np.int64)
        doc = np.repeat(np.arange(len(ids)), doc)
        m = 75 + np.array([25 * int(n) * total_docs // total_terms for n in lengths], np.int64)
        impact = (1_000_000_000 * often) // (1000 * often + 12 * m[doc])
        by = np.lexsort((doc, -impact, term))  # of equal impacts the smaller place comes first
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(known)))])
        doc = doc[by]
        depth = max(0, int(len(ids) - 1).bit_length())
        bits = np.zeros((depth, len(doc)), bool)
        for level in range(depth):
            bits[level] = (doc >> (depth - 1 - level)) & 1
            doc = np.concatenate([doc[~bits[level]], doc[bits[level]]])
        return Shard(np.array(ids, np.int64)[order], list(known), starts, impact[by].astype(np.int32), bits)

    def row(self) -> tuple:
        return self.ids.tobytes(), self.names, self.starts.astype(np.int64).tobytes(), self.impacts.tobytes(), np.packbits(self.bits, axis=1).tobytes()

    @staticmethod
    def read(ids: bytes, names: list[bytes], starts: bytes, impacts: bytes, bits: bytes) -> Shard:
        found, heights = np.frombuffer(ids, np.int64), np.frombuffer(impacts, np.int32)
        depth = max(0, (len(found) - 1).bit_length())
        packed = np.frombuffer(bits, np.uint8).reshape(depth, -1 if depth else 0)
        return Shard(found, names, np.frombuffer(starts, np.int64), heights, np.unpackbits(packed, axis=1, count=len(heights)).astype(bool) if depth else np.zeros((0, len(heights)), bool))

    def open(self) -> None:
        """Lay out what the search reads: ones before each place, zeros, and impacts, level by level."""
        depth, n = self.bits.shape
        self.depth = depth
        self.ones = np.zeros((max(1, depth), n + 1), np.int32)
        self.high = np.zeros((depth + 1, n + 1), np.int32)  # one place more, which no list has
        self.high[0, :n] = self.impacts
        for level, bit in enumerate(self.bits):
            np.cumsum(bit, out=self.ones[level, 1:])
            self.high[level + 1, :n] = np.concatenate([self.high[level, :n][~bit], self.high[level, :n][bit]])
        self.zeros = n - self.ones[:, -1]
        self.places = {t: i for i, t in enumerate(self.names)}

    def best(self, asked: dict[bytes, int], k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of ``held`` and this shard's documents; ``asked`` has each term's weight."""
        mine = [(self.places[t], w) for t, w in asked.items() if w > 0 and t in self.places]
        if not mine:
            return held
        at, weight = (np.array(x, np.int64) for x in zip(*mine, strict=True))
        low, high = self.starts[at][None, :], self.starts[at + 1][None, :]
        level, place = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self._bounds(level, low, high, weight)
        wide = max(8, min(NODES, OPENED // len(at)))
        scores, ids = held
        self.opened = 0
        while len(bound):
            least = scores[-1] if len(scores) >= k else 1
            fit = bound >= least
            if not fit.all():
                level, place, low, high, bound = level[fit], place[fit], low[fit], high[fit], bound[fit]
            if not len(bound):
                break
            top = np.argpartition(-bound, wide)[:wide] if len(bound) > wide else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[top] = False
            leaf = top[level[top] == self.depth]
            if len(leaf):
                scores, ids = ranked(np.concatenate([scores, bound[leaf]]), np.concatenate([ids, self.ids[place[leaf]]]), k)
            top = top[level[top] < self.depth]
            self.opened += len(top)
            lv = level[top][:, None]
            a, b = self.ones[lv, low[top]], self.ones[lv, high[top]]
            zeros = self.zeros[lv]
            below = level[top] + 1
            left, right = low[top] - a, high[top] - b
            more = [(below, 2 * place[top], left, right), (below, 2 * place[top] + 1, zeros + a, zeros + b)]
            level = np.concatenate([level[rest], below, below])
            place = np.concatenate([place[rest], *(x[1] for x in more)])
            low = np.concatenate([low[rest], *(x[2] for x in more)])
            high = np.concatenate([high[rest], *(x[3] for x in more)])
            bound = np.concatenate([bound[rest], *(self._bounds(x[0], x[2], x[3], weight) for x in more)])
        return scores, ids

    def _bounds(self, level: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
        first = self.high[level[:, None], low]
        return np.where(low < high, first, 0).astype(np.int64) @ weight


def ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:k]
    return scores[keep], ids[keep]


def index(docs: DataFrame, total_docs: int, total_terms: int, postings: int = SHARD_POSTINGS) -> DataFrame:
    """The shards of ``docs`` (doc_id, text), a row each (``Shard.SCHEMA``): every term of every whole text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, held = [], [], 0

        def shard() -> pa.RecordBatch:
            row = Shard.build(ids, found, total_docs, total_terms).row()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.binary(), pa.list_(pa.binary()), *[pa.binary()] * 3], strict=True)], ["ids", "terms", "starts", "impacts", "bits"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), _bytes(batch.column("text")), strict=True):
                c = Counter(terms(text))
                if not c:
                    continue
                if held and held + len(c) > postings:
                    yield shard()
                    ids, found, held = [], [], 0
                ids.append(NO_ID if doc is None else doc)
                found.append(c)
                held += len(c)
        if ids:
            yield shard()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, Shard.SCHEMA)


def _frequencies(shards: DataFrame, asked: set[bytes]) -> dict[bytes, int]:
    """In how many documents each asked term is."""
    shared = shards.sparkSession.sparkContext.broadcast(asked)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for names, starts in zip(batch.column("terms"), batch.column("starts").to_pylist(), strict=True):
                often = np.diff(np.frombuffer(starts, np.int64))
                total.update({t: int(n) for t, n in zip(names.values.to_pylist(), often, strict=True) if t in shared.value})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "df"])

    made = shards.select("terms", "starts").mapInArrow(kernel, "term binary, df long")
    return {bytes(r["term"]): r["df"] for r in made.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def weighted(questions: list[Counter], frequencies: dict[bytes, int], total_docs: int) -> list[dict[bytes, int]]:
    """Of each question the weights of its terms, repeats included; terms of no document have none."""
    one = {t: math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1))) for t, df in frequencies.items()}
    return [{t: one[t] * n for t, n in q.items() if t in one} for q in questions]


def _searched(shards: DataFrame, questions: list[dict[bytes, int]], k: int) -> DataFrame:
    """(item, doc_id, score): of each task and question the k best."""
    shared = shards.sparkSession.sparkContext.broadcast(questions)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        held = [(none, none)] * len(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, names, starts, impacts, bits = (batch.column(c)[i].as_py() for c in ("ids", "terms", "starts", "impacts", "bits"))
                shard = Shard.read(ids, names, starts, impacts, bits)
                shard.open()
                held = [shard.best(q, k, h) for q, h in zip(shared.value, held, strict=True)]
        found = [len(s) for s, _ in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(held)), found), pa.int64()), pa.array(np.concatenate([none, *(d for _, d in held)])), pa.array(np.concatenate([none, *(s for s, _ in held)]))], ["item", "doc_id", "score"])

    return shards.mapInArrow(kernel, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score) of ``items`` (item_id, text) over ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    total_docs, total_terms = sizes(docs)
    with small_batches(spark):
        shards = stored(index(docs, total_docs, total_terms, postings), "search-shards")
    asked = items.select("item_id", "text", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    size = asked.agg(F.coalesce(F.sum(4 * F.col("n") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks > 1:
        asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "search-items")
    found = [_block(shards, asked if blocks == 1 else asked.where(F.col("block") == b), total_docs, k) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block(shards: DataFrame, items: DataFrame, total_docs: int, k: int) -> DataFrame:
    spark = shards.sparkSession
    rows = items.select("item_id", "text").orderBy("item_id", "text").collect()
    questions = [Counter(terms((r["text"] or "").encode())) for r in rows]
    weights = weighted(questions, _frequencies(shards, set().union(*questions)), total_docs)
    with small_batches(spark, 1):  # a shard at a time
        found = stored(_searched(shards, weights, k), "search-found")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
    doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", doc, "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = {
    "op11_ranked_search": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM documents),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS often FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
s AS (SELECT q.item_id, tf.doc_id, sum(q.often * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * l.n * docs) // words))))::BIGINT AS score
      FROM q JOIN tf ON q.term = tf.term JOIN w ON w.term = q.term JOIN lengths l ON l.doc_id = tf.doc_id, whole GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {K}
"""
}
