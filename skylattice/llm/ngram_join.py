"""N-gram Jaccard join over a token-group matrix, and the classes it makes.

Documents are sets of word shingles (hashes of 64 bits).  Two link when their
Jaccard similarity reaches the threshold.  The join is exact:

1. Equal sets are one set, with a count of documents and a number of its own.
2. A set that links shares at least ``ceil(t n)`` of its ``n`` tokens with one
   other set, so it has at most ``n - ceil(t n)`` tokens of its own.  Tokens are
   counted over all sets in the part of the hash range below ``REGION`` (at
   least the first ``n - ceil(t n) + 1`` of a set): sets with more tokens of
   their own there than they may have at all end here.  What is left is counted
   again over the whole range.  A token that several sets of a task have is
   credited to them there and travels once, so a token that very many sets have
   fills no bucket.
3. For the rest the number of sets of each token is known.  With tokens in one
   order, rare ones first, two sets that link share one of the first
   ``s - ceil(t n) + 1`` of their ``s`` shared tokens: their *keys*.  Tokens of
   more than one in ``HOT_PARTS`` of the sets come last in that order without a
   closer count, and are never brought together in one place.
4. Sets are partitioned into groups of similar sets, by their smallest shared
   token, split by hash beyond ``GROUP_TOKENS``.  The matrix of keys and groups
   gives the pairs of groups that share a key; sets that link are in one group
   or in such a pair of groups.
5. Each group's token union is stored.  What two unions have in common bounds the
   overlap of any query set of one group with any set of the other; only pairs
   that reach the bound are opened.  There the bound is taken for each query set,
   and overlaps are counted exactly by products of token-set matrices, a block of
   rows at a time: memory does not depend on how many short sets a group has.

Every link between different sets is met once and counted; out of a group or a
pair of groups come one row a set with its number of links and the smallest set
it hangs together with there, never the pairs.  ``components`` ties these up.

Defined cases: a null text, or one without words, has an empty set, links with
nothing and is its own class.  Fewer words than five are one shingle.  Copies
link.  Rows that repeat a doc_id are documents of their own, with that id; so are
rows without an id, which is no class's smallest: a class in which no row has an
id has none.  Other columns are not read, so none can clash.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, if_small, join_skewed, small_batches, stored, table
from .components import components
from .shingles import shingle_sets

THRESHOLD = 75  # per cent
REGION = 0.4  # of the range of hashes
GROUP_TOKENS = 100_000
#: Tokens a bucket should hold, and the least number of buckets.
BUCKET_TOKENS, LEAST_BUCKETS = 1_000_000, 1024
FLUSH = 500_000
ROW_SEED = 0x51AB
#: A token is hot if more than one in so many sets has it, and at least this many sets.
HOT_PARTS, LEAST_HOT = 1000, 4096
LAST = 1 << 40  # stands for the number of sets of a hot token
#: Cells of a matrix that is held at once when sets of groups are compared.
BLOCK_CELLS = 1_000_000
#: Sets whose counts a task sends in one row, and the least number of such rows.
SLICE_SETS, LEAST_SLICES = 100_000, 512


def own_tokens(n: int, threshold: int) -> int:
    """How many tokens a set of ``n`` that links can have for itself."""
    return n - (threshold * n + 99) // 100


def in_region(tokens: np.ndarray, threshold: int) -> tuple[np.ndarray, int]:
    """The smallest tokens of a sorted set, and how many of them must be shared if it links."""
    inside = int(np.searchsorted(tokens, np.uint64(int(REGION * 2**64))))
    own = own_tokens(len(tokens), threshold)
    return tokens[: max(inside, own + 1)], max(1, inside - own)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that the sets of few texts are held at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def row_key() -> Column:
    """What tells a row from others: two hashes of its id and its text, 128 bits, taken without a copy of the text."""
    named = F.col("doc_id").isNull().cast("int")
    return F.struct(F.xxhash64("doc_id", named, "text").alias("h"), F.xxhash64(F.lit(ROW_SEED), "text", named, "doc_id").alias("g"))


ROW_KEY = "struct<h: bigint, g: bigint>"


def _described(docs: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, row_key, n_shingles, digest, need) of every document."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([in_region(s, threshold)[1] for s in sets], pa.int64()),
                ],
                ["doc_id", "row_key", "n_shingles", "digest", "need"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text").mapInArrow(describe, f"doc_id long, row_key {ROW_KEY}, n_shingles long, digest binary, need long")


def _classes(described: DataFrame) -> DataFrame:
    """(digest, rid, low, row_key, weight, n, need): equal sets, numbered from 0, each with its first row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key"))
    once = described.where("digest is not null").groupBy("digest").agg(first.alias("first"), F.count("*").alias("weight"), F.max("n_shingles").alias("n"), F.max("need").alias("need"))
    once = stored(once.select("digest", F.monotonically_increasing_id().alias("place"), F.col("first.doc_id").alias("low"), F.col("first.row_key").alias("row_key"), "weight", "n", "need"), "sets")
    task, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    at, starts = 0, []
    for r in once.groupBy(task.alias("task")).count().orderBy("task").collect():  # a row a task
        starts.append((r["task"], at))
        at += r["count"]
    offsets = F.broadcast(once.sparkSession.createDataFrame(starts, "task long, first long"))
    classes = stored(once.withColumn("task", task).join(offsets, "task").select("digest", (F.col("first") + within).alias("rid"), "low", "row_key", "weight", "n", "need"), "classes")
    discard(once)
    return classes


def _cut(names: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The columns in parts of equal names, and the names."""
    order = np.argsort(names, kind="stable")
    names = names[order]
    cut = np.flatnonzero(np.diff(names)) + 1
    return names[np.concatenate([[0], cut])], [np.split(c[order], cut) for c in columns]


def _dealt(texts: DataFrame, buckets: int, threshold: int, make: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], whole: bool) -> DataFrame:
    """(bucket, tokens, rids): what ``make`` gives of the tokens of ``texts`` (rid, text), whole sets or their regions, dealt by bucket.

    ``make`` gets the tokens of a few sets and the sets' numbers, and gives (bucket, value, rid) a token or set.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        rids: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, values, r in make(np.concatenate(tokens), np.concatenate(rids)):
                if len(bucket):
                    names, (v, r) = _cut(bucket, values, r)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([packed(x) for x in r], pa.binary())], ["bucket", "tokens", "rids"])

        size = 0
        for part in _slices(batches):
            for rid, t in zip(part.column("rid").to_pylist(), shingle_sets(part.column("text").to_pylist()), strict=True):
                if not whole:
                    t = in_region(t, threshold)[0]
                tokens.append(t)
                rids.append(np.full(len(t), rid, np.int64))
                size += len(t)
            if size >= FLUSH:
                yield from flush()
                tokens, rids, size = [], [], 0
        if size:
            yield from flush()

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.select("rid", "text").mapInArrow(deal, "bucket long, tokens binary, rids binary").repartition(n, "bucket").sortWithinPartitions("bucket")


def slice_of(rids: np.ndarray, slices: int) -> np.ndarray:
    return (rids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % slices


def credited(buckets: int, slices: int) -> Callable:
    """For ``_dealt``: a token that several of the sets have is credited to them (in a slice's bucket, beyond ``buckets``) and sent once, as minus the number of those sets."""

    def make(t: np.ndarray, r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        order = np.argsort(t, kind="stable")
        t, r = t[order], r[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.append(first, len(t)))
        sent = np.where(count > 1, -count, r[first])
        yield (t[first] % np.uint64(buckets)).astype(np.int64), t[first], sent
        rids, counts = np.unique(r[np.repeat(count > 1, count)], return_counts=True)
        yield buckets + slice_of(rids, slices), counts.astype(np.int32), rids

    return make


def by_token(buckets: int, slices: int, hot: Broadcast) -> Callable:
    """For ``_dealt``: tokens go to their bucket, hot ones to a bucket of their set's slice."""

    def make(t: np.ndarray, r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        is_hot = np.isin(t, hot.value)
        cold = ~is_hot
        yield (t[cold] % np.uint64(buckets)).astype(np.int64), t[cold], r[cold]
        yield buckets + slice_of(r[is_hot], slices), t[is_hot], r[is_hot]

    return make


def packed(ids: np.ndarray) -> bytes:
    """Ids as the first and 32-bit steps, where these suffice; else as they are."""
    steps = np.diff(ids)
    if len(steps) and (np.abs(steps) < 2**31).all():
        return b"s" + ids[:1].tobytes() + steps.astype(np.int32).tobytes()
    return b"w" + ids.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if blob[:1] == b"w":
        return np.frombuffer(blob, np.int64, offset=1)
    return np.cumsum(np.concatenate([np.frombuffer(blob, np.int64, 1, 1), np.frombuffer(blob, np.int32, offset=9)]))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """Of each bucket: its values and numbers of sets, as packed."""
    name, values, rids = None, [], []
    for batch in batches:
        for bucket, v, r in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            if bucket != name and values:
                yield name, values, rids
                values, rids = [], []
            name = bucket
            values.append(v)
            rids.append(r)
    if values:
        yield name, values, rids


def _runs(values: list[bytes], rids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens in order, their sets, and which run of equal tokens each belongs to."""
    t = np.concatenate([np.frombuffer(x, np.uint64) for x in values])
    r = np.concatenate([unpacked(x) for x in rids])
    order = np.argsort(t, kind="stable")
    t, r = t[order], r[order]
    return t, r, np.cumsum(np.concatenate([[True], t[1:] != t[:-1]])) - 1


def _sharing(dealt: DataFrame, buckets: int, slices: int, hot: int) -> DataFrame:
    """(rid, shared): how many of a set's tokens other sets have, too; and of each token that more than ``hot`` sets have, (-1, token).

    A task's counts travel packed, in ``slices`` rows by the set's hash, and are added up there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        size = 0
        for name, values, rids in _buckets(batches):
            if name >= buckets:  # credits of a slice
                yield pa.RecordBatch.from_arrays([pa.array([name - buckets] * len(values)), pa.array(rids, pa.binary()), pa.array(values, pa.binary())], ["slice", "rids", "counts"])
                continue
            t, r, run = _runs(values, rids)
            sets = np.bincount(run, np.where(r < 0, -r, 1)).astype(np.int64)
            many = np.unique(t[sets[run] > hot])
            if len(many):
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([packed(many.view(np.int64))], pa.binary()), pa.array([b""], pa.binary())], ["slice", "rids", "counts"])
            found.append(r[(sets[run] > 1) & (r >= 0)])
            size += len(found[-1])
            if size >= FLUSH:
                yield sliced(np.concatenate(found))
                found, size = [], 0
        if size:
            yield sliced(np.concatenate(found))

    def sliced(found: np.ndarray) -> pa.RecordBatch:
        rids, counts = np.unique(found, return_counts=True)
        names, (r, c) = _cut(slice_of(rids, slices), rids, counts.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([packed(x) for x in r], pa.binary()), pa.array([x.tobytes() for x in c], pa.binary())], ["slice", "rids", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rids, counts in _buckets(batches):
            if name < 0:
                tokens = np.concatenate([unpacked(r) for r in rids])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), -1)), pa.array(tokens)], ["rid", "shared"])
                continue
            ids, at = np.unique(np.concatenate([unpacked(r) for r in rids]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([np.frombuffer(c, np.int32) for c in counts]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums.astype(np.int64))], ["rid", "shared"])

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = dealt.mapInArrow(count, "slice long, rids binary, counts binary").repartition(n, "slice").sortWithinPartitions("slice")
    return parts.mapInArrow(total, "rid long, shared long")


def _shared_tokens(dealt: DataFrame, buckets: int) -> DataFrame:
    """(token, rid, sets) of tokens that two or more sets have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, values, rids in _buckets(batches):
            if name >= buckets:  # hot tokens of a slice's sets
                for v, r in zip(values, rids, strict=True):
                    t = np.frombuffer(v, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(unpacked(r)), pa.array(np.full(len(t), LAST))], ["token", "rid", "sets"])
                continue
            t, r, run = _runs(values, rids)
            n = np.bincount(run)[run]
            keep = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(r[keep]), pa.array(n[keep].astype(np.int64))], ["token", "rid", "sets"])

    return dealt.mapInArrow(rows, "token long, rid long, sets long")


class Group:
    """Sets of a group, unpacked: ids, counts of documents, sizes, and all tokens in a row."""

    def __init__(self, rids: bytes, weights: bytes, sizes: bytes, tokens: bytes):
        self.rids, self.weights, self.sizes = np.frombuffer(rids, np.int64), np.frombuffer(weights, np.int64), np.frombuffer(sizes, np.int64)
        self.tokens = np.frombuffer(tokens, np.uint64)
        self.owner = np.repeat(np.arange(len(self.rids)), self.sizes)


def link_blocks(a: Group, b: Group, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which sets of ``a`` link with which of ``b``: (sets of a, sets of b, matrix) for a block of rows at a time.

    A block has ``BLOCK_CELLS`` cells or one row, however many sets the groups have.
    Within one group no set links with itself.
    """
    if a is b:
        union, having = np.unique(a.tokens, return_counts=True)
        union = union[having > 1]
    else:
        union = np.intersect1d(a.tokens, b.tokens)  # what either group's union has of the other's sets
    if not len(union):
        return
    sides = []
    for g, other in ((a, b), (b, a)):
        at = np.searchsorted(union, g.tokens)
        at[at == len(union)] = 0
        hit = union[at] == g.tokens
        bound = np.bincount(g.owner[hit], minlength=len(g.rids))
        query = np.flatnonzero((100 * bound >= threshold * g.sizes) & ((100 + threshold) * bound >= threshold * (g.sizes + other.sizes.min())))
        place = np.full(len(g.rids), -1)
        place[query] = np.arange(len(query))
        row = place[g.owner]
        ok = hit & (row >= 0)
        sides.append((query, row[ok], at[ok]))
    (qa, row_a, at_a), (qb, row_b, at_b) = sides
    if not (len(qa) and len(qb)):
        return
    rows = max(1, BLOCK_CELLS // len(qb))
    for low in range(0, len(qa), rows):
        high = min(low + rows, len(qa))
        first, end = np.searchsorted(row_a, [low, high])
        named = np.unique(at_a[first:end])
        column = np.full(len(union), -1)
        column[named] = np.arange(len(named))
        overlap = np.zeros((high - low, len(qb)), np.float64)
        step = max(1, BLOCK_CELLS // (high - low + len(qb)))
        for left in range(0, len(named), step):
            right = min(left + step, len(named))
            both = []
            for row, at, n in ((row_a[first:end] - low, at_a[first:end], high - low), (row_b, at_b, len(qb))):
                m = np.zeros((n, right - left), np.float32)
                c = column[at]
                ok = (c >= left) & (c < right)
                m[row[ok], c[ok] - left] = 1
                both.append(m)
            overlap += both[0] @ both[1].T
        overlap *= 100 + threshold
        links = overlap >= threshold * (a.sizes[qa[low:high]][:, None] + b.sizes[qb][None, :])
        if a is b:
            links[np.arange(high - low), np.arange(low, high)] = False
        yield qa[low:high], qb, links


def tied(a: Group, b: Group, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of one group or of two, the smallest set each hangs together with by links of ``a`` with ``b``, and the documents it links with."""
    rids = a.rids if a is b else np.concatenate([a.rids, b.rids])
    from_b = 0 if a is b else len(a.rids)
    ranked, label = np.unique(rids, return_inverse=True)
    links = np.zeros(len(rids), np.int64)
    for rows, cols, block in link_blocks(a, b, threshold):
        some = np.flatnonzero(block.any(axis=1))
        if not len(some):
            continue
        as_numbers = block.astype(np.float64)
        links[rows] += np.rint(as_numbers @ b.weights[cols].astype(np.float64)).astype(np.int64)
        if a is not b:
            links[from_b + cols] += np.rint(a.weights[rows].astype(np.float64) @ as_numbers).astype(np.int64)
        for i in some:
            met, own = label[from_b + cols[block[i]]], label[rows[i]]
            if (met != own).any():
                joined = np.zeros(len(ranked), bool)
                joined[met] = joined[own] = True
                label[joined[label]] = min(met.min(), own)
    return rids, ranked[label], links


FOUND = "rid long, low long, links long"


def _found(rids: np.ndarray, low: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    keep = links > 0
    return pa.RecordBatch.from_arrays([pa.array(rids[keep]), pa.array(low[keep]), pa.array(links[keep])], ["rid", "low", "links"])


def _packed(members: DataFrame, texts: DataFrame, n_bytes: int) -> DataFrame:
    """(gid, rids, weights, sizes, tokens): the sets of each group, made from the ``texts`` (rid, text) again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("gid", "rid", "weight")] + [pa.array([s.tobytes() for s in found], pa.binary())], ["gid", "rid", "weight", "tokens"])

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("rid")
        rids, weights = (np.asarray(part.column(c)).astype(np.int64) for c in ("rid", "weight"))
        blobs = part.column("tokens").to_pylist()
        sizes = np.array([len(b) // 8 for b in blobs], np.int64)
        return pa.table({"gid": part.column("gid")[:1], "rids": pa.array([rids.tobytes()], pa.binary()), "weights": pa.array([weights.tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()), "tokens": pa.array([b"".join(blobs)], pa.large_binary()).cast(pa.binary())})

    placed = texts.join(if_small(members, n_bytes), "rid").select("gid", "rid", "weight", "text")
    return placed.mapInArrow(sets, "gid long, rid long, weight long, tokens binary").groupBy("gid").applyInArrow(pack, "gid long, rids binary, weights binary, sizes binary, tokens binary")


def _unions(groups: DataFrame) -> DataFrame:
    """(gid, tokens, least): the token union of each group, and the size of its smallest set."""

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, sizes, tokens in zip(*(batch.column(c).to_pylist() for c in ("gid", "sizes", "tokens")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([gid]), pa.array([np.unique(np.frombuffer(tokens, np.uint64)).tobytes()], pa.binary()), pa.array([int(np.frombuffer(sizes, np.int64).min())])], ["gid", "tokens", "least"])

    return groups.select("gid", "sizes", "tokens").mapInArrow(union, "gid long, tokens binary, least long")


def _qualifying(pairs: DataFrame, unions: DataFrame, n_bytes: int, threshold: int) -> DataFrame:
    """The ``pairs`` of groups whose unions have enough in common for a link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, least_a, least_b in zip(*(batch.column(c).to_pylist() for c in ("tokensa", "tokensb", "leasta", "leastb")), strict=True):
                common = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                keep.append((100 + threshold) * common >= threshold * (least_a + least_b))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("gida"), kept.column("gidb")], ["gida", "gidb"])

    side = lambda s: if_small(unions.select(*[F.col(c).alias(f"{c}{s}") for c in ("gid", "tokens", "least")]), n_bytes)
    return pairs.join(side("a"), "gida").join(side("b"), "gidb").mapInArrow(bound, "gida long, gidb long")


def _within(groups: DataFrame, threshold: int) -> DataFrame:
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                g = Group(r["rids"], r["weights"], r["sizes"], r["tokens"])
                yield _found(*tied(g, g, threshold))

    return groups.select("rids", "weights", "sizes", "tokens").mapInArrow(own, FOUND)


def _between(pairs: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    parts = ("rids", "weights", "sizes", "tokens")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (Group(*(r[f"{p}{side}"] for p in parts)) for side in "ab")
                yield _found(*tied(a, b, threshold))

    side = lambda s: groups.select(F.col("gid").alias(f"gid{s}"), *[F.col(p).alias(f"{p}{s}") for p in parts])
    joined = pairs.join(side("a"), "gida").join(side("b"), "gidb")
    return joined.select(*[f"{p}{s}" for s in "ab" for p in parts]).mapInArrow(both, FOUND)


class Texts:
    """The documents by row key; of rows with one key, one."""

    def __init__(self, docs: DataFrame, described: DataFrame):
        self.keyed = docs.select(row_key().alias("row_key"), "text")
        self.repeats = stored(described.where("digest is not null").groupBy("row_key").count().where("count > 1").select("row_key"), "repeated-rows")
        self.any_repeat = bool(self.repeats.limit(1).count())

    def of(self, sets: DataFrame, n: int) -> DataFrame:
        """(rid, text) of ``n`` ``sets`` (rid, row_key)."""
        met = self.keyed.join(if_small(sets.select("rid", "row_key"), 32 * n), "row_key")
        if not self.any_repeat:
            return met.select("rid", "text")
        once = met.join(self.repeats, "row_key", "left_anti").select("rid", "text")
        return once.union(met.join(self.repeats, "row_key", "left_semi").groupBy("rid").agg(F.first("text").alias("text")))


def _linked(classes: DataFrame, texts: Texts, threshold: int) -> DataFrame:
    """(rid, low, links): of each set that links, a set it hangs together with and the documents it links with; several rows a set."""
    spark = classes.sparkSession
    size = classes.agg(F.count("*").alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    least = F.ceil(F.col("n") * threshold / 100)
    buckets = max(LEAST_BUCKETS, size["tokens"] // BUCKET_TOKENS)
    slices = max(LEAST_SLICES, size["sets"] // SLICE_SETS)
    make = credited(buckets, slices)

    region = _sharing(_dealt(texts.of(classes, size["sets"]), buckets, threshold, make, whole=False), buckets, slices, size["tokens"])
    may = stored(region.join(classes.select("rid", "need", "row_key"), "rid").where("shared >= need").select("rid", "row_key"), "may-link")
    n_may = may.count()
    hot = max(LEAST_HOT, n_may // HOT_PARTS)
    # The texts of the sets that are left are kept, so that all later steps read (and shuffle) no others.
    some = stored(texts.of(may, n_may), "texts-left")
    whole = stored(_sharing(_dealt(some, buckets, threshold, make, whole=True), buckets, slices, hot), "sharing")
    live = stored(whole.join(classes.select("rid", "n", "weight"), "rid").where(F.col("shared") >= least).select("rid", "n", "weight"), "live")
    n_live = live.count()
    # Each is in more than one in HOT_PARTS of the sets, so there are at most HOT_PARTS times the tokens of a mean set.
    tokens = np.sort(whole.where("rid = -1").select("shared").toArrow().column("shared").to_numpy().view(np.uint64))
    discard(may, whole)

    texts_of_live = some.join(if_small(live.select("rid"), 16 * n_live), "rid", "left_semi")
    shared = _shared_tokens(_dealt(texts_of_live, buckets, threshold, by_token(buckets, slices, spark.sparkContext.broadcast(tokens)), whole=True), buckets)
    of_set = Window.partitionBy("rid")
    placed = shared.select("token", "rid", F.row_number().over(of_set.orderBy("sets", "token")).alias("place"), F.count("*").over(of_set).alias("s"), F.min("token").over(of_set).alias("lead"))
    keys = stored(placed.join(if_small(live.select("rid", "n"), 24 * n_live), "rid").where((F.col("s") >= least) & (F.col("place") <= F.col("s") - least + 1)).select("token", "rid", "lead"), "keys")

    leads = stored(keys.select("rid", "lead").distinct().join(live, "rid").select("rid", "lead", "n", "weight"), "leads")
    sizes = leads.groupBy("lead").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets"))
    part = F.pmod(F.xxhash64("rid"), F.ceil(F.col("tokens") / GROUP_TOKENS))
    members = stored(join_skewed(leads, stored(sizes, "lead-sizes"), "lead", "sets", n_live).select("rid", F.xxhash64("lead", part).alias("gid"), "weight"), "members")

    matrix = keys.select("token", "rid").join(if_small(members.select("rid", "gid"), 24 * n_live), "rid").groupBy("token").agg(F.sort_array(F.collect_set("gid")).alias("gids")).where("size(gids) > 1")
    lists = matrix.select("gids").distinct().select("gids", F.posexplode("gids").alias("at", "gida"))
    pairs = stored(lists.select("gida", F.explode(F.expr("slice(gids, at + 2, size(gids))")).alias("gidb")).distinct(), "group-pairs")
    groups = stored(_packed(members, some, 24 * n_live), "groups")
    unions = stored(_unions(groups), "unions")
    union_bytes = unions.agg(F.coalesce(F.sum(F.octet_length("tokens") + 32), F.lit(0))).first()[0]
    opened = stored(_qualifying(pairs, unions, union_bytes, threshold), "opened-pairs")
    found = stored(_within(groups, threshold).union(_between(opened, groups, threshold)), "found")
    discard(some, live, keys, leads, members, pairs, groups, unions, opened)
    return found


def _judged(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, Texts]:
    """The described documents, (digest, component, keeper, links, weight) of their sets, and the texts.

    component is the smallest doc_id of all rows that hang together, and keeper the key of its first row.
    """
    with small_batches(docs.sparkSession):
        return _described_and_known(docs, threshold)


def _described_and_known(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, Texts]:
    described = stored(_described(docs, threshold), "shingles")
    classes = _classes(described)
    texts = Texts(docs, described)
    found = _linked(classes, texts, threshold)
    ties = components(found.select(F.col("rid").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rid").withColumnRenamed("component", "root")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    rows = classes.join(ties, "rid", "left").join(links, "rid", "left")
    rows = stored(rows.select("digest", F.coalesce("root", "rid").alias("root"), "low", "row_key", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "class-links")
    first = F.min(F.struct(F.col("low").isNull().alias("nameless"), "low", "row_key"))
    roots = stored(rows.groupBy("root").agg(first.alias("first"), F.count("*").alias("sets")), "components")
    of_root = roots.select("root", "sets", F.col("first.low").alias("component"), F.col("first.row_key").alias("keeper"))
    known = stored(join_skewed(rows.drop("low", "row_key"), of_root, "root", "sets", rows.count()).select("digest", "component", "keeper", "links", "weight"), "classes-known")
    discard(found, classes, rows, roots)
    return described, known, texts


def ngram_jaccard_join(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links; n_links counts the
    documents that a document links with.
    """
    described, known, _ = _judged(docs.select("doc_id", "text"), threshold)
    met = join_skewed(described.where("digest is not null"), known, "digest", "weight", described.count())
    alone = described.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return met.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("links").cast("long").alias("n_links")).union(alone)


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, its first by doc_id; all columns stay.

    Rows without words are classes of their own and stay.
    """
    described, known, texts = _judged(docs.select("doc_id", "text"), threshold)
    met = join_skewed(described.where("digest is not null"), known, "digest", "weight", described.count())
    gone = stored(met.where("row_key <> keeper").select("row_key").distinct(), "near-copies")
    key = fresh("_row_key", docs.columns)
    keyed = docs.withColumn(key, row_key())
    kept = keyed.join(if_small(gone.withColumnRenamed("row_key", key), 32 * gone.count()), key, "left_anti")
    if texts.any_repeat:  # rows of one id and text: any one of them
        repeats = texts.repeats.withColumnRenamed("row_key", key)
        whole = kept.join(repeats, key, "left_semi").groupBy(key).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
        return kept.join(repeats, key, "left_anti").select(*docs.columns).union(whole)
    return kept.select(*docs.columns)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
