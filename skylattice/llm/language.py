"""Language identification by a string kernel.

A text's features are the blended spectrum of its letters: which n-grams of one
to ``N`` letters occur at all (anything that is no letter counts as one space),
hashed into ``DIM`` places.  The kernel of two texts is the number of common
features over the root of the product of their numbers.  Landmarks span a Nystroem map;
one-versus-rest kernel ridge regression is fitted on it.  Since the kernel to a
landmark is linear in the features, landmarks and coefficients are multiplied
once, and a batch of texts is scored by one product of matrices.

The classifier is fitted on a bounded sample: of each label about
``PER_LANGUAGE`` documents, chosen by a hash of the id, with whole texts; landmarks
are drawn from each label in proportion, ``FOR_EACH`` at least.  With
many labels each has an equal part of ``SAMPLE`` documents, ``LEAST`` at least.
Labels, sources and ids are no features.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and
so is every text if there is nothing to learn from; the stage (``identified``)
then keeps all that has a letter, and otherwise what some language fits.  A null id is not held out.
Repeated rows are judged one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

N = 3
DIM = 1 << 15
PER_LANGUAGE = 400
#: Documents of all labels together, and of each label however many there are.
SAMPLE, LEAST = 38_400, 20
#: Landmarks, and the least number for each label.
LANDMARKS, FOR_EACH = 160, 2
RIDGE = 1e-3
#: Best score under which the stage rejects a text: no language it has learnt fits.  One-versus-rest scores
#: are near 1 for a text of the language, and those of other scripts and of noise near 0.
LEAST_SCORE = 0.1
SEED = 71
UNKNOWN = "und"
BATCH = 64


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # (DIM, labels): landmarks times coefficients


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def features(text: str | None) -> np.ndarray | None:
    """Presence of the hashed n-grams; None where there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return None
    found = np.zeros(DIM, bool)
    x = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for n in range(1, N + 1):
        h = (h[: len(x) - n + 1] + x[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        found[(h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15)).astype(np.int64)] = True
    return found


def unpacked(bits: list[bytes]) -> np.ndarray:
    """Features of texts divided by the root of their number, a row a text."""
    found = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)
    x = found.astype(np.float32)
    x /= np.sqrt(np.maximum(1, found.sum(axis=1, dtype=np.float32)))[:, None]
    return x


def chosen_landmarks(labels: list[str], most: int) -> list[int]:
    """Places of the landmarks: of each label its share of ``most``, ``FOR_EACH`` at least, spread over its texts."""
    places: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        places.setdefault(label, []).append(i)
    out: list[int] = []
    for mine in places.values():
        n = min(len(mine), max(FOR_EACH, round(most * len(mine) / len(labels))))
        out += [mine[i] for i in np.unique(np.linspace(0, len(mine) - 1, n).astype(int))]
    return sorted(out)


def fit(bits: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression over a Nystroem map; ``bits`` has the packed features of each text."""
    names = sorted(set(labels))
    landmarks = max(landmarks, FOR_EACH * len(names))
    marks = unpacked([bits[i] for i in chosen_landmarks(labels, landmarks)])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    ok = values > 1e-6 * values.max()
    whiten = vectors[:, ok] / np.sqrt(values[ok])
    mapped = np.concatenate([(unpacked(bits[low : low + BATCH]) @ marks.T).astype(np.float64) @ whiten for low in range(0, len(bits), BATCH)])
    target = np.zeros((len(labels), len(names)))
    at = {name: i for i, name in enumerate(names)}
    target[np.arange(len(labels)), [at[label] for label in labels]] = 1.0
    beta = np.linalg.solve(mapped.T @ mapped + ridge * len(bits) * np.eye(mapped.shape[1]), mapped.T @ target)
    return Model(names, (marks.T.astype(np.float64) @ (whiten @ beta)).astype(np.float32))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    for low in range(0, len(texts), BATCH):
        found = [(i, f) for i, f in enumerate(map(features, texts[low : low + BATCH]), low) if f is not None]
        if not found:
            continue
        x = np.stack([f for _, f in found])
        out = x.astype(np.float32) @ model.weights / np.sqrt(x.sum(axis=1, dtype=np.float32))[:, None]
        for (i, _), row in zip(found, out, strict=True):
            at = int(row.argmax())
            langs[i], scores[i] = model.labels[at], float(min(1.0, max(0.0, row[at])))
    return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model | None:
    """The model of ``docs`` (doc_id, text, lang), learnt from labelled rows that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rank = F.xxhash64("doc_id", "text", F.lit(SEED))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min(rank).alias("first")).orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return None
    chance = F.pmod(rank, F.lit(1_000_003)) / 1_000_003.0
    each = max(LEAST, min(PER_LANGUAGE, SAMPLE // len(counts)))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, each / r["count"]))])
    first = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], r["first"])])
    # Rows that are alike are drawn together and count once; a label's first row is always drawn.
    drawn = labelled.where((chance < F.element_at(share, F.col("lang"))) | (rank == F.element_at(first, F.col("lang"))))
    chosen = drawn.groupBy("lang", rank.alias("rank")).agg(F.first("text").alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part.slice(low, BATCH) for part in batches for low in range(0, part.num_rows, BATCH)):
            found = [features(t) for t in batch.column("text").to_pylist()]
            keep = [i for i, f in enumerate(found) if f is not None]
            yield pa.RecordBatch.from_arrays([batch.column("rank").take(pa.array(keep, pa.int64())), batch.column("lang").take(pa.array(keep, pa.int64())), pa.array([np.packbits(found[i]).tobytes() for i in keep], pa.binary())], ["rank", "lang", "bits"])

    rows = chosen.select("rank", "lang", "text").mapInArrow(kernel, "rank long, lang string, bits binary")
    # Twice what is expected, which a sample does not come near.
    got = sorted(rows.limit(2 * max(SAMPLE, each * len(counts))).collect())
    if not got:
        return None
    return fit([bytes(r["bits"]) for r in got], [r["lang"] for r in got])


def with_language(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score as further columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for batch in (part.slice(low, BATCH) for low in range(0, part.num_rows, BATCH)):
                yield judged(batch)

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = predict(shared.value, batch.column(text).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(kernel, schema)


def identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without those the classifier rejects: no letter in the text, or a best score under ``least``.

    Where there is no model, only texts without a letter go.
    """
    lang, score = fresh("_language_of_text", docs.columns), fresh("_language_score", docs.columns)
    model = train(docs)
    if model is None:
        model, least = Model([""], np.zeros((DIM, 1), np.float32)), 0.0  # tells only whether there is a letter
    judged = with_language(docs, model, lang, score)
    return judged.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = with_language(docs.select("doc_id", "text"), train(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
