"""Language identification by nearest centroid.

A text's vector holds the character 1-, 2- and 3-grams of its letters (lower case, everything else one
space), hashed to ``DIMS`` places, as sublinear TF times IDF, with length 1. Each language has several
centroids, found by clustering its training vectors by cosine; a text gets the language of the nearest one.
The score is that cosine. Distance decides on rejection: a text is rejected if its similarity to the nearest centroid is below
``SLACK`` times what all but ``QUANTILE`` of the language's training texts of about as many different n-grams reach (short texts are
further from any centroid than long ones, so a foreign text of some length is rejected where a short native one is not).

The classifier is fitted on the driver on a bounded sample: at most ``PER_LANGUAGE`` labelled rows of each
language, those with the smallest hash. Prediction sees the text alone, whole, in Arrow batches; the model
(``CENTROIDS`` vectors a language) is the only thing sent to executors.

Defined results: a null text or one without letters is `und` with score 0 and rejected; repeated rows are
predicted alike; without any labelled row everything is `und`; an empty table gives an empty result; other
columns are never inputs, and ``keep_known`` hands them on, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unit_hash

DIMS, CENTROIDS, PER_LANGUAGE, ROUNDS = 4096, 4, 600, 12
#: Labels that a model tells apart: those with the most rows.
MOST_LANGUAGES = 1000
SLACK, QUANTILE = 0.8, 0.005
#: Sizes of texts for rejection: powers of two of different n-grams; a size takes in its neighbours until it has so many texts.
SIZES, LEAST_TEXTS = 13, 50
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    letter = np.concatenate(([False], letter, [False]))
    points = np.where(letter, np.concatenate(([0], points, [0])), 32).astype(np.uint32)
    start = np.ones(len(points), dtype=bool)
    start[1:] = letter[1:] | letter[:-1]  # one space for a run of others
    points = points[start]
    a = points * np.uint32(2654435761)
    b = a[:-1] ^ (points[1:] * np.uint32(2246822519) + np.uint32(374761393))
    c = (b[:-1] * np.uint32(3266489917)) ^ (points[2:] * np.uint32(668265263))
    out = np.zeros(DIMS, dtype=np.int64)
    for grams in (a, b * np.uint32(3266489917), c * np.uint32(2654435761)):
        out += np.bincount(grams >> np.uint32(20), minlength=DIMS)
    return out


def sublinear(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def size_of(grams):
    return np.minimum(np.log2(np.maximum(grams, 1)).astype(np.int64), SIZES - 1)


def scales(near: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The similarity that all but QUANTILE of the training texts of each size reach. Below the smallest size seen it falls
    with the root of the number of n-grams, as the cosine of a part of a text does."""
    size, out = size_of(grams), np.zeros(SIZES)
    for b in range(SIZES):
        reach = 0
        while (np.abs(size - b) <= reach).sum() < min(LEAST_TEXTS, len(size)):
            reach += 1
        out[b] = np.quantile(near[np.abs(size - b) <= reach], QUANTILE) * 2.0 ** (-max(0, size.min() - b) / 2)
    return out


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)  # of each centroid
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    least: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZES)))  # of each centroid and size of text
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMS, np.float32))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        n = counts(text)
        if n is None or not self.languages:
            return UNKNOWN, 0.0, True
        near = self.centroids @ _unit(sublinear(n) * self.idf)
        k = int(near.argmax())
        return self.languages[k], float(min(1.0, max(0.0, near[k]))), bool(near[k] < self.least[k, size_of(np.count_nonzero(n))])


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids by cosine: farthest-first starts, then Lloyd rounds. Deterministic."""
    centres = [_unit(x.mean(axis=0))]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([_unit(x[own == j].mean(axis=0)) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def train(docs: DataFrame, trainable: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows of ``docs`` where ``trainable`` holds and lang is not null."""
    rows = docs.where(trainable & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", unit_hash(F.col("doc_id"), F.col("text")).alias("u"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return Model()
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.5 * (per_language + 20) / n)).otherwise(share)

    def vectors(batches):
        for batch in batches:
            for lang, u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (n := counts(text)) is not None:
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "u": [u], "v": [sublinear(n).astype(np.float16).tobytes()]})

    # Rows repeated with the same id and text count once; then those with the smallest hashes of each language.
    drawn = rows.where(F.col("u") < share).groupBy("lang", "u").agg(F.first("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    drawn = drawn.withColumn("place", first).where(F.col("place") <= per_language + 20).select("lang", "u", "text")
    found = drawn.mapInArrow(vectors, "lang string, u double, v binary").collect()
    found.sort(key=lambda r: (r.lang, r.u, r.v))
    by: dict[str, list[np.ndarray]] = {}
    for r in found:
        if len(own := by.setdefault(r.lang, [])) < per_language:
            own.append(np.frombuffer(r.v, dtype=np.float16))
    every = np.stack([v for own in by.values() for v in own]).astype(np.float32) if by else np.zeros((0, DIMS), np.float32)
    if not len(every):
        return Model()
    idf = np.log((1 + len(every)) / (1 + (every > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model(idf=idf)
    centroids, least = [], []
    for lang, own in sorted(by.items()):
        x = _unit(np.stack(own).astype(np.float32) * idf)
        c = cluster(x, CENTROIDS)
        near = (x @ c.T).max(axis=1)
        model.languages += [lang] * len(c)
        centroids.append(c)
        least += [SLACK * scales(near, (x > 0).sum(axis=1))] * len(c)
    model.centroids, model.least = np.concatenate(centroids).astype(np.float32), np.stack(least)
    return model


def _sent(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(model)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected, a row for each row of ``docs``."""
    sent = _sent(docs, model)

    def run(batches):
        for batch in batches:
            found = [sent.value.predict(x.as_py()) for x in batch.column(1)]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with its columns; no join, no shuffle."""
    sent, at = _sent(docs, model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not sent.value.predict(x.as_py())[2] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def held_out() -> Column:
    """Rows that no training sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
