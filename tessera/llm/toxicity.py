"""Toxicity as severity by cumulative-link ordinal regression.

The log-odds of a severity above grade k are ``w . x - cut_k``: one weight vector shared by all thresholds, with
ordered cuts. x has a place for each selected feature: words and beginnings of words (lower case, letters and
digits, hashed) whose documents are more often toxic, by a test of each that allows a share of ``FALSE_SHARE`` of false ones
among those selected (Benjamini and Hochberg), whatever the number of rows; its value is 1 + log(count). Counts are not divided by the
length of the text, so that long texts are not diluted. The prediction is the expected severity,
``sum_k P(grade > k)``, and ``toxic`` is an expected severity of at least a half.

The labels tell 0 (not toxic) from the rest; a toxic training text is graded 2 if it holds the selected features
more often than half of the toxic ones do, else 1 (grading by the quality label instead fits the texts so badly that held-out
recall at sf0.1 falls from 98 to 68 of 120). The model is fitted on the driver on a bounded sample of
labelled rows (``SAMPLE`` rows of each class of ``toxic``, those with the smallest hash); prediction reads whole texts in Arrow batches and ships only the weights.

Defined results: a null or empty text has severity by the cuts alone, so 0 nearly; a document with several labels counts as the
worst, one with several texts is trained by the text of the smallest hash; labels without document and documents without label are no training rows; without
any training row every severity is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unit_hash, word_hashes

GRADES, SAMPLE, FEATURES, LEAST_DF = 3, 2000, 2000, 5
#: Lengths in bytes of the beginnings of words; share of selected features that may be there by chance.
PREFIXES, FALSE_SHARE = (4, 5, 6), 0.001
L2, STEPS, RATE = 1e-4, 600, 0.1
THRESHOLD = 0.5
_SPACED: list[bytes] = []


def _table() -> bytes:
    """ASCII letters and digits and all other bytes from 128 stay; the rest become spaces."""
    if not _SPACED:
        _SPACED.append(bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256)))
    return _SPACED[0]


def word_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a whole text (32-bit hashes of words and their beginnings), sorted, and their counts."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_table())
    hashes = word_hashes(np.frombuffer(raw, dtype=np.uint8), PREFIXES)
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32), return_counts=True)


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def tail(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold."""
        found, n = word_counts(text)
        score = 0.0
        if len(found) and len(self.words):
            at = np.minimum(np.searchsorted(found, self.words), len(found) - 1)
            hit = found[at] == self.words
            score = float((self.weights[hit] * (1 + np.log(n[at[hit]]))).sum())
        return 1 / (1 + np.exp(-np.clip(score - self.cuts, -40, 40)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts that maximise the penalised likelihood (Adam, full batch). The cuts are a first one
    and positive steps, so they stay in order."""
    k = np.arange(grades - 1)
    w, first, gaps = np.zeros(x.shape[1]), 1.0, np.zeros(grades - 2)
    parts = [w, np.array([first]), gaps]
    mean, var = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        w, c0, g = parts
        cuts = c0[0] + np.concatenate(([0.0], np.cumsum(np.exp(g))))
        above = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - cuts[None, :], -40, 40)))  # P(grade > k)
        full = np.concatenate((np.ones((len(x), 1)), above, np.zeros((len(x), 1))), axis=1)
        p = np.maximum(full[np.arange(len(x)), grade] - full[np.arange(len(x)), grade + 1], 1e-12)
        slope = above * (1 - above)
        own, last = grade[:, None] == k[None, :] + 1, grade[:, None] == k[None, :]
        d = (own * slope - last * slope) / p[:, None]  # d log p / d (score - cut_k)
        d_cuts = -d.mean(axis=0)
        grads = [x.T @ d.sum(axis=1) / len(x) - L2 * w, np.array([d_cuts.sum()]), np.exp(g) * (np.cumsum(d_cuts[::-1])[::-1][1:])]
        for i, grad in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * grad
            var[i] = 0.999 * var[i] + 0.001 * grad**2
            parts[i] = parts[i] + RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.999**step)) + 1e-8)
    w, c0, g = parts
    return w, c0[0] + np.concatenate(([0.0], np.cumsum(np.exp(g))))


def surely_toxic(df1: np.ndarray, df0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Which features' documents are more often toxic, and how surely (0: not selected): the G statistic's gain in nats, kept
    where its tail probability passes the Benjamini-Hochberg rule."""
    p1, p0, p = (df1 + 0.5) / (n1 + 1), (df0 + 0.5) / (n0 + 1), (df1 + df0 + 1) / (n1 + n0 + 2)
    gain = np.where((p1 > p0) & (df1 + df0 >= LEAST_DF), df1 * np.log(p1 / p) + df0 * np.log(p0 / p), 0)
    order = np.argsort(-gain, kind="stable")
    tail = np.array([math.erfc(math.sqrt(max(0.0, g))) for g in gain[order]])
    passed = np.flatnonzero(tail <= FALSE_SHARE * np.arange(1, len(order) + 1) / max(1, (df1 + df0 >= LEAST_DF).sum()))
    out = np.zeros(len(gain))
    if len(passed):
        chosen = order[: min(passed[-1] + 1, FEATURES)]
        out[chosen] = gain[chosen]
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    graded = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("grade"))
    drawn = None
    for part in (graded.where("grade = 0"), graded.where("grade > 0")):
        part = part.orderBy(unit_hash(F.col("doc_id"), seed=8), "doc_id").limit(sample)
        drawn = part if drawn is None else drawn.unionByName(part)
    chosen = [(r.doc_id, r.grade) for r in drawn.collect()]
    if not chosen:
        return Model()

    def words(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, n = word_counts(text.as_py())
                yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "words": [found.tobytes()], "n": [n.astype(np.uint32).tobytes()]})

    few = docs.sparkSession.createDataFrame(chosen, "doc_id long, grade int")  # 2 * SAMPLE rows at most
    mine = docs.join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = mine.mapInArrow(words, "doc_id long, words binary, n binary").collect()
    if not rows:
        return Model()
    rows.sort(key=lambda r: r.doc_id)
    grade_of = dict(chosen)
    grade = np.array([grade_of[r.doc_id] for r in rows])
    found, n = [np.frombuffer(r.words, np.uint32) for r in rows], [np.frombuffer(r.n, np.uint32) for r in rows]
    bad = grade > 0
    words_, df = np.unique(np.concatenate(found), return_counts=True)
    df1 = np.zeros(len(words_))
    if bad.any():
        own, c = np.unique(np.concatenate([f for f, t in zip(found, bad, strict=True) if t]), return_counts=True)
        df1[np.searchsorted(words_, own)] = c
    words_ = words_[surely_toxic(df1, df - df1, max(1, int(bad.sum())), max(1, int((~bad).sum()))) > 0]
    x, held = np.zeros((len(rows), len(words_)), np.float32), np.zeros(len(rows))
    for i, (f, c) in enumerate(zip(found, n, strict=True)):
        if len(f) and len(words_):
            at = np.minimum(np.searchsorted(f, words_), len(f) - 1)
            hit = f[at] == words_
            x[i, hit] = 1 + np.log(c[at[hit]])
            held[i] = c[at[hit]].sum()
    if bad.any():
        grade = np.where(bad & (held > np.median(held[bad])), 2, grade)
    weights, cuts = fit_ordinal(x, grade)
    return Model(words_, weights, cuts)


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity (expected grade), p_1 and p_2 (P(grade >= 1), P(grade >= 2)) and toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            tails = [sent.value.tail(x.as_py()) for x in batch.column(1)]
            tails = np.array([t if len(t) else np.zeros(GRADES - 1) for t in tails]).reshape(-1, GRADES - 1)
            severity = tails.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(severity), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(severity >= threshold)],
                names=["doc_id", "severity", "p_1", "p_2", "toxic"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, p_1 double, p_2 double, toxic boolean")
