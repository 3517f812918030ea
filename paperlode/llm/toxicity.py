"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w.x) with one weight vector for all thresholds, which stay ordered. Features
are counts of distinct words and of distinct words with a prefix of four or five letters, hashed; an L1 penalty
leaves few of them, none negative. The expected severity is the sum over k of P(grade > k).
"""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, held, trim
from .token_ids import groups

#: Labelled rows that the fit may take from each side (graded 0, graded above). Scoring and everything else see all rows.
FIT_CLEAN, FIT_GRADED = 6000, 3000
FEATURES = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[int]:
    from xxhash import xxh32_intdigest

    keys = [word] if len(word) < 5 else [word, "^" + word[:4], "^" + word[:5]]
    return [xxh32_intdigest(k) & (FEATURES - 1) for k in keys]


#: Entries of a sparse matrix that are worked on at once: what lies between is as large as these, not as the matrix.
ENTRIES_EACH = 1 << 18


class Rows(NamedTuple):
    """A sparse matrix by rows; a row's features are distinct."""

    index: np.ndarray
    value: np.ndarray
    begin: np.ndarray

    def blocks(self):
        """(first row, row after the last, their entries) of successive rows with about ENTRIES_EACH entries."""
        a, n = 0, len(self.begin) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.begin, self.begin[a] + ENTRIES_EACH, "right")) - 1)
            yield a, b, slice(int(self.begin[a]), int(self.begin[b]))
            a = b

    def by_row(self, of) -> np.ndarray:
        """For each row the sum of what `of` gives for its entries."""
        out = np.zeros(len(self.begin) - 1)
        for a, b, at in self.blocks():
            sums = np.append(0.0, np.cumsum(of(at)))
            out[a:b] = sums[self.begin[a + 1 : b + 1] - at.start] - sums[self.begin[a:b] - at.start]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.by_row(lambda at: w[self.index[at]] * self.value[at])

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for a, b, at in self.blocks():
            out += np.bincount(self.index[at], np.repeat(g[a:b], np.diff(self.begin[a : b + 1])) * self.value[at], size)
        return out

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """In how many of the rows that are True each feature stands."""
        out = np.zeros(FEATURES, np.int64)
        for a, b, at in self.blocks():
            out += np.bincount(self.index[at][np.repeat(rows[a:b], np.diff(self.begin[a : b + 1]))], minlength=FEATURES)
        return out

    def only(self, features: np.ndarray) -> Rows:
        """The entries whose features are True, with features numbered among those."""
        use, place = features[self.index], (np.cumsum(features) - 1).astype(np.int32)
        begin = np.append(0, np.cumsum(self.by_row(lambda at: use[at]))).astype(np.int64)
        return Rows(place[self.index[use]], self.value[use], begin)


def rows_of(lists: list[list[int]]) -> Rows:
    """Rows of features, repeats counted."""
    parts = [np.unique(np.array(r, np.int64), return_counts=True) for r in lists]
    begin = np.cumsum([0, *(len(i) for i, _ in parts)])
    index, value = (np.concatenate([x[k] for x in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
    return Rows(index, value.astype(float), begin)


class Model(NamedTuple):
    """weights: feature -> weight; thresholds ascend."""

    weights: dict[int, float]
    thresholds: list[float]

    def severity(self, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade > 0))."""
        over = [1 / (1 + np.exp(np.clip(t - eta, -500, 500))) for t in self.thresholds]
        return (np.sum(over, axis=0), over[0]) if over else (np.zeros(len(eta)), np.zeros(len(eta)))


def fit(rows: Rows, grades: np.ndarray, penalty: float = 0.001, rounds: int = 80, least: int = 4) -> Model:
    """Proximal gradient with momentum. grades: 0, 1, ... of each row; features of fewer than `least` rows are left out."""
    top = int(grades.max(initial=0))
    if not len(grades) or top == 0:
        return Model({}, [])
    often = rows.counts(np.ones(len(grades), bool)) >= least
    kept = np.flatnonzero(often)
    x = rows.only(often)
    x = x._replace(value=np.minimum(x.value, 5))
    n = len(grades)
    share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-6, 1 - 1e-6)
    theta = np.log((1 - share) / share)
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(top))
    w = last = np.zeros(len(kept))
    # the penalty chooses features; those chosen are then fitted alone, with little of it
    for penalty_now, rounds_now in ((penalty, rounds), (penalty / 20, 4 * rounds)):
        if penalty_now < penalty:
            chosen = np.flatnonzero(w)
            x = x.only(w != 0)
            w = last = w[chosen]
            kept = kept[chosen]
        # curvature of each weight, bounded: rare features may take long steps
        step, momentum = 1 / np.maximum(0.3 * x.back(x.dot(np.ones(len(kept))), len(kept)) / n, 1e-9), 1.0
        for _ in range(rounds_now):
            after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
            ahead = w + (momentum - 1) / after * (w - last)
            momentum = after
            eta = x.dot(ahead)
            edge = np.concatenate([[-np.inf], theta, [np.inf]])
            cdf = lambda t: 1 / (1 + np.exp(np.clip(eta - t, -500, 500)))  # noqa: B023, E731
            low, high = cdf(edge[grades]), cdf(edge[grades + 1])
            mass = np.maximum(high - low, 1e-12)
            g = (low * (1 - low) - high * (1 - high)) / mass  # d log mass / d eta
            last = w
            w = ahead + step * x.back(g, len(kept)) / n
            w = np.maximum(w - step * penalty_now, 0)  # evidence only adds, so that length does not drown it
            slope = np.array([((grades == k) * high * (1 - high) / mass).sum() - ((grades == k + 1) * low * (1 - low) / mass).sum() for k in range(top)]) / n
            theta = np.maximum.accumulate(theta + slope)
    return Model({int(kept[i]): float(w[i]) for i in np.flatnonzero(w)}, [float(t) for t in theta])


def severity_grades(rows: Rows, toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 2 from a yes-or-no label: toxic texts with more distinct marker features than the toxic texts'
    median are graded 2, other toxic texts 1. Markers: features at least 20 times as likely in toxic texts."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    ones, zeros = rows.counts(toxic > 0), rows.counts(toxic <= 0)
    marker = (ones >= 3) & ((ones + 0.5) / (n1 + 1) > 20 * (zeros + 0.5) / (n0 + 1))
    held = rows.by_row(lambda at: marker[rows.index[at]])
    middle = np.median(held[toxic > 0]) if toxic.any() else 0
    return np.where(toxic > 0, 1 + (held > middle), 0).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, clean: int = FIT_CLEAN, graded: int = FIT_GRADED) -> tuple[Rows, np.ndarray]:
    """Features and labels of at most clean + graded labelled documents, first by a hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.filter("toxic = 0").orderBy(*order).limit(clean).union(known.filter("toxic > 0").orderBy(*order).limit(graded))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ints, few = pa.list_(pa.int32()), pa.list_(pa.int8())
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("features", ints), ("counts", few)])

    def run(batches):
        for batch in batches:
            for a, b in groups(batch):
                found = [np.unique(np.array([f for w in words_of(t) for f in features_of(w)], np.int32), return_counts=True) for t in batch.column(2).slice(a, b - a).to_pylist()]
                own = [pa.array([f[0] for f in found], ints), pa.array([np.minimum(f[1], 127).astype(np.int8) for f in found], few)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *own], schema=schema)

    # at most clean + graded rows of two numbers; the fit counts a feature five times at most, so that a byte holds it
    own = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, features array<int>, counts array<tinyint>")
    found = own.orderBy("doc_id").limit(clean + graded).toArrow().combine_chunks()
    features, counts = found.column("features").combine_chunks(), found.column("counts").combine_chunks()
    begin = np.append(0, np.cumsum(features.value_lengths().to_numpy(zero_copy_only=False)))
    rows = Rows(features.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False), begin)
    return rows, found.column("toxic").to_numpy().astype(np.int64)


def _weigher(key: str, shipped) -> Memo:
    """word -> weight, by the model broadcast under key."""

    def make():
        weights = shipped.value.weights
        return Memo(lambda w: sum(weights.get(f, 0.0) for f in features_of(w)), 300_000)

    return held(("toxicity", key), make)


def _eta(weigh: Memo, texts: list[str | None]) -> np.ndarray:
    # sorted: a sum of floats then has one value
    return np.array([sum(sorted(map(weigh.__getitem__, words_of(t)))) for t in texts], float)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, expected_severity, p_toxic (a grade above 0), grade (the expected one, rounded), toxic.

    docs: doc_id, text; other columns are left out. A text that is null, empty or without words has no features. Rows
    may repeat, a null doc_id stays null. toxic: the expected severity reaches the threshold. A model fitted without
    graded rows gives severity 0 to all. The model is bounded by the number of features.
    """
    key, shipped = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("expected_severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])

    def run(batches):
        weigh = _weigher(key, shipped)
        for batch in batches:
            for a, b in groups(batch):
                severity, p = shipped.value.severity(_eta(weigh, batch.column(1).slice(a, b - a).to_pylist()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(severity), pa.array(p), pa.array(np.rint(severity).astype(np.int32)), pa.array(severity >= threshold)], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose expected severity stays below the threshold.

    docs: text, and any other columns. A text that is null, empty or without words is judged by the thresholds alone.
    """
    key, shipped = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        weigh = _weigher(key, shipped)
        for batch in batches:
            for a, b in groups(batch, at):
                some = batch.slice(a, b - a)
                yield some.filter(pa.array(shipped.value.severity(_eta(weigh, some.column(at).to_pylist()))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, clean: int = FIT_CLEAN, graded: int = FIT_GRADED) -> Model:
    rows, toxic = sample(docs, labels, clean, graded)
    model = fit(rows, severity_grades(rows, toxic))
    del rows
    trim()  # the driver goes on to other stages
    return model
