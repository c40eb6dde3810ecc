"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

A text has severity grade 0 (clean) to ``GRADES``.  The model is proportional odds:
P(grade <= k) = logistic(threshold_k - w.x), one weight vector shared by all
ordered thresholds.  Features are a text's words and their four- and five-letter
beginnings, of which the sample's most telling ones are kept; a feature's value is
log(1 + count).

Labels say only toxic or not.  Grades of toxic training texts come from how dense
their telling features are (thirds of the toxic sample), those of the others are 0.
Fitting sees a bounded sample of labelled rows; scoring is one narrow pass over
whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

GRADES = 3
#: Labelled rows that are fitted on, and features of the model; both bounds.
SAMPLE_ROWS = 20_000
FEATURES = 4096
#: Standard errors from even odds that a feature needs to be kept; others are noise of the sample.
TELLING = 2.0
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> tuple[Counter, int]:
    """Counts of the features of a text, and how many words it has."""
    words = Counter(_WORD.findall(text.lower()))
    found: Counter = Counter()
    for word, n in words.items():
        found["=" + word] += n
        if len(word) > 4:
            found[word[:4]] += n
        if len(word) > 5:
            found[word[:5]] += n
    return found, sum(words.values())


class _Frequencies:
    """In how many toxic and other texts of a partition a feature is."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in blocks(batches, "text"):
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(features(text)[0].keys())
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield self.batch(counts)
                counts = (Counter(), Counter())
        yield self.batch(counts)

    @staticmethod
    def batch(counts) -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[0][x] for x in names], pa.int64()), pa.array([counts[1][x] for x in names], pa.int64())], ["feature", "clean", "toxic"])


class _Rows:
    """Of each sample text: its label, its words, and places and counts of the model's features."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            rows = [(features(text), toxic) for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            hits = [[(self.index[f], n) for f, n in found.items() if f in self.index] for (found, _), _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.int32()), pa.array([w for (_, w), _ in rows], pa.int64()), pa.array([[f for f, _ in h] for h in hits], pa.list_(pa.int32())), pa.array([[n for _, n in h] for h in hits], pa.list_(pa.int32()))], ["toxic", "words", "at", "n"])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, grades: int = GRADES, steps: int = 400, penalty: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by full-batch Adam on the mean log-likelihood."""
    w, first, gaps = np.zeros(width), np.array([1.0]), np.zeros(grades - 1)
    n = len(grade)
    moments = [np.zeros(width + grades) for _ in range(2)]
    for step in range(1, steps + 1):
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        score = np.bincount(row, value * w[column], n)
        upper = np.concatenate([theta, [np.inf]])[grade] - score
        lower = np.concatenate([[-np.inf], theta])[grade] - score
        a, b = _logistic(upper), _logistic(lower)
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        to_score = (da - db) / n  # gradient of the loss by the score
        to_theta = np.zeros(grades)
        np.add.at(to_theta, grade[grade < grades], -da[grade < grades] / n)
        np.add.at(to_theta, grade[grade > 0] - 1, db[grade > 0] / n)
        tail = np.cumsum(to_theta[::-1])[::-1]
        gradient = np.concatenate([np.bincount(column, value * to_score[row], width) + penalty * w, tail[:1], tail[1:] * np.exp(gaps)])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        change = rate * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, first, gaps = w - change[:width], first - change[width : width + 1], gaps - change[width + 1 :]
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


class Model:
    """Weights by feature and ordered thresholds; small enough to go with every task."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, np.array(thresholds)

    def exceed(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for k = 0 ... grades - 1, one row a text."""
        get, scores = self.weights.get, []
        for text in texts:
            words = Counter(_WORD.findall((text or "").lower()))
            beginnings: Counter = Counter()
            score = 0.0
            for word, n in words.items():
                if weight := get("=" + word):
                    score += weight * math.log1p(n)
                if len(word) > 4 and word[:4] in self.weights:
                    beginnings[word[:4]] += n
                if len(word) > 5 and word[:5] in self.weights:
                    beginnings[word[:5]] += n
            scores.append(score + sum(get(b) * math.log1p(n) for b, n in beginnings.items()))
        return 1 - _logistic(self.thresholds[None, :] - np.array(scores, float).reshape(-1, 1))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = FEATURES) -> Model:
    """Fitted on the ``rows`` labelled documents whose doc_id has the least hashes; at most one label row a document."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("toxic")).limit(rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # at most ``rows`` rows are broadcast
    counted = sample.mapInArrow(_Frequencies(), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = chosen.agg(F.sum("toxic"), F.count(F.lit(1))).head()
    bad, good = float(sizes[0] or 0), float((sizes[1] or 0) - (sizes[0] or 0))
    if not bad or not good:
        return Model({}, [20.0 + k for k in range(GRADES)])
    # The log-odds of a feature in standard errors: the most telling ones, either way.
    odds = F.log((F.col("toxic") + 0.5) / (bad - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (good - F.col("clean") + 0.5))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5) + 1 / (bad - F.col("toxic") + 0.5) + 1 / (good - F.col("clean") + 0.5))
    top = counted.where(F.col("toxic") + F.col("clean") >= 3).withColumn("z", odds / error).where(F.abs("z") >= TELLING).orderBy(F.desc(F.abs("z")), "feature").limit(size).select("feature", "z").collect()
    index = {r["feature"]: i for i, r in enumerate(top)}
    telling = np.array([r["z"] for r in top]) > 0
    data = sample.mapInArrow(_Rows(index), "toxic int, words long, at array<int>, n array<int>").collect()
    data.sort(key=lambda r: (r["toxic"], r["words"], r["at"], r["n"]))  # whatever order tasks end in
    row = np.repeat(np.arange(len(data)), [len(r["at"]) for r in data])
    column = np.array([x for r in data for x in r["at"]], np.int64)
    count = np.array([x for r in data for x in r["n"]], float)
    toxic = np.array([r["toxic"] for r in data], bool)
    if not toxic.any():  # none of the labelled documents is there
        return Model({}, [20.0 + k for k in range(GRADES)])
    hit = telling[column] if len(column) else np.zeros(0, bool)
    density = np.bincount(row[hit], count[hit], len(data)) / np.maximum([r["words"] for r in data], 1)
    cuts = np.quantile(density[toxic], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(toxic, 1 + (density[:, None] > cuts[None, :]).sum(axis=1), 0)
    weights, thresholds = fit(row, column, np.log1p(count), grade, len(index))
    return Model({f: float(weights[i]) for f, i in index.items() if weights[i]}, thresholds.tolist())


class _Score:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            exceed = self.model.exceed(batch.column(1).to_pylist())
            at_least = np.concatenate([np.ones((len(exceed), 1)), exceed, np.zeros((len(exceed), 1))], axis=1)
            grade = (at_least[:, :-1] - at_least[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exceed.sum(axis=1)), pa.array(exceed[:, 0]), pa.array(grade.astype(np.int32)), pa.array(exceed[:, 0] >= 0.5)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = FEATURES) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (probability of a grade above 0), grade (likeliest), toxic (p_toxic >= 0.5).

    One row per row of ``docs``; null is the empty text, which has no feature.  Without labelled texts of both kinds all
    are clean.  Repeated rows and null ids are scored like any other; an empty table gives an empty one.  Only doc_id
    and text are read of ``docs``, doc_id and toxic of ``labels``, other values of toxic than 0 and 1 are passed over.
    """
    model = train(docs, labels, rows, size)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_Score(model), "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
