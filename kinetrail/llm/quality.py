"""Quality classifier by co-training.

Two views of a document: its content (hashed byte trigrams) and its metadata
(source, language, length, and figures of the page's layout). A logistic
regression per view is fitted on labelled documents; in each round either view
labels the unlabelled documents that it is sure of for the other one. A held-out
part of the labelled rows calibrates both views (Platt scaling); the sum of the
calibrated log odds, less the prior that both contain, scores every document.

Fitted on a bounded sample of the labelled rows, LABELLED_ROWS, and on a pool of
the others that grows with the table, POOL_SHARE of it (POOL_ROWS where that is
more), both chosen by hashed id. Every document of the table is scored over its
whole text.

Defined results: null text is empty; null source or lang is a value of its own;
several labels of a document count as their largest; labels that are null take
no part; without labels of both classes every document gets the one known class
(1 where there is none) as its score; repeated rows are scored each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of
from .word_hashes import word_hashes

LABELLED_ROWS, POOL_SHARE, POOL_ROWS = 12_000, 0.05, 12_000
ROUNDS = 2
SURE = 0.97
THRESHOLD = 0.5
TRIGRAMS = 1_024
SOURCES, LANGS = 32, 8
LAYOUT = 14
META = SOURCES + LANGS + LAYOUT

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def content_features(text: np.ndarray) -> np.ndarray:
    """Log counts of hashed trigrams, scaled to length 1."""
    if len(text) < 3:
        return np.zeros(TRIGRAMS, dtype=np.float32)
    b = text.astype(np.uint32)
    code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    counts = np.log1p(np.bincount((code * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=TRIGRAMS))
    return (counts / np.sqrt((counts**2).sum())).astype(np.float32)


def metadata_features(text: np.ndarray, source: str | None, lang: str | None) -> np.ndarray:
    """Hashed source and language, length and layout."""
    out = np.zeros(META, dtype=np.float32)
    out[zlib.crc32(("s" + source).encode()) % SOURCES if source is not None else 0] = 1
    out[SOURCES + (zlib.crc32(("l" + lang).encode()) % LANGS if lang is not None else 0)] = 1
    n = max(len(text), 1)
    words = word_hashes(text)
    ends = np.flatnonzero(text == 10)
    lines = np.diff(np.concatenate(([0], ends, [len(text)])))
    w = max(len(words), 1)
    distinct = np.unique(words, return_counts=True)[1] if len(words) else np.ones(1)
    out[SOURCES + LANGS :] = (
        np.log1p(len(text)) / 10,
        np.log1p(len(words)) / 10,
        np.log1p(len(ends)) / 5,
        np.log1p(lines.mean()) / 5,
        np.log1p(lines.max()) / 10,
        _UPPER[text].sum() / n,
        _DIGIT[text].sum() / n,
        _MARK[text].sum() / n,
        (text >= 128).sum() / n,
        len(text) / w / 10,
        len(distinct) / w,
        distinct.max() / w,
        (words[1:] == words[:-1]).sum() / w,
        (text == 124).sum() / n,
    )
    return out


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content, metadata) as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [np.frombuffer(t.as_buffer(), dtype=np.uint8) for t in batch.column(1)]
                content = [content_features(t) for t in texts]
                meta = [
                    metadata_features(t, s, g)
                    for t, s, g in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
                ]
                kind = pa.list_(pa.float32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(content, type=kind), pa.array(meta, type=kind)],
                    names=["doc_id", "content", "metadata"],
                )

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, content array<float>, metadata array<float>")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"), docs["source"], docs["lang"]
    )


def _share(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def held_out() -> Column:
    """Is a labelled document kept from the fit, for the calibration."""
    return _share(3) < 0.25


class Model:
    """Weights of both views with their calibration; small whatever the data."""

    def __init__(self, views: dict[str, tuple[np.ndarray, float, float, float]], prior: float) -> None:
        self.views, self.prior = views, prior

    def log_odds(self, features: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for name, (weights, intercept, slope, offset) in self.views.items():
            out[name] = slope * (features[name] @ weights + intercept) + offset
        return out

    def combined(self, odds: dict[str, np.ndarray]) -> np.ndarray:
        return sum(odds.values()) - self.prior * (len(odds) - 1)


def _logistic(iterations: int = 40, penalty: float = 1e-4) -> LogisticRegression:
    return LogisticRegression(featuresCol="x", labelCol="y", maxIter=iterations, regParam=penalty, probabilityCol="p")


def _platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit log odds to labels, on the bounded held-out rows."""
    if len(scores) < 20 or labels.min() == labels.max():
        return 1.0, 0.0
    a, b, centre, spread = 1.0, 0.0, scores.mean(), scores.std() + 1e-9
    z = (scores - centre) / spread
    goal = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((labels == 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([((p - goal) * z).sum(), (p - goal).sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    a = max(a, 1e-3)
    return a / spread, b - a * centre / spread


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> Model | float:
    """The co-trained model, or the one class that the labels know."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    picked = known.filter(_share(1) < min(1.0, LABELLED_ROWS / max(1, labels.count())))
    pool_share = min(1.0, max(POOL_SHARE, POOL_ROWS / max(1, docs.count())))
    # LABELLED_ROWS ids, whatever the input; the pool is told by the id alone: no text is shuffled to find the sample
    slim = _slim(docs, "doc_id", "text").filter("doc_id is not null")
    rows = slim.join(F.broadcast(picked.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"), "left").filter(
        F.col("y").isNotNull() | (_share(2) < pool_share)
    )
    sampled = feature_rows(rows.select("doc_id", "text", "source", "lang").dropDuplicates(["doc_id"]))
    sampled = sampled.join(F.broadcast(picked), "doc_id", "left")
    data = materialise(
        sampled.withColumn("held", F.col("y").isNotNull() & held_out()), "quality-sample"
    )
    counts = {r["y"]: r["count"] for r in data.filter("y is not null and not held").groupBy("y").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), 1.0)
    frames = {
        name: data.select("doc_id", "y", "held", array_to_vector(F.col(name).cast("array<double>")).alias("x"))
        for name in ("content", "metadata")
    }
    other = {"content": "metadata", "metadata": "content"}
    pseudo: dict[str, DataFrame | None] = {"content": None, "metadata": None}
    models = {}
    for turn in range(rounds + 1):
        for name, frame in frames.items():
            train = frame.filter("not held").select("doc_id", "y", "x")
            if pseudo[name] is not None:
                train = train.join(pseudo[name], "doc_id", "left").withColumn("y", F.coalesce("y", "guess")).drop("guess")
            models[name] = _logistic().fit(train.filter("y is not null").select("y", "x"))
        if turn < rounds:
            for name, frame in frames.items():
                p = vector_to_array("p")[1]
                guess = F.when(p >= sure, 1.0).when(p <= 1 - sure, 0.0)
                told = models[name].transform(frame.filter("y is null")).select("doc_id", guess.alias("guess"))
                pseudo[other[name]] = materialise(told.filter("guess is not null"), "pseudo-labels")
    held = data.filter("held").select("y", "content", "metadata").toPandas()  # LABELLED_ROWS / 4 rows
    views = {}
    for name, model in models.items():
        weights, intercept = np.array(model.coefficients.toArray()), float(model.intercept)
        scores = np.array([np.asarray(x, dtype=float) @ weights + intercept for x in held[name]])
        views[name] = (weights, intercept, *_platt(scores, held["y"].to_numpy()))
    good = counts.get(1.0, 1) / max(1, sum(counts.values()))
    return Model(views, float(np.log(good / max(1e-9, 1 - good))))


SCORE_SCHEMA = "doc_id long, p_content double, p_metadata double, score double"


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, p_content, p_metadata, score of every row."""
    if not isinstance(model, Model):
        fixed = F.lit(float(model))
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), fixed.alias("p_content"), fixed.alias("p_metadata"), fixed.alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [np.frombuffer(t.as_buffer(), dtype=np.uint8) for t in batch.column(1)]
                odds = model.log_odds(
                    {
                        "content": np.array([content_features(t) for t in texts], dtype=float),
                        "metadata": np.array(
                            [
                                metadata_features(t, s, g)
                                for t, s, g in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
                            ],
                            dtype=float,
                        ),
                    }
                )
                chance = [1 / (1 + np.exp(-np.clip(x, -50, 50))) for x in (*odds.values(), model.combined(odds))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(np.round(x, 6)) for x in chance)],
                    names=["doc_id", "p_content", "p_metadata", "score"],
                )

    return _slim(docs, "doc_id", "text").mapInArrow(run, SCORE_SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_content, p_metadata, score, kept: one row per row of docs."""
    return score(docs, fit(docs, labels)).withColumn("kept", F.col("score") >= threshold)
