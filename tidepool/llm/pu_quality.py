"""Quality scores from positive-unlabelled learning.

A linear model over the shapes of a text's words (runs of lower case, upper case, digits and each other character), their
repetition and a few shares is fitted to trusted positives and unlabelled texts by the non-negative unbiased risk
``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])`` with the logistic loss. Where the second part falls below zero, a step
raises it again instead. The prior is the share of label 1 among the labelled training rows; labels 0 serve nothing else.
The fit takes at most ``sample`` positives and as many unlabelled training texts, those with the smallest hash of their id.

Cases: null and empty texts have all features 0 and get the score of that point; texts differ only by their content, so
repeated rows get equal scores; null ids count as training rows; null labels are no labels; without positives or unlabelled rows every score is the
prior (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import WHITE, small_batches, whole_text
from tidepool.session import stage_table

SHAPES = 1024
EXTRA = 8
SAMPLE = 5000
ROUNDS = 400
RATE = 0.05
RIDGE = 1e-4
THRESHOLD = 0.3
#: Class of each byte: 0 white space, 1 lower case and non-ASCII, 2 upper case, 3 digit, else the character's own.
CLASSES = np.array([
    0 if bytes([b]) in WHITE else 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 + b
    for b in range(256)
], np.uint32)


def features(text: str) -> np.ndarray:
    """Roots of the shares of word shapes, and the shares that follow them; 32-bit."""
    out = np.zeros(SHAPES + EXTRA, np.float32)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return out
    kinds = CLASSES[np.frombuffer(data, np.uint8)]
    runs = kinds[np.concatenate(([True], kinds[1:] != kinds[:-1]))]
    blank = runs == 0
    ink = ~blank
    number = np.cumsum(blank)[ink]
    starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(number)])))
    place = np.arange(len(number)) - np.repeat(starts, sizes)
    powers = (np.uint64(0x9E3779B97F4A7C15) * (2 * place.astype(np.uint64) + np.uint64(1)))
    shape = np.add.reduceat((runs[ink].astype(np.uint64) + np.uint64(1)) * powers, starts)
    shape = ((shape ^ (shape >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(54)
    out[:SHAPES] = np.sqrt(np.bincount(shape.astype(np.int64), minlength=SHAPES) / len(shape))
    total = np.bincount(np.minimum(kinds, 4), minlength=5) / len(kinds)
    n = len(words)
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = data.split(b"\n")
    out[SHAPES:] = [
        np.sqrt(again), 1 - len(set(words)) / n, 1 - len(set(lines)) / len(lines), total[2], total[3], total[4],
        np.log1p(n) / 10, min(len(data) / n, 40) / 40,
    ]
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, text: str) -> float:
        g = float(((features(text) - self.mean) * self.scale) @ self.weights + self.bias)
        return float(1 / (1 + np.exp(-np.clip(g, -500, 500))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS) -> Model:
    """Adam on the non-negative risk."""
    width = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        odds = np.clip(prior, 1e-6, 1 - 1e-6)
        return Model(np.zeros(width), float(np.log(odds / (1 - odds))), np.zeros(width), np.ones(width))
    mean, spread = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 0.02), 0.0)
    p = np.hstack(((positive - mean) * scale, np.ones((len(positive), 1)))).astype(np.float32)
    u = np.hstack(((unlabelled - mean) * scale, np.ones((len(unlabelled), 1)))).astype(np.float32)
    w = np.zeros(width + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    keep = np.append(np.full(width, RIDGE), 0.0)
    for step in range(1, rounds + 1):
        gp, gu = p @ w.astype(np.float32), u @ w.astype(np.float32)
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -50, 50))), 1 / (1 + np.exp(-np.clip(gu, -50, 50)))
        lean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        gradient = negative - prior * (p.T @ (1 - sp)) / len(p) if lean >= 0 else -negative
        gradient = gradient + keep * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(w[:-1], float(w[-1]), mean, scale)


def train(docs: DataFrame, labels: DataFrame, usable: Column, doc: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Learn from the rows where ``usable`` holds; ``labels`` has doc_id and ``label``."""
    small_batches(docs.sparkSession)
    ids = docs.where(usable & F.col(doc).isNotNull()).select(F.col(doc).alias("d")).distinct()
    marks = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("d"), F.col(label).alias("y")).distinct().join(ids, "d")
    prior = marks.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    order = F.xxhash64("d")
    positive = marks.where("y = 1").select("d").distinct().orderBy(order, "d").limit(sample).withColumn("trusted", F.lit(True))
    other = ids.orderBy(F.xxhash64(F.col("d") + 1), "d").limit(sample).withColumn("trusted", F.lit(False))
    chosen = stage_table(positive.unionByName(other), "quality-sample")

    def vectors(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                rows = [features(t).astype(np.float16).tobytes() for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, pa.binary())], ["trusted", "x"])

    rows = docs.select(F.col(doc).alias("d"), whole_text(text).alias("t")).join(chosen, "d").select("trusted", "t")
    found = rows.mapInArrow(vectors, "trusted boolean, x binary").toPandas()  # at most twice ``sample`` texts, were ids unique
    matrix = np.array([np.frombuffer(x, np.float16) for x in found["x"]], np.float32).reshape(-1, SHAPES + EXTRA)
    trusted = found["trusted"].to_numpy(bool) if len(found) else np.zeros(0, bool)
    return fit(matrix[trusted], matrix[~trusted], 0.5 if prior is None else float(prior))


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(sent.value.score).astype("float64")

    return docs.withColumn(name, of(whole_text(text)))
