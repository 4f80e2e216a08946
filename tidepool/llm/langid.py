"""Language identification by nearest centroid.

A text becomes its counts of byte n-grams (lengths 1 to 3 of the lower-cased text, its runs of non-letters as one space,
hashed to ``DIMENSIONS`` places), damped by a square root, weighted by inverse document frequency and normalised. Document frequencies come from every training
text; the centroids of a language from spherical k-means over at most ``sample`` of its training texts, the ones with
the smallest hash of text and id. The nearest centroid by cosine gives the language. A text is rejected when its distance to that
centroid is larger than what the centroid's own training texts show, with a margin.

Cases: a text without a letter (also null or empty) is ``und`` with score 0 and rejected; ties between centroids go to
the first in order of language; a null language is not trained on; a language of one text is one centroid; without any training
text every text is ``und``. Rows do not depend on each other; other columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.common import small_batches, spare, whole_text
from tidepool.session import stage_table

DIMENSIONS = 4096
SAMPLE = 600
CENTROIDS = 4
PARTS = 16
ROUNDS = 8
#: A text is rejected below this share of the least cosine that all but a hundredth of the training texts reach.
MARGIN = 0.2
UNKNOWN = "und"
#: Bytes of ASCII that are no letter count as a space.
LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def counts(text: str) -> np.ndarray:
    """Hashed counts of the byte n-grams of a whole text; slices bound the memory."""
    data = LETTERS[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    blank = data == 32
    data = data[~(blank & np.concatenate(([False], blank[:-1])))] if len(data) else data
    total = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(data), 1 << 20):
        part = data[at : at + (1 << 20) + 2].astype(np.uint32)
        size = min(1 << 20, len(data) - at)
        code = part
        for n in range(1, 4):
            own = code[: min(size, len(code))] + np.uint32(n << 27)
            own = (own * np.uint32(2654435761)) >> np.uint32(20)
            total += np.bincount(own, minlength=DIMENSIONS)
            if n < 3:
                code = code[:-1] * np.uint32(257) + part[n:] if len(code) > 1 else code[:0]
    return total


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    weighted = np.sqrt(counts(text)) * idf
    size = np.sqrt((weighted * weighted).sum())
    return (weighted / size if size else weighted).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages by centroid, centroids, least cosine of each, and inverse document frequencies."""

    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def predict(self, text: str) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ vector(text, self.idf)
        best = int(cosines.argmax())
        return self.langs[best], float(min(1.0, max(0.0, cosines[best]))), bool(cosines[best] < self.floors[best])


def _clusters(vectors: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts; also each row's cosine to its own centroid."""
    chosen = [0]
    nearest = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centers = vectors[chosen].copy()
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        for j in range(len(centers)):
            if (own == j).any():
                mean = vectors[own == j].mean(axis=0)
                centers[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return centers, (vectors @ centers.T).max(axis=1)


def train(docs: DataFrame, usable: Column, doc: str = "doc_id", text: str = "text", lang: str = "lang",
          sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from the rows where ``usable`` holds and the language is known."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(usable & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(doc).alias("d"), whole_text(text).alias("t"))

    def frequencies(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += counts(value) > 0
                n += 1
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(-1, DIMENSIONS), pa.int32()), "n": pa.array([n, *total], pa.int64())})

    df = {r.place: r.n for r in known.select("t").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    if not df.get(-1):
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), np.ones(DIMENSIONS))
    idf = np.log((1 + df[-1]) / (1 + np.array([df.get(i, 0) for i in range(DIMENSIONS)]))) + 0.1

    order = Window.partitionBy("lang").orderBy("h", "d")
    keys = known.select("lang", "d", F.xxhash64("t", "d").alias("h"))
    # first within parts of each language, so that the last window meets at most PARTS * sample rows however many there are
    within = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h", "d")
    keys = keys.withColumn("place", F.row_number().over(within)).where(F.col("place") <= sample)
    few = stage_table(keys.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).select("h").distinct(), "lang-sample")

    def fit(lang_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        good = [t for _, t in sorted(zip(rows["h"], rows["t"], strict=True))[:sample] if has_letter(t)]
        if not good:
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        centers, cosines = _clusters(np.stack([vector(t, idf) for t in good]), centroids, ROUNDS)
        floor = MARGIN * float(np.quantile(cosines, 0.01))
        return pd.DataFrame({"lang": lang_key[0], "centroid": [c.astype("<f4").tobytes() for c in centers], "floor": floor})

    hashed = known.withColumn("h", F.xxhash64("t", "d"))
    chosen = hashed.join(few, "h", "left_semi")
    learned = chosen.groupBy("lang").applyInPandas(fit, "lang string, centroid binary, floor double").collect()
    learned.sort(key=lambda r: (r.lang, bytes(r.centroid)))
    matrix = np.array([np.frombuffer(r.centroid, "<f4") for r in learned], np.float32).reshape(-1, DIMENSIONS)
    return Model([r.lang for r in learned], matrix, np.array([r.floor for r in learned]), idf)


def predict(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column (lang, score, rejected)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    return docs.withColumn(name, of(whole_text(text)))


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the texts that the model rejects."""
    name = spare(docs, "language")
    return predict(docs, model, text, name).where(~F.col(f"`{name}`.rejected")).select(*[f"`{c}`" for c in docs.columns])
