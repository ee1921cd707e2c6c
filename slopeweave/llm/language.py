"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from slopeweave.llm.shards import byte_grams, in_batches, shards
from slopeweave.llm.tokenizing import decoded
from slopeweave.session import cut

SIZES = range(1, 4)
BITS = 12
CLUSTERS = 4
# Centroids are fitted on at most so many documents of each language, those whose ids hash lowest;
# document frequencies are counted over all learning documents.
MOST_PER_LANGUAGE = 1_500
# Documents of one language are ranked in so many parts first.
PARTS = 64
# A text is rejected when it is further from its centroid than this share of the centroid's own documents.
WITHIN = 0.995
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Unit centroids (rows), their languages and radii (cosine distances), and the idf of each bucket."""

    centroids: np.ndarray
    languages: list[str]
    radii: np.ndarray
    idf: np.ndarray


_shown = np.full(256, 0x20, np.uint8)
_shown[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x61, 0x7B), *range(0x80, 0x100)]


def _counts(text: bytes) -> np.ndarray:
    """Byte n-grams of the lower-cased words: every run of ASCII other than letters counts as one space."""
    shown = _shown[np.frombuffer(decoded(text).lower().encode(), np.uint8)]
    space = shown == 0x20
    tidy = shown[~(space & np.append(False, space[:-1])[:len(space)])]
    return np.bincount(byte_grams(tidy.tobytes(), SIZES, BITS), minlength=1 << BITS)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _weighted(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    return _unit(np.stack([np.log1p(_counts(t)) for t in texts]).astype(np.float32) * idf)


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means. Starts from the row nearest the mean, then from the row furthest from
    all chosen ones; gives fewer centroids where rows coincide."""
    chosen = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(chosen) < k:
        near = (rows @ rows[chosen].T).max(axis=1)
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        chosen.append(far)
    centroids = rows[chosen]
    for _ in range(rounds):
        own = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        used = np.bincount(own, minlength=len(centroids)) > 0
        centroids = np.where(used[:, None], _unit(sums), centroids)
    return centroids


def train(docs: DataFrame, clusters: int = CLUSTERS, most: int = MOST_PER_LANGUAGE) -> LanguageModel:
    """Learn from ``docs (doc_id, text, lang)``; rows without text or language teach nothing.

    The idf of a bucket comes from all rows. The centroids of a language come from its sample.
    Without any row the model knows no language.
    """
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for _, texts in shards(batches):
            n += len(texts)
            for t in texts:
                df += _counts(t) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*df[at], n], pa.int64())], ["bucket", "n"])

    df = in_batches(known, frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    of = dict(zip(df["bucket"], df["n"]))
    total = of.pop(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([of.get(b, 0) for b in range(1 << BITS)]))).astype(np.float32) + np.float32(1)

    # First in parts of a language, so that no task ranks all rows of one; then among what is left, at most ``most`` of each part.
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = lambda df, *keys: df.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_hash))).filter(F.col("at") <= most)
    parts = known.filter("doc_id IS NOT NULL").select("lang", "doc_id").withColumn("part", F.pmod(F.hash("doc_id"), F.lit(PARTS)))
    ids = first(first(parts, "lang", "part"), "lang").select("doc_id", "lang")
    sample = known.join(F.broadcast(ids), ["doc_id", "lang"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shards(batches):
            rows = [r.tobytes() for r in _weighted(texts, idf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], ["doc_id", "lang", "v"])

    kind = known.schema["doc_id"].dataType.simpleString()
    seen = cut(in_batches(sample, vectors, f"doc_id {kind}, lang string, v binary").dropDuplicates(["doc_id", "lang"]), "language")

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(part.sort_values("doc_id")["v"]), np.float32).reshape(len(part), -1)
        found = cluster(rows, clusters)
        near = rows @ found.T
        own = near.argmax(axis=1)
        radii = [float(np.quantile(1 - near[own == c, c], WITHIN)) if (own == c).any() else 0.0 for c in range(len(found))]
        return pd.DataFrame({"lang": part["lang"].iloc[0], "v": [c.astype(np.float32).tobytes() for c in found], "radius": radii})

    got = seen.groupBy("lang").applyInPandas(centroids, "lang string, v binary, radius double").toPandas().sort_values(["lang", "v"])
    return LanguageModel(np.frombuffer(b"".join(got["v"]), np.float32).reshape(len(got), 1 << BITS), list(got["lang"]),
                         got["radius"].to_numpy(float), idf)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row, from the whole text.

    ``lang_pred`` is the language of the nearest centroid by cosine and ``score`` that cosine
    (0 to 1). A text that is null or has no letter, and any text when the model knows no language,
    is ``und`` with score 0. ``rejected`` says that the text lies outside the centroid's radius, or is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in shards(batches):
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            if m.languages:
                near = _weighted(texts, m.idf) @ m.centroids.T
                best = near.argmax(axis=1)
                score = np.where(letters, np.clip(near.max(axis=1).astype(float), 0, 1), 0.0)
                lang = np.where(letters, np.array(m.languages, object)[best], UNKNOWN)
                rejected = ~letters | (1 - near.max(axis=1) > m.radii[best])
            else:
                score, lang, rejected = np.zeros(len(texts)), np.full(len(texts), UNKNOWN, object), np.ones(len(texts), bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                             ["doc_id", "lang_pred", "score", "rejected"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return in_batches(narrow, run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
