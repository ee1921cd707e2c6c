"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slopeweave.llm.shards import Distinct, char_grams, in_batches, rows_per_batch, shards
from slopeweave.session import cut

SIZES = range(3, 6)
BITS = 19
# The classifier is fitted on at most so many labelled documents, those whose ids hash lowest.
MOST_LABELLED = 12_000
# L1 penalty: few n-grams mark toxic texts, and a small weight on each of the many others would drown them in long texts.
PENALTY = 5e-4
# Parts of the fit, each of which sends a gradient in every step; steps at most, and how many of the last ones tell the curvature.
FIT_PARTS = 6
STEPS, REMEMBERED = 50, 6
# A step that lowers the sum by less than this share of it is the last.
ENOUGH = 2e-3
# Documents of the fit that a task holds at once.
ROWS_AT_ONCE = 100
# Bytes of text whose n-grams a task of the fit sends at once; they take some eight times as much.
FIT_TEXT = 1 << 18
THRESHOLD = 0.3


@dataclass
class ToxicityModel:
    """One weight per n-gram bucket (coefficient times log-count ratio), the intercept, and the log-count ratios."""

    weights: np.ndarray
    intercept: float
    ratios: np.ndarray


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, smoothing: float = 1.0) -> ToxicityModel:
    """Fit on the documents that ``labels (doc_id, toxic)`` marks.

    A document is the set of its n-grams of 3 to 5 characters, each hashed to one of 2^19 buckets; all of them are features. A bucket's value is its log-count ratio
    between toxic and other documents; a logistic regression on these values (L1 penalty) gives
    the weights. Rows without id, label or text teach nothing; of several labels for a document,
    the largest holds. With one class only, or no rows, every score is the share of toxic rows (0 if none).
    """
    marks = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    mine = docs.filter("text IS NOT NULL").select("doc_id", "text")
    # At most ``most`` ids are sent.
    marked = mine.join(F.broadcast(marks), "doc_id").select("text", "toxic")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct(BITS)
        for batch, texts in shards(batches, FIT_TEXT):
            grams = [np.sort(distinct(char_grams(t, SIZES, BITS))).astype(np.int32) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.list_(pa.int32())), batch.column("toxic").cast(pa.int32())],
                                             ["grams", "toxic"])

    seen = cut(in_batches(marked, features, "grams array<int>, toxic int"), "toxicity")
    sizes = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    none = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        return ToxicityModel(none, np.inf if n1 else -np.inf, none)
    # At most a row for each bucket.
    counts = (seen.select(F.explode("grams").alias("gram"), (F.col("toxic") == 1).cast("int").alias("one"))
              .groupBy("gram").agg(F.count("*").cast("int").alias("n"), F.sum("one").cast("int").alias("ones")).toArrow())
    ones, every = np.zeros(1 << BITS), np.zeros(1 << BITS)
    ones[counts["gram"].to_numpy()], every[counts["gram"].to_numpy()] = counts["ones"].to_numpy(), counts["n"].to_numpy()
    ratios = np.log((ones + smoothing) / (n1 + 2 * smoothing)) - np.log((every - ones + smoothing) / (n0 + 2 * smoothing))
    coefficients, intercept = _fit(cut(seen.repartition(FIT_PARTS), "toxicity"), ratios.astype(np.float32))
    return ToxicityModel(coefficients * ratios.astype(np.float32), intercept, ratios.astype(np.float32))


def _loss(seen: DataFrame, weights: np.ndarray, intercept: float) -> tuple[float, np.ndarray, float]:
    """Mean logistic loss of the rows ``grams, toxic``, and its derivatives by each bucket's weight and by the intercept. One job; at most ``FIT_PARTS`` tasks
    send a row each, into however many pieces Spark cuts the files of ``seen``."""
    shared = seen.sparkSession.sparkContext.broadcast((weights, intercept))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        gradient, sums = np.zeros(len(w)), np.zeros(3)
        for batch in batches:
            grams, lengths = batch.column("grams").flatten().to_numpy(), batch.column("grams").value_lengths().to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            margin = b + np.bincount(row, weights=w[grams], minlength=len(lengths))
            y = (batch.column("toxic").to_numpy() == 1).astype(float)
            error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y
            gradient += np.bincount(grams, weights=error[row], minlength=len(w))
            sums += np.logaddexp(0, (1 - 2 * y) * margin).sum(), error.sum(), len(y)
        if not sums[2]:
            return
        yield pa.RecordBatch.from_arrays([pa.array([gradient.astype("<f4").tobytes()], pa.binary()), pa.array([sums.tolist()], pa.list_(pa.float64()))], ["gradient", "sums"])

    with rows_per_batch(seen.sparkSession, ROWS_AT_ONCE):
        rows = seen.coalesce(FIT_PARTS).mapInArrow(part, "gradient binary, sums array<double>").toArrow()
    shared.destroy()
    loss, by_intercept, n = np.sum(rows["sums"].to_pylist(), axis=0)
    gradient = np.zeros(len(weights), np.float32)
    for g in rows["gradient"]:
        gradient += np.frombuffer(g.as_buffer(), "<f4")
    return loss / n, gradient / np.float32(n), by_intercept / n


def _fit(seen: DataFrame, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of the scaled buckets and the intercept that minimise the mean logistic loss and ``PENALTY`` times the sum of the coefficients' sizes.

    An orthant-wise quasi-Newton descent: each step goes down along the curvature seen in the last steps, within the signs that the penalty's slope allows, and
    is halved until the sum falls. Only derivatives come to the driver.
    """
    size = len(ratios)
    penalty = np.append(np.full(size, PENALTY, np.float32), np.float32(0))
    scale = np.append(ratios, np.float32(1))

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient, by_intercept = _loss(seen, x[:-1] * ratios, float(x[-1]))
        return loss + float(np.abs(x * penalty).sum(dtype=np.float64)), np.append(gradient, np.float32(by_intercept)) * scale

    def downhill(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The steepest way down with the penalty's slope; 0 where it holds a coefficient at 0."""
        rest = np.sign(g) * np.maximum(np.abs(g) - penalty, 0)
        return -np.where(x != 0, g + np.sign(x) * penalty, rest)

    x = np.zeros(size + 1, np.float32)
    value, g = at(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        down = downhill(x, g)
        d, passed = down.copy(), []
        for s, y in reversed(steps):
            alpha = np.dot(s, d) / np.dot(s, y)
            passed.append(alpha)
            d -= alpha * y
        if steps:
            s, y = steps[-1]
            d *= np.dot(s, y) / np.dot(y, y)
        for (s, y), alpha in zip(steps, reversed(passed)):
            d += (alpha - np.dot(y, d) / np.dot(s, y)) * s
        d[d * down <= 0] = 0
        side = np.where(x != 0, np.sign(x), np.sign(down))
        length = 1.0 if steps else 1.0 / max(float(np.linalg.norm(down)), 1e-12)
        gain = float(np.dot(d, down))
        for _ in range(20):
            new = x + np.float32(length) * d
            new[(new * side < 0) & (penalty > 0)] = 0
            new_value, new_g = at(new)
            if new_value <= value - 1e-4 * length * gain:
                break
            length /= 2
        else:
            break
        s, y = new - x, new_g - g
        if np.dot(s, y) > 1e-12:
            steps = [*steps, (s, y)][-REMEMBERED:]
        done = value - new_value < ENOUGH * value
        x, value, g = new, new_value, new_g
        if done:
            break
    return x[:-1], float(x[-1])


def _scorer(model: ToxicityModel, spark):
    """Scores of a shard's texts in tasks."""
    shared = spark.sparkContext.broadcast(model)

    def scores(texts: list[bytes], distinct: Distinct) -> np.ndarray:
        m = shared.value
        sums = np.fromiter((m.weights[distinct(char_grams(t, SIZES, BITS))].sum(dtype=np.float64) for t in texts), float, len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + m.intercept, -700, 700)))

    return scores


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``, from the whole text; null is as empty."""
    scores = _scorer(model, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct(BITS)
        for batch, texts in shards(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts, distinct))], ["doc_id", "score"])

    narrow = docs.select("doc_id", "text")
    return in_batches(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")


def keep_harmless(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold. A null text is scored as empty; of repeated rows
    all stay or none."""
    scores = _scorer(model, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct(BITS)
        for batch, texts in shards(batches):
            yield batch.filter(pa.array(scores(texts, distinct) < threshold))

    return in_batches(docs, run, docs.schema)
