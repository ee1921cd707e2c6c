"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slopeweave.llm.shards import in_batches, members, mix, shards, words
from slopeweave.llm.topk import mark_top
from slopeweave.session import cut

BITS = 14
KEPT_SHARE = 0.25


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of a shard, and the document of each."""
    w = words(texts)
    pair = w.doc[1:] == w.doc[:-1]
    pairs = mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])[pair]
    at = np.concatenate([w.hash, pairs]) >> np.uint64(64 - BITS)
    return at.astype(np.int64), np.concatenate([w.doc, w.doc[1:][pair]])


def log_ratio(docs: DataFrame, target: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of target and raw probability of each bucket.

    Both models count all words and word pairs: the raw model over every document, the target model over the documents in
    ``target (doc_id)``. Without a target document, or without text, all ratios are 0.
    """
    ids = target.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    narrow = docs.select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << BITS, np.int64)
        for _, texts in shards(batches):
            sums += np.bincount(_buckets(texts)[0], minlength=1 << BITS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], ["bucket", "n"])

    counted = lambda texts: in_batches(texts, count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    every, some = counted(narrow.select("text")), counted(members(narrow, ids, "doc_id").select("text"))
    raw, wanted = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[every["bucket"]], wanted[some["bucket"]] = every["n"], some["n"]
    if not wanted.sum():
        return np.zeros(1 << BITS)
    share = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * len(c)))
    return share(wanted) - share(raw)


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id, log_weight`` of every row: the sum of its buckets' log ratios over the whole text;
    0 for a text without words, or null."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shards(batches):
            at, doc = _buckets(texts)
            sums = np.bincount(doc, weights=shared.value[at], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums.astype(float))], ["doc_id", "log_weight"])

    narrow = docs.select("doc_id", "text")
    return in_batches(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, log_weight double")


def resample(docs: DataFrame, target: DataFrame, share: float = KEPT_SHARE, seed: int = 42) -> DataFrame:
    """``doc_id, log_weight, key, selected`` of every row of ``docs``.

    ``key`` is the log weight plus a Gumbel variate drawn from the hash of id and seed; the rows with the largest keys, the given share of
    all rows (rounded up), are ``selected``: a sample without replacement with probabilities in proportion to the weights.
    Equal keys go by id, a null id first; of equal rows any are taken.
    """
    weights = log_weights(docs, log_ratio(docs, target))
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = cut(weights.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    return mark_top(keyed, [F.desc("key"), F.asc("doc_id")], F.ceil(F.lit(share) * F.lit(keyed.count())), "selected")
