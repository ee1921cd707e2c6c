"""Documents scored by the cross-entropy difference of two matched n-gram models with one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slopeweave.llm.shards import in_batches, members, mix, shards, words

# The shared vocabulary: a word's class is its hash. Class 0 stands for the start of a document.
WORD_BITS = 16
# Classes of word pairs, by their hash: the size of either model, whatever the input's size.
PAIR_BITS = 22
PRIOR = 20.0
ROWS_OUT = 1 << 16

WORD, BEFORE, PAIR = 0, 1, 2
# Where the classes of each kind begin in an array of all.
_FIRST = [0, 1 << WORD_BITS, 2 << WORD_BITS, (2 << WORD_BITS) + (1 << PAIR_BITS)]
# Losses by either model, as if the document were among those it counts and as if not.
_LOSSES = ["target_in", "target_out", "other_in", "other_out"]


class Grams:
    """Classes of each word of a shard: of itself, of the word before (0 at a text's start) and of the pair; and its document."""

    def __init__(self, texts: list[bytes]) -> None:
        w = words(texts)
        self.doc, self.per_doc = w.doc, w.per_doc
        own = (w.hash % np.uint64((1 << WORD_BITS) - 1) + np.uint64(1)).astype(np.int64)
        before = np.append(0, own[:-1])[:len(own)]
        before[np.append(True, w.doc[1:] != w.doc[:-1])[:len(own)]] = 0
        pair = mix((before << WORD_BITS | own).astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)
        self.classes = {WORD: own, BEFORE: before, PAIR: pair.astype(np.int64)}


def _counted(texts: DataFrame, side: str) -> DataFrame:
    """``class, n, side`` summed over each task's texts, in arrays of fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(_FIRST[-1], np.int32)
        for _, shard in shards(batches):
            grams = Grams(shard)
            for kind, classes in grams.classes.items():
                met, n = np.unique(classes, return_counts=True)
                sums[_FIRST[kind] + met] += n.astype(np.int32)
        used = np.flatnonzero(sums)
        for first in range(0, len(used), ROWS_OUT):
            at = used[first:first + ROWS_OUT]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["class", "n"])

    return in_batches(texts, count, "class int, n int").withColumn("side", F.lit(side))


def models(docs: DataFrame, ids: DataFrame) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Counts of each class of words, words before and pairs over all rows of ``docs (doc_id, text)``: for each kind, those of the documents in ``ids`` and those
    of the others; and the words of either.

    Every task reports the classes it met, which are summed. What comes to the driver is at
    most a row for each class.
    """
    both = _counted(docs.select("text"), "all").unionByName(_counted(members(docs, ids, "doc_id").select("text"), "target"))
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))
    summed = both.groupBy("class").agg(of("target").alias("target"), (of("all") - of("target")).alias("other"))
    summed = summed.select("class", F.col("target").cast("float").alias("target"), F.col("other").cast("float").alias("other")).toArrow()
    whole = np.zeros((2, _FIRST[-1]), np.float32)
    at = summed["class"].to_numpy()
    whole[:, at] = summed["target"].to_numpy(), summed["other"].to_numpy()
    tables = {kind: whole[:, _FIRST[kind]:_FIRST[kind + 1]] for kind in (WORD, BEFORE, PAIR)}
    return tables, tables[WORD].sum(axis=1, dtype=np.float64)


def _own(doc: np.ndarray, classes: np.ndarray, size: int) -> np.ndarray:
    """How often each word's class occurs in its own document."""
    _, inverse, n = np.unique(doc * size + classes, return_inverse=True, return_counts=True)
    return n[inverse]


def differences(docs: DataFrame, target: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``doc_id, n_words, loss_target, loss_background, difference`` of every row of ``docs``.

    The target model counts the documents in ``target (doc_id)``, the background model all others. Both are bigram models over the same
    classes of words and of word pairs, with a Dirichlet prior on their own unigrams, which have one added to each count. They are matched: the counts
    of the larger one are scaled down to the number of words of the smaller, so that both are smoothed alike. Counts are over all rows; a document is scored
    without its own words' counts, so that it does not vouch for itself.

    A loss is the mean negative log probability (nats) of the document's words, and the difference is target less background: the
    lower, the more like the target. A text without words, or null, has losses and difference 0. Where either side has no words, both models are
    uniform and differences are 0. A row without id is never a target; of repeated ids every row is. Bytes that are not UTF-8 are parts of words.
    """
    ids = target.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    narrow = docs.select("doc_id", "text")
    counted, total = models(narrow, ids)
    scale = total.min() / np.maximum(total, 1)
    shared = docs.sparkSession.sparkContext.broadcast((counted, total, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total, scale = shared.value
        for batch, texts in shards(batches):
            grams = Grams(texts)
            doc, n = grams.doc, grams.per_doc
            own = {kind: _own(doc, classes, tables[kind].shape[1]) for kind, classes in grams.classes.items()}
            losses = []
            for side in (0, 1):
                for inside in (1, 0):
                    left = {kind: scale[side] * np.maximum(tables[kind][side, classes] - own[kind] * inside, 0.0) for kind, classes in grams.classes.items()}
                    of_all = scale[side] * np.maximum(total[side] - n * inside, 0)[doc]
                    unigram = (left[WORD] + 1.0) / (of_all + (1 << WORD_BITS))
                    logs = np.log((left[PAIR] + prior * unigram) / (left[BEFORE] + prior))
                    losses.append(-np.bincount(doc, weights=logs, minlength=len(texts)) / np.maximum(n, 1) + 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(x) for x in losses]], ["doc_id", "n_words", *_LOSSES])

    kind_of_id = narrow.schema["doc_id"].dataType.simpleString()
    losses = in_batches(narrow, run, f"doc_id {kind_of_id}, n_words long, " + ", ".join(f"{c} double" for c in _LOSSES))
    # Only now, beside a few numbers instead of the text, each document learns on which side it is.
    sided = losses.join(ids.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    wanted = F.col("_id").isNotNull()
    both = sided.select("doc_id", "n_words", F.when(wanted, F.col("target_in")).otherwise(F.col("target_out")).alias("loss_target"),
                        F.when(wanted, F.col("other_out")).otherwise(F.col("other_in")).alias("loss_background"))
    return both.withColumn("difference", F.col("loss_target") - F.col("loss_background"))
