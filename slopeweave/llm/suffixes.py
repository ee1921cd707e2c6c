"""Benchmark decontamination by suffix arrays over shards of the documents' words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from slopeweave.llm.shards import in_batches, shards, words
from slopeweave.session import cut

WINDOW = 10
# The items are searched in blocks of some so many bytes, one pass over the documents each.
BLOCK_BYTES = 16 << 20
SPANS = "array<struct<item:string,at:long,words:long>>"


@dataclass
class Tests:
    """The words of a block of items as one sequence, and the suffix at each word."""

    ids: list[str | None]
    hash: np.ndarray
    item: np.ndarray
    left: np.ndarray
    need: np.ndarray

    @classmethod
    def of(cls, ids: list[str | None], texts: list[str | None], window: int) -> "Tests":
        w = words([(t or "").encode() for t in texts])
        ends = np.cumsum(w.per_doc)
        left = ends[w.doc] - np.arange(len(w.doc))
        need = np.minimum(window, w.per_doc)[w.doc]
        return cls(ids, w.hash, w.doc, left, need)


def suffix_array(symbols: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` symbols at least. A suffix has ``left``
    symbols and sorts before those it is a prefix of.

    Prefix doubling: each round sorts only the suffixes that still have equals, by their rank
    and that of the suffix as many symbols on.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    group = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(group, np.arange(n), 0))
    rank[order] = first
    step = 1
    while step < depth and n:
        alone = group & np.append(group[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        own = order[places]
        on = np.minimum(own + step, n - 1)
        second = np.where(left[own] > step, rank[on] + 1, 0)
        key = rank[own] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[places] = own[by]
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group[places] = new
        first = np.maximum.accumulate(np.where(new, places, 0))
        rank[own[by]] = first
        step *= 2
    return order


def search(symbols: np.ndarray, left: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every test suffix: its longest match's length, and the range of the suffix array that shares the
    first ``need`` symbols with it (empty where the match is shorter). All suffixes descend together, one symbol at a time,
    each by binary search within its range."""
    k = len(tests.hash)
    lo, hi = np.zeros(k, np.int64), np.full(k, len(order), np.int64)
    length = np.zeros(k, np.int64)
    low, high = np.zeros(k, np.int64), np.zeros(k, np.int64)
    live = np.arange(k) if len(order) else np.zeros(0, np.int64)
    depth = 0
    while len(live):
        wanted = tests.hash[live + depth]

        def bound(right: bool) -> np.ndarray:
            a, b = lo[live].copy(), hi[live].copy()
            while (a < b).any():
                mid = np.minimum((a + b) >> 1, len(order) - 1)
                at = order[mid]
                has = left[at] > depth
                value = symbols[np.minimum(at + depth, len(symbols) - 1)]
                less = ~has | ((value <= wanted) if right else (value < wanted))
                a, b = np.where((a < b) & less, mid + 1, a), np.where((a < b) & ~less, mid, b)
            return a

        a, b = bound(False), bound(True)
        found = a < b
        live, a, b = live[found], a[found], b[found]
        lo[live], hi[live] = a, b
        depth += 1
        length[live] = depth
        done = tests.need[live] == depth
        low[live[done]], high[live[done]] = a[done], b[done]
        live = live[(tests.left[live] > depth)]
    return length, low, high, hi


def _shard_hits(texts: list[bytes], tests: Tests, depth: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Words per document, and the hits: document, item, first word and number of words of each place where a test suffix matches a window."""
    w = words(texts)
    ends = np.cumsum(w.per_doc)
    left = ends[w.doc] - np.arange(len(w.doc))
    order = suffix_array(w.hash, left, depth)
    _, low, high, _ = search(w.hash, left, order, tests)
    hit = np.flatnonzero(high > low)
    many = high[hit] - low[hit]
    test = np.repeat(hit, many)
    at = order[np.repeat(low[hit] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())] if len(hit) else np.zeros(0, np.int64)
    return w.per_doc, pd.DataFrame({"doc": w.doc[at], "item": tests.item[test], "at": at - (ends - w.per_doc)[w.doc[at]], "words": tests.need[test]})


def merged(hits: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Union of overlapping or touching spans ``at, words`` within equal keys."""
    hits = hits.sort_values([*keys, "at"], ignore_index=True)
    if not len(hits):
        return hits
    group = hits[keys].ne(hits[keys].shift()).any(axis=1).cumsum().to_numpy()
    end = (hits["at"] + hits["words"]).to_numpy()
    reach = pd.Series(end).groupby(group).cummax().to_numpy()
    new = np.append(True, (group[1:] != group[:-1]) | (hits["at"].to_numpy()[1:] > reach[:-1]))
    span = np.cumsum(new) - 1
    out = hits[new].reset_index(drop=True)
    out["words"] = pd.Series(reach).groupby(span).max().to_numpy() - out["at"].to_numpy()
    return out


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, whole: bool = True) -> DataFrame:
    """The rows of ``docs`` with all their columns (but for the text, unless ``whole``) in a struct ``row``, and
    ``n_words``, ``n_hit`` and ``spans``.

    A word of a document is hit if it lies in a place where ``window`` consecutive words of an item (all of them, if it has fewer but
    not none) occur. ``spans`` lists the longest verbatim stretches that these places form: item id as text, first word
    and number of words. Words are the runs of a-z, 0-9 and non-ASCII characters, after A-Z are lowered.

    Each task sorts the suffixes of its shards of words and finds every suffix of every item in them
    by binary search. Shards follow documents' borders, so no match is cut. Items without text match nothing; an
    item without id hits words but has a null id. Repeated items count once by id. Rows of ``docs`` are kept as they are, repeated ones too.
    """
    spark = docs.sparkSession
    texts = items.filter("text IS NOT NULL").select(F.col("item_id").cast("string").alias("id"), "text").distinct()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    # The text travels once, beside the other columns, and comes back only if it is needed.
    others = [f for f in docs.schema.fields if f.name != "text"]
    back = whole or blocks > 1
    schema = T.StructType([T.StructField("row", T.StructType(others)), *[T.StructField("text", docs.schema["text"].dataType)] * back,
                           T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([
                               T.StructField("item", T.StringType()), T.StructField("at", T.LongType()), T.StructField("words", T.LongType())])))])
    found = docs.select(F.struct(*[f.name for f in others]).alias("row"), "text", F.array().cast(SPANS).alias("hits"))
    kind = pa.list_(pa.struct([("item", pa.string()), ("at", pa.int64()), ("words", pa.int64())]))
    for block in range(blocks):
        got = dealt.filter(F.col("block") == block).select("id", "text").toPandas()
        shared = spark.sparkContext.broadcast(Tests.of(list(got["id"]), list(got["text"]), window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            depth = int(tests.left.max(initial=1))
            for batch, texts in shards(batches):
                per_doc, hits = _shard_hits(texts, tests, depth)
                before = batch.column("hits").to_pylist()
                for doc, part in merged(hits, ["doc", "item"]).groupby("doc"):
                    before[doc] = before[doc] + [{"item": tests.ids[i], "at": a, "words": n} for i, a, n in zip(part["item"], part["at"], part["words"])]
                columns = [batch.column("row"), *[batch.column("text")] * back, pa.array(per_doc, pa.int64()), pa.array(before, kind)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        if block:
            found = cut(found.select("row", "text", "hits"), "spans")
        found = in_batches(found, run, schema)
    # Words in any span: spans sorted by start, each adds what lies beyond the ends before it.
    covered = F.aggregate(F.array_sort(F.transform("hits", lambda h: F.struct(h["at"].alias("at"), (h["at"] + h["words"]).alias("end")))),
                          F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                          lambda s, h: F.struct((s["n"] + F.greatest(h["end"] - F.greatest(h["at"], s["end"]), F.lit(0))).alias("n"),
                                                F.greatest(s["end"], h["end"]).alias("end")), lambda s: s["n"])
    row = F.struct(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]) if whole else F.col("row")
    return found.select(row.alias("row"), "n_words", covered.alias("n_hit"), F.col("hits").alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``, and its ``spans``."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda s: s["item"]), lambda i: i.isNotNull())))
    return find(docs.select("doc_id", "text"), items, window, whole=False).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item's window occurs."""
    return find(docs, items, window).filter("n_hit = 0").select("row.*")
