"""Tokens of one tokenizer aligned with those of another, and how often two tokens end together."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from slopeweave.llm.shards import in_batches, shards
from slopeweave.llm.tokenizing import Encoder, Pieces, decoded
from slopeweave.session import cut

SHARD_TEXT = 1 << 20


class Sides:
    """Both tokenizers of a worker, the bytes of their tokens, and their ids as text with what may follow them."""

    known: dict[tuple[str, str], "Sides"] = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = Encoder(path_a, plain=True), Pieces(path_b)
        self.bytes = [pa.array(side.bytes, pa.large_binary()) for side in (self.a, self.b)]
        self.sizes = [np.fromiter(map(len, side.bytes), np.int64, len(side.bytes)) for side in (self.a, self.b)]
        self.most = max(map(len, self.sizes))
        self.shown = pa.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(self.most)], pa.large_string())

    @classmethod
    def of(cls, *paths: str) -> "Sides":
        if paths not in cls.known:
            cls.known[paths] = cls(*paths)
        return cls.known[paths]

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of either side; none where the text is empty, or a side's bytes are not a space and the text."""
        plain = decoded(text)
        if not plain:
            return None
        ids = self.a.ids(" " + plain), self.b.ids(plain)
        want = b" " + text
        for side, sizes, spelled in zip(ids, self.sizes, self.bytes):
            if int(sizes[side].sum()) != len(want) or _joined(spelled.take(pa.array(side))) != want:
                return None
        return ids


def _joined(parts: pa.Array) -> bytes:
    """The concatenation of a freshly built array of strings."""
    offsets = np.frombuffer(parts.buffers()[1], np.int64)
    return parts.buffers()[2].to_pybytes()[offsets[0]:offsets[len(parts)]]


def common_ends(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of either side up to each byte offset where tokens of both sides end, in order."""
    index_a = {end: i for i, end in enumerate(accumulate(sizes_a.tolist()), 1)}
    index_b = {end: i for i, end in enumerate(accumulate(sizes_b.tolist()), 1)}
    common = sorted(index_a.keys() & index_b.keys())
    return (np.fromiter(map(index_a.__getitem__, common), np.int64, len(common)), np.fromiter(map(index_b.__getitem__, common), np.int64, len(common)))


def group_texts(sides: Sides, ids: list[tuple[np.ndarray, np.ndarray]], ends: list[tuple[np.ndarray, np.ndarray]]) -> list[str]:
    """The groups of each text as ``a1,a2|b1;a3|b2,b3``. The ids' texts are taken from a table, all at once."""
    codes, borders = [], [0]
    for (a, b), (at_a, at_b) in zip(ids, ends):
        code = np.empty(len(a) + len(b), np.int64)
        group_a = np.repeat(np.arange(len(at_a)), np.diff(at_a, prepend=0))
        group_b = np.repeat(np.arange(len(at_b)), np.diff(at_b, prepend=0))
        place_a, place_b = np.arange(len(a)) + np.append(0, at_b)[group_a], np.arange(len(b)) + at_a[group_b]
        code[place_a], code[place_b] = a, b
        code[place_a[at_a - 1]] += sides.most
        code[place_b[at_b - 1]] += 2 * sides.most
        code[-1:] += sides.most
        codes.append(code)
        borders.append(borders[-1] + len(code))
    shown = sides.shown.take(pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int64)))
    offsets = np.frombuffer(shown.buffers()[1], np.int64)[:borders[-1] + 1] if borders[-1] else np.zeros(1, np.int64)
    text = _joined(shown).decode() if borders[-1] else ""
    return [text[offsets[i] - offsets[0]:offsets[j] - offsets[0]] for i, j in zip(borders, borders[1:])]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, shard, links, pairs, counts`` of every row of ``docs``.

    A text is a space and the document's text, encoded by the byte-level tokenizer of ``path_a`` (A) and, without the
    space, by the sentence-piece model of ``path_b`` (B), which adds it. Special tokens' strings are ordinary text. Where tokens of both
    sides end at the same byte, the ids are cut into groups, written as ``a1,a2|b1;a3|b2,b3``; the last tokens of a group's two
    sides are linked, since they end together. A null or empty text, and one whose tokens do not spell it (white
    characters that the model rewrites, bytes that are not UTF-8), has no tokens and no groups.

    Documents of a task are held in shards. ``links`` are those of the document, as the index of each distinct pair among its shard's and
    its number (little-endian unsigned 32-bit, all indexes first). The first document of a shard lists the shard's distinct ``pairs``
    (id of A times 2^32 and id of B) and their ``counts``; in the others both are null.
    """
    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")],
                           T.StructField("groups", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("links", T.BinaryType()),
                           *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("pairs", "counts")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, shard = Sides.of(path_a, path_b), TaskContext.get().partitionId() << 32
        none = np.zeros(0, np.int64)
        for batch, texts in shards(batches, SHARD_TEXT):
            ids = [sides.tokens(t) or (none, none) for t in texts]
            ends = [common_ends(sides.sizes[0][a], sides.sizes[1][b]) for a, b in ids]
            linked = [(a[p - 1].astype(np.int64) << 32) | b[q - 1] for (a, b), (p, q) in zip(ids, ends)]
            pairs, at, counts = np.unique(np.concatenate(linked), return_inverse=True, return_counts=True)
            doc = np.repeat(np.arange(len(texts)), [len(x) for x in linked])
            keys, times = np.unique(doc * max(len(pairs), 1) + at, return_counts=True)
            own, index = np.divmod(keys, max(len(pairs), 1))
            border = np.searchsorted(own, np.arange(len(texts) + 1))
            index, times = index.astype("<u4"), times.astype("<u4")
            links = [index[i:j].tobytes() + times[i:j].tobytes() for i, j in zip(border, border[1:])]
            size = lambda parts: pa.array([len(p) for p in parts], pa.int64())
            first = lambda values: pa.array([values.tolist()] + [None] * (len(texts) - 1), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), size([a for a, _ in ids]), size([b for _, b in ids]), size([p for p, _ in ends]),
                pa.array(group_texts(sides, ids, ends), pa.string()), pa.array([shard] * len(texts), pa.int64()), pa.array(links, pa.binary()),
                first(pairs), first(counts)], schema.names)
            shard += 1

    return in_batches(narrow, run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: how many links hold each pair in all rows, and whether that is the most of any pair with its B id."""
    pairs = aligned.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counted = pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    counted = cut(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair-counts")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """Rows of ``align``, or of a selection of its columns with ``shard``, ``links``, ``pairs`` and ``counts``; instead of these four, with ``n_links``, ``n_best``
    (links whose pair has the highest count of its B id, ties included) and ``count_sum`` (the counts of all links).

    The counts of a shard's distinct pairs are summed over all shards and joined back to it, so that what moves are
    distinct pairs, not links, and a pair that is everywhere is one row for each shard. Then each shard's documents meet
    their pairs' counts.
    """
    aligned = cut(aligned, "aligned")
    used = aligned.filter("pairs IS NOT NULL").select(F.col("shard").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    known = used.join(pair_counts(aligned), "pair").select("of", "at", "n", "best")
    kept = [f for f in aligned.schema.fields if f.name not in ("shard", "links", "pairs", "counts")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in ("n_links", "n_best", "count_sum")]])

    def look_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        n, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        at = pairs["at"].to_numpy()
        n[at], best[at] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
        sums = np.zeros((3, docs.num_rows), np.int64)
        for i, links in enumerate(docs["links"].to_pylist()):
            index, times = np.frombuffer(links, "<u4").reshape(2, -1).astype(np.int64)
            sums[:, i] = times.sum(), (times * best[index]).sum(), (times * n[index]).sum()
        out = docs.select(names)
        for name, values in zip(("n_links", "n_best", "count_sum"), sums):
            out = out.append_column(name, pa.array(values))
        return out

    return aligned.drop("pairs", "counts").groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(look_up, schema)
