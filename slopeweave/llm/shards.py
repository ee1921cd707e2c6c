"""Texts in tasks: shards of bounded size, byte n-grams and words as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHARD_BYTES = 2 << 20
# Rows of one Arrow batch. Whole texts of a batch are in memory several times (in the JVM, in Arrow, as bytes).
BATCH_ROWS = 1_000
# Odd multipliers for hashing (the first is the golden ratio of 2^64, the others are those of a common 64-bit finaliser).
# Bits of the table that picks out rows by their id, at most (2^27 bits are 16 MB).
ID_BITS = 27
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of a column as text, modulo ``n``; null for null."""
    return F.crc32(F.col(key).cast("string")) % n


def members(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key is among the distinct, non-null ``ids``.

    Texts of other rows stay where they are: a table of bits, one set for the hash of each id, has at most 2^(``ID_BITS`` - 6) rows and is
    broadcast. Rows that meet a set bit, the members and a few more by chance, are joined with the ids themselves, by a shuffle at any size. The more ids, the
    fuller the table, and the more rows are moved in vain.
    """
    wanted = ids.select(F.col(key).cast(docs.schema[key].dataType).alias("_id"))
    bits = min(ID_BITS, max(12, (16 * wanted.count()).bit_length()))
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    table = (wanted.select(place("_id").alias("at")).groupBy(F.shiftright("at", 6).alias("_word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("_set")))
    at = place(docs[key])
    bit = (at.bitwiseAND(F.lit(63))).cast("int")
    some = (docs.filter(docs[key].isNotNull()).join(F.broadcast(table), F.shiftright(at, 6) == table["_word"])
            .filter(F.call_function("shiftright", F.col("_set"), bit).bitwiseAND(F.lit(1)) == 1).select(*[docs[c] for c in docs.columns]))
    return some.join(wanted.hint("merge"), some[key] == wanted["_id"], "left_semi")


def in_batches(docs: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows, so that a task holds few whole texts at once."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.mapInArrow(run, schema)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in the jobs run inside; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shards(batches: Iterator[pa.RecordBatch], limit: int = SHARD_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with some ``limit`` bytes of text each (one text at least), and
    their texts as UTF-8, null as empty."""
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        first = held = 0
        for i, text in enumerate(texts):
            if held and held + len(text) > limit:
                yield batch.slice(first, i - first), texts[first:i]
                first = i
                held = 0
            held += len(text)
        if first < len(texts):
            yield batch.slice(first), texts[first:]


def byte_grams(text: bytes, sizes: range, bits: int) -> np.ndarray:
    """Buckets (of 2^bits) of all byte n-grams of the text, A-Z in lower case; the text is
    padded with a space at either end."""
    return _gram_buckets(np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32), sizes, bits)


def char_grams(text: bytes, sizes: range, bits: int) -> np.ndarray:
    """The same of all character n-grams of the text in lower case. Bytes that are not UTF-8 are replacement characters."""
    return _gram_buckets(np.frombuffer(f" {text.decode('utf-8', 'replace').lower()} ".encode("utf-32-le"), "<u4"), sizes, bits)


def _gram_buckets(data: np.ndarray, sizes: range, bits: int) -> np.ndarray:
    found, h = [], np.zeros(len(data), np.uint32)
    for n in range(1, sizes.stop):
        if n > len(data):
            break
        h = h[:len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1:] + np.uint32(1)
        if n in sizes:
            found.append((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


class Distinct:
    """Distinct buckets of an array, without sorting."""

    def __init__(self, bits: int) -> None:
        self.last = np.zeros(1 << bits, np.uint32)

    def __call__(self, buckets: np.ndarray) -> np.ndarray:
        at = np.arange(len(buckets), dtype=np.uint32)
        self.last[buckets] = at
        return buckets[self.last[buckets] == at]


@dataclass
class Words:
    """Words of a shard in order: place in ``data``, document (index in the shard) and hash."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    per_doc: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX_1
    h = (h ^ (h >> np.uint64(33))) * MIX_2
    return h ^ (h >> np.uint64(33))


_is_word = np.zeros(256, bool)
_is_word[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, kept for the next shard."""
    key = str(base)
    if len(_powers.get(key, ())) < n:
        factors = np.full(max(n, SHARD_BYTES + 4096), base, np.uint64)
        factors[0] = 1
        _powers[key] = np.cumprod(factors)
    return _powers[key][:n]


def words(texts: list[bytes]) -> Words:
    """Words: the longest runs of digits, letters a-z (A-Z are lowered) and non-ASCII characters."""
    data = b"\n".join(texts).lower() + b"\n"
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(_is_word[raw].view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    per_doc = np.diff(np.searchsorted(start, ends), prepend=0)
    base = int(GOLDEN)
    total = np.zeros(len(raw) + 1, np.uint64)
    terms = raw.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power(base, len(raw))
    np.cumsum(terms, out=total[1:])
    del terms
    h = (total[end] - total[start]) * _power(pow(base, -1, 1 << 64), len(raw) + 1)[start] if len(start) else np.zeros(0, np.uint64)
    return Words(data, start, end, np.repeat(np.arange(len(texts)), per_doc), mix(h), per_doc)
