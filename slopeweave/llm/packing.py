"""Tokens of documents, and best-fit packing after Martello and Toth's dominance reduction."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from slopeweave.llm.shards import in_batches, shards
from slopeweave.llm.tokenizing import Encoder, decoded
from slopeweave.session import cut

CAPACITY = 2_048
SEPARATOR = 0
# Rows of one length that are numbered in one task.
RANKED = 200


_encoders: dict[str, Encoder] = {}


def tokens(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, ids`` of every row of ``docs``: the token ids of its whole text and a final 0
    (little-endian unsigned 32-bit, as binary). Documents of more than ``capacity`` tokens are cut into pieces of that
    length, of which the first may be shorter. Null is as empty, which is the 0 alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(path, None) or Encoder(path)
        _encoders[path] = encoder
        for batch, texts in shards(batches, 1 << 20):
            row, piece, start, out = [], [], [], []
            for i, text in enumerate(texts):
                ids = encoder.encode(decoded(text)) + SEPARATOR.to_bytes(4, "little")
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i), piece.append(k), start.append(a), out.append(ids[4 * a:4 * b])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                                              pa.array(start, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "piece", "start", "ids"])

    narrow = docs.select("doc_id", "text")
    return in_batches(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, piece int, start long, ids binary")


@dataclass
class Pattern:
    """``count`` sequences filled alike: lengths in order of placing."""

    lengths: tuple[int, ...]
    count: int


@dataclass
class Instance:
    """Numbers of items by length, and the lengths present in ascending order."""

    capacity: int
    left: dict[int, int]
    lengths: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lengths = sorted(k for k, n in self.left.items() if n)

    def largest(self, room: int, taken: tuple[int, ...] = ()) -> int:
        """The longest item of at most ``room``, besides those taken; 0 if there is none."""
        at = bisect_left(self.lengths, room + 1) - 1
        while at >= 0 and self.left[self.lengths[at]] <= taken.count(self.lengths[at]):
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def least(self, k: int, taken: tuple[int, ...]) -> int:
        """Sum of the ``k`` shortest items besides those taken; beyond the capacity if there are fewer."""
        total = 0
        for length in self.lengths:
            n = min(k, self.left[length] - taken.count(length))
            total += n * length
            k -= n
            if not k or total > self.capacity:
                return total
        return self.capacity + 1

    def take(self, lengths: tuple[int, ...]) -> int:
        """Remove as many equal sets as there are items for; their number."""
        n = min(self.left[k] // lengths.count(k) for k in set(lengths))
        self.remove(lengths, n)
        return n

    def remove(self, lengths: tuple[int, ...], n: int) -> None:
        for k in set(lengths):
            self.left[k] -= n * lengths.count(k)
            if not self.left[k]:
                self.lengths.remove(k)


def dominating(instance: Instance, item: int) -> tuple[int, ...]:
    """A set of up to three items, ``item`` among them, that dominates every other feasible set with it; empty if none is found.

    Alone, if nothing fits beside it; with the longest fitting item, if they fill the sequence, if no two items fit,
    or if no three fit and no two together exceed that one; with two items, if no three fit and the two are
    the longest fitting one and the longest beside it, and no pair has a longer second item.
    """
    room = instance.capacity - item
    one = instance.largest(room, (item,))
    if not one:
        return (item,)
    if one == room or instance.least(2, (item,)) > room:
        return (item, one)
    if instance.least(3, (item,)) <= room:
        return ()
    # Pairs only from here. For each first item, the longest second one that fits beside it.
    best = second = 0
    for p in instance.lengths[:bisect_left(instance.lengths, one + 1)]:
        if instance.left[p] <= (item == p):
            continue
        q = instance.largest(room - p, (item, p))
        if q:
            best, second = max(best, p + q), max(second, min(p, q))
    if one >= best:
        return (item, one)
    beside = instance.largest(room - one, (item, one))
    return (item, one, beside) if beside and second <= beside else ()


def reduce(instance: Instance) -> list[Pattern]:
    """Fix dominating sets, longest item first, again and again until no item has one; the
    instance keeps the rest."""
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for item in reversed(list(instance.lengths)):
            while instance.left[item]:
                found = dominating(instance, item)
                if not found:
                    break
                # The set stays dominating while all its items last: fewer items only lessen the alternatives.
                fixed.append(Pattern(found, instance.take(found)))
                changed = True
    return fixed


def best_fit(instance: Instance) -> list[Pattern]:
    """Best-fit, longest items first: each item goes to the fullest sequence with room for it. Equal
    items meet equally filled sequences, so whole groups are placed at once."""
    open_: dict[int, list[Pattern]] = defaultdict(list)
    rooms: list[int] = []
    for item in reversed(instance.lengths):
        n = instance.left[item]
        while n:
            at = bisect_left(rooms, item)
            if at == len(rooms):
                per = instance.capacity // item
                fresh = [Pattern((item,) * per, n // per)] if n >= per else []
                if n % per:
                    fresh.append(Pattern((item,) * (n % per), 1))
                n = 0
            else:
                room = rooms[at]
                was = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
                fill = min(room // item, n)
                full = min(was.count, n // fill)
                fresh = [Pattern(was.lengths + (item,) * fill, full)] + ([Pattern(was.lengths, was.count - full)] if was.count > full else [])
                n -= fill * full
            for p in fresh:
                room = instance.capacity - sum(p.lengths)
                if not open_[room]:
                    insort(rooms, room)
                open_[room].append(p)
    instance.left, instance.lengths = {}, []
    return [p for patterns in open_.values() for p in patterns]


def plan(sizes: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that place all items of the given lengths (length: number)."""
    instance = Instance(capacity, dict(sizes))
    return reduce(instance) + best_fit(instance)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``doc_id``, ``piece`` and ``length`` (1 to ``capacity``).

    The plan needs only the number of pieces of each length, at most ``capacity`` rows, whatever the
    input's size. Pieces of one length are interchangeable: each gets a number among its equals, and the plan
    says which numbers go to which sequences. Numbers come from groups by length and a salt, so that a common length
    is spread over many tasks, and from the groups' sizes.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces, "pieces")
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spans, sequence = [], 0
    used: dict[int, int] = defaultdict(int)
    for p in plan(sizes, capacity):
        offset = 0
        for length in sorted(set(p.lengths), key=p.lengths.index):
            each = p.lengths.count(length)
            spans.append((length, used[length], each, sequence, offset))
            used[length] += each * p.count
            offset += each * length
        sequence += p.count
    by_length: dict[int, list] = defaultdict(list)
    for length, first, each, seq, offset in spans:
        by_length[length].append((first, each, seq, offset))
    table = [(k, [v[0] for v in vs], vs) for k, vs in by_length.items()]
    # A row for each length in use; a length has a span for each pattern it is part of.
    planned = F.broadcast(spark.createDataFrame(table, "length long, firsts array<long>, spans array<struct<first:long,each:long,sequence:long,offset:long>>"))

    salts = F.greatest(F.ceil(F.col("n") / RANKED), F.lit(1))
    counted = F.broadcast(spark.createDataFrame(list(sizes.items()), "length long, n long"))
    salted = (pieces.withColumn("length", F.col("length").cast("long")).join(counted, "length")
              .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts)).drop("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
               .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    turn = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    numbered = (salted.withColumn("turn", F.row_number().over(turn) - 1).join(offsets, ["length", "salt"])
                .withColumn("number", F.col("before") + F.col("turn")).join(planned, "length"))
    # The last span that starts at or before the number.
    span = F.element_at("spans", F.size(F.filter("firsts", lambda f: f <= F.col("number"))))
    placed = numbered.withColumn("span", span).withColumn("in", F.col("number") - F.col("span.first"))
    return placed.select(*[F.col(c) for c in pieces.columns],
                         (F.col("span.sequence") + F.floor(F.col("in") / F.col("span.each"))).alias("sequence_id"),
                         (F.col("span.offset") + F.pmod(F.col("in"), F.col("span.each")) * F.col("length")).alias("offset"))


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces of ``docs``."""
    pieces = tokens(docs, path, capacity).select(
        "doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, capacity)


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids`` of the packed sequences, the ids as an array; at most ``capacity`` each."""
    pieces = cut(tokens(docs, path, capacity).withColumn("length", (F.octet_length("ids") / 4).cast("long")), "tokens")
    placed = pack(pieces, capacity)

    def joined(rows):
        rows = rows.sort_values("offset")
        ids = np.frombuffer(b"".join(rows["ids"]), "<u4").astype(np.int64)
        return rows[["sequence_id"]].iloc[:1].assign(ids=[ids])

    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(joined, "sequence_id long, ids array<long>")
