"""SimHash fingerprints and near-duplicates by a covering code of anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from slopeweave.llm.linked import components
from slopeweave.llm.shards import in_batches, shards
from slopeweave.session import cut

SHINGLE = 3
SEED = 42
MOST_BITS = 3
# Anchors with more home fingerprints than this are split; their members go to every piece.
HOMES_PER_PIECE = 1_024
HALF = 31

_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` words, single-spaced; of all words if there are fewer; none without words."""
    raw = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    space = _is_space[raw]
    tidy = np.where(space, np.uint8(0x20), raw)[~(space & np.roll(space, 1))] if len(raw) > 1 else raw[:0]
    tidy = tidy if len(tidy) and tidy[0] != 0x20 else tidy[1:]
    blank = np.flatnonzero(tidy == 0x20)
    if not len(blank):
        return np.zeros(0, np.uint64)
    data = tidy.tobytes()
    size = min(size, len(blank))
    starts = [0, *(blank[:len(blank) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[s:e], SEED) for s, e in zip(starts, blank[size - 1:].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit, whether over half the hashes have it; 0 without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, -(-len(hashes) // 65_536)):
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, mark, fp`` of every row of ``docs``: the 64-bit fingerprint of the whole text as a
    signed long, and a hash of id and text that tells rows apart. Null is as empty."""
    narrow = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in shards(batches):
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(fps)], ["doc_id", "mark", "fp"])

    return in_batches(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, mark long, fp long")


def _syndrome(half: Column) -> Column:
    """Syndrome of a 31-bit word in the Hamming code whose column i (1 to 31) is i itself."""
    parity = lambda j: F.bit_count(half.bitwiseAND(F.lit(sum(1 << (i - 1) for i in range(1, HALF + 1) if i >> j & 1)))) % 2
    return sum((parity(j).cast("long") * (1 << j) for j in range(1, 5)), parity(0).cast("long"))


def _errors(radius: int) -> list[list[int]]:
    """For each syndrome, the 31-bit error patterns of weight up to ``radius`` that have it."""
    found: list[list[int]] = [[] for _ in range(HALF + 1)]
    level = [(0, 0, 0)]
    for _ in range(radius + 1):
        for pattern, syndrome, _top in level:
            found[syndrome].append(pattern)
        level = [(p | 1 << (i - 1), s ^ i, i) for p, s, top in level for i in range(top + 1, HALF + 1)]
    return found


def anchored(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``anchor, fp, home`` rows of the distinct fingerprints ``fps (fp)``.

    The anchors are the words of the perfect Hamming code (31, 26), covering radius 1, laid on bits 0-30 and
    on bits 32-62. Two fingerprints that differ in at most ``most_bits`` bits differ in at most ``most_bits // 2`` of one of
    the halves. So each fingerprint has a home anchor on either half, within the covering radius, and goes to all anchors
    within the covering radius plus that threshold; any linked pair meets at the home of each.
    """
    errors = _errors(1 + most_bits // 2)
    nearest = F.lit([e[0] for e in errors]).cast("array<long>")
    around = F.array(*[F.lit(e).cast("array<long>") for e in errors])
    halves = [(F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)), 0), (F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit((1 << HALF) - 1)), 1)]
    sides = F.array(*[F.struct(half.alias("half"), (_syndrome(half) + 1).cast("int").alias("s"), F.lit(side).alias("side")) for half, side in halves])
    return (fps.select("fp", F.explode(sides).alias("x"))
            .select("fp", "x", F.element_at(nearest, F.col("x.s")).alias("near"), F.explode(F.element_at(around, F.col("x.s"))).alias("error"))
            .select((F.col("x.half").bitwiseXOR(F.col("error")) * 2 + F.col("x.side")).alias("anchor"), "fp", (F.col("error") == F.col("near")).alias("home")))


def _link_run(homes: np.ndarray, members: np.ndarray, most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links from ``members`` to ``homes`` that join the same fingerprints as all their links within
    ``most_bits`` would, at most one per member and one more per home."""
    label = np.arange(len(homes))
    for first in range(0, len(members), 1_024):
        block = members[first:first + 1_024]
        near = np.bitwise_count(block[:, None] ^ homes[None, :]) <= most_bits
        some = np.flatnonzero(near.any(axis=1))
        one = near[some].argmax(axis=1)
        other = block[some] != homes[one]
        yield block[some][other], homes[one][other]
        for row in some[near[some].sum(axis=1) > 1]:
            own = np.flatnonzero(near[row])
            roots, at = np.unique(label[own], return_index=True)
            if len(roots) > 1:
                ends = homes[own[at]]
                yield np.full(len(ends), block[row]), ends
                label[np.isin(label, roots)] = roots[0]


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``a, b`` pairs of fingerprints within ``most_bits`` that connect the same groups as all such pairs do."""
    spark = fps.sparkSession
    rows = anchored(fps, most_bits)
    hot = cut(rows.filter("home").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOMES_PER_PIECE)
              .select("anchor", F.ceil(F.col("n") / HOMES_PER_PIECE).cast("int").alias("pieces")), "hot")
    if hot.isEmpty():
        placed = rows.withColumn("piece", F.lit(0))
    else:
        placed = (rows.join(hot, "anchor", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
                  .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
                  .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
                  .withColumn("home", F.col("home") & (F.col("piece") == F.col("mine"))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    key = F.xxhash64("anchor", "piece")
    dealt = (placed.select(key.alias("key"), "home", "fp").repartition(parts, "key")
             .sortWithinPartitions("key", F.desc("home")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys come in order, homes first. Only the homes of the current key are held."""
        key, homes = None, np.zeros(0, np.uint64)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            home = batch.column("home").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            found = []
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(keys))
            sums = np.append(0, np.cumsum(home))
            at_home = sums[ends] - sums[starts]
            # Runs inside the batch with one home or none and one row need no look; the last run may go on.
            for i in np.flatnonzero(((at_home > 0) & (ends - starts > 1)) | (np.arange(len(starts)) == 0) | (ends == len(keys))):
                s, e, n = starts[i], ends[i], at_home[i]
                if keys[s] != key:
                    key, homes = keys[s], fp[s:s + n]
                elif n:  # the homes of one key may be spread over batches: earlier members of it meet only homes, which are members too
                    found += _link_run(fp[s:s + n], homes, most_bits)
                    homes = np.append(homes, fp[s:s + n])
                if len(homes) and e - s:
                    found += _link_run(homes, fp[s:e], most_bits)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").filter("a <> b")


def grouped(docs: DataFrame, size: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, mark, fp, component_id`` of every row of ``docs``.

    Rows whose fingerprints differ in at most ``most_bits`` bits are linked; ``component_id`` is the
    smallest id that links reach, null only where no row of the component has an id. Rows without words have fingerprint 0.
    """
    rows = cut(fingerprints(docs, size), "fingerprints")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), most_bits))
    named = (classes.join(roots, classes["fp"] == roots["node"], "left")
             .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = cut(named.join(ids, "root").select("fp", "component_id"), "component_ids")
    return rows.join(joined, "fp").select("doc_id", "mark", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component the row with the
    smallest id (then the smallest hash of its text; of rows alike in both, one). Where no row of a component has an
    id, one row of each fingerprint stays.
    """
    rows = grouped(docs, size, most_bits)
    first = (rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("k"))
             .select(F.col("k.doc_id").alias("_id"), F.col("k.mark").alias("_mark")))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_mark"))
    same = (packed["_id"] == first["_id"]) | (packed["_id"].isNull() & first["_id"].isNull())
    kept = packed.join(first, (packed["_mark"] == first["_mark"]) & same, "left_semi")
    turn = Window.partitionBy("_mark", "_id").orderBy(F.lit(1))
    return kept.withColumn("_n", F.row_number().over(turn)).filter("_n = 1").select("row.*")
