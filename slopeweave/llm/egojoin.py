"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from slopeweave.llm.linked import components
from slopeweave.llm.shards import rows_per_batch
from slopeweave.llm.topk import positions
from slopeweave.operators.blocks import by_group, local_components
from slopeweave.session import cut

SIMILARITY = 0.95
# Vectors of one block of the sequence, and blocks (or intervals) of one interval.
BLOCK, FAN = 2_048, 8
# Vectors that the principal dimensions are fitted on; they only decide the order, not the links.
FITTED = 20_000
# Leading principal dimensions of the grid.
GRID = 8
# Rows of a block that are compared at once.
AT_ONCE = 512
# Blocks that are sent to a task in one batch.
BLOCKS_AT_ONCE = 4
# Bytes of blocks (as doubles) of one stripe of the sequence, about; a stripe is compared with all blocks in one pass. There are so many passes at least,
# and each deals the blocks beside the stripe to so many tasks.
STRIPE_BYTES, STRIPES, CHUNKS = 1 << 25, 4, 24
# Bounds are widened by this, so that rounding never skips a link.
SLACK = 1e-7
# A vector that more than this share of all rows has in common is looked up in a broadcast table (of at most its inverse rows).
HOT_SHARE = 1e-3


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double vectors scaled by powers of two (which is exact) so that no norm over- or underflows, and their norms."""
    vectors = vectors.astype(np.float64)
    most = np.abs(vectors).max(axis=1, initial=0.0)
    vectors = np.ldexp(vectors, -np.frexp(most)[1][:, None])
    return vectors, np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def usable(vector: str) -> Column:
    """Whether a vector can be linked: not null, not zero, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal(classes: DataFrame, width: int) -> np.ndarray:
    """Orthogonal directions, widest spread first, of at most ``FITTED`` vectors taken by the order of their hash."""
    some = classes.select("vector").orderBy(F.xxhash64("vector")).limit(FITTED).toArrow()
    if some.num_rows < 2:
        return np.eye(width)
    vectors, norms = unit(_matrix(some["vector"].combine_chunks(), width))
    vectors /= norms[:, None]
    return np.linalg.eigh(np.cov(vectors.T).reshape(width, width))[1][:, ::-1]


def sequence(classes: DataFrame, axes: Broadcast, width: int, epsilon: float) -> DataFrame:
    """``no, vector, many, block``: the classes in epsilon grid order, dealt to blocks of ``BLOCK``.

    The cell of a vector is that of its leading principal coordinates in a grid of edge epsilon; the order is by cell, dimension by dimension, and
    then by coordinate and number, so that a crowded cell is spread over blocks. Rows are range-partitioned by that order.
    """
    schema = T.StructType([*classes.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("first", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, norms = unit(_matrix(batch.column("vector"), width))
            along = vectors / norms[:, None] @ axes.value[:, :GRID]
            cells = np.floor(along / epsilon).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(along[:, 0])], schema.names)

    placed = classes.mapInArrow(place, schema)
    ordered = positions(placed, [F.asc("cells"), F.asc("first"), F.asc("no")], "at")
    return ordered.select("no", "vector", "many", F.floor(F.col("at") / BLOCK).alias("block"))


INTERVAL = "no long, level int, n long, low array<double>, high array<double>, centre array<double>, radius double"


def intervals(blocks: DataFrame) -> DataFrame:
    """A row for each interval of the sequence on each level: its box and ball. Level 0 are the blocks; each further level joins ``FAN`` neighbours,
    up to one for all."""

    def join(key: tuple, part: pa.Table) -> pa.Table:
        n = part["n"].to_numpy()
        low, high, centre = (np.stack(part[c].to_numpy()) for c in ("low", "high", "centre"))
        middle = n @ centre / n.sum()
        radius = (np.linalg.norm(centre - middle, axis=1) + part["radius"].to_numpy()).max()
        row = {"no": key[0].as_py(), "level": part["level"][0].as_py() + 1, "n": int(n.sum()), "low": low.min(axis=0), "high": high.max(axis=0), "centre": middle, "radius": radius}
        return pa.table({k: pa.array([v], pa.list_(pa.float64()) if isinstance(v, np.ndarray) else {"level": pa.int32(), "radius": pa.float64()}.get(k, pa.int64())) for k, v in row.items()})

    every = last = blocks
    while last.count() > 1:
        up = last.withColumn("no", F.floor(F.col("no") / FAN))
        last = cut(up.groupBy("no").applyInArrow(join, INTERVAL), "intervals")
        every = every.unionByName(last)
    return cut(every, "intervals")


def _bounds(batches: Iterator[pa.RecordBatch], epsilon: float) -> Iterator[pa.RecordBatch]:
    """Pairs of intervals that are not provably further apart than epsilon, and whether they are provably within it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        side = lambda s, c: np.stack(batch.column(f"{s}_{c}").to_numpy(zero_copy_only=False))
        gap = np.maximum(0, np.maximum(side("a", "low") - side("b", "high"), side("b", "low") - side("a", "high")))
        apart = np.linalg.norm(side("a", "centre") - side("b", "centre"), axis=1)
        reach = batch.column("a_radius").to_numpy() + batch.column("b_radius").to_numpy()
        possible = (np.linalg.norm(gap, axis=1) <= epsilon + SLACK) & (apart - reach <= epsilon + SLACK)
        within = apart + reach <= epsilon - SLACK
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(within)], ["a", "b", "within"])
        yield out.filter(pa.array(possible))


def interval_pairs(every: DataFrame, epsilon: float) -> DataFrame:
    """``a, b, level, within`` with a <= b: the pairs of intervals that the recursion ends in.

    It starts with the whole sequence beside itself. A pair that is provably further apart than epsilon is skipped; one that is provably within
    it is kept as it is; any other is replaced by the pairs of its parts, down to blocks.
    """
    spark = every.sparkSession
    top = every.agg(F.max("level")).first()[0]
    pairs = every.filter(F.col("level") == top).select(F.col("no").alias("a"), F.col("no").alias("b"))
    found = None
    for level in range(top, -1, -1):
        here = every.filter(F.col("level") == level)
        of = lambda s: here.select(F.col("no").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("low", "high", "centre", "radius")])
        # Not a broadcast by choice: how many intervals there are depends on the rows.
        near = pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(lambda batches: _bounds(batches, epsilon), "a long, b long, within boolean")
        near = cut(near.withColumn("level", F.lit(level)), "near")
        done = near if level == 0 else near.filter("within")
        found = done if found is None else found.unionByName(done)
        part = F.array(*[F.lit(i) for i in range(FAN)])
        pairs = (near.filter("NOT within").select((F.col("a") * FAN).alias("x"), (F.col("b") * FAN).alias("y"), F.explode(part).alias("i"))
                 .select("x", "y", "i", F.explode(part).alias("j")).select((F.col("x") + F.col("i")).alias("a"), (F.col("y") + F.col("j")).alias("b")).filter("a <= b"))
    return found


def _pack(width: int, number: str):
    """A block's rows as one: numbers, vectors, numbers of rows, box and ball of its unit vectors along the principal axes."""
    def pack(key: tuple, part: pa.Table, axes) -> pa.Table:
        part = part.sort_by("no").combine_chunks()
        raw = _matrix(part["vector"].chunk(0), width)
        vectors, norms = unit(raw)
        along = vectors / norms[:, None] @ axes
        middle = along.mean(axis=0)
        lists = pa.list_(pa.float64())
        return pa.table({
            "no": pa.array([key[0].as_py()], pa.int64()), "level": pa.array([0], pa.int32()), "n": pa.array([len(raw)], pa.int64()),
            "low": pa.array([along.min(axis=0)], lists), "high": pa.array([along.max(axis=0)], lists), "centre": pa.array([middle], lists),
            "radius": pa.array([np.linalg.norm(along - middle, axis=1).max()]),
            "ids": pa.array([part["no"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "many": pa.array([part["many"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "rows": pa.array([np.ascontiguousarray(raw, number).tobytes()], pa.binary())})
    return pack


def _compare(one: tuple, other: tuple, same: bool, similarity: float) -> tuple[list, np.ndarray, np.ndarray]:
    """Linked rows of two blocks: for either, the sums of the other rows' numbers; and pairs that connect what the links connect."""
    (x, nx, wx), (y, ny, wy) = one, other
    sums = [np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)]
    ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for first in range(0, len(x), AT_ONCE):
        part = slice(first, first + AT_ONCE)
        near = (x[part] @ y.T) / (nx[part, None] * ny[None, :]) >= similarity
        u, v = np.nonzero(near)
        u += first
        if same:
            u, v = u[u != v], v[u != v]
        # Sums of whole numbers below 2^53 are exact in doubles.
        sums[0] += np.bincount(u, weights=wy[v], minlength=len(x)).astype(np.int64)
        if not same:
            sums[1] += np.bincount(v, weights=wx[u], minlength=len(y)).astype(np.int64)
        if len(u):
            # Rows of the other block are numbered after those of this one. Links found so far are kept as a star for each group.
            a, b = np.append(ends[0], u), np.append(ends[1], v if same else v + len(x))
            label = local_components(a, b, len(x) + (0 if same else len(y)))
            moved = np.flatnonzero(label != np.arange(len(label)))
            ends = [moved, label[moved]]
    return sums, *ends


def links(packed: DataFrame, pairs: DataFrame, width: int, kind: str, similarity: float) -> DataFrame:
    """``a, b, n``: for each class ``a`` with links the number of rows that it is linked to (``b`` null), and pairs ``a, b`` that connect the same groups
    as all links (``n`` null), from pairs of blocks.

    The sequence is gone through in stripes. The blocks beside a stripe are dealt to tasks in chunks, and each task gets its blocks and those of the stripe once for all
    their pairs. So a pass moves the blocks about once, and the stripe once for each chunk, however many pairs there are; what it moved goes before the next pass.
    """
    blocks = packed.agg(F.coalesce(F.max("no") + 1, F.lit(0))).first()[0]
    stripe = max(1, min(-(-blocks // STRIPES), STRIPE_BYTES // (BLOCK * width * 8)))
    chunk = -(-blocks // CHUNKS)
    found = None
    for first in range(0, blocks, stripe):
        met = pairs.filter((F.col("a") >= first) & (F.col("a") < first + stripe)).select(F.floor(F.col("b") / chunk).alias("chunk"), "a", "b")
        # A few dozen rows for each block at most.
        needed = F.broadcast(met.select("chunk", F.explode(F.array("a", "b")).alias("no")).distinct())
        sent = (packed.select("no", "ids", "many", "rows").join(needed, "no").select("chunk", F.col("no").alias("a"), F.lit(None).cast("long").alias("b"), "ids", "many", "rows")
                .unionByName(met, allowMissingColumns=True))
        part = cut(by_group(sent, ["chunk"], _linked(width, kind, similarity), "a long, b long, n long"), "links")
        found = part if found is None else found.unionByName(part)
    return pairs.select("a", "b", F.col("a").alias("n")).limit(0) if found is None else found


def _linked(width: int, kind: str, similarity: float):
    """Links of the pairs of blocks of one group, whose rows are blocks (without ``b``) and pairs."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        held, pairs, parts = {}, [], []
        for row in range(len(group)):
            get = lambda c: group[c][row].as_py()
            if get("b") is not None:
                pairs.append((get("a"), get("b")))
            else:
                held[get("a")] = (np.frombuffer(get("ids"), "<i8"), (*unit(np.frombuffer(get("rows"), kind).reshape(-1, width)), np.frombuffer(get("many"), "<i8")))
        for a, b in sorted(pairs):
            same = a == b
            ids = [held[a][0], held[b][0]]
            sums, u, v = _compare(held[a][1], held[b][1], same, similarity)
            every = ids[0] if same else np.concatenate(ids)
            of, n = (ids[0], sums[0]) if same else (every, np.concatenate(sums))
            of, n = of[n > 0], n[n > 0]
            parts.append(pa.table({"a": pa.array(np.append(of, every[u])), "b": pa.concat_arrays([pa.nulls(len(of), pa.int64()), pa.array(every[v])]),
                                   "n": pa.concat_arrays([pa.array(n), pa.nulls(len(u), pa.int64())])}))
        return pa.concat_tables(parts)

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row of ``vectors``.

    Rows whose cosine, in double precision, is ``similarity`` or more are linked. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest
    key that links reach, ``kept`` tells whether it is the row's own. Vectors that are null, zero or hold null or non-finite components link with nothing; a
    shorter vector is compared as if filled up with zeros. Rows without a key count as links of others; they name no component and are not kept. Equal
    rows are compared once, as a class with its number of rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), usable(vector).alias("usable"))
    kind = rows.schema["vector"].dataType.elementType
    counted = (rows.filter("usable").groupBy("vector").agg(F.count("*").alias("many"), F.min("key").alias("least"))
               .select(F.monotonically_increasing_id().alias("no"), "vector", "many", "least"))
    classes = cut(counted, "classes")
    width = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * similarity)))
    axes = spark.sparkContext.broadcast(principal(classes, width))
    placed = sequence(classes.select("no", "vector", "many"), axes, width, epsilon)
    number = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    pack = _pack(width, number)
    packed = cut(placed.groupBy("block").applyInArrow(lambda key, part: pack(key, part, axes.value), f"{INTERVAL}, ids binary, many binary, rows binary"), "blocks")
    every = intervals(packed.drop("ids", "many", "rows"))
    pairs = cut(interval_pairs(every, epsilon), "interval-pairs") if not packed.isEmpty() else every.select(F.col("no").alias("a"), F.col("no").alias("b"), "level", F.lit(True).alias("within"))

    with rows_per_batch(spark, BLOCKS_AT_ONCE):
        found = links(packed, pairs.filter("level = 0 AND NOT within"), width, number, similarity)
    members = cut(placed.select("no", "many", "block"), "members")
    counts, edges = _within(members, pairs.filter("within"))
    n_links = found.filter("b IS NULL").select("a", "n").unionByName(counts).groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b").unionByName(edges))

    named = (classes.join(roots, classes["no"] == roots["node"], "left").join(n_links, classes["no"] == n_links["a"], "left")
             .select("vector", "many", "least", F.coalesce("root", "no").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links")))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = cut(named.join(least, "root").select("vector", "many", "n_links", "component"), "named")
    return _looked_up(rows, named).select(F.col("key").alias(key), "n_links", F.col("component").alias("component_id"),
                                          F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


def _within(members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of pairs of intervals that are linked as a whole: their numbers ``a, n``, and ``a, b`` pairs that connect them.

    Each interval has one number for all its members: the rows of all intervals linked to it.
    """
    none = members.limit(0).select(F.col("no").alias("a"), F.col("no").alias("b"), F.col("many").alias("n"))
    if pairs.isEmpty():
        return none.select("a", "n"), none.select("a", "b")
    levels = [r["level"] for r in pairs.select("level").distinct().collect()]
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("block") / FAN ** k).alias("in")) for k in levels]))
    spread = members.select("no", "many", at.alias("x")).select("no", "many", "x.level", "x.in")
    whole = cut(spread.groupBy("level", "in").agg(F.sum("many").alias("rows"), F.min("no").alias("one")), "whole")
    both = pairs.select("level", "a", "b").unionByName(pairs.filter("a <> b").select("level", F.col("b").alias("a"), F.col("a").alias("b")))
    other = whole.select("level", F.col("in").alias("b"), "rows", F.col("one").alias("other"))
    linked = cut(both.join(other, ["level", "b"]).groupBy("level", F.col("a").alias("in")).agg(F.sum("rows").alias("rows"), F.min("other").alias("other"),
                                                                                             F.max(F.col("a") == F.col("b")).alias("itself")), "linked")
    one = spread.join(linked, ["level", "in"])
    counts = one.select(F.col("no").alias("a"), (F.col("rows") - F.when(F.col("itself"), F.col("many")).otherwise(0)).alias("n"))
    # Every member is connected to one member of a linked interval, and that to one member of each other.
    ends = both.join(whole.select("level", F.col("in").alias("a"), F.col("one").alias("x")), ["level", "a"]).join(other, ["level", "b"])
    edges = one.select(F.col("no").alias("a"), F.col("other").alias("b")).unionByName(ends.select(F.col("x").alias("a"), F.col("other").alias("b")))
    return counts, edges


def _looked_up(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Each row with its class's ``n_links`` and ``component``; a row that cannot be linked has none and its own key.

    Classes with more than ``HOT_SHARE`` of all rows are at most the inverse of that share in number and are broadcast, so no key of the shuffled join
    has more rows than that.
    """
    most = (named.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]) * HOT_SHARE
    hot = F.broadcast(named.filter(F.col("many") > most).select("vector", "n_links", "component"))
    cold = named.filter(F.col("many") <= most).select("vector", "n_links", "component")
    good = rows.filter("usable").select("key", "vector")
    alone = rows.filter("NOT usable").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return (good.join(hot, "vector").select("key", "n_links", "component")
            .unionByName(good.join(hot.select("vector"), "vector", "left_anti").join(cold, "vector").select("key", "n_links", "component"))
            .unionByName(alone))
