"""Faces of cells to polygons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from slopeweave.functions.cells import face_color
from slopeweave.functions.rings import closed_ring, moved_rings, ring_area
from slopeweave.operators.blocks import SIDE, Window, by_group, local_components
from slopeweave.operators.components import components
from slopeweave.operators.growth import SCOPE
from slopeweave.operators.joins import attach
from slopeweave.operators.ranking import with_position
from slopeweave.session import cut, cut_counting

# Directions of a border edge, with the face on its right in an image (y down).
_STEP = np.array([[1, 0], [0, 1], [-1, 0], [0, -1]])

# Kinds of row that a block reports.
PART, LINK, EDGE_CELL, RING, PATH = 0, 1, 2, 3, 4
_REPORT = ("param_id INT, tile_id STRING, kind TINYINT, face_id BIGINT, a BIGINT, b BIGINT, c BIGINT, "
           "xs ARRAY<INT>, ys ARRAY<INT>")


def simple_loops(corners: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """A closed walk cut wherever it meets a corner again, into loops that touch no corner twice."""
    loops, walk, place = [], [], {}
    for corner in corners:
        if corner in place:
            start = place[corner]
            loops.append(walk[start:])
            for left in walk[start:]:
                del place[left]
            del walk[start:]
        place[corner] = len(walk)
        walk.append(corner)
    loops.append(walk)
    return loops


def _trace_block(side: int):
    """Report of one block: its parts with their cell counts, links to parts of other blocks,
    rings that close inside the block, and pieces of rings that leave it."""

    def report(key: tuple, block: pa.Table) -> pa.Table:
        param_id, tile_id, bx, by = (v.as_py() for v in key)
        px, py, face = (block[c].to_numpy() for c in ("px", "py", "face_id"))
        cell = (py.astype(np.int64) << 32) | px
        order = np.argsort(cell)
        px, py, face, cell = px[order], py[order], face[order], cell[order]
        own = (px // side == bx) & (py // side == by)
        mine = np.flatnonzero(own)
        # Of each kind: face, a, b, c, and the corners as lists or none.
        found: list[tuple] = []
        if len(mine):
            window = Window(px, py, 1)

            def joined(index: np.ndarray, steps: np.ndarray) -> np.ndarray:
                """Neighbour of the same face at one offset per row, or -1."""
                to = window.at[window.place[index] + steps[:, 0] * window.stride + steps[:, 1]]
                return np.where((to >= 0) & (face[to] == face[index]), to, -1)

            ahead = [(mine, joined(mine, np.broadcast_to(step, (len(mine), 2)))) for step in _STEP[:2]]
            u, v = (np.concatenate(x) for x in zip(*ahead))
            u, v = u[v >= 0], v[v >= 0]
            inner = own[v]
            root = cell[local_components(u[inner], v[inner], len(px))]
            roots, first, counts = np.unique(root[mine], return_index=True, return_counts=True)
            found.append((PART, face[mine][first], roots, counts, None, None))
            found.append((LINK, None, *np.unique(np.stack([root[u[~inner]], cell[v[~inner]]]), axis=1), None, None))
            edge = mine[(px[mine] % side == 0) | (py[mine] % side == 0)]
            found.append((EDGE_CELL, None, cell[edge], root[edge], None, None))
            found += _walks(mine, own, px, py, face, cell, root, joined)
        sizes = [len(f[2]) for f in found]
        total = sum(sizes)
        longs = lambda i: np.concatenate([np.zeros(n, np.int64) if f[i] is None else f[i].astype(np.int64) for f, n in zip(found, sizes)]) if found else np.zeros(0, np.int64)
        lists = pa.list_(pa.int32())
        corners = lambda i: pa.concat_arrays([pa.nulls(n, lists) if f[5] is None else f[5][i] for f, n in zip(found, sizes)]) if found else pa.nulls(0, lists)
        return pa.table({
            "param_id": pa.array([param_id] * total, pa.int32()), "tile_id": pa.array([tile_id] * total, pa.string()),
            "kind": np.repeat(np.array([f[0] for f in found], np.int8), sizes),
            **{n: longs(i) for i, n in enumerate(("face_id", "a", "b", "c"), 1)}, "xs": corners(0), "ys": corners(1)})

    return report


def chains(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First member, place, and whether it closes, of the chain that each item is in. ``follow`` gives the item after each, -1 for none; no two items have the same
    after them. A closed chain begins with its least item.

    All items look back at once, twice as far in each round.
    """
    item = np.arange(len(follow))
    before = np.full(len(follow), -1)
    before[follow[follow >= 0]] = item[follow >= 0]
    back, least = before.copy(), item.copy()
    for _ in range(len(follow).bit_length()):
        some = back >= 0
        least = np.where(some, np.minimum(least, least[back]), least)
        back = np.where(some, back[back], -1)
    # Who still has someone before it that far back goes round.
    closed = back >= 0
    before[closed & (least == item)] = -1
    first, place = np.where(before >= 0, before, item), (before >= 0).astype(np.int64)
    while (before[first] >= 0).any():
        first, place = first[first], place + place[first]
    return first, place, closed


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _walks(mine, own, px, py, face, cell, root, joined) -> list[tuple]:
    """Walk the border edges of the block's cells. An edge goes on along its cell's next side,
    straight on, or around the cell diagonally ahead, so that a walk stays with one part."""
    cells, ways = [], []
    for way in range(4):
        outward = np.broadcast_to(_STEP[way - 1], (len(mine), 2))
        open_ = mine[joined(mine, outward) < 0]
        cells.append(open_)
        ways.append(np.full(len(open_), way))
    at, way = np.concatenate(cells), np.concatenate(ways)
    if not len(at):
        return []
    front = joined(at, _STEP[way])
    diagonal = joined(at, _STEP[way] + _STEP[way - 1])
    right, left = front < 0, (front >= 0) & (diagonal >= 0)
    next_cell = np.where(right, at, np.where(left, diagonal, front))
    next_way = np.where(right, (way + 1) % 4, np.where(left, (way - 1) % 4, way))
    slot = np.full(len(px) * 4, -1)
    slot[at * 4 + way] = np.arange(len(at))
    follow = np.where(own[next_cell], slot[next_cell * 4 + next_way], -1)
    # the end of an edge: its cell's corner that lies ahead
    end_x = px[at] + np.isin(way, (0, 1))
    end_y = py[at] + np.isin(way, (1, 2))
    start_key, next_key = cell[at] << 2 | way, cell[next_cell] << 2 | next_way

    first, place, closed = chains(follow)
    order = np.lexsort((place, first))
    chain = first[order]
    begins = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    heads, tails = order[begins], order[np.append(begins[1:], len(order)) - 1]
    turns = order[(right | left)[order]]
    number = np.searchsorted(chain[begins], first[turns])
    counts = np.bincount(number, minlength=len(heads))
    ring = closed[heads]

    def walks(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = turns[which[number]]
        return end_x[some], end_y[some], counts[which]

    paths, own_face = heads[~ring], lambda h: (face[at[h]], root[at[h]])
    xs, ys, sizes = walks(~ring)
    found = [(PATH, *own_face(paths), start_key[paths], next_key[tails[~ring]], (_lists(xs, sizes), _lists(ys, sizes)))]
    # Rings that meet a corner twice are the exception; they are cut there into several.
    x, y = end_x[turns].astype(np.int64), end_y[turns].astype(np.int64)
    met = np.lexsort((y, x, number))
    same = (number[met][1:] == number[met][:-1]) & (x[met][1:] == x[met][:-1]) & (y[met][1:] == y[met][:-1])
    knotted = np.zeros(len(heads), bool)
    knotted[number[met[1:][same]]] = True
    plain = ring & ~knotted
    xs, ys, sizes = walks(plain)
    found.append((RING, *own_face(heads[plain]), None, None, (_lists(xs, sizes), _lists(ys, sizes))))
    knots = np.flatnonzero(ring & knotted)
    loops = [(k, loop) for k in knots for loop in simple_loops(list(zip(*(v[turns[number == k]].tolist() for v in (end_x, end_y)))))]
    if loops:
        of = heads[[k for k, _ in loops]]
        sizes = np.array([len(loop) for _, loop in loops])
        flat = np.array([c for _, loop in loops for c in loop])
        found.append((RING, *own_face(of), None, None, (_lists(flat[:, 0], sizes), _lists(flat[:, 1], sizes))))
    return found


def vectorize(face_pixels: DataFrame, limit: DataFrame | int = 0, side: int = SIDE) -> DataFrame:
    """Polygons of the 4-connected parts of every face, in pixel corners.

    ``face_pixels`` is ``(param_id, tile_id, px, py, face_id)``. Parts of ``limit`` pixels or
    fewer are dropped; ``limit`` is a number or ``(param_id, region_limit)``. Returns
    ``(param_id, tile_id, face_id, part_id, cells, rings)``, outer ring first.
    """
    def blocks(axis: str) -> Column:
        low = F.floor((F.col(axis) - 1) / side).cast("int")
        return F.explode(F.sequence(low, F.floor((F.col(axis) + 1) / side).cast("int")))

    placed = face_pixels.select(*SCOPE, "px", "py", "face_id", blocks("px").alias("bx")).select("*", blocks("py").alias("by"))
    report, seen = cut_counting(
        by_group(placed, [*SCOPE, "bx", "by"], _trace_block(side), _REPORT), "traced",
        links=F.count_if(F.col("kind") == LINK), paths=F.count_if(F.col("kind") == PATH))

    def kind(which: int, *columns: str | Column) -> DataFrame:
        return report.filter(F.col("kind") == which).select(*SCOPE, *columns)

    parts = kind(PART, "face_id", F.col("a").alias("part_id"), F.col("b").alias("cells"))
    rings = kind(RING, F.col("a").alias("part_id"), "xs", "ys")
    if seen["paths"]:
        rings = rings.unionByName(_close(kind(
            PATH, F.col("a").alias("part_id"), F.col("b").alias("start"), F.col("c").alias("next"), "xs", "ys")))
    if seen["links"]:
        far = kind(EDGE_CELL, F.col("a").alias("b"), F.col("b").alias("far"))
        links = kind(LINK, "a", "b").join(far, [*SCOPE, "b"]).select(*SCOPE, "a", F.col("far").alias("b"))
        tops = components(links, SCOPE).select(*SCOPE, F.col("node").alias("part_id"), F.col("root").alias("_top"))
        parts, rings = (
            attach(df, tops, [*SCOPE, "part_id"], "left").withColumn("part_id", F.coalesce("_top", "part_id")).drop("_top")
            for df in (parts, rings))
    parts = parts.groupBy(*SCOPE, "face_id", "part_id").agg(F.sum("cells").alias("cells"))
    parts = drop_small_parts(parts, limit)
    ring = closed_ring(F.col("xs"), F.col("ys"))
    traced = rings.select(*SCOPE, "part_id", ring.alias("ring")).select(
        *SCOPE, "part_id", F.struct(
            (ring_area(F.col("ring")) < 0).alias("hole"),
            F.get(F.get("ring", F.lit(0)), F.lit(1)).alias("y"), F.get(F.get("ring", F.lit(0)), F.lit(0)).alias("x"),
            "ring").alias("r"))
    polygons = traced.groupBy(*SCOPE, "part_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return (parts.join(polygons, [*SCOPE, "part_id"])
            .select(*SCOPE, "face_id", "part_id", "cells", F.transform("r", lambda r: r["ring"]).alias("rings")))


def drop_small_parts(parts: DataFrame, limit: DataFrame | int) -> DataFrame:
    """Parts of more than ``limit`` cells."""
    if isinstance(limit, int):
        return parts.filter(F.col("cells") > limit)
    return (parts.join(F.broadcast(limit.select("param_id", "region_limit")), "param_id")
            .filter("cells > region_limit").drop("region_limit"))


def _close(paths: DataFrame) -> DataFrame:
    """Rings from the pieces that left their blocks, joined end to start.

    Every piece looks twice as far ahead each round, until none finds a lesser piece: then all
    pieces of a ring know its least one. The same doubling gives each piece its distance to it.
    """
    key = [*SCOPE, "start"]
    ahead = cut(paths.select(*key, "next", F.col("start").alias("ring")), "ahead")
    while True:
        beyond = ahead.select(*SCOPE, F.col("start").alias("next"), F.col("next").alias("_next"), F.col("ring").alias("_ring"))
        ahead, seen = cut_counting(
            ahead.join(beyond, [*SCOPE, "next"])
            .select(*key, F.col("_next").alias("next"), F.least("ring", "_ring").alias("ring"),
                    (F.col("_ring") < F.col("ring")).alias("_fell")),
            "ahead", fell=F.count_if("_fell"))
        ahead = ahead.drop("_fell")
        if not seen["fell"]:
            break
    named = paths.join(ahead.select(*key, "ring"), key)
    leads = F.col("start") == F.col("ring")
    hops = cut(named.select(*key, "ring", F.when(leads, F.col("start")).otherwise(F.col("next")).alias("next"),
                            F.when(leads, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("hops")), "hops")
    while True:
        beyond = hops.select(*SCOPE, F.col("start").alias("next"), F.col("next").alias("_next"), F.col("hops").alias("_hops"))
        hops, seen = cut_counting(
            hops.join(beyond, [*SCOPE, "next"])
            .select(*key, "ring", F.col("_next").alias("next"), (F.col("hops") + F.col("_hops")).alias("hops"),
                    (F.col("_hops") > 0).alias("_moved")),
            "hops", moved=F.count_if("_moved"))
        hops = hops.drop("_moved")
        if not seen["moved"]:
            break
    pieces = named.join(hops.select(*key, "hops"), key)
    # the least piece comes first (null), then those farthest from it along the ring
    place = F.when(F.col("hops") > 0, -F.col("hops"))
    whole = pieces.groupBy(*SCOPE, "ring").agg(
        F.min("part_id").alias("part_id"),
        F.sort_array(F.collect_list(F.struct(place.alias("place"), "xs", "ys"))).alias("p")).select(
        *SCOPE, "part_id", F.flatten("p.xs").alias("xs"), F.flatten("p.ys").alias("ys"))

    def split(batches):
        for batch in batches:
            rows = {n: [] for n in batch.schema.names}
            for row in batch.to_pylist():
                for loop in simple_loops(list(zip(row["xs"], row["ys"]))):
                    for name in (*SCOPE, "part_id"):
                        rows[name].append(row[name])
                    rows["xs"].append([c[0] for c in loop])
                    rows["ys"].append([c[1] for c in loop])
            yield pa.RecordBatch.from_pydict(rows, schema=batch.schema)

    return whole.mapInArrow(split, whole.schema)


def to_crs(features: DataFrame, georef: DataFrame) -> DataFrame:
    """Ring corners from pixels to map coordinates; adds ``srid``, 0 when unknown."""
    matrix = ["m00", "m01", "m02", "m10", "m11", "m12"]
    return (attach(features, georef.select("tile_id", *matrix, "srid"), ["tile_id"])
            .withColumns({"rings": moved_rings(F.col("rings")), "srid": F.coalesce("srid", F.lit(0))})
            .drop(*matrix))


def label_colors(faces: DataFrame, before: DataFrame) -> DataFrame:
    """Display colour of every face by its position in size order. ``faces`` has the size and
    seed columns; ``before`` is ``(param_id, tile_id, n)``, large regions before merging."""
    placed = with_position(faces, SCOPE, [F.col("size").desc(), F.col("seed_ncurv"), F.col("seed_id")], "index")
    return (placed.join(before, SCOPE)
            .withColumn("color", face_color(F.col("index"), F.col("n"))))
