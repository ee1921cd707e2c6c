"""Regions of like orientation, grown from the cell-to-cell tests.

Two masked cells are tested when one is among the other's k nearest. The test is smooth if
their normals agree, and strong if curvature and colour agree too. A region is a set of cells
connected by strong pairs; a cell without any strong pair joins the best-seeded region that
reaches it smoothly, else it stays alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from slopeweave.functions.cells import cell_px, cell_py, seed_key, seed_parts
from slopeweave.functions.planes import cosine
from slopeweave.operators.blocks import (
    SIDE, Window, by_group, local_components, near_edge, nearest, offsets, reach, reach_column, with_blocks)
from slopeweave.operators.components import components
from slopeweave.operators.joins import attach
from slopeweave.session import cut, cut_counting

SCOPE = ["param_id", "tile_id"]

# Kinds of row that a block reports.
CELL, LINK, REACHED, REACHED_FROM_OUTSIDE = 0, 1, 2, 3
_CARRIED = ["ncurv", "intensity", "height"]
# What an edge test looks at.
EDGE_VALUES = ["nx", "ny", "nz", "ncurv", "intensity"]
_REPORT = ("param_id INT, tile_id STRING, kind TINYINT, a BIGINT, b BIGINT, strong BOOLEAN, "
           + ", ".join(f"{c} DOUBLE" for c in _CARRIED))


# --- the tests as table operators -------------------------------------------------------

def knn_cells(cells: DataFrame, tiles: DataFrame, k: int, carried: list[str] | None = None) -> DataFrame:
    """The k nearest grid cells of each masked cell, itself included, as
    ``(tile_id, px, py, qx, qy, d2, rnk)``; ties by column, then row. Columns ``carried`` of the cell are passed on as ``p_<name>``.

    The candidates come from one array of offsets, nearest first, so there is neither a join
    of cells nor a window, and exactly k rows per cell leave the stage.
    """
    radius = tiles.agg(F.max(reach_column(F.lit(k), F.col("w"), F.col("h")))).first()[0] or 0
    steps = F.array(*[F.struct(F.lit(int(dx)).alias("dx"), F.lit(int(dy)).alias("dy"))
                      for dx, dy in offsets(radius)])
    own = [f"p_{c}" for c in carried or []]
    placed = attach(cells.filter("in_mask").select("tile_id", "px", "py", *[F.col(c).alias(f"p_{c}") for c in carried or []]),
                    tiles.select("tile_id", "w", "h"), ["tile_id"])
    inside = F.filter(steps, lambda s: (
        (F.col("px") + s["dx"] >= 0) & (F.col("px") + s["dx"] < F.col("w"))
        & (F.col("py") + s["dy"] >= 0) & (F.col("py") + s["dy"] < F.col("h"))))
    return (placed.select("tile_id", "px", "py", *own, F.posexplode(F.slice(inside, 1, k)).alias("at", "step"))
            .select("tile_id", "px", "py", (F.col("px") + F.col("step.dx")).alias("qx"),
                    (F.col("py") + F.col("step.dy")).alias("qy"),
                    (F.col("step.dx") * F.col("step.dx") + F.col("step.dy") * F.col("step.dy")).alias("d2"),
                    (F.col("at") + 1).alias("rnk"), *own))


def edge_attrs(nbr: DataFrame, cells: DataFrame) -> DataFrame:
    """Normals, curvature and intensity of both ends of every pair of distinct masked cells. Where the pairs carry ``EDGE_VALUES`` of their first cell, only
    the other end is joined."""
    start = cells.select("tile_id", "px", "py", *[F.col(v).alias(f"p_{v}") for v in EDGE_VALUES])
    end = cells.select("tile_id", F.col("px").alias("qx"), F.col("py").alias("qy"),
                       *[F.col(v).alias(f"q_{v}") for v in EDGE_VALUES])
    pairs = exclude_self(nbr, "grow")
    if not all(f"p_{v}" in nbr.columns for v in EDGE_VALUES):
        pairs = pairs.join(start, ["tile_id", "px", "py"])
    return pairs.join(end, ["tile_id", "qx", "qy"])


def exclude_self(pairs: DataFrame, mode: str = "grow") -> DataFrame:
    """Drop pairs of a cell with itself; in mode ``merge`` also those sharing a row or column."""
    test = "(px <> qx OR py <> qy)" if mode == "grow" else "(px <> qx AND py <> qy)"
    return pairs.filter(test)


def edge_cosine() -> Column:
    return cosine([F.col(f"p_{a}") for a in ("nx", "ny", "nz")], [F.col(f"q_{a}") for a in ("nx", "ny", "nz")])


def smooth_edges(edges: DataFrame, smoothness: float) -> DataFrame:
    return edges.filter(edge_cosine() > smoothness)


def flat_edges(edges: DataFrame, curvature: float) -> DataFrame:
    return edges.filter(F.abs(F.col("q_ncurv") - F.col("p_ncurv")) < curvature)


def like_color_edges(edges: DataFrame, color: float) -> DataFrame:
    return edges.filter(F.abs(F.col("q_intensity") - F.col("p_intensity")) < color)


def seed_order(cells: DataFrame, keys: list[str]) -> list[Column]:
    """Order in which cells seed regions: least curvature first, then by row and column."""
    return [F.col("ncurv"), F.col("py"), F.col("px")]


# --- the same tests inside blocks -------------------------------------------------------

def _grow_block(sets: dict[int, list[tuple]], side: int):
    """Report of one block for every parameter set with its number of neighbours: its cells with their local region, links to cells of other
    blocks, and the regions that smoothly reach its cells without a strong pair.

    The pairs of cells and what is tested of them are found once; the sets only differ in the thresholds.
    """

    def report(key: tuple, block: pa.Table) -> pa.Table:
        tile_id, k, bx, by = (v.as_py() for v in key)
        w, h = block["w"][0].as_py(), block["h"][0].as_py()
        px, py = block["px"].to_numpy(), block["py"].to_numpy()
        cell_id = (py.astype(np.int64) << 32) | px
        order = np.argsort(cell_id)
        px, py, cell_id = px[order], py[order], cell_id[order]
        normal = [block[c].to_numpy()[order] for c in ("nx", "ny", "nz")]
        ncurv, light, height = (block[c].to_numpy()[order] for c in _CARRIED)
        own = (px // side == bx) & (py // side == by)
        mine = np.flatnonzero(own)
        pairs = _tested_pairs(px, py, own, k, w, h, normal, ncurv, light, min(s[1] for s in sets[k]))
        parts = []
        for param_id, *limits in sets[k]:
            has_strong, found = _grow_set(cell_id, own, *pairs, *limits)
            parts += [(param_id, CELL, *found[0], has_strong[mine], *[v[mine] for v in (ncurv, light, height)])]
            for kind, (a, b) in zip((LINK, REACHED, REACHED_FROM_OUTSIDE), found[1:]):
                parts.append((param_id, kind, a, b, np.zeros(len(a), bool), *[np.full(len(a), np.nan)] * 3))
        sizes = [len(p[2]) for p in parts]
        whole = lambda i: np.concatenate([p[i] for p in parts])
        return pa.table({
            "param_id": np.repeat(np.array([p[0] for p in parts], np.int32), sizes),
            "tile_id": pa.array([tile_id] * sum(sizes), pa.string()),
            "kind": np.repeat(np.array([p[1] for p in parts], np.int8), sizes),
            "a": whole(2), "b": whole(3), "strong": whole(4), **{c: whole(i) for i, c in enumerate(_CARRIED, 5)}})

    return report


def _tested_pairs(px, py, own, k, w, h, normal, ncurv, light, loosest) -> tuple[np.ndarray, ...]:
    """Pairs of near cells, at least one of the block, whose normals agree by the loosest limit: both ends, cosine, and differences of curvature and colour."""
    empty = np.empty(0, dtype=np.int64)
    found = [(empty, empty, *[np.empty(0)] * 3)]
    window = Window(px, py, reach(k, w, h)) if own.any() else None
    length = np.sqrt(sum(n * n for n in normal))
    for some, steps, used in nearest(px, py, np.arange(len(px)) if own.any() else empty, k, w, h):
        target = window.shifted(some, steps)
        at = np.flatnonzero(used & (target >= 0))
        u, v = some[at // len(steps)], target.ravel()[at].astype(np.int64)
        keep = (u != v) & (own[u] | own[v])
        u, v = u[keep], v[keep]
        cosine_ = sum(n[u] * n[v] for n in normal) / (length[u] * length[v])
        some_set = cosine_ > loosest
        u, v = u[some_set], v[some_set]
        found.append((u, v, cosine_[some_set], np.abs(ncurv[v] - ncurv[u]), np.abs(light[v] - light[u])))
    return tuple(np.concatenate(columns) for columns in zip(*found))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a and b, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _grow_set(cell_id, own, u, v, cosine_, bend, shade, smoothness, curvature, color) -> tuple[np.ndarray, list]:
    """Which cells have a strong pair, and by kind of report its two columns, for one parameter set."""
    smooth = cosine_ > smoothness
    u, v = u[smooth], v[smooth]
    strong = (bend[smooth] < curvature) & (shade[smooth] < color)
    into = own[v]
    su, sv, wu, wv = u[strong], v[strong], u[into], v[into]
    has_strong = np.zeros(len(cell_id), dtype=bool)
    has_strong[su] = has_strong[sv] = True
    both = own[su] & own[sv]
    root = cell_id[local_components(su[both], sv[both], len(cell_id))]
    near, far = np.where(own[su], su, sv)[~both], np.where(own[su], sv, su)[~both]
    first = cell_id[near] < cell_id[far]
    links = _distinct(root[near[first]], cell_id[far[first]])
    weak = ~has_strong[wv]
    wu, wv = wu[weak], wv[weak]
    inner = own[wu] & has_strong[wu]
    reached = _distinct(cell_id[wv[inner]], root[wu[inner]])
    outside = _distinct(cell_id[wv[~own[wu]]], cell_id[wu[~own[wu]]])
    mine = np.flatnonzero(own)
    return has_strong, [(cell_id[mine], root[mine]), links, reached, outside]


def grow_regions(cells: DataFrame, tiles: DataFrame, params: list, side: int = SIDE) -> DataFrame:
    """Region of every masked cell, for every parameter set.

    ``cells`` holds masked cells with ``tile_id, knn, px, py``, normal, ``ncurv``,
    ``intensity`` and ``height``; ``params`` the parameter rows. Returns ``(param_id, tile_id,
    cell_id, ncurv, intensity, height, region_id, anchor)``. The region is named by its least
    strongly connected cell; cells that only joined smoothly are no anchors.

    Cells are shuffled once for each number of neighbours, however many sets have it: a block goes through all of them.
    Blocks find their own regions; only pairs of regions across block borders are left to
    the component search over all of Spark.
    """
    sets: dict[int, list[tuple]] = {}
    for p in params:
        sets.setdefault(p["knn"], []).append((p["param_id"], p["smoothness"], p["curvature"], p["color"]))
    every = F.explode(F.array(*[F.lit(k) for k in sets]))
    halos = tiles.select("tile_id", "w", "h", every.alias("knn")).withColumn("halo", reach_column(F.col("knn"), F.col("w"), F.col("h")))
    placed = attach(cells.select("tile_id", "knn", "px", "py", "nx", "ny", "nz", *_CARRIED), halos, ["tile_id", "knn"])
    report, seen = cut_counting(
        by_group(with_blocks(placed, F.col("halo"), side).drop("halo"), ["tile_id", "knn", "bx", "by"], _grow_block(sets, side), _REPORT),
        "growth",
        links=F.count_if(F.col("kind") == LINK),
        reached=F.count_if(F.col("kind") == REACHED),
        outside=F.count_if(F.col("kind") == REACHED_FROM_OUTSIDE))
    of_set = F.explode(F.array(*[F.struct(F.lit(p["param_id"]).alias("param_id"), F.lit(p["knn"]).alias("k")) for p in params]))
    sizes = halos.select("tile_id", "knn", "halo", of_set.alias("p")).filter("knn = p.k").select(F.col("p.param_id").alias("param_id"), "tile_id", "halo")
    own = report.filter(F.col("kind") == CELL).select(
        *SCOPE, F.col("a").alias("cell_id"), *_CARRIED, F.col("b").alias("root"), F.col("strong").alias("anchor"))

    if seen["links"] or seen["outside"]:
        banded = (attach(own, sizes, SCOPE)
                  .withColumns({"px": cell_px(F.col("cell_id")), "py": cell_py(F.col("cell_id"))})
                  .filter(near_edge(F.col("halo"), side))
                  .select(*SCOPE, F.col("cell_id").alias("b"), "root", "anchor"))
    if seen["links"]:
        links = (report.filter(F.col("kind") == LINK).select(*SCOPE, "a", "b")
                 .join(banded.select(*SCOPE, "b", "root"), [*SCOPE, "b"])
                 .select(*SCOPE, "a", F.col("root").alias("b")))
        merged = components(links, SCOPE).select(*SCOPE, F.col("node").alias("root"), F.col("root").alias("_top"))
        own = cut(attach(own, merged, [*SCOPE, "root"], "left")
                  .select(*SCOPE, "cell_id", *_CARRIED, F.coalesce("_top", "root").alias("root"), "anchor"), "grown")
    if not (seen["reached"] or seen["outside"]):
        return _named(own)

    reached = report.filter(F.col("kind") == REACHED).select(*SCOPE, F.col("a").alias("cell_id"), F.col("b").alias("root"))
    if seen["outside"]:
        reached = reached.unionByName(
            report.filter(F.col("kind") == REACHED_FROM_OUTSIDE).select(*SCOPE, F.col("a").alias("cell_id"), "b")
            .join(banded.filter("anchor").select(*SCOPE, "b", "root"), [*SCOPE, "b"]).drop("b"))
    if seen["links"]:
        reached = (attach(reached, merged, [*SCOPE, "root"], "left")
                   .select(*SCOPE, "cell_id", F.coalesce("_top", "root").alias("root")))
    seeds = cut(region_seeds(own.filter("anchor"), "root"), "seeds")
    joined = (attach(reached, seeds, [*SCOPE, "root"])
              .groupBy(*SCOPE, "cell_id").agg(F.min(F.struct("seed_ncurv", "seed_id", "root")).alias("_best"))
              .select(*SCOPE, "cell_id", F.col("_best.root").alias("_joined")))
    return _named(own.join(joined, [*SCOPE, "cell_id"], "left")
                  .select(*SCOPE, "cell_id", *_CARRIED, F.coalesce("_joined", "root").alias("root"), "anchor",
                          F.col("_joined").isNull().alias("_apart")))


def _named(own: DataFrame) -> DataFrame:
    anchor = (F.col("anchor") | F.col("_apart")) if "_apart" in own.columns else F.lit(True)
    return own.select(*SCOPE, "cell_id", *_CARRIED, F.col("root").alias("region_id"), anchor.alias("anchor"))


def region_seeds(own: DataFrame, region: str) -> DataFrame:
    """The seed of each region: its cell of least curvature, then of least row and column."""
    ncurv, cell = seed_parts(F.col("_seed"))
    return (own.groupBy(*SCOPE, region).agg(F.min(seed_key(F.col("ncurv"), F.col("cell_id"))).alias("_seed"))
            .select(*SCOPE, region, ncurv.alias("seed_ncurv"), cell.alias("seed_id")))
