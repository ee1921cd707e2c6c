"""Plane fits, bearings and regions against known answers and numpy."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slopeweave.functions import planes
from slopeweave.operators import blocks, fit, growth, regions
from slopeweave.session import cut


def region(spark, heights):
    """One region with the given {(px, py): height}."""
    rows = [(0, "t", (y << 32) | x, 0.0, 0.0, float(h)) for (x, y), h in heights.items()]
    first = min(r[2] for r in rows)
    df = spark.createDataFrame(rows, "param_id INT, tile_id STRING, cell_id BIGINT, ncurv DOUBLE, intensity DOUBLE, height DOUBLE")
    return df.withColumns({"region_id": F.lit(first), "anchor": F.lit(True)})


def attrs(spark, heights, **kw):
    return regions.region_attrs(regions.region_means(regions.region_stats(region(spark, heights))), **kw).first()


GRID = [(x, y) for x in range(6) for y in range(6)]


@pytest.mark.parametrize("height,slope,azimuth,compass", [
    (lambda x, y: x + y, 54.7356, 315.0, 315.0),
    (lambda x, y: -x + 2 * y, 65.9052, 26.5651, 26.5651),
    (lambda x, y: x - 2 * y, 65.9052, 243.4349, 206.5651),
])
def test_planes(spark, height, slope, azimuth, compass):
    cells = {(x, y): height(x, y) for x, y in GRID}
    row = attrs(spark, cells)
    assert row["slope"] == pytest.approx(slope, abs=1e-3)
    assert row["azimuth"] == pytest.approx(azimuth, abs=1e-3)
    assert row["curv"] == pytest.approx(0, abs=1e-12)
    assert attrs(spark, cells, compass=True)["azimuth"] == pytest.approx(compass, abs=1e-3)


def test_flat_and_single_cell(spark):
    for cells in ({c: 5.0 for c in GRID}, {(3, 4): 5.0}):
        row = attrs(spark, cells)
        assert row["slope"] == 0 and math.isnan(row["azimuth"])
        assert (row["nx"], row["ny"], row["nz"]) == (0, 0, 1)


def test_normals_against_numpy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        p = rng.normal(size=(int(rng.integers(4, 40)), 3)) * [3, 2, 0.2] @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
        rows.append((i, p))
    sums = lambda p: [len(p), *p.sum(0), *(p[:, a] @ p[:, b] for a, b in ((0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)))]
    df = spark.createDataFrame([(i, *map(float, sums(p))) for i, p in rows], "id INT, " + ", ".join(f"{m} DOUBLE" for m in planes.MOMENTS))
    got = {r["id"]: r for r in planes.with_plane(df).collect()}
    for i, p in rows:
        values, vectors = np.linalg.eigh(np.cov(p.T))
        n = vectors[:, 0]
        assert got[i]["curv"] == pytest.approx(values[0] / values.sum(), abs=1e-9)
        assert abs(n @ [got[i]["nx"], got[i]["ny"], got[i]["nz"]]) == pytest.approx(1, abs=1e-7)
        assert got[i]["nz"] >= 0


def brute_nearest(w, h, x, y, k):
    cells = sorted(((qx - x) ** 2 + (qy - y) ** 2, qx - x, qy - y) for qx in range(w) for qy in range(h))
    return [(x + dx, y + dy) for _, dx, dy in cells[:k]]


def grid_table(spark, w, h, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("t", x, y, float(rng.normal()), bool(rng.random() < 0.7), float(rng.integers(0, 3)))
            for x in range(w) for y in range(h)]
    return cut(spark.createDataFrame(rows, "tile_id STRING, px INT, py INT, height DOUBLE, in_mask BOOLEAN, intensity DOUBLE")), \
        cut(spark.createDataFrame([("t", w, h)], "tile_id STRING, w INT, h INT"))


@pytest.mark.parametrize("w,h,k", [(9, 7, 12), (1, 30, 8), (3, 4, 54), (12, 11, 54), (6, 6, 1)])
def test_neighbours_and_moments_against_brute_force(spark, w, h, k):
    cells, tiles = grid_table(spark, w, h)
    height = {(r["px"], r["py"]): r["height"] for r in cells.collect()}
    mask = {(r["px"], r["py"]) for r in cells.filter("in_mask").collect()}
    listed = {}
    for r in growth.knn_cells(cells, tiles, k).orderBy("rnk").collect():
        listed.setdefault((r["px"], r["py"]), []).append((r["qx"], r["qy"]))
    assert listed == {c: brute_nearest(w, h, *c, k) for c in mask}
    for side in (4, 128):
        rows = fit.local_moments(cells, tiles, [k], side).collect()
        assert {(r["px"], r["py"]) for r in rows} == mask
        for r in rows:
            near = brute_nearest(w, h, r["px"], r["py"], k)
            p = np.array([(x - r["px"], y - r["py"], height[x, y] - r["height"]) for x, y in near])
            assert r["n"] == len(p)
            assert [r["sx"], r["sy"], r["sh"]] == pytest.approx(p.sum(0))
            assert [r["sxx"], r["sxh"], r["syh"], r["shh"]] == pytest.approx(
                [p[:, 0] @ p[:, 0], p[:, 0] @ p[:, 2], p[:, 1] @ p[:, 2], p[:, 2] @ p[:, 2]])


def test_reach_is_enough():
    for w in range(1, 12):
        for h in range(1, 12):
            for k in (1, 5, 9, 54, 64):
                far = max((qx - x) ** 2 + (qy - y) ** 2 for x in (0, w // 2) for y in (0, h // 2)
                          for qx, qy in brute_nearest(w, h, x, y, k))
                assert far <= blocks.reach(k, w, h) ** 2


def test_curvature_is_scaled_over_the_whole_grid(spark):
    tiles = cut(spark.createDataFrame([("t", 2, 2), ("u", 1, 2)], "tile_id STRING, w INT, h INT"))
    fits = cut(spark.createDataFrame([("t", 5, 0, 0, 0.2), ("t", 5, 0, 1, 0.4), ("u", 5, 0, 0, 0.3), ("u", 5, 0, 1, 0.3)],
                                     "tile_id STRING, knn INT, px INT, py INT, curv DOUBLE"))
    got = {(r["tile_id"], r["py"]): r["ncurv"] for r in fit.normalize(fits, tiles).collect()}
    assert got == {("t", 0): 0.5, ("t", 1): 1.0, ("u", 0): 0.0, ("u", 1): 0.0}
    stats = {r["tile_id"]: r for r in fit.curvature_stats(fits, tiles).collect()}
    assert stats["t"]["mean_ncurv"] == pytest.approx((0.2 + 0.4) / 4 / 0.4)


def brute_growth(cells, w, h, p):
    """Regions by the written rule, one cell at a time."""
    near = {c: [q for q in brute_nearest(w, h, *c, p["knn"]) if q in cells and q != c] for c in cells}
    cos = lambda a, b: sum(i * j for i, j in zip(a, b)) / math.sqrt(sum(i * i for i in a) * sum(i * i for i in b))
    smooth = {(c, q) for c in cells for q in near[c] if cos(cells[c]["n"], cells[q]["n"]) > p["smoothness"]}
    strong = {(c, q) for c, q in smooth if abs(cells[c]["ncurv"] - cells[q]["ncurv"]) < p["curvature"]
              and abs(cells[c]["light"] - cells[q]["light"]) < p["color"]}
    strong |= {(q, c) for c, q in strong}
    ident = lambda c: (c[1] << 32) | c[0]
    label = {c: ident(c) for c in cells}
    changed = True
    while changed:
        changed = False
        for c, q in strong:
            if label[c] < label[q]:
                label[q], changed = label[c], True
    tied = {c for c, _ in strong}
    seed = {}
    for c in tied:
        rank = (cells[c]["ncurv"], ident(c))
        seed[label[c]] = min(seed.get(label[c], rank), rank)
    out = {}
    for c in cells:
        reach = [label[u] for u, v in smooth if v == c and u in tied] if c not in tied else []
        out[ident(c)] = min(reach, key=lambda r: seed[r]) if reach else label[c]
    return out


@pytest.mark.parametrize("seed,k", [(1, 8), (2, 14), (3, 54)])
def test_growth_against_brute_force(spark, seed, k):
    w, h = 14, 11
    rng = np.random.default_rng(seed)
    cells = {}
    for x in range(w):
        for y in range(h):
            if rng.random() < 0.8:
                n = np.array([0.3 if x < 6 else -0.3, 0.1 * (y > 5), 1.0]) + rng.normal(size=3) * 0.08
                cells[x, y] = {"n": (n / np.linalg.norm(n)).tolist(), "ncurv": round(float(rng.random()), 2), "light": float(rng.integers(0, 4))}
    p = {"param_id": 3, "smoothness": 0.985, "curvature": 0.12, "color": 1.5, "knn": k}
    # sets with other limits and another number of neighbours go through the same blocks
    sets = [p, p | {"param_id": 4, "smoothness": 0.99, "color": 2.5}, p | {"param_id": 5, "curvature": 0.4, "knn": 5}]
    df = spark.createDataFrame([(n, "t", x, y, *c["n"], c["ncurv"], c["light"], 0.0) for (x, y), c in cells.items() for n in (k, 5)],
                               "knn INT, tile_id STRING, px INT, py INT, nx DOUBLE, ny DOUBLE, nz DOUBLE, ncurv DOUBLE, intensity DOUBLE, height DOUBLE")
    tiles = cut(spark.createDataFrame([("t", w, h)], "tile_id STRING, w INT, h INT"))
    expected = {(q["param_id"], c): r for q in sets for c, r in brute_growth(cells, w, h, q).items()}
    labels = [tuple(r for (i, _), r in sorted(expected.items()) if i == q["param_id"]) for q in sets]
    assert len(set(labels[0])) > 3 and len(set(labels)) == 3
    for side in (128, 5):
        got = growth.grow_regions(df.repartition(3), tiles, sets, side).collect()
        assert {(r["param_id"], r["cell_id"]): r["region_id"] for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("batch,gathered", [(1, 4), (7, 1), (7, 1 << 14), (1000, 50)])
def test_groups_are_cut_from_batches(spark, monkeypatch, batch, gathered):
    monkeypatch.setattr(blocks, "RESULTS_AT_ONCE", gathered)
    sizes = {(None, 1): 3, ("a", 1): 1, ("a", 2): 20, ("b", 1): 7, ("b", None): 2, (None, None): 9, ("c", 1): 64}
    rows = [(*key, i) for key, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "tile_id STRING, bx INT, v BIGINT").repartition(3)

    def report(key, part):
        tile, bx = (v.as_py() for v in key)
        assert set(part["tile_id"].to_pylist()) == {tile} and set(part["bx"].to_pylist()) == {bx}
        # a group may have no result or several
        times = 0 if len(part) == 7 else 2
        return pa.table({"tile_id": pa.array([tile] * times, pa.string()), "bx": pa.array([bx] * times, pa.int32()),
                         "n": pa.array([len(part)] * times, pa.int64()), "total": pa.array([sum(part["v"].to_pylist())] * times, pa.int64())})

    # here, as the workers do not see what is patched
    groups = blocks._cut_by_group(["tile_id", "bx"], report)
    ordered = sorted(rows, key=lambda r: (r[0] or "", r[1] or 0))
    table = pa.table({n: pa.array(c, t) for n, c, t in zip(("tile_id", "bx", "v"), zip(*ordered), (pa.string(), pa.int32(), pa.int64()))})
    expected = sorted(((*key, n, n * (n - 1) // 2) for key, n in sizes.items() if n != 7 for _ in range(2)), key=str)
    assert sorted((tuple(r.values()) for b in groups(table.to_batches(batch)) for r in b.to_pylist()), key=str) == expected
    assert not list(groups(iter([]))) and not list(groups(table.slice(0, 0).to_batches()))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = blocks.by_group(df, ["tile_id", "bx"], report, "tile_id STRING, bx INT, n BIGINT, total BIGINT").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == expected


def test_blocks_share_batches(spark):
    """No stream of its own for each block, of which a table of small tiles has as many as tiles."""
    cells = spark.createDataFrame([("t", 0, 0, 1.0, True, 0.0)], "tile_id STRING, px INT, py INT, height DOUBLE, in_mask BOOLEAN, intensity DOUBLE")
    tiles = cut(spark.createDataFrame([("t", 2, 2)], "tile_id STRING, w INT, h INT"))
    plan = fit.local_moments(cells, tiles, [3])._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan
