"""Components, merging and absorption against plain loops."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from slopeweave.operators import absorb, components, growth, merging, regions, scoring
from slopeweave.session import cut
from slopeweave.sources.tables import clean_params, params_df

STATS = "param_id INT, tile_id STRING, region_id BIGINT, size BIGINT, " + ", ".join(
    f"{s} {'BIGINT' if s in ('sum_x', 'sum_y') else 'DOUBLE'}" for s in regions.SUMS) + ", seed_ncurv DOUBLE, seed_id BIGINT"


def test_components(spark):
    rng = random.Random(5)
    edges = [(s, rng.randrange(60), rng.randrange(60)) for s in (1, 2) for _ in range(45)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for s, a, b in edges:
        if a != b:
            low, high = sorted((find((s, a)), find((s, b))))
            parent[high] = low
    expected = {v: find(v)[1] for v in list(parent)}
    got = components.components(spark.createDataFrame(edges, "s INT, a BIGINT, b BIGINT"), ["s"])
    assert {(r["s"], r["node"]): r["root"] for r in got.collect()} == expected


def test_a_long_chain_is_one_component(spark):
    got = components.components(spark.range(300).select(F.lit(0).alias("s"), F.col("id").alias("a"), (F.col("id") + 1).alias("b")), ["s"])
    assert got.select("root").distinct().collect()[0][0] == 0 and got.count() == 301


def test_components_of_whole_scopes_take_one_pass(spark, monkeypatch):
    """Ranges, chunks and rounds give the same roots, and only scopes at the ends of tasks and large ones take rounds."""
    rng = random.Random(8)
    edges = [(s, f"t{s % 7}", rng.randrange(40), rng.randrange(40)) for s in range(60) for _ in range(30)]
    edges += [(99, "big", i, i + 1) for i in range(900)]
    df = spark.createDataFrame(edges, "s INT, t STRING, a BIGINT, b BIGINT")
    want = {(r["s"], r["t"], r["node"]): r["root"] for r in components._in_rounds(df, ["s", "t"]).collect()}
    seen = []
    rounds = components._in_rounds
    monkeypatch.setattr(components, "_in_rounds", lambda rest, scope: seen.append({r["s"] for r in rest.select("s").collect()}) or rounds(rest, scope))
    for most in (1 << 20, 100, 7):
        monkeypatch.setattr(components, "EDGES_AT_ONCE", most)
        rows = components.components(df, ["s", "t"]).collect()
        assert len(rows) == len(want) and {(r["s"], r["t"], r["node"]): r["root"] for r in rows} == want
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 99 in seen[1] and all(len(s) <= 2 * parts + 1 for s in seen)


def test_pairs_that_carry_their_first_cell_take_one_join_less(spark):
    cells = spark.range(30).selectExpr("'t' AS tile_id", "CAST(id % 6 AS INT) AS px", "CAST(id DIV 6 AS INT) AS py", "id % 4 > 0 AS in_mask",
                                       "id * 0.1D AS nx", "id * 0.2D AS ny", "1.0D AS nz", "id / 30 AS ncurv", "id * 2.0D AS intensity").filter("in_mask")
    cells, tiles = cut(cells), cut(spark.sql("SELECT 't' AS tile_id, 6 AS w, 5 AS h"))
    plain = growth.edge_attrs(growth.knn_cells(cells, tiles, 8), cells)
    carried = growth.edge_attrs(growth.knn_cells(cells, tiles, 8, growth.EDGE_VALUES), cells)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(carried) == joins(plain) - 1
    rows = lambda df: sorted(map(tuple, df.select(sorted(plain.columns)).collect()))
    assert rows(carried) == rows(plain) and len(rows(plain)) > 50


def test_faces_are_made_once_for_a_score(spark):
    ring = lambda i: [[[i, 0.0], [i + 0.5, 0.0], [i + 0.5, 1.0], [i, 1.0], [i, 0.0]]]
    made = lambda name: spark.createDataFrame([(i, ring(float(i))) for i in range(20)], f"{name} INT, rings ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    score = scoring.evaluate(made("gold_id"), made("result_id").filter("result_id < 15"), 0.5)
    plan = score._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert score.first()[0] == pytest.approx(5 / 35)


def plane_region(ident, cx, cy, size, gx, gy):
    """Sums of a region of ``size`` cells around (cx, cy) on the plane gx * x + gy * y."""
    side = math.isqrt(size)
    cells = [(cx - side // 2 + i, cy - side // 2 + j) for i in range(side) for j in range(side)]
    ox, oy = cells[0]
    rows = [(x - ox, y - oy, gx * x + gy * y) for x, y in cells]
    total = lambda f: float(sum(f(*r) for r in rows))
    region_id = (oy << 32) | ox
    return (0, "t", region_id, len(cells), 0.0, sum(c[0] for c in cells), sum(c[1] for c in cells), 0.0,
            total(lambda x, y, h: x), total(lambda x, y, h: y), total(lambda x, y, h: h), total(lambda x, y, h: x * x),
            total(lambda x, y, h: x * y), total(lambda x, y, h: y * y), total(lambda x, y, h: x * h),
            total(lambda x, y, h: y * h), total(lambda x, y, h: h * h), float(ident), ident)


def one_tile(spark):
    return cut(spark.createDataFrame([("t", 450, 350)], "tile_id STRING, w INT, h INT"))


def params(spark, slope=2.0, azimuth=15.0):
    return clean_params(params_df(spark, [(0, 0.9, 0.1, 1.0, 8, 10, slope, azimuth)]))


def gradient(slope, azimuth):
    """Gradient of a plane with a slope and an azimuth below 90."""
    t, z = math.radians(azimuth), math.cos(math.radians(slope))
    nx, ny = math.sin(t) * math.sin(math.radians(slope)), -math.cos(t) * math.sin(math.radians(slope))
    return -nx / z, -ny / z


@pytest.mark.parametrize("cy,cmp,left", [(15, "gt", 1), (15, "lt", 2), (10, "gt", 2)])
def test_merge_of_two(spark, cy, cmp, left):
    rows = [plane_region(1, 10, 10, 49, *gradient(30, 40)), plane_region(2, 20, cy, 25, *gradient(33, 45))]
    merged, names = merging.merge_regions(spark.createDataFrame(rows, STATS), one_tile(spark), params(spark), slope_cmp=cmp)
    assert merged.count() == left
    if left == 1:
        row = merged.first()
        assert (row["region_id"], row["size"], row["sum_x"]) == (rows[0][2], 74, rows[0][5] + rows[1][5])
        assert [tuple(r) for r in names.select("region_id", "face_id").collect()] == [(rows[1][2], rows[0][2])]


def test_single_cells_never_merge(spark):
    rows = [plane_region(1, 10, 10, 1, 1, 1), plane_region(2, 20, 15, 1, 1, 1)]
    assert merging.merge_regions(spark.createDataFrame(rows, STATS), one_tile(spark), params(spark, 0.0, 360.0))[0].count() == 2


def sequential_merge(stats, attrs_of, combine_of, slope, azimuth):
    """One region after the other, as long as a pass absorbs anything. Each pass sorts the list that the last one left."""
    stats = sorted(stats, key=lambda r: (r["seed_ncurv"], r["seed_id"]))
    while True:
        order = sorted(stats, key=lambda r: -r["size"])
        attrs = {r["region_id"]: attrs_of(r) for r in order}
        centre = {r["region_id"]: (r["sum_x"] // r["size"], r["sum_y"] // r["size"]) for r in order}
        rank = {r["region_id"]: (r["seed_ncurv"], r["seed_id"]) for r in order}
        open_, absorbed = [r["region_id"] for r in order], {}
        left = set(open_)
        for a in open_:
            if a not in left:
                continue
            left.discard(a)
            ax, ay = centre[a]
            near = sorted(centre, key=lambda r: ((centre[r][0] - ax) ** 2 + (centre[r][1] - ay) ** 2, centre[r], rank[r]))[:5]
            for b in near:
                if b in left and centre[b][0] != ax and centre[b][1] != ay:
                    if abs(attrs[b][0] - attrs[a][0]) > slope and abs(attrs[b][1] - attrs[a][1]) < azimuth:
                        left.discard(b)
                        absorbed[b] = a
        if not absorbed:
            return {r["region_id"]: r["size"] for r in stats}
        merged = {r["region_id"]: r for r in combine_of(stats, absorbed)}
        stats = [merged[r["region_id"]] for r in order if r["region_id"] in merged]


@pytest.mark.parametrize("seed, sizes", [(11, [16, 25, 36, 49]), (5, [16, 16, 16, 25]), (8, [25])])
def test_merging_equals_the_sequential_loop(spark, seed, sizes):
    rng = random.Random(seed)
    taken, rows = set(), []
    while len(rows) < 45:
        cx, cy, size = rng.randrange(20, 150), rng.randrange(20, 150), rng.choice(sizes)
        row = plane_region(len(rows), cx, cy, size, *gradient(rng.uniform(20, 50), rng.uniform(20, 70)))
        if row[2] not in taken:
            taken.add(row[2])
            rows.append(row)
    frame = spark.createDataFrame(rows, STATS)

    def with_attrs(stats):
        df = regions.region_attrs(regions.region_means(spark.createDataFrame([tuple(r) for r in stats], STATS)))
        return {r["region_id"]: (r["slope"], r["azimuth"]) for r in df.collect()}

    cache = {}

    def attrs_of(row):
        if row not in cache:
            cache.update({row: with_attrs([row])[row["region_id"]]})
        return cache[row]

    def combine_of(stats, absorbed):
        df = spark.createDataFrame([(0, "t", b, a) for b, a in absorbed.items()], "param_id INT, tile_id STRING, region_id BIGINT, absorber BIGINT")
        names = [f.split()[0] for f in STATS.split(", ")]
        return regions.combine(spark.createDataFrame([tuple(r) for r in stats], STATS), df).select(*names).collect()

    start = frame.collect()
    every = with_attrs(start)
    cache.update({r: every[r["region_id"]] for r in start})
    expected = sequential_merge(start, attrs_of, combine_of, 2.0, 15.0)
    merged, names = merging.merge_regions(frame, one_tile(spark), params(spark))
    assert {r["region_id"]: r["size"] for r in merged.collect()} == expected
    assert len(expected) < 45
    named = {r["region_id"]: r["face_id"] for r in names.collect()}
    assert set(named) | set(expected) == {r["region_id"] for r in start}
    assert set(named.values()) <= set(expected)


@pytest.mark.parametrize("fan", [2, 8])
def test_nearest_regions_with_shared_centres(spark, fan):
    rng = random.Random(3)
    centres = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(5, 5)] * 8 + [(400, 300)]
    rows = [(0, "t", i, x, y, 0.0, i) for i, (x, y) in enumerate(centres)]
    df = cut(spark.createDataFrame(rows, "param_id INT, tile_id STRING, region_id BIGINT, cx INT, cy INT, seed_ncurv DOUBLE, seed_id BIGINT"))
    got = {}
    for r in merging.knn_regions(df, one_tile(spark), 5, fan).collect():
        got.setdefault(r["region_id"], set()).add(r["other_id"])
    for i, (x, y) in enumerate(centres):
        near = sorted(range(len(centres)), key=lambda j: ((centres[j][0] - x) ** 2 + (centres[j][1] - y) ** 2, *centres[j], j))[:5]
        assert got[i] == set(near)


def test_equal_sizes_keep_the_order_of_the_pass_before(spark):
    """1 (30 cells) absorbs 4 (4), and 2 (28) absorbs 5 (6): both have 34 then. By seeds 2 would come first, but 1 did in the first pass."""
    order = spark.createDataFrame([(1, 30, 9.0), (2, 28, 1.0), (3, 28, 0.5)], "region_id INT, size INT, seed_ncurv DOUBLE").withColumn("seed_id", F.col("region_id"))
    first = order.withColumn("order", merging.first_order())
    assert [r.region_id for r in first.orderBy("order").collect()] == [1, 3, 2]
    later = first.withColumn("size", F.when(F.col("region_id") < 3, 34).otherwise(F.col("size"))).withColumn("order", merging.next_order())
    assert [r.region_id for r in later.orderBy("order").collect()] == [1, 2, 3]
    same = later.withColumn("size", F.lit(40)).withColumn("order", merging.next_order())
    assert [r.region_id for r in same.orderBy("order").collect()] == [1, 2, 3]


def test_chains_of_absorbers(spark):
    """Pairs of a random order against the loop over that order; a chain is settled two links a round."""
    rng = random.Random(6)
    rows = [(0, f"t{t}", a, b, a) for t in range(6) for b in range(1, 60) for a in {rng.randrange(b) for _ in range(rng.randint(0, 3))}]
    rows += [(0, "chain", a, a + 1, a) for a in range(12)]
    frame = cut(spark.createDataFrame(rows, "param_id INT, tile_id STRING, a BIGINT, b BIGINT, order BIGINT"))
    expected = {}
    for _, tile, a, b, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if (tile, a) not in expected:
            expected.setdefault((tile, b), a)
    assert {(r["tile_id"], r["region_id"]): r["absorber"] for r in merging.resolve_pass(frame).collect()} == expected


def test_size_split(spark):
    df = spark.createDataFrame([(76,), (77,)], "size INT")
    large, small = regions.split_by_size(df, 76)
    assert [r[0] for r in large.collect()] == [77] and [r[0] for r in small.collect()] == [76]


CELLS = "param_id INT, tile_id STRING, cell_id BIGINT"


def nearest_large(small, large):
    """Face of the nearest large cell by looking at all of them; ties by column, then row."""
    cells = np.array(sorted(large))
    faces = [large[tuple(c)] for c in cells.tolist()]
    found = {}
    for x, y in small:
        found[(y << 32) | x] = faces[int(((cells[:, 0] - x) ** 2 + (cells[:, 1] - y) ** 2).argmin())]
    return found


def absorbed(spark, tiles, band=128):
    """``tiles`` is a list of (small cells, large cells with their face)."""
    row = lambda t, c: (0, f"t{t}", (c[1] << 32) | c[0])
    small = [row(t, c) for t, (cells, _) in enumerate(tiles) for c in cells] + [(0, "no large region", 1)]
    large = [(*row(t, c), f) for t, (_, cells) in enumerate(tiles) for c, f in cells.items()]
    got = absorb.absorb_small(cut(spark.createDataFrame(small, CELLS)), cut(spark.createDataFrame(large, CELLS + ", face_id BIGINT")), band).collect()
    found = {}
    for r in got:
        assert found.setdefault(r["tile_id"], {}).setdefault(r["cell_id"], r["face_id"]) == r["face_id"]
    assert len(got) == sum(len(f) for f in found.values())
    return found


@pytest.mark.parametrize("band", [128, 8, 1])
def test_absorption_against_brute_force(spark, band):
    rng = random.Random(9)
    cells = {(rng.randrange(60), rng.randrange(60)): None for _ in range(400)}
    corner = {c: i % 3 for i, c in enumerate(cells) if c[0] < 12 and c[1] < 20}
    mixed = {c: i for i, c in enumerate(cells) if rng.random() < 0.3}
    lattice = {(x, y): x * 100 + y for x in range(0, 60, 4) for y in range(0, 60, 4)}
    tiles = [([c for c in cells if c not in large], large) for large in (corner, mixed)]
    tiles.append(([(x, y) for x in range(60) for y in range(60) if (x, y) not in lattice], lattice))
    assert absorbed(spark, tiles, band) == {f"t{t}": nearest_large(*tile) for t, tile in enumerate(tiles)}


def test_absorption_over_more_than_a_thousand_cells(spark, monkeypatch):
    """Islands far apart in both directions, on a tile of many bands; few distances are held at once."""
    monkeypatch.setattr(absorb, "HELD", 50)
    rng = random.Random(2)
    islands = [(5, 5), (1_900, 40), (700, 1_500), (1_901, 1_999)]
    large = {(x + i, y + j): n for n, (x, y) in enumerate(islands) for i in range(4) for j in range(3)}
    small = [c for c in {(rng.randrange(2_100), rng.randrange(2_100)) for _ in range(1_500)} if c not in large]
    found = absorbed(spark, [(small, large)])["t0"]
    assert found == nearest_large(small, large)
    assert max(min(math.dist(c, q) for q in large) for c in small) > 900


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_least_per_query(data):
    columns = np.array(sorted(data.draw(st.sets(st.integers(0, 40), min_size=1))))
    heights = np.array(data.draw(st.lists(st.lists(st.integers(0, 900), min_size=len(columns), max_size=len(columns)), min_size=1, max_size=3)))
    queries = sorted({(data.draw(st.integers(0, len(heights) - 1)), data.draw(st.integers(0, 40))) for _ in range(data.draw(st.integers(0, 12)))})
    row, x = (np.array(v, np.int64).reshape(-1) for v in (zip(*queries) if queries else ([], [])))
    got = absorb.least_per_query(x, row, columns, heights)
    assert got.tolist() == [int(((b - columns) ** 2 + heights[a]).argmin()) for a, b in queries]


def test_paint(spark):
    cells = spark.createDataFrame([(0, "t", 1), (0, "t", 2)], "param_id INT, tile_id STRING, cell_id BIGINT")
    faces = spark.createDataFrame([(0, "t", 2, 99)], "param_id INT, tile_id STRING, cell_id BIGINT, color INT")
    assert {r["cell_id"]: r["color"] for r in absorb.paint(cells, faces).collect()} == {1: 0, 2: 99}


def test_generated_cells_are_painted_by_a_merge(spark):
    cells = spark.range(3).selectExpr("0 AS param_id", "CAST(id AS STRING) AS tile_id", "explode(sequence(0L, 9L)) AS cell_id")
    colored = cells.filter("tile_id = '1' AND cell_id < 4").selectExpr("*", "CAST(cell_id + 1 AS INT) AS color")
    painted = absorb.paint(cells, colored)
    assert sorted(r["color"] for r in painted.collect()) == [0] * 26 + [1, 2, 3, 4]
    assert "Broadcast" not in painted._jdf.queryExecution().executedPlan().toString()
