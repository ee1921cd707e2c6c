"""Polygon tracing, GeoJSON and scoring: hand cases and brute force."""

import json
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from slopeweave.functions.rings import polygon_area, ring_area
from slopeweave.operators import faces, scoring
from slopeweave.session import cut
from slopeweave.sources import geojson

PIXELS = "param_id INT, tile_id STRING, px INT, py INT, face_id BIGINT"


def traced(spark, cells, limit=0, side=128):
    df = spark.createDataFrame([(0, "t", x, y, f) for (x, y), f in cells.items()], PIXELS)
    return faces.vectorize(df, limit, side).orderBy("face_id", "part_id").collect()


def area(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) / 2


def block(x0, x1, y0, y1, face=0):
    return {(x, y): face for x in range(x0, x1) for y in range(y0, y1)}


@settings(max_examples=200, deadline=None)
@given(st.permutations(list(range(14))), st.sets(st.integers(0, 13)))
def test_chains(order, ends):
    """Chains of a permutation, some of whose links are cut: walking from the first member ends at the item after as many steps as its place says."""
    follow = np.array([-1 if i in ends else j for i, j in enumerate(order)])
    first, place, closed = faces.chains(follow)
    for item in range(14):
        walk = [first[item]]
        while follow[walk[-1]] >= 0 and follow[walk[-1]] != walk[0]:
            walk.append(follow[walk[-1]])
        assert walk[place[item]] == item and closed[item] == (follow[walk[-1]] == walk[0])
        assert first[item] == min(walk) if closed[item] else not (follow == first[item]).any()


def test_square(spark):
    (row,) = traced(spark, block(3, 5, 2, 4))
    assert row["rings"] == [[[3, 2], [5, 2], [5, 4], [3, 4], [3, 2]]]
    assert row["cells"] == 4


@pytest.mark.parametrize("side", [128, 2])
def test_ring_with_hole(spark, side):
    cells = block(0, 3, 0, 3)
    del cells[1, 1]
    (row,) = traced(spark, cells, side=side)
    assert [area(r) for r in row["rings"]] == [9, -1]


@pytest.mark.parametrize("side", [128, 2, 3])
def test_hole_that_touches_the_outline_at_a_corner(spark, side):
    cells = block(0, 4, 0, 4)
    for gap in ((1, 1), (2, 1), (1, 2), (3, 0)):
        del cells[gap]
    (row,) = traced(spark, cells, side=side)
    assert [area(r) for r in row["rings"]] == [15, -3]
    for ring in row["rings"]:
        assert len({tuple(p) for p in ring}) == len(ring) - 1


def test_corner_contact_does_not_join_parts(spark):
    rows = traced(spark, {(0, 0): 1, (1, 1): 1, (5, 5): 1, (6, 5): 1}, limit=0)
    assert [r["cells"] for r in rows] == [1, 1, 2]
    assert [r["cells"] for r in traced(spark, {(0, 0): 1, (1, 1): 1, (5, 5): 1, (6, 5): 1}, limit=1)] == [2]


def test_blocks_do_not_change_the_polygons(spark):
    rng = random.Random(4)
    cells = {(x, y): rng.choice((0, 0, 0, 1)) for x in range(23) for y in range(19)}
    whole = traced(spark, cells)
    for row in whole:
        assert sum(area(r) for r in row["rings"]) == row["cells"]
        assert area(row["rings"][0]) > 0 and all(area(r) < 0 for r in row["rings"][1:])
    flat = lambda rows: {(r["part_id"], json.dumps(sorted(r["rings"]))) for r in rows}
    assert flat(traced(spark, cells, side=4)) == flat(whole)


def feature_frame(spark, shapes, name):
    rows = [(i, [[list(map(float, p)) for p in ring] for ring in rings]) for i, rings in enumerate(shapes)]
    return spark.createDataFrame(rows, f"{name} BIGINT, rings {geojson.RINGS}")


def box(x0, y0, x1, y1):
    x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def score(spark, gold, result, **kw):
    return scoring.evaluate(feature_frame(spark, gold, "gold_id"), feature_frame(spark, result, "result_id"), 1.0, **kw).first()["score"]


@pytest.mark.parametrize("gold,result,expected,kw", [
    ([box(0, 0, 10, 10)], [box(0, 0, 10, 10)], 0.0, {}),
    ([box(0, 0, 10, 10)], [box(5, 0, 15, 10)], 0.25, {}),
    ([box(0, 0, 10, 10)], [box(50, 0, 60, 10)], 1.0, {}),
    ([box(0, 0, 10, 10)], [box(10, 0, 20, 10)], 0.5, {}),
    ([box(0, 0, 10, 10)], [box(10, 10, 20, 20)], 0.5, {}),
    ([box(0, 0, 10, 10)], [box(10, 0, 20, 10)], 1.0, {"touching": False}),
    ([box(0, 0, 5, 10), box(5, 0, 10, 10)], [box(0, 0, 10, 10)], 1 / 6, {}),
    ([box(-70, -3, 130, 5)], [box(-70, -3, 130, 5)], 0.0, {}),
    ([], [box(0, 0, 1, 1)], 1.0, {}),
])
def test_scores(spark, gold, result, expected, kw):
    assert score(spark, gold, result, **kw) == pytest.approx(expected)


def clipped(subject, clip):
    """Convex polygon cut by the sides of another (both turned the same way), corner by corner."""
    out = list(subject)
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        ring, out = out, []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if side(p) >= 0:
                out.append(p)
            if (side(p) < 0) != (side(q) < 0):
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            return []
    return out


def plain_area(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2 if ring else 0.0


@pytest.mark.parametrize("cell, origin", [(0.5, (0, 0)), (7.0, (0, 0)), (1.0, (520_000.0, 4_980_000.0))])
def test_overlap_of_any_polygons_is_exact(spark, cell, origin):
    """Convex faces of all sizes, turned either way, against clipping one by the other; a hole takes away what lies in it."""
    rng = random.Random(4)

    def convex(x, y, size):
        return [(x + size * math.cos(a), y + 0.7 * size * math.sin(a)) for a in sorted(rng.uniform(0, 6.28) for _ in range(rng.randint(3, 8)))]

    shapes = [[convex(rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.05, 0.4, 3, 12])) for _ in range(60)] for _ in range(2)]
    placed = lambda ring: [(origin[0] + x, origin[1] + y) for x, y in ring + ring[:1]]
    closed = lambda ring, i: [placed(ring[::-1] if i % 2 else ring)]
    gold, result = ([closed(r, i) for i, r in enumerate(side)] for side in shapes)
    hole, outer = [(-1, -1), (2, -1), (2, 3), (-1, 3)], [(-30, -30), (30, -30), (30, 30), (-30, 30)]
    gold.append([placed(outer), placed(hole)])
    got = {(r["gold_id"], r["result_id"]): r["overlap"] for r in scoring.overlap_pairs(
        feature_frame(spark, gold, "gold_id"), feature_frame(spark, result, "result_id"), ["gold_id"], ["result_id"], cell, touching=False).collect()}
    expected = {(i, j): plain_area(clipped(a, b)) for i, a in enumerate(shapes[0]) for j, b in enumerate(shapes[1])}
    expected |= {(60, j): plain_area(clipped(b, outer)) - plain_area(clipped(b, hole)) for j, b in enumerate(shapes[1])}
    tolerance = 1e-6 if origin[0] else 1e-9
    assert sum(v > 1e-3 for v in expected.values()) > 100
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=tolerance) for k, v in expected.items())


def test_edges_are_not_sent_to_the_driver(spark):
    """Written boxes compress to next to nothing, so that Spark would take their edges for a small table."""
    frame = lambda name: cut(spark.range(500).select(F.col("id").alias(name), F.expr(f"cast('{json.dumps([[[0, 0], [1, 0], [1, 1], [0, 0]]])}' as string)").alias("t"))
                             .select(name, F.from_json("t", geojson.RINGS).alias("rings")), name)
    found = scoring.overlap_pairs(frame("gold_id"), frame("result_id"), ["gold_id"], ["result_id"], 1.0)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("few", [0, 3, 5, 64])
def test_large_faces_by_rows_and_small_ones_as_a_whole(spark, monkeypatch, few):
    """Faces of few edges are compared as a whole, others row by row; repeated ids count as before by either way."""
    monkeypatch.setattr(scoring, "FEW_EDGES", few)
    polygon = lambda n, x: [[(x + 2 * math.cos(6.28 * i / n), 2 * math.sin(6.28 * i / n)) for i in [*range(n), 0]]]
    gold, result = [polygon(3, 0), polygon(5, 1), polygon(9, 2)], [polygon(4, 1.5), polygon(9, 0.5), polygon(3, 9)]
    expected = {(i, j): plain_area(clipped(a[0][:-1], b[0][:-1])) for i, a in enumerate(gold) for j, b in enumerate(result)}
    for times in (1, 2):
        frames = [feature_frame(spark, side, name) for side, name in ((gold, "gold_id"), (result, "result_id"))]
        frames[0] = frames[0].unionByName(frames[0].limit(0) if times == 1 else frames[0])
        got = {(r["gold_id"], r["result_id"]): r["overlap"] for r in scoring.overlap_pairs(*frames, ["gold_id"], ["result_id"], 0.5).collect()}
        assert all(got.get(k, 0.0) == pytest.approx(v * times ** 2, abs=1e-9) for k, v in expected.items())


def test_a_set_beside_itself_scores_zero(spark):
    rng = random.Random(8)
    small = [box(x, y, x + rng.uniform(0.01, 0.3), y + rng.uniform(0.01, 0.3)) for x, y in ((rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(40))]
    star = [(500_000 + (3 + i % 2) * math.cos(i), 9 + (3 + i % 2) * math.sin(i)) for i in range(6)]
    assert score(spark, small + [[star + star[:1]]], small + [[star + star[:1]]]) == 0.0


@pytest.mark.parametrize("other, meets", [(box(1, 0.5, 2, 2), True), (box(1, 1, 2, 2), True), (box(1.001, 0, 2, 1), False), (box(0.2, 1, 0.4, 3), True), (box(0.2, 1.2, 0.4, 3), False)])
def test_faces_meet_where_they_touch(spark, other, meets):
    args = [feature_frame(spark, [box(0, 0, 1, 1)], "gold_id"), feature_frame(spark, [other], "result_id"), ["gold_id"], ["result_id"], 1.0]
    assert [r["overlap"] for r in scoring.overlap_pairs(*args).collect()] == [0.0] * meets
    assert scoring.overlap_pairs(*args, touching=False).count() == 0


def test_score_of_nothing(spark):
    assert math.isnan(score(spark, [], []))


def test_scores_by_parameter_set(spark):
    gold = feature_frame(spark, [box(0, 0, 10, 10)], "gold_id")
    result = feature_frame(spark, [box(0, 0, 10, 10), box(5, 0, 15, 10)], "result_id").withColumn("param_id", F.col("result_id").cast("int"))
    sets = spark.createDataFrame([(0,), (1,), (2,)], "param_id INT")
    got = scoring.evaluate(gold, result, 1.0, ["param_id"], sets)
    assert dict(scoring.collect_scores(got)) == {0: 0.0, 1: 0.25, 2: 1.0}
    stats = scoring.score_stats(got).first()
    assert (stats["min_score"], stats["max_score"]) == (0.0, 1.0)
    best = scoring.best_candidate(got, sets.withColumn("knn", F.lit(8))).first()
    assert (best["param_id"], best["knn"], best["score"]) == (0, 8, 0.0)


def inside(rings, x, y):
    hit = False
    for ring in rings:
        for (xa, ya), (xb, yb) in zip(ring, ring[1:]):
            if (ya <= y) != (yb <= y) and x < xa + (y - ya) / (yb - ya) * (xb - xa):
                hit = not hit
    return hit


def test_rasterize_against_brute_force(spark):
    rng = random.Random(2)
    shapes = []
    for _ in range(12):
        cx, cy = rng.uniform(-20, 120), rng.uniform(-20, 40)
        star = [(cx + rng.uniform(2, 15) * math.cos(a), cy + rng.uniform(2, 15) * math.sin(a)) for a in sorted(rng.uniform(0, 6.28) for _ in range(9))]
        shapes.append([star + star[:1]])
    shapes.append(box(0, 0, 30, 30) + box(5, 5, 20, 25))
    got = {}
    for r in scoring.rasterize(feature_frame(spark, shapes, "id"), ["id"], 0.5).collect():
        got.setdefault(r["id"], set()).add((r["cx"], r["cy"]))
    for i, rings in enumerate(shapes):
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        expected = {(x, y) for x in range(math.floor(min(xs) * 2), math.ceil(max(xs) * 2))
                    for y in range(math.floor(min(ys) * 2), math.ceil(max(ys) * 2)) if inside(rings, (x + .5) / 2, (y + .5) / 2)}
        assert got.get(i, set()) == expected


def test_areas(spark):
    df = feature_frame(spark, [box(0, 0, 4, 3) + box(1, 1, 2, 2)], "id")
    row = df.select(ring_area(F.get("rings", F.lit(0))).alias("outer"), polygon_area(F.col("rings")).alias("area")).first()
    assert (row["outer"], row["area"]) == (12.0, 11.0)


def features(spark, rows):
    return spark.createDataFrame([(a, i, s, box(0, 0, i + 1, 1), sl, az) for a, i, s, sl, az in rows],
                                 f"apn STRING, feature_id BIGINT, srid INT, rings {geojson.RINGS}, slope DOUBLE, azimuth DOUBLE")


def test_geojson_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = features(spark, [("a/b 1", 0, 3857, 10.0, 20.0), ("a/b 1", 1, 3857, 30.0, float("nan")), ("007", 0, 0, 1.0, 2.0)])
    geojson.write_geojson(df, path)
    back = geojson.read_features(spark, path, by_folder=True, attributes=True).orderBy("apn", "feature_id")
    rows = back.collect()
    assert [(r["apn"], r["feature_id"], r["srid"], r["slope"]) for r in rows] == [("007", 0, 0, 1.0), ("a/b 1", 0, 3857, 10.0), ("a/b 1", 1, 3857, 30.0)]
    assert rows[1]["rings"] == [[list(map(float, p)) for p in box(0, 0, 1, 1)[0]]]
    assert rows[2]["azimuth"] is None and [(r["param_id"], r["part"]) for r in rows] == [(0, 0)] * 3
    geojson.write_geojson(features(spark, [("007", 0, 0, 5.0, 2.0)]), path)
    again = geojson.read_features(spark, path, by_folder=True, attributes=True)
    assert again.count() == 3 and again.filter("apn = '007'").first()["slope"] == 5.0
    assert geojson.read_features(spark, path, by_folder=True).filter("slope IS NOT NULL").count() == 0


def written(path):
    """The documents below a folder by their place, parsed."""
    files = [f for f in path.rglob("*.txt")]
    found = {str(f.parent.relative_to(path)): json.loads(f.read_text()) for f in files}
    assert len(found) == len(files)
    return found


def test_every_set_and_parcel_is_one_valid_document(spark, tmp_path):
    df = features(spark, [("a", i, 1, float(i), float("nan")) for i in range(300)] + [("b", 7, 0, None, 2.0)])
    both = df.withColumn("param_id", F.lit(3)).unionByName(df.filter("feature_id % 2 = 1").withColumn("param_id", F.lit(4)))
    geojson.write_geojson(both.repartition(5), str(tmp_path))
    docs = written(tmp_path)
    assert set(docs) == {f"param_id={p}/apn={a}" for p in (3, 4) for a in "ab"}
    assert [f["id"] for f in docs["param_id=3/apn=a"]["features"]] == [str(i) for i in range(300)]
    assert [f["id"] for f in docs["param_id=4/apn=a"]["features"]] == [str(i) for i in range(1, 300, 2)]
    assert docs["param_id=3/apn=a"]["crs"]["properties"]["name"] == "EPSG:1" and "crs" not in docs["param_id=3/apn=b"]
    assert docs["param_id=4/apn=a"]["features"][0]["properties"] == {"apn": "a", "slope": 1.0, "azimuth": None}
    assert docs["param_id=4/apn=b"]["features"][0]["properties"]["slope"] is None


def test_geometries_of_any_kind(spark, tmp_path):
    a, b, hole = box(0, 0, 4, 4), box(5, 5, 6, 6), box(1, 1, 2, 2)
    inner = {"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "Polygon", "coordinates": b}]}
    kinds = [{"type": "MultiPolygon", "coordinates": [a + hole, b]}, None, {"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": []},
             {"type": "GeometryCollection", "geometries": [{"type": "MultiPolygon", "coordinates": [b, a]}, inner]},
             {"type": "Polygon", "coordinates": [[[*p, 9.5] for p in a[0]]]}, {"type": "MultiPolygon", "coordinates": []}]
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}},
           "features": [{"type": "Feature", "properties": None, "geometry": g, "bbox": [0, 1]} for g in kinds]}
    (tmp_path / "p.geojson").write_text(json.dumps(doc, indent=1))
    rows = geojson.read_features(spark, str(tmp_path)).orderBy("feature_id", "part").collect()
    flat = lambda rings: [[list(map(float, p)) for p in r] for r in rings]
    assert [(r["feature_id"], r["part"], [[p[:2] for p in ring] for ring in r["rings"]]) for r in rows] == [
        (0, 0, flat(a + hole)), (0, 1, flat(b)), (4, 0, flat(b)), (4, 1, flat(a)), (4, 2, flat(b)), (5, 0, flat(a))]
    assert {r["srid"] for r in rows} == {3857}
    (tmp_path / "bad.geojson").write_text("{]")
    with pytest.raises(Exception):
        geojson.read_features(spark, str(tmp_path)).collect()


def test_reading_plain_geojson_files(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": box(0, 0, 2, 2)}}]}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "p1.geojson").write_text(json.dumps(doc, indent=2))
    (tmp_path / "p2.geojson").write_text(json.dumps(doc))
    rows = geojson.read_gold(spark, str(tmp_path)).orderBy("apn").collect()
    assert [(r["apn"], r["feature_id"], r["srid"]) for r in rows] == [("p1", 0, 0), ("p2", 0, 0)]
    assert geojson.append(geojson.read_gold(spark, str(tmp_path)), geojson.read_gold(spark, str(tmp_path))).count() == 4


def test_label_colors(spark):
    rows = [(0, "t", i, 100 - i, 0.1, i) for i in range(4)]
    df = spark.createDataFrame(rows, "param_id INT, tile_id STRING, region_id BIGINT, size BIGINT, seed_ncurv DOUBLE, seed_id BIGINT")
    before = spark.createDataFrame([(0, "t", 4)], "param_id INT, tile_id STRING, n BIGINT")
    colors = [r["color"] for r in faces.label_colors(df, before).orderBy("region_id").collect()]
    assert colors[-1] == 16777219 and colors[0] == int(16777215 / 4 + 1)


def test_to_crs(spark):
    df = spark.createDataFrame([("t", box(0, 0, 2, 1))], f"tile_id STRING, rings {geojson.RINGS}")
    ref = cut(spark.createDataFrame([("t", 0.5, 0.25, 100.0, 0.0, -0.5, 50.0, None)],
                                    "tile_id STRING, m00 DOUBLE, m01 DOUBLE, m02 DOUBLE, m10 DOUBLE, m11 DOUBLE, m12 DOUBLE, srid INT"))
    row = faces.to_crs(df, ref).first()
    assert row["srid"] == 0
    assert row["rings"][0][:3] == [[100.0, 50.0], [101.0, 50.0], [101.25, 49.5]]


def test_a_document_is_sorted_by_many_tasks_and_has_one_file(spark, tmp_path):
    df = features(spark, [("a/%b 1", i // 2, 1, float(i), 1.0) for i in range(4000)] + [("é", i, 0, 1.0, 1.0) for i in range(3)])
    df = df.unionByName(df.filter("feature_id = 1999").withColumns({"feature_id": F.lit(None).cast("bigint"), "slope": F.lit(-1.0)}))
    plan = geojson.lines(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\((.*?) ASC", plan)
    assert windows and all(w.count("feature_id") == 2 for w in windows), "numbered within a whole document"
    for _ in range(2):
        geojson.write_geojson(df.repartition(5), str(tmp_path))
        docs = written(tmp_path)
        assert sorted(len(d["features"]) for d in docs.values()) == [3, 4002]
        ids = [f["id"] for d in docs.values() for f in d["features"] if len(d["features"]) > 3]
        assert ids == [None, None, *[str(i // 2) for i in range(4000)]]
        back = geojson.read_features(spark, str(tmp_path), by_folder=True, attributes=True)
        assert back.count() == 4005 and back.filter("apn = 'a/%b 1'").agg(F.sum("slope")).first()[0] == sum(range(4000)) - 2
    assert not [f for f in tmp_path.rglob("_whole*")]
