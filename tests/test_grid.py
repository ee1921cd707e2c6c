"""Hand cases for points, cells and pixels."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from slopeweave.functions import cells as fc
from slopeweave.operators import grid, ranking
from slopeweave.operators.joins import attach
from slopeweave.plans.dem import dem
from slopeweave.session import cut
from slopeweave.sources import points as pts, tables


def points(spark, rows):
    return spark.createDataFrame([("t", i, *map(float, r)) for i, r in enumerate(rows)],
                                 "tile_id STRING, seq BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")


def square(spark):
    """99 points that span (0, 0) to (9, 9)."""
    rows = [(x, y, x + y) for x in range(10) for y in range(10) if (x, y) != (5, 5)]
    return points(spark, rows)


def test_grid_size(spark):
    row = grid.grid_size(grid.extents(square(spark))).first()
    assert (row["n"], row["w"], row["h"]) == (99, 10, 10)


def test_last_point_wins_and_empty_cells(spark):
    rows = square(spark).unionByName(points(spark, [(0, 9, 7.0)]).withColumn("seq", F.lit(1000).cast("bigint")))
    tiles = cut(grid.grid_size(grid.extents(rows)))
    cells = {(r["px"], r["py"]): r["height"] for r in grid.height_grid(rows, tiles).collect()}
    assert len(cells) == 100
    assert cells[(0, 0)] == 7.0          # (min x, max y) is the upper left cell
    assert cells[(5, 4)] == 0.0          # no point at (5, 5)
    assert cells[(9, 0)] == 18.0


def test_dem_colors(spark):
    pixels = {(r["px"], r["py"]): r["argb"] for r in dem(square(spark)).collect()}
    assert pixels[(5, 4)] == -16777216
    assert pixels[(9, 0)] == -16777216 + 18000


@pytest.mark.parametrize("z,expected", [(1e9, 2147483647 - 16777216), (-1e9, 2147483648 - 16777216), (-0.0015, -16777217)])
def test_dem_color_saturates_then_wraps(spark, z, expected):
    df = spark.createDataFrame([(10, 0.0, 9.0, z)], "w INT, min_x DOUBLE, max_x DOUBLE, z DOUBLE")
    assert df.select(fc.dem_color()).first()[0] == expected


def test_a_tile_without_area_has_no_grid(spark):
    line = points(spark, [(1, y, 0) for y in range(5)])
    assert dem(line).count() == 0


def test_resample_takes_the_nearest_source(spark):
    for w, big in ((3, 7), (7, 3), (5, 5), (1, 4), (30, 24)):
        source = spark.range(w).select(F.lit("t").alias("tile_id"), F.col("id").cast("int").alias("px"),
                                       F.lit(0).alias("py"), F.col("id").cast("int").alias("argb"))
        sizes = cut(spark.createDataFrame([("t", w, 1, big, 1)], "tile_id STRING, src_w INT, src_h INT, w INT, h INT"))
        got = {r["px"]: r["argb"] for r in grid.resample(source, sizes).collect()}
        assert got == {x: int((x + 0.5) * w / big) for x in range(big)}


@pytest.mark.parametrize("sent, join", [(100_000, "BuildRight"), (2, "SortMergeJoin")])
def test_generated_pixels_are_never_sent(spark, monkeypatch, sent, join):
    monkeypatch.setattr(grid, "TILES_TO_SEND", sent)
    sizes = cut(spark.range(500).selectExpr("CAST(id AS STRING) AS tile_id", "30 AS src_w", "1 AS src_h", "15 AS w", "1 AS h"))
    pixels = spark.range(2).selectExpr("CAST(id AS STRING) AS tile_id", "explode(sequence(0, 29)) AS px", "0 AS py")
    taken = grid.resample(pixels, sizes)
    assert sorted((r["tile_id"], r["px"]) for r in taken.collect()) == [(t, x) for t in "01" for x in range(15)]
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert join in plan and "BuildLeft" not in plan


def test_a_task_aggregates_a_bounded_number_of_cells(spark, monkeypatch):
    monkeypatch.setattr(grid, "CELLS_AT_ONCE", 10)
    rows = square(spark)
    tiles = cut(grid.grid_size(grid.extents(rows)))
    for made in (grid.height_grid(rows, tiles), grid.dem_pixels(rows, tiles)):
        assert made.count() == 100 and made.rdd.getNumPartitions() == 10


def test_pixels_of_the_fixtures_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(1, 21).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(fx, "PIXELS_AT_ONCE", 2000)
    pixels = fx.raster(spark, str(tmp_path))
    assert pixels.count() == 20 * 900 and pixels.rdd.getNumPartitions() == 9


def test_band_and_intensity(spark):
    df = spark.createDataFrame([("t", 0, 0, 0x00102030 - 16777216)], tables.PIXELS)
    row = df.select(fc.band(F.col("argb"), 0x102030).alias("hit"), fc.band(F.col("argb"), 1).alias("miss"),
                    fc.intensity(F.col("argb")).alias("light")).first()
    assert (row["hit"], row["miss"], row["light"]) == (-1, 0, (16 + 32 + 48) / 3)


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_read_points(spark, tmp_path):
    write(tmp_path / "deep", "a.b.txt", "1 2 3\n\n4 5 6 \n7 8 9\n")
    write(tmp_path, "c.txt", "0 0 0\n")
    write(tmp_path, "c.csv", "not read\n")
    rows = pts.read_points(spark, str(tmp_path)).orderBy("tile_id", "seq").collect()
    assert [(r["tile_id"], r["x"], r["y"], r["z"]) for r in rows] == [
        ("a.b", 1, 2, 3), ("a.b", 4, 5, 6), ("a.b", 7, 8, 9), ("c", 0, 0, 0)]
    assert {r["tile_id"] for r in pts.manifest(spark, str(tmp_path), ".txt").collect()} == {"a.b", "c"}


@pytest.mark.parametrize("line", ["1 2", "1 2 3 4", "1  2 3", "1 2 x"])
def test_malformed_lines_fail(spark, tmp_path, line):
    write(tmp_path, "t.txt", f"1 2 3\n{line}\n")
    with pytest.raises(Exception):
        pts.read_points(spark, str(tmp_path)).collect()


def test_seq_follows_the_file_over_splits(spark, tmp_path):
    write(tmp_path, "t.txt", "".join(f"{i} 0 0\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = pts.read_points(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 3
        assert [r["x"] for r in read.orderBy("seq").collect()] == [float(i) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_inputs_are_matched_by_name(spark):
    files = lambda *paths: spark.createDataFrame(
        [(p, p.split("/")[-1].split(".")[0]) for p in paths], "path STRING, tile_id STRING")
    rows = grid.match_inputs(files("h/a.txt", "h/b.txt"), files("o/2/a.tif", "o/1/a.tif"), files("r/a.tif", "r/b.tif")).collect()
    assert [tuple(r) for r in rows] == [("a", "h/a.txt", "o/1/a.tif", "r/a.tif")]


SPLIT = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "6",
         "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_hot_key_is_split_where_the_small_side_is_not_broadcast(spark, how):
    big = cut(spark.range(60_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 900).alias("k"), "id", F.hash("id").alias("v")).repartition(8))
    small = cut(spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")))
    order = lambda df: sorted(map(tuple, df.collect()))
    broadcast = attach(big, small, ["k"], how)
    expected = order(broadcast)
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().toString()
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    try:
        for k, v in SPLIT.items():
            spark.conf.set(k, v)
        shuffled = attach(big, small, ["k"], how)
        assert order(shuffled) == expected
        assert "skew=true" in shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_positions_in_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("k"), F.hash("id").alias("v"), "id")
    got = ranking.with_position(df, ["k"], [F.col("v"), F.col("id")])
    groups = {}
    for r in got.collect():
        groups.setdefault(r["k"], []).append((r["v"], r["id"], r["position"]))
    for rows in groups.values():
        assert [r[2] for r in sorted(rows)] == list(range(len(rows)))


def test_first_match_and_nearest_k(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5)], "k STRING, v INT")
    assert sorted(map(tuple, ranking.first_by(df, ["k"], ["v"]).collect())) == [("a", 1), ("b", 5)]
    assert sorted(map(tuple, ranking.first_k(df, ["k"], [F.col("v")], 2).collect())) == [("a", 1, 1), ("a", 2, 2), ("b", 5, 1)]


def test_params_are_made_valid(spark):
    raw = tables.params_df(spark, [tables.Params(), (7, -0.5, 0.1, 1.0, -8.9, 20.7, -1.0, 2.0), (8, None, 0.1, 1.0, 8, 20, 1.0, 2.0)])
    rows = {r["param_id"]: r for r in tables.clean_params(tables.valid_params(raw)).collect()}
    assert set(rows) == {0, 7}
    assert (rows[7]["smoothness"], rows[7]["knn"], rows[7]["region_limit"], rows[7]["slope"]) == (0.5, 8, 20, 1.0)


def test_dem_tiles_are_replaced(spark, tmp_path):
    path = str(tmp_path / "dem")
    first = spark.createDataFrame([("a", 0, 0, 1), ("b", 0, 0, 2)], tables.PIXELS)
    tables.write_dem(first, path)
    tables.write_dem(spark.createDataFrame([("b", 0, 0, 3)], tables.PIXELS), path)
    assert sorted(tuple(r) for r in tables.read_dem(spark, path).collect()) == [("a", 0, 0, 1), ("b", 0, 0, 3)]
    assert tables.processed_count(first) == 2


def test_files_are_named_by_their_tiles(spark, tmp_path, monkeypatch):
    rows = [("a", 2, "y"), ("b", 1, "z"), ("a", 1, "x"), (None, 1, "n"), ("c d", 1, None), ("é", 1, "ä")]
    lines = spark.createDataFrame(rows, "tile_id STRING, place BIGINT, value STRING")
    monkeypatch.setattr(fx, "_write_renamed", None)       # nothing is renamed file by file
    folder = tmp_path / "with space"
    assert fx._write_named(spark, lines, f"file://{folder}", ".txt") == f"file://{folder}"
    assert {f.name: f.read_text() for f in folder.iterdir()} == {
        "a.txt": "x\ny\n", "b.txt": "z\n", "__HIVE_DEFAULT_PARTITION__.txt": "n\n", "c d.txt": "\n", "é.txt": "ä\n"}


def test_files_elsewhere_are_renamed(spark, tmp_path):
    lines = spark.createDataFrame([("a", 2, "y"), ("b", 1, "z"), ("a", 1, "x")], "tile_id STRING, place BIGINT, value STRING")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(tmp_path))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fx._write_renamed(spark, lines.repartition(2, "tile_id").sortWithinPartitions("tile_id", "place").select("tile_id", "value"), files, str(tmp_path), ".txt")
    assert {f.name: f.read_text() for f in tmp_path.glob("*.txt")} == {"a.txt": "x\ny\n", "b.txt": "z\n"}
