"""Tables with a folder for each value, written by tasks."""

import os

from pyspark.sql import functions as F

from slopeweave.sources import folders, geojson, tables

ODD = ["a/b 1", "x=y%", "ü'\"", "#{[^]}", "\\", None, ""]


def test_folders_are_named_as_spark_names_them(spark, tmp_path):
    df = spark.createDataFrame([(v, 1) for v in ODD], "k STRING, v INT")
    df.write.partitionBy("k").parquet(str(tmp_path / "spark"))
    assert {n for n in os.listdir(tmp_path / "spark") if "=" in n} == {folders.folder_name("k", v) for v in ODD}


def test_tiles_are_written_and_replaced_by_tasks(spark, tmp_path):
    """No file by Spark's writer: it opens and moves them one at a time."""
    path = str(tmp_path / "dem")
    rows = [(t, x, y, n) for n, t in enumerate(ODD) for x in (0, 3000) for y in (0, 1)]
    dem = spark.createDataFrame(rows, tables.PIXELS)
    tables.write_dem(dem.repartition(3), path)
    tables.write_dem(dem.filter("tile_id LIKE 'a%' AND px = 0").withColumn("argb", F.lit(-5)), path)
    expected = [(t or None, x, y, -5 if t == "a/b 1" else n) for t, x, y, n in rows if t != "a/b 1" or x == 0]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, tables.read_dem(spark, path).collect()), key=key) == sorted(expected, key=key)
    names = os.listdir(path)
    assert all("=" in n for n in names) and "_SUCCESS" not in names


def test_a_joined_document_is_the_same_when_the_task_is_tried_again(tmp_path):
    import pyarrow as pa

    folder = tmp_path / "d"
    folder.mkdir()
    texts = [b"one\n", b"two two\n", b"three\n"]
    for i, text in enumerate(texts):
        (folder / f"part-{i}").write_bytes(text)
    batch = pa.RecordBatch.from_pylist([{"staged": str(tmp_path), "folder": "d", "parts": [{"file": f"part-{i}", "bytes": len(t)} for i, t in enumerate(texts)]}])
    # Ended while the second part was copied.
    with open(folder / "part-0", "ab") as whole:
        whole.write(texts[1][:3])
    for _ in range(2):
        list(geojson._joined([batch]))
        assert os.listdir(folder) == ["part-0"] and (folder / "part-0").read_bytes() == b"".join(texts)
