"""What intermediate tables leave on disk."""

import os

from pyspark.sql import functions as F

from slopeweave import session
from slopeweave.operators.ranking import with_position


def test_shuffle_files_go_when_a_table_is_written(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {
        name for top in store.localDirs() for _, _, names in os.walk(top.getPath()) for name in names if name.startswith("shuffle_")}
    before = shuffled()
    setting = spark.conf.get(session._DROP_SHUFFLES, None)
    table = session.cut(spark.range(1000).repartition(3, F.col("id") % 7).groupBy((F.col("id") % 5).alias("k")).count())
    assert not shuffled() - before
    assert table.count() == 5 and spark.conf.get(session._DROP_SHUFFLES, None) == setting


def test_a_held_table_goes_at_the_end(spark):
    with session.held(spark.range(10), "held") as table:
        (folder,) = {os.path.dirname(f.removeprefix("file://")) for f in table.inputFiles()}
        assert table.count() == 10 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_positions_keep_the_rows_once(spark):
    with session.held(spark.range(1), "where") as table:
        root = os.path.dirname(os.path.dirname(table.inputFiles()[0].removeprefix("file://")))
    old = set(os.listdir(root))
    placed = with_position(spark.range(100).select((F.col("id") % 3).alias("k"), "id"), ["k"], [F.col("id").desc()])
    assert {n.split("-")[0] for n in set(os.listdir(root)) - old} == {"placed", "offsets"}
    assert placed.filter("position = 0").count() == 3
