"""Session defaults, and intermediate tables that cut the lineage of long plans."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_scratch: tempfile.TemporaryDirectory | None = None
_shipped: set[str] = set()
# Whether Spark drops the shuffle files of an execution when it ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("slopeweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per application, so that they can import it
    wherever the session was started from."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="slopeweave-")
        context.addPyFile(shutil.make_archive(f"{folder}/slopeweave", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names in
    ``spark.checkpoint.dir``. Only a local session may fall back to a temporary folder."""
    global _local_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.TemporaryDirectory(prefix="slopeweave-")
    return "file://" + _local_scratch.name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    The result has no lineage, survives the loss of executors, and has a size that
    Spark knows from its files.
    """
    return _write_and_read(df, label)


def cut_counting(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut`` that also returns aggregates observed while writing, without another job.

    A retried task may be observed twice, so use the metrics only as "none or some".
    """
    seen = Observation()
    observed = df.observe(seen, *[m.alias(name) for name, m in metrics.items()])
    return _write_and_read(observed, label), seen.get


@contextmanager
def held(df: DataFrame, label: str = "table") -> Iterator[DataFrame]:
    """``cut`` for as long as the block lasts; what is made of the table must be written by its end."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    try:
        yield _write_and_read(df, label, path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _write_and_read(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile needs its shuffle files no more when it is done, so they go then and not whenever the driver collects garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
