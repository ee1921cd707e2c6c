"""Polygon faces as GeoJSON."""

from __future__ import annotations

import os
import shutil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from slopeweave.functions.cells import base_name
from slopeweave.operators.joins import attach
from slopeweave.session import cut
from slopeweave.sources.folders import local_path, put_in_place, stage, without_empty

RINGS = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
CRS = "STRUCT<type: STRING, properties: STRUCT<name: STRING>>"
PROPERTIES = "STRUCT<apn: STRING, slope: DOUBLE, azimuth: DOUBLE>"
FEATURE = f"type STRING, geometry VARIANT, properties {PROPERTIES}, id STRING"
COLLECTION = f"type STRING, crs {CRS}, features ARRAY<STRUCT<type: STRING, geometry: VARIANT, properties: {PROPERTIES}, id: STRING>>"

# Lines of a document: the first, those of the features, the last.
OPENING, FEATURES, CLOSING = 0, 1, 2
# Collections of geometries may lie in each other; this many levels are unfolded.
NESTED = 3


def lines(features: DataFrame) -> DataFrame:
    """The lines ``(param_id, apn, kind, feature_id, value)`` of one GeoJSON document per parameter set and parcel, put in order by kind and
    ``feature_id``, the line without a comma first. A feature is one line; what stands between two features begins the later one's line.

    ``param_id`` is 0 where ``features`` have none. Slope and azimuth are null where they are not a number. The coordinate system
    is named where a parcel has one (the largest, should they differ).
    """
    if "param_id" not in features.columns:
        features = features.withColumn("param_id", F.lit(0))
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"),
        F.struct("apn", number("slope"), number("azimuth")).alias("properties"),
        F.col("feature_id").cast("string").alias("id")), {"ignoreNullFields": "false"})
    # The comma goes before each feature but one of the least number (null is least), so that lines need not be numbered document by document.
    number_or_none = F.struct(F.col("feature_id").isNotNull().alias("known"), F.col("feature_id"))
    parcels = features.groupBy("param_id", "apn").agg(F.max(F.coalesce("srid", F.lit(0))).alias("srid"), F.min(number_or_none).alias("_least"))
    crs = F.when(F.col("srid") != 0, F.concat(F.lit('"crs":{"type":"name","properties":{"name":"EPSG:'), F.col("srid").cast("string"), F.lit('"}},'))).otherwise(F.lit(""))
    edge = lambda kind, value: parcels.select("param_id", "apn", F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("feature_id"), value.alias("value"))
    same = Window.partitionBy("param_id", "apn", "feature_id").orderBy("feature_id")
    least = parcels.select(F.col("param_id").alias("_set"), F.col("apn").alias("_apn"), "_least")
    first = (F.col("_at") == 1) & F.col("feature_id").eqNullSafe(F.col("_least.feature_id"))
    return (features.withColumn("_at", F.row_number().over(same))
            .join(least, F.col("param_id").eqNullSafe(F.col("_set")) & F.col("apn").eqNullSafe(F.col("_apn")))
            .select("param_id", "apn", F.lit(FEATURES).alias("kind"), "feature_id", F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), feature).alias("value"))
            .unionByName(edge(OPENING, F.concat(F.lit('{"type":"FeatureCollection",'), crs, F.lit('"features":['))))
            .unionByName(edge(CLOSING, F.lit("]}"))))


def write_geojson(features: DataFrame, path: str) -> None:
    """One GeoJSON document per parameter set and parcel under ``param_id=<set>/apn=<parcel>/``; those already there are replaced.

    A document is one file. Lines are sorted by ranges, so a large parcel is spread over many tasks, each of which writes its part of the file; the parts of a
    document are then put one after the other by a task that holds a few bytes of them. Where tasks cannot reach ``path`` by themselves (it is neither a local nor a shared folder), one
    task sorts and writes each document. Without ``param_id`` the set is 0.
    """
    spark = features.sparkSession
    order = ["param_id", "apn", "kind", "feature_id", F.col("value").desc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, root = lines(features), local_path(spark, path)
    if root is None:
        (found.repartition(parts, "param_id", "apn").sortWithinPartitions(*order).select("param_id", "apn", "value")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("lineSep", "\n").partitionBy("param_id", "apn").text(path))
        return
    rows = found.repartitionByRange(parts, *order[:-1]).sortWithinPartitions(*order)
    files = stage(rows.select("param_id", without_empty("apn", found), "value"), ["param_id", "apn"], root, _TextFile, ".txt")
    _join_parts(files)
    put_in_place(files, root)


class _TextFile:
    def __init__(self, path: str):
        self.out = open(path, "wb")

    def write(self, batch: pa.RecordBatch) -> None:
        self.out.write("".join([f"{line or ''}\n" for line in batch.column("value").to_pylist()]).encode())

    def close(self) -> None:
        self.out.close()


def _join_parts(files: DataFrame) -> None:
    """Make one file of the staged files of each document, whose names are in the order of their lines."""
    several = (files.groupBy("staged", "folder").agg(F.sort_array(F.collect_list(F.struct("file", "bytes"))).alias("parts")).filter(F.size("parts") > 1))
    several.mapInArrow(_joined, "folder STRING").foreach(lambda row: None)


def _joined(batches):
    for batch in batches:
        for staged, folder, parts in zip(*[batch[c].to_pylist() for c in ("staged", "folder", "parts")]):
            names = [f"{staged}/{folder}/{p['file']}" for p in parts]
            size = 0
            # Each part goes as soon as it is behind the others. If the task is tried again, what is left of a part that was not finished is cut off.
            for name, part in zip(names, parts):
                if name != names[0] and os.path.exists(name):
                    with open(names[0], "r+b") as whole, open(name, "rb") as more:
                        whole.truncate(size)
                        whole.seek(size)
                        shutil.copyfileobj(more, whole, 1 << 20)
                    os.remove(name)
                size += part["bytes"]
        yield pa.record_batch({"folder": pa.array([], pa.string())})


def polygons(geometry: Column, nested: int = NESTED) -> Column:
    """The polygons of a variant geometry of any kind, in order, as an array of rings: a polygon, the members of a multi-polygon, and those of the
    members of a collection. Null for null and for kinds without area."""
    get = lambda path, kind: F.try_variant_get(geometry, path, kind)
    kind, one = get("$.type", "string"), get("$.coordinates", RINGS)
    found = F.when((kind == "Polygon") & one.isNotNull(), F.array(one)).when(kind == "MultiPolygon", get("$.coordinates", f"ARRAY<{RINGS}>"))
    if nested:
        inner = F.transform(get("$.geometries", "array<variant>"), lambda g: F.coalesce(polygons(g, nested - 1), F.array().cast(f"ARRAY<{RINGS}>")))
        found = found.when(kind == "GeometryCollection", F.flatten(inner))
    return found


def read_features(spark: SparkSession, path: str, by_folder: bool = False,
                  attributes: bool = False) -> DataFrame:
    """Faces of every GeoJSON document below ``path``, as ``(apn, feature_id, part, srid, rings, slope, azimuth)``.

    By default these are ``.geojson`` files at any depth and the base name is the parcel.
    ``by_folder`` reads what ``write_geojson`` wrote, line by line, and adds ``param_id``. A feature with several polygons
    has a row for each, numbered by ``part``; one without any has none. Slope and azimuth are null unless
    ``attributes`` is set. The SRID is 0 when the document names none. A file that is not JSON ends the scan.
    """
    srid = lambda crs: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract({crs}.properties.name, '([0-9]+)$', 1), '') AS INT)"), F.lit(0))
    keep = (lambda c: F.col(f"feature.properties.{c}")) if attributes else (lambda c: F.lit(None).cast("double"))
    if by_folder:
        text = spark.read.schema("value STRING, param_id INT, apn STRING").option("lineSep", "\n").text(path)
        opening = text.filter(F.col("value").startswith('{"type":"FeatureCollection"'))
        heads = opening.select("param_id", "apn", F.from_json(F.concat("value", F.lit("]}")), f"crs {CRS}", {"mode": "FAILFAST"}).alias("d"))
        heads = heads.select("param_id", "apn", srid("d.crs").alias("srid"))
        parsed = F.from_json(F.ltrim(F.col("value"), F.lit(",")), FEATURE, {"mode": "FAILFAST"})
        rows = (text.filter(F.ltrim(F.col("value"), F.lit(",")).startswith('{"type":"Feature",')).select("param_id", "apn", parsed.alias("feature"))
                .transform(attach, cut(heads, "heads"), ["param_id", "apn"]).withColumn("pos", F.lit(None).cast("int")))
        scope = ["param_id", "apn"]
    else:
        docs = (spark.read.schema(COLLECTION).option("mode", "FAILFAST").option("multiLine", True)
                .option("recursiveFileLookup", True).option("pathGlobFilter", "*.geojson").json(path)
                .withColumn("apn", base_name(F.col("_metadata.file_name"))))
        rows = docs.select("apn", srid("crs").alias("srid"), F.posexplode("features").alias("pos", "feature"))
        scope = ["apn"]
    position = F.coalesce(F.expr("try_cast(feature.id AS BIGINT)"), F.col("pos").cast("bigint"))
    named = rows.select(*scope, position.alias("feature_id"), "srid", F.col("feature.geometry").alias("geometry"),
                        keep("slope").alias("slope"), keep("azimuth").alias("azimuth"))
    parts = F.filter(polygons(F.col("geometry")), lambda rings: F.size(rings) > 0)
    return (named.select(*scope, "feature_id", "srid", "slope", "azimuth", F.posexplode(parts).alias("part", "rings"))
            .select(*scope, "feature_id", "part", "srid", "rings", "slope", "azimuth"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Every ground-truth face below ``path``, in one list."""
    return read_features(spark, path)


def append(features: DataFrame, more: DataFrame) -> DataFrame:
    """Both collections in one, duplicates kept."""
    return features.unionByName(more)
