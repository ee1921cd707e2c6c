"""Registered queries against their SQL on the smallest data, and whole jobs."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.compare import connect, same
from checks.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
# Those that take a few seconds; `python -m checks.compare` runs all of them.
QUICK = ["s3_read_points", "s4_read_features", "s6_read_georef", "k1_write_geojson", "p1_base_name", "p3_grid_size",
         "p6_dem_color", "p8_extract_band", "p9_intensity", "p11_cosine", "p14_slope", "p15_azimuth", "p19_resample",
         "p20_to_crs", "p23_clean_params", "p24_ring_area", "f9_valid_params", "j1_match_inputs", "j8_overlap_pairs",
         "a1_extents", "a11_score_stats", "a12_best_candidate", "w3_with_position", "w6_first_k", "w7_rank_scores",
         "u1_append", "u3_minus", "x3_vectorize", "x4_rasterize", "q2_dem", "q3_evaluate"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    assert same(QUERIES[name](spark, DATA).toPandas(), connect(DATA).execute(ORACLES[name]).df()) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_segmentation_does_not_depend_on_order_or_partitions(spark):
    from slopeweave import segment

    def run(shuffle, parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        mixed = lambda df: df.orderBy(F.rand(5)).repartition(5) if shuffle else df
        return segment(mixed(fx.roof_points(spark, DATA)), mixed(fx.outline(spark, DATA)), mixed(fx.raster(spark, DATA)),
                       fx.georef(spark, DATA), fx.roof_params_df(spark).filter("param_id IN (0, 3)")).select(
            "param_id", "apn", "feature_id", F.to_json("rings").alias("rings"), F.round("slope", 5).alias("slope")).toPandas()

    a, b = run(False, 4), run(True, 7)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(a) > 20 and same(a, b) == ""
