import math

import pytest
from pyspark.sql import functions as F

from fieldgrid.functions import bands, paths, scores
from fieldgrid.plans.grid import CrsError, Grid, require_projected


def test_indices_need_their_bands(spark):
    df = bands.add_indices(spark.createDataFrame([(0.2, 0.3, 0.7, 0.5, 0.4)], "B03 double, B04 double, B08 double, B11 double, B12 double"))
    assert {"NDVI", "NDWI", "NDBI", "NBR"} <= set(df.columns) and "NDRE_B05" not in df.columns
    r = df.first()
    assert r.NDVI == pytest.approx(0.4) and r.NDBI == -r.NDMI


def test_safe_ratio_guards_small_denominators(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1e-7), (1.0, 1e-6), (None, 2.0), (4.0, -2.0)], "a double, b double")
    got = [r[0] for r in df.select(bands.safe_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [None, None, pytest.approx(1e6), None, -2.0]


def test_validity_takes_every_band(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, None), (float("nan"), 1.0), (float("inf"), 1.0), (-9999.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(bands.all_valid(["a", "b"], -9999.0)).collect()] == [True, False, False, False, False]
    masked = bands.mask_common(df, ["a"], ["b"], -9999.0).collect()
    assert [(r.a, r.b) for r in masked] == [(1.0, 1.0), (1.0, None), (None, None), (None, None), (None, None)]


def test_cloud_predicates(spark):
    df = spark.createDataFrame([(0,), (3,), (8,)], "m int")
    assert [r[0] for r in df.select(bands.is_cloud(F.col("m"))).collect()] == [False, True, True]
    assert [r[0] for r in df.select(bands.is_cloud(F.col("m"), "values", (3,))).collect()] == [False, True, False]
    with pytest.raises(ValueError):
        bands.is_cloud(F.col("m"), "values")


def test_entropy_extremes(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],), ([0.9, 0.1],), ([1.0],), (None,)], "p array<double>")
    e = [r[0] for r in df.select(scores.normalized_entropy(F.col("p"))).collect()]
    assert e[0] < 1e-5 and abs(e[1] - 1) < 1e-5 and 0 < e[2] < 1 and e[3] == 0 and e[4] is None
    assert e[2] == pytest.approx(-(0.9 * math.log(0.9) + 0.1 * math.log(0.1)) / math.log(2), abs=1e-6)


def test_best_class_ties_go_to_the_first(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)], "p array<double>")
    assert [r[0] for r in df.select(scores.best_class(F.col("p"), [7, 8, 9])).collect()] == [7, 9]


def test_row_and_column(spark):
    g = Grid(100.0, 200.0, 10.0, 50, 50)
    r = spark.createDataFrame([(125.0, 175.0), (99.0, 201.0)], "x double, y double").select(g.row(F.col("y")), g.col(F.col("x"))).collect()
    assert [tuple(x) for x in r] == [(2, 2), (-1, -1)]
    c = spark.range(1).select(g.center_x(F.lit(2)), g.center_y(F.lit(2))).first()
    assert tuple(c) == (125.0, 175.0)


def test_crs_guard():
    assert require_projected(32735) == 32735
    for bad in (None, 4326):
        with pytest.raises(CrsError):
            require_projected(bad)


@pytest.mark.parametrize(("name", "band", "hit"), [("T_B02_10m.jp2", "B02", True), ("X_FRE_B2.tif", "B02", True), ("T_B8A_20m.jp2", "B08", False), ("T_B8A_20m.jp2", "B8A", True), ("T_b08.tif", "B08", True), ("T_B12.tif", "B02", False), ("T-B02 x.tif", "B02", True), ("B2", "B02", True), ("T.B02.tif", "B02", False), ("TB02.tif", "B02", False), ("T_B020.tif", "B02", False)])
def test_band_tokens(spark, name, band, hit):
    assert spark.range(1).select(paths.has_band(F.lit(name), band)).first()[0] is hit


def test_resolution_and_safe_names(spark):
    got = [spark.range(1).select(paths.resolution(F.lit(p))).first()[0] for p in ("a/T_B02_10m.jp2", "R20m/T_B02.jp2", "T_B02.jp2", "x/T.60m.tif", "IMG_DATA/R60m/T_B02.jp2", "a/b10m/T.jp2", "R10m/a/b/c/T.jp2")]
    assert got == [10.0, 20.0, None, 60.0, 60.0, None, None]
    assert spark.range(1).select(paths.safe_id(F.lit("a b/c:1.tif"))).first()[0] == "a_b_c_1.tif"
