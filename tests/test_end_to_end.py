"""A tiny run from files to reports."""

import json

import numpy as np
import pytest

from fieldgrid.plans import classification
from fieldgrid.plans.grid import Grid
from fieldgrid.plans.settings import Blocks, Imagery, Masks, Products, Run, Samples, Search, SettingError
from fieldgrid.operators import model
from fieldgrid.sources import geotiff


def test_run(spark, tmp_path):
    rng = np.random.default_rng(0)
    g = Grid(500000.0, 8000000.0, 10.0, 40, 40, 32735, -9999.0)
    kind = (np.add.outer(np.arange(40) // 5, np.arange(40) // 5) % 2) + 1
    for scene in ("S1", "S2"):
        (tmp_path / "img" / scene).mkdir(parents=True)
        for k, band in enumerate(("B02", "B03", "B04", "B08", "B11", "B12")):
            values = (100 + 50 * kind * (k + 1) + rng.normal(0, 3, (40, 40))).astype("f4")
            if scene == "S1":
                values[:3] = -9999.0
            coarse = scene == "S2" and band == "B12"  # one band at another resolution
            grid, values = (Grid(g.x0, g.y0, 20.0, 20, 20, 32735, -9999.0), values[::2, ::2]) if coarse else (g, values)
            (tmp_path / "img" / scene / f"T_{band}_{20 if coarse else 10}m.tif").write_bytes(geotiff.write(values, grid, [band]))
        mask = np.zeros((40, 40), "u1")
        mask[20:, :4] = 1 if scene == "S1" else 0
        (tmp_path / "img" / scene / "cloud.tif").write_bytes(geotiff.write(mask, g))
    features = []
    for i in range(120):
        r, c = (int(v) for v in rng.integers(0, 40, 2))
        features.append({"type": "Feature", "properties": {"label": "wood" if kind[r, c] == 1 else "field"}, "geometry": {"type": "Point", "coordinates": [g.x0 + c * 10 + 5, g.y0 - r * 10 - 5]}})
    (tmp_path / "train.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    out = tmp_path / "outputs"
    plan = Run(
        Imagery(str(tmp_path / "img"), more_bands=(), masks=Masks(r"^cloud\.tif$")),
        Samples(str(tmp_path / "train.geojson"), srid=32735),
        Products(str(out)),
        Blocks(metres=100.0, folds=2),
        Search(forests={"n_estimators": [3], "max_depth": [4]}, trials=1, svm=False, selection=False),
    )
    meta = classification.run(spark, plan)
    assert meta["holdout"]["raw"]["accuracy"] > 0.9 and meta["extraction"]["point_objects"] == 120
    assert json.loads((out / "metrics" / "run.json").read_text())["model"] == "random_forest"
    stack = spark.read.parquet(str(out / "prepared" / "feature_stack.parquet"))
    assert stack.count() == 1600 and stack.filter("B02 IS NULL").count() == 0
    assert (out / "rasters" / "classes.qml").exists()
    # the written rasters, read again, hold what the tables hold
    table = spark.read.parquet(str(out / "rasters" / "predictions.parquet")).orderBy("prow", "pcol").toPandas()
    for name, columns in (("landcover_raw", ["class"]), ("model_confidence", ["confidence"]), ("entropy_uncertainty_proxy", ["entropy"])):
        read = geotiff.read_pixels(spark, str(out / "rasters" / f"{name}.tif")).orderBy("prow", "pcol").toPandas()
        assert list(read["band"].unique()) == columns and np.allclose(read["value"], table[columns[0]].astype("f4"), equal_nan=True)
    grids = geotiff.read_grids(spark, str(out / "rasters" / "class_probability_scores.tif"))
    (grid, bands), = grids.values()
    assert (grid.width, grid.height, grid.srid) == (40, 40, 32735) and bands == ["class_1_score", "class_2_score"]
    assert geotiff.read_pixels(spark, str(out / "prepared" / "feature_stack.tif")).select("band").distinct().count() == len(stack.columns) - 4
    again = model.load_model(spark, str(out / "models" / "selected"))
    assert model.classify_pixels(again, stack, again.names).filter("class IS NOT NULL").count() == 1600


def test_scenes_of_two_zones_and_a_stack_that_is_there(spark, tmp_path):
    """The second scene lies in the next zone, on another resolution, and its files name no system; its metadata does."""
    first, second = Grid(790_000.0, 7_200_000.0, 20.0, 30, 30, 32735), Grid(185_000.0, 7_202_000.0, 20.0, 250, 250, None)
    for scene, grid, value in (("A", first, 3.0), ("B", second, 7.0)):
        folder = tmp_path / "img" / scene
        folder.mkdir(parents=True)
        for band in ("B04", "B08"):
            (folder / f"{band}_20m.tif").write_bytes(geotiff.write(np.full((grid.height, grid.width), value, "f4"), grid, [band]))
    (tmp_path / "img" / "B" / "MTD_TL.xml").write_text("<a><HORIZONTAL_CS_CODE>EPSG:32736</HORIZONTAL_CS_CODE></a>")
    stack = classification.prepare_stack(spark, Imagery(str(tmp_path / "img"), bands=("B04", "B08"), more_bands=(), metres=None))
    assert stack.grid.srid == 32735 and stack.grid.res == 20.0
    seen = {(r.prow, r.pcol): r.B04 for r in stack.pixels.filter("B04 IS NOT NULL").collect()}
    down, right = int((stack.grid.y0 - first.y0) / 20), int((first.x0 - stack.grid.x0) / 20)
    own = {(down + r, right + c) for r in range(30) for c in range(30)}
    assert {c for c, v in seen.items() if v == 3.0} == own  # the first scene wins where it is
    assert abs(sum(v == 7.0 for v in seen.values()) + len(own & set(seen)) - 250 * 250) < 0.02 * 250 * 250 + 900
    geotiff.write_raster(stack.pixels, str(tmp_path / "stack.tif"), stack.grid, stack.names)
    again = classification.prepare_stack(spark, Imagery(stack=str(tmp_path / "stack.tif")))
    assert again.names == stack.names and again.grid.srid == 32735
    assert {(r.prow, r.pcol): r.B04 for r in again.pixels.filter("B04 IS NOT NULL").collect()} == seen
    with pytest.raises(FileNotFoundError):
        classification.prepare_stack(spark, Imagery(stack=str(tmp_path / "none.tif")))
    with pytest.raises(FileNotFoundError):
        classification.prepare_stack(spark, Imagery(str(tmp_path / "none")))


def test_choices_are_checked():
    for bad in (lambda: Search(score="kappa"), lambda: Imagery("x", resampling="cubic"), lambda: Products("x", window=4), lambda: Blocks(held_out=1.0), lambda: Search(keep="most"), lambda: Imagery(), lambda: Imagery("x", stack="y")):
        with pytest.raises(SettingError):
            bad()
