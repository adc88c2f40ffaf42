"""A whole run: scenes and training layer in, class raster, scores and reports out. Lazy but for the model fits."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgrid.functions.bands import add_indices, mask_common
from fieldgrid.functions.projection import with_projected
from fieldgrid.operators import focal, metrics, model, mosaic, spatial, vector
from fieldgrid.plans.grid import Grid, require_projected
from fieldgrid.plans.settings import Imagery, Products, Run, Samples
from fieldgrid.sources import geotiff, safe, sinks, store, vectors


@dataclass
class Stack:
    pixels: DataFrame
    grid: Grid
    names: list[str]


def _needed(spark: SparkSession, uri: str) -> str:
    if not store.exists(spark, uri):
        raise FileNotFoundError(uri)
    return uri


def with_systems(spark: SparkSession, root: str, grids: dict[str, Grid], default: int | None = None) -> dict[str, Grid]:
    """Each file's grid with a reference system: its own, that of its product's metadata, or the default."""
    by_folder: dict[str, int] = {}
    out = {}
    for path, g in grids.items():
        if g.srid is None:
            folder = path.rpartition("/")[0]
            if folder not in by_folder:
                by_folder[folder] = default or safe.find_srid(spark, None, root, path)
            g = replace(g, srid=by_folder[folder])
        out[path] = g
    return out


def projected_boxes(spark: SparkSession, boxes: dict[str, tuple[tuple[float, ...], int]], srid: int, steps: int = 20) -> dict[str, tuple[float, ...]]:
    """name -> (box, system) as boxes in one system; points along the sides are projected, for sides bend."""
    out = {k: b for k, (b, own) in boxes.items() if own == srid}
    for own in sorted({o for _, o in boxes.values()} - {srid}):
        rows = [(k, *map(float, b)) for k, (b, o) in boxes.items() if o == own]
        df = spark.createDataFrame(rows, "k string, x0 double, y0 double, x1 double, y1 double").withColumn("t", F.explode(F.array(*[F.lit(k / steps) for k in range(steps + 1)])))
        along = lambda a, b: F.col(a) + F.col("t") * (F.col(b) - F.col(a))
        sides = [(F.col("x0"), along("y0", "y1")), (F.col("x1"), along("y0", "y1")), (along("x0", "x1"), F.col("y0")), (along("x0", "x1"), F.col("y1"))]
        points = df.select("k", F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in sides])).alias("p")).select("k", "p.*")
        moved = with_projected(points, "x", "y", own, srid)
        out |= {r.k: tuple(r)[1:] for r in moved.groupBy("k").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).collect()}
    return out


def reference_grid(spark: SparkSession, imagery: Imagery, grids: dict[str, Grid], first: str) -> tuple[Grid, DataFrame | None]:
    """The run's grid and its area of interest: system and resolution of the first file, extent of the area or of all files."""
    srid, area = require_projected(grids[first].srid), None
    boxes = projected_boxes(spark, {p: (g.bounds(), g.srid) for p, g in grids.items()}, srid)
    extent = tuple(f(b[i] for b in boxes.values()) for i, f in enumerate((min, min, max, max)))
    if imagery.area is not None:
        uri = _needed(spark, imagery.area)
        area = vectors.reproject_layer(vectors.read_layer(spark, uri), vectors.layer_srid(spark, uri), srid)
        extent = vectors.bounds(area)
        if extent is None:
            raise vectors.VectorError("the area of interest is empty")
        for path, b in boxes.items():
            if min(b[2], extent[2]) <= max(b[0], extent[0]) or min(b[3], extent[3]) <= max(b[1], extent[1]):
                raise mosaic.SceneError(f"{path} lies outside the area of interest")
    return Grid.covering(extent, imagery.metres or grids[first].res, srid, imagery.nodata), area


def file_windows(spark: SparkSession, grids: dict[str, Grid], target: Grid) -> dict[str, geotiff.Window]:
    """The pixels of each file that the target grid can need: its extent in the file's system, and two pixels around."""
    box = {str(s): projected_boxes(spark, {"": (target.bounds(), target.srid)}, s)[""] for s in {g.srid for g in grids.values()}}
    out = {}
    for path, g in grids.items():
        x0, y0, x1, y1 = box[str(g.srid)]
        rows = (math.floor((g.y0 - y1) / g.res) - 2, math.ceil((g.y0 - y0) / g.res) + 2)
        cols = (math.floor((x0 - g.x0) / g.res) - 2, math.ceil((x1 - g.x0) / g.res) + 2)
        out[path] = (max(rows[0], 0), max(cols[0], 0), min(rows[1], g.height), min(cols[1], g.width))
    return out


def to_grid(spark: SparkSession, about: DataFrame, grids: dict[str, Grid], target: Grid, method: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, prow, pcol, value of files on any grids, on the target grid. about(path, keys) has a row per file.

    Each file is read once and only where the target is. Corner and resolution are columns, so that there is one branch
    per reference system and kind of resampling however many grids there are."""
    windows, parts = file_windows(spark, grids, target), []
    aligned = lambda g: g.srid == target.srid and g.res == target.res and (g.x0 - target.x0) % g.res == 0 and (g.y0 - target.y0) % g.res == 0
    for srid, how in sorted({(g.srid, "nearest" if aligned(g) else method) for g in grids.values()}):
        own = {p: g for p, g in grids.items() if g.srid == srid and ("nearest" if aligned(g) else method) == how}
        placed = spark.createDataFrame([(p, float(g.x0), float(g.y0), float(g.res)) for p, g in own.items()], "path string, _x0 double, _y0 double, _res double")
        values = geotiff.read_pixels(spark, list(own), {p: windows[p] for p in own}).select("path", "prow", "pcol", F.col("value").cast("double").alias("value"))
        source = Grid(F.col("_x0"), F.col("_y0"), F.col("_res"), 0, 0, srid)
        files = about.join(placed, "path")  # a row per file
        parts.append(mosaic.resampling(how)(values.join(F.broadcast(files), "path"), source, target, "value", keys))
    return reduce(DataFrame.unionByName, parts)


def open_stack(spark: SparkSession, uri: str) -> Stack:
    """A stack that was prepared elsewhere: one multiband raster, its bands named by their descriptions."""
    _needed(spark, uri)
    found = geotiff.read_grids(spark, uri)
    if len(found) != 1:
        raise mosaic.SceneError(f"{uri} must be one raster, it holds {len(found)}")
    (grid, names), = found.values()
    if len(set(names)) < len(names):
        raise mosaic.SceneError(f"{uri} names a band twice: {names}")
    require_projected(grid.srid)
    held = geotiff.read_pixels(spark, uri).groupBy("prow", "pcol").agg(*[F.min(F.when(F.col("band") == n, F.col("value"))).alias(n) for n in names])
    return Stack(held, grid, names)


def prepare_stack(spark: SparkSession, imagery: Imagery) -> Stack:
    """Discover, resample, mask, mosaic, clip and derive; or open the stack that is there."""
    if imagery.stack is not None:
        return open_stack(spark, imagery.stack)
    root, need = _needed(spark, imagery.uri).rstrip("/"), list(imagery.bands)
    files = safe.list_files(spark, root)
    catalog = mosaic.discover(files, need, list(imagery.more_bands), imagery.metres)
    rows = sorted(catalog.collect(), key=lambda x: (x.scene_ord, x.band))  # one row per scene and band
    have = {x.band for x in rows}
    raw = need + [b for b in imagery.more_bands if b in have]
    heads = {p: g for p, (g, _) in geotiff.read_grids(spark, root).items()}
    whole = {p.rpartition(root + "/")[2]: p for p in heads}  # names below the root, and whole ones
    grids = with_systems(spark, root, {x.path: heads[whole[x.path]] for x in rows})
    target, area = reference_grid(spark, imagery, grids, next(x.path for x in rows if x.band == raw[0]))
    about = spark.createDataFrame([(whole[x.path], x.scene_id, x.scene_ord, x.band) for x in rows], "path string, scene_id string, scene_ord int, band string")
    out = to_grid(spark, about, {whole[p]: g for p, g in grids.items()}, target, imagery.resampling, ("scene_id", "scene_ord", "band"))
    if masks := imagery.masks:
        seen = {x.scene_id: grids[x.path].srid for x in rows}
        found = mosaic.find_masks(mosaic.scene_files(files, auxiliary=True), masks.pattern, masks.needed).filter("mask_path IS NOT NULL")
        where = {m.mask_path: m.scene_id for m in found.collect() if m.scene_id in seen}  # at most one per scene
        if where:
            own = {whole[p]: replace(heads[whole[p]], srid=heads[whole[p]].srid or seen[s]) for p, s in where.items()}
            about = spark.createDataFrame([(whole[p], s) for p, s in where.items()], "path string, scene_id string")
            read = to_grid(spark, about, own, target, masks.resampling, ("scene_id",))
            out = mosaic.apply_masks(out, read.select("scene_id", "prow", "pcol", F.col("value").cast("int").alias("mask")), masks.mode, masks.hidden)
    pixels = mosaic.stack(out.withColumn("value", F.col("value").cast("float")), raw)
    if area is not None:
        pixels = vector.inside_area(pixels, area.select("feature_id", "rings"), target)
    pixels = add_indices(mask_common(pixels, raw), "float")
    return Stack(pixels, target, [c for c in pixels.columns if c not in ("prow", "pcol")])


def training_samples(spark: SparkSession, stack: Stack, layer: DataFrame, wanted: Samples) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples with sample_id and label, classes, one-row report) from a vector layer."""
    flat = layer.withColumns({k: F.col("attributes").getItem(k) for k in (wanted.label, *wanted.names)})
    vector.check_layer(flat, wanted.label)
    have = [c for c in wanted.names if not flat.filter(F.col(c).isNotNull()).isEmpty()]
    coded = vector.coerce_labels(flat, wanted.label)
    classes = vector.class_names(coded, have)
    points = vector.explode_multipoints(coded.filter(F.col("geom_type").isin("Point", "MultiPoint")).select("feature_id", "points"))
    polygons = coded.filter(F.col("geom_type").isin("Polygon", "MultiPolygon")).select("feature_id", "rings")
    taken = vector.extract_training(points, polygons, stack.pixels, stack.grid, stack.names, wanted.per_polygon, wanted.seed)
    report = vector.extraction_report(layer.select("feature_id", "geom_type", "is_empty"), taken)
    if taken.isEmpty():
        raise vector.LabelError("no feature of the training layer lies on a valid pixel")
    named = taken.join(coded.select("feature_id", F.col("code").alias("label")), "feature_id")
    order = F.xxhash64("feature_id", "x", "y")
    return named.withColumn("sample_id", order), classes, report


def _kept(df: DataFrame, uri: str) -> DataFrame:
    """df after it was written as tiles."""
    geotiff.write_tiles(df, uri)
    return df.sparkSession.read.parquet(uri).drop("tile_row", "tile_col")


def write_rasters(pixels: DataFrame, stack: Stack, labels: list[int], smooth: DataFrame | None, products: Products) -> None:
    """One GeoTIFF per product: stack, classes, confidence and its complement, entropy, class scores, filtered classes."""
    at = lambda name: products.at(f"rasters/{name}.tif")
    whole = {"dtype": "i4", "nodata": products.class_nodata}
    geotiff.write_raster(stack.pixels, products.at("prepared/feature_stack.tif"), stack.grid, stack.names)
    geotiff.write_raster(pixels, at("landcover_raw"), stack.grid, ["class"], **whole)
    for name, column in (("model_confidence", "confidence"), ("uncertainty_proxy_1_minus_confidence", "uncertainty"), ("entropy_uncertainty_proxy", "entropy")):
        geotiff.write_raster(pixels, at(name), stack.grid, [column])
    if products.class_scores:
        each = {f"class_{k}_score": F.get("probabilities", F.lit(i)) for i, k in enumerate(labels)}
        geotiff.write_raster(pixels.select("prow", "pcol", *[c.alias(n) for n, c in each.items()]), at("class_probability_scores"), stack.grid, list(each))
    if smooth is not None:
        geotiff.write_raster(smooth, at("landcover_filtered"), stack.grid, ["class"], **whole)


def run(spark: SparkSession, plan: Run) -> dict:
    """The nine steps. Returns the metadata, which is also written below the products' folder."""
    began, to, blocks = time.time(), plan.products, plan.blocks
    source = _needed(spark, plan.samples.uri)
    stack = prepare_stack(spark, plan.imagery)
    stack.pixels = _kept(stack.pixels, to.at("prepared/feature_stack.parquet"))
    layer = vectors.reproject_layer(vectors.read_layer(spark, source), plan.samples.srid or vectors.layer_srid(spark, source), stack.grid.srid)
    samples, classes, report = training_samples(spark, stack, layer, plan.samples)
    split = spatial.split_holdout(spatial.add_blocks(samples, blocks.metres), blocks.held_out, blocks.seed, blocks.gap)
    split.write.mode("overwrite").parquet(to.at("prepared/samples.parquet"))
    split = spark.read.parquet(to.at("prepared/samples.parquet"))
    spatial.check_split(split)
    development, test = split.filter("split = 'development'"), split.filter("split = 'test'")
    spatial.check_development_support(classes, development)
    folded = spatial.add_folds(development, blocks.folds, blocks.seed, blocks.least_per_class).persist()
    chosen = model.select_model(folded, stack.names, plan.search)
    folded.unpersist()
    names = {r.label: r.class_name for r in classes.collect()}
    labels = sorted(names)
    raw_scores = model.predicted(chosen.model, test).select("label", "prediction")
    pixels = _kept(model.classify_pixels(chosen.model, stack.pixels, stack.names), to.at("rasters/predictions.parquet"))
    if to.class_scores:
        geotiff.write_tiles(model.probability_bands(pixels.filter("probabilities IS NOT NULL"), chosen.model.labels), to.at("rasters/class_probability_scores.parquet"))
    results = {"raw": metrics.overall(raw_scores, labels).first().asDict()}
    sinks.save_per_class(metrics.named(metrics.per_class(raw_scores, labels), classes), to.at("metrics/per_class_raw.csv"))
    sinks.save_confusion_figure(metrics.normalized(metrics.confusion(raw_scores, labels)), to.at("figures/confusion_raw.png"))
    smooth = None
    if to.window:
        smooth = _kept(focal.majority_filter(pixels, stack.grid, to.window, "class"), to.at("rasters/filtered.parquet"))
        found = focal.lookup(test, smooth, stack.grid, "class")
        scored = found.filter("found IS NOT NULL").select("label", F.col("found").alias("prediction"))
        results["filtered"] = metrics.overall(scored, labels).first().asDict()
        results["holdout_on_nodata"] = found.filter("found IS NULL").count()
    if to.geotiff:
        write_rasters(pixels, stack, chosen.model.labels, smooth, to)
    results["missing_in_holdout"] = sorted(r.label for r in spatial.missing_classes(classes, test).collect())
    sinks.legend_json(spark, names, to.at("rasters/legend.json"))
    sinks.palette_qml(spark, names, to.at("rasters/classes.qml"))
    chosen.model.save(to.at("models/selected"))
    meta = {"model": chosen.name, "experiment": chosen.experiment, "parameters": chosen.parameters, "features": chosen.features, "extraction": report.first().asDict(), "cross_validation": chosen.results, "holdout": results, "environment": sinks.environment(), "runtime_seconds": time.time() - began}
    sinks.save_json(spark, meta, to.at("metrics/run.json"))
    return meta
