"""Scenes: catalog, candidate choice, masks, mosaic, stacking and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldgrid.functions import paths
from fieldgrid.functions.bands import clean_value, is_cloud
from fieldgrid.functions.projection import widest, with_projected
from fieldgrid.plans.grid import Grid


class SceneError(ValueError):
    """The imagery doesn't hold what the configuration asks for."""


def scene_files(files: DataFrame, auxiliary: bool = False) -> DataFrame:
    """files(path relative to the imagery root) -> scene_id, path. A SAFE granule at any depth is a scene, and only files
    under its IMG_DATA count; other files belong to their first folder ("." at the root). Auxiliary folders are skipped,
    unless masks are looked for in them."""
    granule = F.regexp_extract("path", r"^((?:.*/)?[^/]+\.SAFE/GRANULE/[^/]+)/" + ("" if auxiliary else "IMG_DATA/"), 1)
    in_safe = F.col("path").rlike(r"(?:^|/)[^/]+\.SAFE/")
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(F.lit("."))
    supported = F.lower("path").rlike(r"\.(?:tif|tiff|jp2)$")
    scene = F.when(in_safe, F.nullif(granule, F.lit(""))).otherwise(F.when(F.lit(auxiliary) | ~paths.is_auxiliary(F.col("path")), top))
    return files.filter(supported).select(scene.alias("scene_id"), "path").filter(F.col("scene_id").isNotNull())


def products_without_images(files: DataFrame) -> DataFrame:
    """product: the SAFE folders among files(path) that have no file below GRANULE/*/IMG_DATA."""
    product = F.regexp_extract("path", r"^((?:.*/)?[^/]+\.SAFE)/", 1).alias("product")
    parts = files.select(product, F.col("path").rlike(r"\.SAFE/GRANULE/[^/]+/IMG_DATA/").alias("image")).filter("product <> ''")
    return parts.groupBy("product").agg(F.max("image").alias("image")).filter("NOT image").select("product")


def band_candidates(files: DataFrame, bands: list[str]) -> DataFrame:
    """scene_id, band, path for each band token in a file's name."""
    name = F.substring_index("path", "/", -1)
    hits = F.filter(F.array(*[F.when(paths.has_band(name, b), F.lit(b)) for b in bands]), lambda b: b.isNotNull())
    return files.select("scene_id", "path", F.explode(hits).alias("band"))


def pick_candidates(candidates: DataFrame, target: float | None = None) -> DataFrame:
    """The file per scene and band: a lone candidate wins; else the nearest to the band's native resolution, then to the
    target, then by lower-cased path. ``ambiguous`` marks a choice among files none of which tells its resolution."""
    native = F.coalesce(*[F.when(F.col("band") == b, F.lit(r)) for b, r in paths.NATIVE.items()], F.lit(None).cast("double"))
    inf = F.lit(float("inf"))
    per = Window.partitionBy("scene_id", "band")
    ranked = (
        candidates.withColumn("resolution", paths.resolution(F.col("path")))
        .withColumn("off_native", F.coalesce(F.abs(F.col("resolution") - native), inf))
        .withColumn("off_target", F.coalesce(F.abs(F.col("resolution") - F.lit(target).cast("double")), inf))
        .withColumn("n", F.count("*").over(per))
        .withColumn("rank", F.row_number().over(per.orderBy("off_native", "off_target", F.lower("path"))))
    )
    blind = (F.col("n") > 1) & (F.col("off_native") == inf) & (F.col("off_target") == inf)
    return ranked.filter("rank = 1").select("scene_id", "band", "path", "resolution", blind.alias("ambiguous"))


def complete_scenes(catalog: DataFrame, required: list[str]) -> DataFrame:
    """scene_id, scene_ord (by id, from 0) of the scenes that have every required band."""
    need = F.array(*[F.lit(b) for b in required])
    full = catalog.groupBy("scene_id").agg(F.collect_set("band").alias("bands")).filter(F.size(F.array_except(need, "bands")) == 0)
    # one row per scene: a catalog, not pixels
    return full.select("scene_id", (F.row_number().over(Window.orderBy("scene_id")) - 1).alias("scene_ord"))


def complete_bands(catalog: DataFrame, scenes: DataFrame, optional: list[str]) -> DataFrame:
    """The optional bands that every retained scene has."""
    kept = catalog.join(scenes.select("scene_id"), "scene_id", "left_semi").filter(F.col("band").isin(*optional))
    n = scenes.agg(F.count("*").alias("n"))
    return kept.groupBy("band").agg(F.countDistinct("scene_id").alias("have")).crossJoin(F.broadcast(n)).filter("have = n").select("band")


def discover(files: DataFrame, required: list[str], optional: list[str], target: float | None = None) -> DataFrame:
    """scene_id, scene_ord, band, path of the complete scenes; raises where a product has no images, a choice is ambiguous
    or nothing is complete."""
    if empty := products_without_images(files).take(3):
        raise SceneError(f"no GRANULE/*/IMG_DATA in {[r.product for r in empty]}")
    catalog = pick_candidates(band_candidates(scene_files(files), [*required, *optional]), target)
    if bad := catalog.filter("ambiguous").select("scene_id", "band").take(3):
        raise SceneError(f"several files without a resolution for {bad}")
    scenes = complete_scenes(catalog, required)
    extra = complete_bands(catalog, scenes, optional)
    wanted = catalog.filter(F.col("band").isin(*required)).unionByName(catalog.join(F.broadcast(extra), "band", "left_semi").select(catalog.columns))
    found = wanted.join(scenes, "scene_id").select("scene_id", "scene_ord", "band", "path")
    if found.isEmpty():
        raise SceneError("no scene has all required bands")
    return found


def find_masks(files: DataFrame, pattern: str | None, required: bool = False) -> DataFrame:
    """files(scene_id, path) -> scene_id, mask_path; at most one per scene."""
    if not pattern:
        raise SceneError("cloud masks need a file pattern")
    name = F.substring_index("path", "/", -1)
    found = files.groupBy("scene_id").agg(F.count_if(name.rlike(pattern)).alias("n"), F.min(F.when(name.rlike(pattern), F.col("path"))).alias("mask_path"))
    wrong = found.filter("n > 1" + (" OR n = 0" if required else "")).take(1)
    if wrong:
        raise SceneError(f"scene {wrong[0].scene_id} has {wrong[0].n} cloud masks")
    return found.select("scene_id", "mask_path")


def union_bounds(extents: DataFrame) -> DataFrame:
    """One row that covers all extents(xmin, ymin, xmax, ymax)."""
    return extents.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def clip_extents(extents: DataFrame, area: DataFrame) -> DataFrame:
    """Each extent's overlap with the one-row area; ``overlaps`` is false where there is none."""
    a = area.select(*[F.col(c).alias(f"a_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    j = extents.crossJoin(F.broadcast(a))  # one row
    cut = {c: F.greatest(c, f"a_{c}") for c in ("xmin", "ymin")} | {c: F.least(c, f"a_{c}") for c in ("xmax", "ymax")}
    j = j.select(*[c for c in extents.columns if c not in cut], *[e.alias(c) for c, e in cut.items()])
    return j.withColumn("overlaps", (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax")))


def apply_masks(pixels: DataFrame, masks: DataFrame | None, mode: str = "nonzero", values: tuple[int, ...] = (), nodata: float | None = None) -> DataFrame:
    """pixels(scene_id, prow, pcol, value, ...) with NoData and cloud pixels NULL; outside its mask a scene is clear."""
    if masks is None:
        return pixels.withColumn("value", clean_value(F.col("value"), nodata))
    joined = pixels.join(masks.select("scene_id", "prow", "pcol", F.col("mask").alias("_mask")), ["scene_id", "prow", "pcol"], "left")
    clear = ~is_cloud(F.coalesce("_mask", F.lit(0)), mode, values)
    return joined.withColumn("value", F.when(clear, clean_value(F.col("value"), nodata))).drop("_mask")


def mosaic(pixels: DataFrame) -> DataFrame:
    """band?, prow, pcol, value: the valid value of the first scene. Masks come before: a hidden pixel gives way."""
    keys = [c for c in ("band", "prow", "pcol") if c in pixels.columns]
    return pixels.filter(F.col("value").isNotNull()).groupBy(*keys).agg(F.min_by("value", "scene_ord").alias("value"))


def stack(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """prow, pcol and one column per band: mosaic and pivot in one aggregate, hence one shuffle."""
    first = [F.min_by(F.when(F.col("band") == b, F.col("value")), F.when((F.col("band") == b) & F.col("value").isNotNull(), F.col("scene_ord"))).alias(b) for b in bands]
    return pixels.filter(F.col("value").isNotNull()).groupBy("prow", "pcol").agg(*first)


def _targets(source: Grid, target: Grid, pixels: DataFrame, reach: float) -> DataFrame:
    """Each source pixel with the target pixels (trow, tcol) whose centres may lie within ``reach`` source pixels of its
    centre, and where those centres are on the source grid (down, right: source pixels from its corner).

    Sources scatter to targets: the number of copies is fixed by the two resolutions, and no join is needed. Between
    systems a pixel is turned and stretched, so its candidates come from a box around its projected centre."""
    same = source.srid == target.srid or source.srid is None
    moved, half = pixels.withColumn("_x", source.center_x(F.col("pcol"))).withColumn("_y", source.center_y(F.col("prow"))), reach * source.res
    if not same:
        moved, half = with_projected(moved, "_x", "_y", source.srid, target.srid), half * widest(source.srid, target.srid)

    def axis(centre: Column, n: int) -> Column:
        low = F.greatest(F.ceil((centre - half) / target.res - 0.5), F.lit(0))
        high = F.least(F.floor((centre + half) / target.res - 0.5), F.lit(n - 1))
        return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))

    placed = moved.withColumn("trow", F.explode(axis(target.y0 - F.col("_y"), target.height)))
    placed = placed.withColumn("tcol", F.explode(axis(F.col("_x") - target.x0, target.width)))
    placed = placed.withColumn("_x", target.center_x(F.col("tcol"))).withColumn("_y", target.center_y(F.col("trow")))
    if not same:
        placed = with_projected(placed, "_x", "_y", target.srid, source.srid)
    return placed.withColumn("down", (source.y0 - F.col("_y")) / source.res).withColumn("right", (F.col("_x") - source.x0) / source.res)


def _carried(source: Grid) -> list[Column]:
    """Columns that describe the source grid, where it differs from row to row."""
    return [c for c in (source.x0, source.y0, source.res) if isinstance(c, Column)]


def resample_nearest(pixels: DataFrame, source: Grid, target: Grid, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, prow and pcol of the target, and the value of the source pixel that holds its centre.

    The source's corner and resolution may be columns of ``pixels``: files on many grids are one plan then."""
    hits = _targets(source, target, pixels.select(*keys, "prow", "pcol", F.col(value).alias("v"), *_carried(source)), 0.5)
    same = (F.floor("down") == F.col("prow")) & (F.floor("right") == F.col("pcol"))
    return hits.filter(same).select(*keys, F.col("trow").alias("prow"), F.col("tcol").alias("pcol"), F.col("v").alias(value))


def resample_bilinear(pixels: DataFrame, source: Grid, target: Grid, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The mean of the up to four valid source pixels around a target centre, weighted by closeness per axis."""
    near = lambda at, s: F.greatest(F.lit(1.0) - F.abs(F.col(at) - 0.5 - F.col(s)), F.lit(0.0))
    hits = _targets(source, target, pixels.select(*keys, "prow", "pcol", F.col(value).alias("v"), *_carried(source)).filter("v IS NOT NULL"), 1.0)
    weighed = hits.withColumn("w", near("down", "prow") * near("right", "pcol")).filter("w > 1e-12")
    summed = weighed.groupBy(*keys, "trow", "tcol").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("w"))
    return summed.select(*keys, F.col("trow").alias("prow"), F.col("tcol").alias("pcol"), (F.col("wv") / F.col("w")).alias(value))


RESAMPLING = {"nearest": resample_nearest, "bilinear": resample_bilinear}


def resampling(name: str):
    if name not in RESAMPLING:
        raise ValueError(f"unknown resampling {name!r}; known: {sorted(RESAMPLING)}")
    return RESAMPLING[name]

