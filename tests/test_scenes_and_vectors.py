import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrid import queries
from fieldgrid.functions.projection import ProjectionError, from_utm, to_utm, widest, with_projected
from fieldgrid.operators import mosaic, vector
from fieldgrid.plans.grid import Grid
from fieldgrid.sources import geotiff, safe, vectors


def test_scene_discovery(spark):
    base = "S2A_TEST.SAFE/GRANULE/L2A_TEST"
    names = [f"{base}/IMG_DATA/R{r}m/T_{b}_{r}m.jp2" for r in (10, 20, 60) for b in ("B02", "B03") if not (r == 60 and b == "B03")]
    names += [f"{base}/IMG_DATA/R20m/T_B11_20m.jp2", f"{base}/IMG_DATA/R60m/T_B11_60m.jp2", f"{base}/QI_DATA/MSK_DETFOO_B02.jp2", "other/B02_10m.tif", f"nested/{base}/IMG_DATA/R10m/T_B02_10m.jp2"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    got = mosaic.discover(files, ["B02", "B03", "B11"], [], 10.0).collect()
    assert {r.scene_id for r in got} == {base}
    assert {r.band: r.path.rpartition("/")[2] for r in got} == {"B02": "T_B02_10m.jp2", "B03": "T_B03_10m.jp2", "B11": "T_B11_20m.jp2"}
    with pytest.raises(mosaic.SceneError):
        mosaic.discover(files, ["B02", "B12"], [])


def test_products_without_images_raise(spark):
    files = spark.createDataFrame([("x/A.SAFE/MTD_TL.xml",), ("x/A.SAFE/GRANULE/G/QI_DATA/M_B02.jp2",), ("B.SAFE/GRANULE/G/IMG_DATA/T_B02_10m.jp2",), ("s/a_B02_10m.tif",)], "path string")
    assert [r.product for r in mosaic.products_without_images(files).collect()] == ["x/A.SAFE"]
    with pytest.raises(mosaic.SceneError, match="IMG_DATA"):
        mosaic.discover(files, ["B02"], [])


def test_ambiguous_files_raise(spark):
    files = spark.createDataFrame([("s/a_B02.tif",), ("s/b_B02.tif",)], "path string")
    with pytest.raises(mosaic.SceneError):
        mosaic.discover(files, ["B02"], [])


def test_masks_come_before_the_mosaic(spark):
    px = spark.createDataFrame([("A", 0, 0, 0, 1.0), ("A", 0, 0, 1, 2.0), ("B", 1, 0, 0, 10.0), ("B", 1, 0, 1, 20.0), ("B", 1, 0, 2, -1.0)], "scene_id string, scene_ord int, prow int, pcol int, value double")
    masks = spark.createDataFrame([("A", 0, 0, 5)], "scene_id string, prow int, pcol int, mask int")
    got = mosaic.mosaic(mosaic.apply_masks(px, masks, nodata=-1.0)).collect()
    assert {(r.prow, r.pcol): r.value for r in got} == {(0, 0): 10.0, (0, 1): 2.0}


def test_stack_keeps_the_first_valid_value_per_band(spark):
    rows = [("B1", 0, 0, 0, None), ("B1", 1, 0, 0, 5.0), ("B2", 0, 0, 0, 7.0), ("B2", 1, 0, 0, 8.0)]
    got = mosaic.stack(spark.createDataFrame(rows, "band string, scene_ord int, prow int, pcol int, value double"), ["B1", "B2"]).first()
    assert (got.B1, got.B2) == (5.0, 7.0)


def test_resampling_between_shifted_grids(spark):
    source, target = Grid(100.0, 200.0, 20.0, 3, 3), Grid(95.0, 210.0, 10.0, 8, 8)
    v = np.arange(9, dtype=float).reshape(3, 3)
    px = spark.createDataFrame([("k", r, c, float(v[r, c])) for r in range(3) for c in range(3) if (r, c) != (1, 1)], "k string, prow int, pcol int, v double")
    near = {(r.prow, r.pcol): r.v for r in mosaic.resample_nearest(px, source, target, "v", ("k",)).collect()}
    soft = {(r.prow, r.pcol): r.v for r in mosaic.resample_bilinear(px, source, target, "v", ("k",)).collect()}
    for r in range(8):
        for c in range(8):
            y, x = (200 - (210 - (r * 10 + 5))) / 20, (95 + c * 10 + 5 - 100) / 20
            cell = (int(np.floor(y)), int(np.floor(x)))
            inside = 0 <= cell[0] < 3 and 0 <= cell[1] < 3 and cell != (1, 1)
            assert near.get((r, c)) == (v[cell] if inside else None)
            parts = [(max(0, 1 - abs(y - 0.5 - i)) * max(0, 1 - abs(x - 0.5 - j)), v[i, j]) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
            w = sum(p[0] for p in parts)
            assert soft.get((r, c)) == (pytest.approx(sum(a * b for a, b in parts) / w) if w > 1e-12 else None)


def _project(spark, points, source, target):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    return [(r.x, r.y) for r in with_projected(df, "x", "y", source, target).orderBy("i").collect()]


@pytest.mark.parametrize(("srid", "corner", "res"), [(32736, (105_000.0, 7_200_100.0), 25.0), (32634, (1_500_000.0, -2_800_000.0), 25.0), (4326, (29.95, -25.1), 0.0003)])
def test_resampling_between_systems_equals_a_lookup_of_every_target(spark, srid, corner, res):
    """Neighbouring zones, a zone of the other hemisphere two zones away, and degrees."""
    n, source = 12, Grid(*corner, res, 12, 12, srid)
    middle = (corner[0] + n / 2 * res, corner[1] - n / 2 * res)
    x, y = _project(spark, [middle], srid, 32735)[0]
    target = Grid(x // 10 * 10 - 150, y // 10 * 10 + 150, 10.0, 30, 30, 32735)
    v = np.random.default_rng(3).integers(0, 99, (n, n)).astype(float)
    px = spark.createDataFrame([("a", r, c, float(v[r, c]), *corner, res) for r in range(n) for c in range(n)], "k string, prow int, pcol int, v double, _x0 double, _y0 double, _res double")
    rows = Grid(F.col("_x0"), F.col("_y0"), F.col("_res"), 0, 0, srid)  # the same grid as columns
    near = {(r.prow, r.pcol): r.v for r in mosaic.resample_nearest(px, source, target, "v", ("k",)).collect()}
    soft = {(r.prow, r.pcol): r.v for r in mosaic.resample_bilinear(px, rows, target, "v", ("k",)).collect()}
    cells = [(r, c) for r in range(30) for c in range(30)]
    at = _project(spark, [(target.x0 + (c + 0.5) * 10, target.y0 - (r + 0.5) * 10) for r, c in cells], 32735, srid)
    want_near, want_soft = {}, {}
    for cell, (x, y) in zip(cells, at, strict=True):
        down, right = (source.y0 - y) / res, (x - source.x0) / res
        if 0 <= down < n and 0 <= right < n:
            want_near[cell] = v[int(down), int(right)]
        parts = [(max(0, 1 - abs(down - 0.5 - i)) * max(0, 1 - abs(right - 0.5 - j)), v[i, j]) for i in range(n) for j in range(n)]
        if (w := sum(p[0] for p in parts)) > 1e-12:
            want_soft[cell] = sum(a * b for a, b in parts) / w
    assert len(want_near) > 300 and near == want_near
    assert soft == pytest.approx(want_soft)


def test_systems_that_rasters_cannot_be_moved_between():
    for pair in ((32735, 32740), (32735, 4326), (32735, 27700)):
        with pytest.raises(ProjectionError):
            widest(*pair)
    assert widest(32701, 32760) == 1.5  # neighbours across the date line


def _ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


POLYGONS = "feature_id long, rings array<array<struct<x:double,y:double>>>"


def test_polygon_with_hole_and_parts(spark):
    g = Grid(0.0, 100.0, 10.0, 10, 10)
    outer, hole, part = _ring((0, 0), (60, 0), (60, 60), (0, 60)), _ring((20, 20), (40, 20), (40, 40), (20, 40)), _ring((80, 80), (100, 80), (100, 100), (80, 100))
    got = {(r.prow, r.pcol) for r in vector.rasterize(spark.createDataFrame([(1, [outer, hole, part])], POLYGONS), g).collect()}
    want = set()
    for r in range(10):
        for c in range(10):
            x, y = c * 10 + 5, 100 - (r * 10 + 5)
            inside = lambda p: p[0]["x"] < x < p[1]["x"] and p[0]["y"] < y < p[2]["y"]
            if (inside(outer) and not inside(hole)) or inside(part):
                want.add((r, c))
    assert got == want


def test_rasterize_equals_ray_casting(spark):
    rng = np.random.default_rng(5)
    g = Grid(0.0, 200.0, 10.0, 20, 20)
    rings = [[rng.uniform(-20, 220, 2) for _ in range(int(rng.integers(3, 9)))] for _ in range(12)]
    got = {tuple(r) for r in vector.rasterize(spark.createDataFrame([(i, [_ring(*p)]) for i, p in enumerate(rings)], POLYGONS), g).collect()}
    want = set()
    for i, p in enumerate(rings):
        for r in range(20):
            for c in range(20):
                x, y, odd = c * 10 + 5, 200 - (r * 10 + 5), False
                for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True):
                    if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                        odd = not odd
                if odd:
                    want.add((i, r, c))
    assert got == want


def test_points_outside_or_invalid_are_dropped(spark):
    g = Grid(0.0, 20.0, 10.0, 2, 2)
    px = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)], "prow int, pcol int, B1 double")
    pts = spark.createDataFrame([(1, [(5.0, 15.0), (15.0, 15.0), (50.0, 5.0)]), (2, [(15.0, 5.0)])], "feature_id long, points array<struct<x:double,y:double>>")
    got = vector.sample_points(vector.explode_multipoints(pts), px, g, ["B1"]).collect()
    assert sorted((r.feature_id, r.x, r.y, r.B1) for r in got) == [(1, 5.0, 15.0, 1.0), (2, 15.0, 5.0, 4.0)]


@pytest.mark.parametrize(("labels", "codes"), [(["3", "1", "2.0"], [3, 1, 2]), (["3", "1.5", "2"], [3, 1, 2]), (["b", "a", "b"], [2, 1, 2]), (["1000.001", "7", "7"], [1000, 7, 7])])
def test_label_coercion(spark, labels, codes):
    df = spark.createDataFrame(list(enumerate(labels)), "feature_id long, label string")
    assert [r.code for r in vector.coerce_labels(df).orderBy("feature_id").collect()] == codes


def test_layer_guards(spark):
    with pytest.raises(vector.LabelError):
        vector.check_layer(spark.createDataFrame([(1,)], "feature_id long"), "label")
    with pytest.raises(vector.LabelError):
        vector.check_layer(spark.createDataFrame([(1, None)], "feature_id long, label string"), "label")
    with pytest.raises(vector.LabelError):
        vector.check_layer(spark.createDataFrame([], "feature_id long, label string"), "label")


def test_class_names_come_from_the_first_feature(spark):
    df = spark.createDataFrame([(2, 1, "later"), (1, 1, "first"), (3, 5, None)], "feature_id long, code int, Name string")
    assert {r.label: r.class_name for r in vector.class_names(df, ["Classe", "Name"]).collect()} == {1: "first", 5: "5"}


@pytest.mark.parametrize("dtype", ["f4", "i4", "u1", "u2"])
def test_geotiff_round_trip(dtype):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 200, (300, 270, 2)).astype(dtype)
    raw = geotiff.write(values, Grid(500000.0, 8000000.0, 10.0, 270, 300, 32735, 0.0), ["B02", "a<b"])
    h = geotiff.read_header(raw)
    assert (h.grid.x0, h.grid.y0, h.grid.res, h.grid.srid, h.nodata) == (500000.0, 8000000.0, 10.0, 32735, 0.0)
    assert h.band_names == ["B02", "a<b"]
    back = np.zeros_like(values)
    for r, c, block in geotiff.read_blocks(raw):
        back[r : r + block.shape[0], c : c + block.shape[1]] = block
    assert (back == values).all()


def test_geotiff_through_spark(spark, tmp_path):
    values = np.arange(12, dtype="f4").reshape(3, 4, 1)
    values[1, 1] = np.nan
    (tmp_path / "a.tif").write_bytes(geotiff.write(values, Grid(0.0, 30.0, 10.0, 4, 3, 32735)))
    got = geotiff.read_pixels(spark, str(tmp_path)).collect()
    assert len(got) == 12 and [r.value for r in got if (r.prow, r.pcol) == (1, 1)] == [None]
    assert {(r.prow, r.pcol): r.value for r in got}[(2, 3)] == 11.0
    grids = geotiff.read_grids(spark, str(tmp_path))
    assert [g.width for g, _ in grids.values()] == [4]


def test_windows_and_lists_of_files(spark, tmp_path):
    values = np.arange(600 * 500, dtype="f4").reshape(600, 500)
    for name in ("a [1].tif", "b.tif", "c.tif"):
        (tmp_path / name).write_bytes(geotiff.write(values, Grid(0.0, 30.0, 10.0, 500, 600, 32735), tile=128))
    paths = {p.rpartition("/")[2]: p for p in geotiff.read_grids(spark, str(tmp_path))}
    window = (100, 250, 130, 262)
    got = geotiff.read_pixels(spark, [paths["a [1].tif"], paths["b.tif"]], {paths["a [1].tif"]: window})
    want = {(r, c): float(values[r, c]) for r in range(100, 130) for c in range(250, 262)}
    assert {(r.prow, r.pcol): r.value for r in got.filter("path LIKE '%a [1]%'").collect()} == want
    assert {r.path: r["count"] for r in got.groupBy("path").count().collect()} == {paths["a [1].tif"]: 360, paths["b.tif"]: 300_000}
    # blocks outside the window aren't even handed on
    assert [(b.row, b.col) for b in geotiff.stored_blocks((tmp_path / "b.tif").read_bytes(), window)] == [(0, 128), (0, 256), (128, 128), (128, 256)]
    assert geotiff.read_pixels(spark, [paths["b.tif"]], {paths["b.tif"]: (700, 0, 600, 500)}).isEmpty()


def test_geojson_and_bounds(spark, tmp_path):
    p = tmp_path / "a.geojson"
    p.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"label":1},"geometry":{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}},{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[5,0],[5,5],[0,0]]]}},{"type":"Feature","properties":null,"geometry":null}]}')
    layer = vectors.read_layer(spark, str(p))
    assert [(r.geom_type, r.is_empty) for r in layer.orderBy("feature_id").collect()] == [("MultiPoint", False), ("Polygon", False), (None, True)]
    assert vectors.bounds(layer) == (0.0, 0.0, 5.0, 5.0)


def test_shapefile(spark, tmp_path):
    import struct

    def record(i, body):
        return struct.pack(">2I", i, len(body) // 2) + body

    point = struct.pack("<I2d", 1, 7.0, 8.0)
    ring = [(0, 0), (0, 4), (4, 4), (0, 0)]
    polygon = struct.pack("<I4d2I", 5, 0, 0, 4, 4, 1, 4) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "a.shp").write_bytes(struct.pack(">I", 9994) + b"\0" * 96 + record(1, point) + record(2, polygon))
    field = b"label".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", 2, 65, 5) + b"\0" * 20 + field + b"\r" + b" 12  " + b" ab  ")
    got = vectors.read_layer(spark, str(tmp_path / "a.shp")).orderBy("feature_id").collect()
    assert [(r.geom_type, r.attributes["label"]) for r in got] == [("Point", "12"), ("Polygon", "ab")]
    assert len(got[1].rings[0]) == 4


def test_product_metadata(spark, tmp_path):
    xml = b'<n1:T xmlns:n1="urn:x"><n1:G><HORIZONTAL_CS_CODE>EPSG:32735</HORIZONTAL_CS_CODE></n1:G></n1:T>'
    assert safe.srid_from_xml(xml) == 32735
    (tmp_path / "MTD_TL.xml").write_bytes(xml)
    (tmp_path / "IMG").mkdir()
    assert safe.find_srid(spark, None, str(tmp_path), "IMG/a.tif") == 32735 and safe.find_srid(spark, 32601, "x", "x") == 32601
    with pytest.raises(safe.CrsNotFound):
        safe.find_srid(spark, None, str(tmp_path / "IMG"), "a.tif")
    with pytest.raises(safe.CrsNotFound):
        safe.srid_from_xml("<a")


def test_utm_round_trip_and_known_point(spark):
    df = spark.createDataFrame([(27.0, 0.0), (28.3, -25.7), (24.5, -33.9)], "lon double, lat double")
    x, y = to_utm(F.col("lon"), F.col("lat"), 32735)
    df = df.withColumn("x", x).withColumn("y", y)
    lon, lat = from_utm(F.col("x"), F.col("y"), 32735)
    rows = df.select("lon", "lat", "x", "y", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 for r in rows)
    assert rows[0].x == pytest.approx(500000.0, abs=1e-6) and rows[0].y == pytest.approx(10000000.0, abs=1e-3)


def _tiff(values, compression, predictor, pack, big=False, order="<"):
    """A one-strip file of values (rows, columns) with the given compression."""
    raw = values.astype(values.dtype.newbyteorder(order))
    if predictor == 2:
        raw = np.diff(raw, axis=1, prepend=np.zeros((len(raw), 1), raw.dtype)).astype(raw.dtype)
    data = raw.tobytes()
    if predictor == 3:
        planes = np.ascontiguousarray(values.astype(">f4").view(np.uint8).reshape(*values.shape, 4).transpose(0, 2, 1)).reshape(len(values), -1)
        data = np.diff(planes, axis=1, prepend=np.zeros((len(planes), 1), np.uint8)).astype(np.uint8).tobytes()
    data = pack(data)
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    step, word, first = (8, "Q", 16) if big else (4, "I", 8)
    tags = [(256, values.shape[1]), (257, values.shape[0]), (258, values.dtype.itemsize * 8), (259, compression), (273, 0), (277, 1), (278, values.shape[0]), (279, len(data)), (317, predictor), (339, kind)]
    place = first + (8 if big else 2) + len(tags) * (4 + 2 * step) + step
    out = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8)) + struct.pack(order + ("Q" if big else "H"), len(tags))
    for tag, v in tags:
        out += struct.pack(order + "HH" + word + word, tag, 16 if big else 4, 1, place if tag == 273 else v)
    return out + struct.pack(order + word, 0) + data


def _lzw(data):
    """Every byte as a code of its own, with the table cleared before it would need wider codes."""
    codes, bits = [], ""
    for at in range(0, len(data), 200):
        codes += [256, *data[at : at + 200]]
    for c in [*codes, 257]:
        bits += f"{c:09b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def _packbits(data):
    out = b""
    for at in range(0, len(data), 100):
        part = data[at : at + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return out + bytes([128])


def test_points_at_and_beyond_a_pole_come_back(spark, tmp_path):
    spark.range(1_800_000).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    keys = spark.range(0, 15000, 500).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("A").alias("c_mktsegment"))
    keys.write.parquet(str(tmp_path / "customer.parquet"))
    out = queries.utm_coordinates(spark, str(tmp_path)).collect()
    assert len(out) == 30 and all(r.same for r in out)  # latitudes up to 210 degrees


def test_a_tie_is_rounded_by_the_binary_number(spark, tmp_path):
    spark.range(900_000).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(7598, 7599).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("A").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    assert queries.utm_coordinates(spark, str(tmp_path)).first().y == 17076659.8031  # 17076659.80315 lies below its decimal


def test_tiff_compressions_predictors_and_big_files():
    rng = np.random.default_rng(4)
    floats, ints = rng.normal(0, 100, (7, 9)).astype("f4"), rng.integers(0, 60000, (7, 9)).astype("u2")
    ints[3] = 7
    for order in "<>":
        for big in (False, True):
            for number, pack in ((1, bytes), (5, _lzw), (8, zlib.compress), (32773, _packbits)):
                for values, predictor in ((floats, 1), (ints, 1), (ints, 2), (floats, 3)):
                    (r, c, got), = geotiff.read_blocks(_tiff(values, number, predictor, pack, big, order))
                    assert (r, c) == (0, 0) and np.array_equal(got[:, :, 0], values), (order, big, number, predictor)
    assert geotiff.unpack_lzw(bytes.fromhex("8000c08080a8000000")[:0]) == b""
    head = geotiff.head(Grid(0.0, 100.0, 1.0, 256, 512, 32735), "f4", 1, ["a"], [5_000_000_000, 7], 256)
    h = geotiff.read_header(head)
    assert h.tags[geotiff.TILES] == (len(head), len(head) + 5_000_000_000) and h.grid.srid == 32735 and h.band_names == ["a"]


def test_lzw_with_a_growing_table():
    # a decoder's view of a run of one byte: each code is the entry that is just being made
    codes, bits, width, size = [256, 65] + list(range(258, 258 + 700)) + [257], "", 9, 258
    for k, c in enumerate(codes):
        bits += f"{c:0{width}b}"
        size = 258 if c == 256 else size + (k > 1)
        width = 9 if c == 256 else min(max((size + 1).bit_length(), 9), 12)
    bits += "0" * (-len(bits) % 8)
    assert geotiff.unpack_lzw(int(bits, 2).to_bytes(len(bits) // 8, "big")) == b"A" * (1 + sum(range(2, 702)))


def test_layer_systems(spark, tmp_path):
    assert vectors.srid_of_wkt('PROJCS["WGS_1984_UTM_Zone_35S",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]]') == 32735
    assert vectors.srid_of_wkt('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32601"]]') == 32601
    assert vectors.srid_of_wkt('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]') == 4326 and vectors.srid_of_wkt("LOCAL") is None
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "features": [], "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::32735"}}}')
    (tmp_path / "b.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    assert [vectors.layer_srid(spark, str(tmp_path / f"{k}.geojson")) for k in "ab"] == [32735, 4326]
    (tmp_path / "c.shp").write_bytes(b"")
    with pytest.raises(vectors.VectorError):
        vectors.layer_srid(spark, str(tmp_path / "c.shp"))


def test_layers_move_between_zones(spark):
    made = spark.createDataFrame([(1, [(790_000.0, 7_200_000.0)], [[(790_000.0, 7_200_000.0), (791_000.0, 7_200_500.0)]])], "feature_id long, points array<struct<x:double,y:double>>, rings array<array<struct<x:double,y:double>>>")
    moved = vectors.reproject_layer(made, 32735, 32736).first()
    want = _project(spark, [(790_000.0, 7_200_000.0), (791_000.0, 7_200_500.0)], 32735, 32736)
    assert [tuple(p) for p in moved.points] == [pytest.approx(want[0], abs=1e-6)]
    assert [tuple(p) for p in moved.rings[0]] == [pytest.approx(w, abs=1e-6) for w in want]
