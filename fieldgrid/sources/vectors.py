"""Vector layers: GeoJSON and shapefiles as DataFrames feature_id, geom_type, is_empty, points, rings, attributes."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgrid.functions.projection import reproject
from fieldgrid.sources import store

_P = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.schema([("feature_id", pa.int64()), ("geom_type", pa.string()), ("is_empty", pa.bool_()), ("points", pa.list_(_P)), ("rings", pa.list_(pa.list_(_P))), ("attributes", pa.map_(pa.string(), pa.string()))])
SCHEMA = "feature_id long, geom_type string, is_empty boolean, points array<struct<x:double,y:double>>, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>"


class VectorError(ValueError):
    """The file isn't a vector layer of a supported kind."""


def _xy(p) -> dict:
    return {"x": float(p[0]), "y": float(p[1])}


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v)


def geojson_features(raw: bytes) -> Iterator[dict]:
    data = json.loads(raw)
    for i, f in enumerate(data["features"] if data.get("type") == "FeatureCollection" else [data]):
        g = f.get("geometry") or {}
        kind, c = g.get("type"), g.get("coordinates") or []
        points = [_xy(c)] if kind == "Point" and c else [_xy(p) for p in c] if kind == "MultiPoint" else []
        parts = [c] if kind == "Polygon" else c if kind == "MultiPolygon" else []
        rings = [[_xy(p) for p in ring] for part in parts for ring in part]
        yield {"feature_id": i, "geom_type": kind, "is_empty": not c, "points": points, "rings": rings, "attributes": [(k, _text(v)) for k, v in (f.get("properties") or {}).items()]}


#: Shape type number -> name. Fixed values; Z and M variants share the XY part.
SHAPES = {0: None, 1: "Point", 8: "MultiPoint", 5: "Polygon", 3: "LineString", 11: "Point", 18: "MultiPoint", 15: "Polygon", 13: "LineString", 21: "Point", 28: "MultiPoint", 25: "Polygon", 23: "LineString"}


def shapefile_shapes(raw: bytes) -> Iterator[tuple[str | None, list, list]]:
    """(geometry type, points, rings) of each record of a .shp file."""
    if struct.unpack(">I", raw[:4])[0] != 9994:
        raise VectorError("no shapefile header")
    at = 100
    while at + 12 <= len(raw):
        size = struct.unpack(">I", raw[at + 4 : at + 8])[0] * 2
        body = raw[at + 8 : at + 8 + size]
        at += 8 + size
        kind = SHAPES.get(struct.unpack("<I", body[:4])[0], "Unknown")
        if kind == "Point":
            yield kind, [_xy(struct.unpack("<2d", body[4:20]))], []
        elif kind == "MultiPoint":
            n = struct.unpack("<I", body[36:40])[0]
            v = struct.unpack(f"<{2 * n}d", body[40 : 40 + 16 * n])
            yield kind, [_xy(v[2 * k : 2 * k + 2]) for k in range(n)], []
        elif kind == "Polygon":
            parts, n = struct.unpack("<2I", body[36:44])
            starts = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), n]
            v = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
            pts = [_xy(v[2 * k : 2 * k + 2]) for k in range(n)]
            yield kind, [], [pts[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            yield kind, [], []


def dbf_rows(raw: bytes, encoding: str = "utf-8") -> Iterator[list[tuple[str, str | None]]]:
    """Attributes of each record of a .dbf file, as text."""
    count, head, width = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(encoding), raw[at + 16]))
        at += 32
    for k in range(count):
        row, place = raw[head + k * width : head + (k + 1) * width], 1
        values = []
        for name, size in fields:
            values.append((name, row[place : place + size].decode(encoding, "replace").strip() or None))
            place += size
        yield values


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, raw, dbf in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if name.lower().endswith(".shp"):
                rows = dbf_rows(dbf) if dbf else iter(())
                features = [{"feature_id": i, "geom_type": kind, "is_empty": kind is None, "points": p, "rings": r, "attributes": next(rows, [])} for i, (kind, p, r) in enumerate(shapefile_shapes(raw))]
            else:
                features = list(geojson_features(raw))
            yield pa.RecordBatch.from_pylist(features, schema=ARROW)


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON file or a shapefile (with its .dbf beside it), through Spark's file sources."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if path.lower().endswith(".shp"):
        dbf = spark.read.format("binaryFile").load(path[:-4] + ".dbf").select(F.col("content").alias("dbf"))
        files = files.crossJoin(dbf)  # one row each
    else:
        files = files.withColumn("dbf", F.lit(None).cast("binary"))
    return files.mapInArrow(_decode, SCHEMA)


def srid_of_wkt(text: str) -> int | None:
    """The code that a system's text names: its own authority code, or a WGS 84 or UTM name."""
    codes = re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]', text)
    if codes:
        return int(codes[-1])
    zone = re.search(r"WGS[ _]?(?:19)?84[ _/]*UTM[ _]zone[ _](\d+)([NS])", text, re.IGNORECASE)
    if zone:
        return (32600 if zone[2].upper() == "N" else 32700) + int(zone[1])
    return 4326 if text.lstrip().startswith("GEOG") and "WGS_1984" in text else None


def layer_srid(spark: SparkSession, path: str) -> int:
    """The layer's own system: the .prj beside a shapefile; the crs member of GeoJSON, which has WGS 84 without one."""
    if path.lower().endswith(".shp"):
        beside = path[:-4] + ".prj"
        found = srid_of_wkt(store.read(spark, beside).decode("utf-8", "replace")) if store.exists(spark, beside) else None
        if found is None:
            raise VectorError(f"{path} doesn't tell its reference system")
        return found
    data = json.loads(store.read(spark, path))
    named = str(((data.get("crs") or {}).get("properties") or {}).get("name", "OGC:1.3:CRS84"))
    code = re.search(r"EPSG:+(?:[\d.]+:)?(\d+)$", named)
    if not code and "CRS84" not in named:
        raise VectorError(f"{path} names an unknown reference system {named!r}")
    return int(code[1]) if code else 4326


def reproject_layer(layer: DataFrame, source: int, target: int) -> DataFrame:
    if source == target:
        return layer
    if 4326 not in (source, target):  # by way of degrees, so that formulas aren't put into one another
        return reproject_layer(reproject_layer(layer, source, 4326), 4326, target)

    def point(p: Column) -> Column:
        x, y = reproject(p.x, p.y, source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return layer.withColumns({"points": F.transform("points", point), "rings": F.transform("rings", lambda r: F.transform(r, point))})


def bounds(layer: DataFrame) -> tuple[float, float, float, float] | None:
    """(xmin, ymin, xmax, ymax) of all features; None for an empty layer."""
    every = F.explode(F.concat("points", F.flatten("rings")))
    r = layer.select(every.alias("p")).agg(F.min("p.x").alias("a"), F.min("p.y").alias("b"), F.max("p.x").alias("c"), F.max("p.y").alias("d")).first()
    return None if r.a is None else tuple(r)
