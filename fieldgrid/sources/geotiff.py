"""GeoTIFF without native libraries: a reader and a writer for the usual forms of the format.

Read: classic and BigTIFF, strips or tiles, no, deflate, LZW or PackBits
compression, without predictor or with the horizontal or the floating-point one,
integers of 8 to 32 bits and floats. Files come through Spark's binaryFile
source, so any store works. One task cuts a file into its stored blocks, drops
those outside the wanted window and passes the rest on, still compressed; all
tasks then decode them, so a large file isn't the work of one. JPEG 2000 isn't
decoded.

Written: tiled, deflated files. ``write_raster`` compresses the tiles in the
executors; the driver only strings them together, one partition at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgrid.plans.grid import Grid
from fieldgrid.sources import store

#: TIFF and GeoTIFF tag numbers. Fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, GEOKEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
PROJECTED_KEY, GEOGRAPHIC_KEY = 3072, 2048
#: The code of a system that the file doesn't name by number. Fixed value.
UNNAMED = 32767
#: Field type number -> struct code. Fixed values.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


#: First row and column, row and column behind the last.
Window = tuple[int, int, int, int]


class RasterError(ValueError):
    """The file isn't a raster of the supported subset."""


@dataclass
class Header:
    tags: dict[int, tuple]
    order: str

    def one(self, tag: int, default=None):
        return self.tags.get(tag, (default,))[0]

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}[self.one(FORMAT, 1)]
        return np.dtype(f"{self.order}{kind}{self.one(BITS, 8) // 8}")

    @property
    def nodata(self) -> float | None:
        text = b"".join(self.tags.get(NODATA, ())).split(b"\0")[0].strip()
        return float(text) if text else None

    @property
    def grid(self) -> Grid:
        scale, tie = self.tags.get(SCALE, (1.0, 1.0, 0.0)), self.tags.get(TIEPOINT, (0.0,) * 6)
        if abs(scale[0] - scale[1]) > 1e-9 * abs(scale[0]):
            raise RasterError("pixels must be square")
        keys = self.tags.get(GEOKEYS, ())
        srid = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (PROJECTED_KEY, GEOGRAPHIC_KEY) and keys[i + 3] not in (0, UNNAMED)), None)
        return Grid(tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], self.one(WIDTH), self.one(HEIGHT), srid, -9999.0 if self.nodata is None else self.nodata)

    @property
    def band_names(self) -> list[str]:
        from xml.sax.saxutils import unescape

        text = b"".join(self.tags.get(METADATA, ())).decode("utf-8", "replace")
        found = {int(i): unescape(v) for i, v in re.findall(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)<', text)}
        return [found.get(i) or f"band_{i + 1}" for i in range(self.one(SAMPLES, 1))]


def read_header(raw: bytes) -> Header:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    version = struct.unpack(order + "H", raw[2:4])[0] if order else None
    if version not in (42, 43):
        raise RasterError("no TIFF header")
    word, step = ("I", 4) if version == 42 else ("Q", 8)  # offsets and counts of BigTIFF have eight bytes
    at = struct.unpack_from(order + word, raw, step)[0]
    n = struct.unpack_from(order + ("H" if version == 42 else "Q"), raw, at)[0]
    first, size_of = at + (2 if version == 42 else 8), 4 + 2 * step
    tags = {}
    for entry in range(first, first + n * size_of, size_of):
        tag, kind, count = struct.unpack_from(order + "HH" + word, raw, entry)
        if kind not in TYPES:
            continue
        code = TYPES[kind]
        size = struct.calcsize("=" + code) * count
        place = entry + 4 + step
        if size > step:
            place = struct.unpack_from(order + word, raw, place)[0]
        data = raw[place : place + size]
        tags[tag] = (data,) if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", data)
    return Header(tags, order)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, 256 clears the table and 257 ends."""
    out, table, width, held, bits, before = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if not table or code > len(table) or (code == len(table) and before is None):
            raise RasterError("broken LZW data")
        new = table[code] if code < len(table) else before + before[:1]
        out += new
        if before is not None:
            table.append(before + new[:1])
        before = new
        width = min(max((len(table) + 1).bit_length(), 9), 12)
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """PackBits: n >= 0 precedes n + 1 bytes, -n a byte that stands n + 1 times; -128 says nothing."""
    out, at = bytearray(), 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


#: Compression number -> how a block is unpacked. Fixed values.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


@dataclass
class Block:
    """A stored block as it is in the file: where it lies, how many of its rows and columns are pixels, how it is packed."""

    row: int
    col: int
    rows: int
    cols: int
    width: int
    bands: int
    dtype: str
    compression: int
    predictor: int
    planes: list[bytes]

    def values(self) -> np.ndarray:
        """(rows, columns, bands)"""
        kind, per = np.dtype(self.dtype), self.bands // len(self.planes)
        line = self.width * per * kind.itemsize
        layers = []
        for packed in self.planes:
            data = UNPACK[self.compression](packed)
            layers.append(_unpredicted(data[: len(data) // line * line], kind, self.predictor, self.width, per)[: self.rows, : self.cols])
        return np.concatenate(layers, axis=2)


def _unpredicted(data: bytes, kind: np.dtype, predictor: int, width: int, per: int) -> np.ndarray:
    """A block's values (rows, width, per) with the predictor undone."""
    if predictor == 3:  # bytes of a row, most significant ones of all values first, as differences
        rows = np.frombuffer(data, np.uint8).reshape(-1, kind.itemsize * width, per)
        values = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(-1, kind.itemsize, width * per)
        return np.ascontiguousarray(values.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(-1, width, per)
    block = np.frombuffer(data, kind).reshape(-1, width, per)
    return np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("=")) if predictor == 2 else block


def stored_blocks(raw: bytes, window: Window | None = None) -> Iterator[Block]:
    """The blocks that meet a window of pixels, still compressed."""
    h = read_header(raw)
    width, height, bands = h.one(WIDTH), h.one(HEIGHT), h.one(SAMPLES, 1)
    if h.one(COMPRESSION, 1) not in UNPACK or h.one(PREDICTOR, 1) not in (1, 2, 3):
        raise RasterError(f"compression {h.one(COMPRESSION)} with predictor {h.one(PREDICTOR, 1)} isn't supported")
    top, left, bottom, right = window or (0, 0, height, width)
    tiled = TILES in h.tags
    bw, bh = (h.one(TILE_W), h.one(TILE_H)) if tiled else (width, min(h.one(STRIP_ROWS, height), height))
    across, down = -(-width // bw), -(-height // bh)
    planes = bands if h.one(PLANAR, 1) == 2 else 1
    places, sizes = (h.tags[TILES], h.tags[TILE_BYTES]) if tiled else (h.tags[STRIPS], h.tags[STRIP_BYTES])
    for k in range(across * down):
        r, c = k // across * bh, k % across * bw
        rows, cols = min(bh, height - r), min(bw, width - c)
        if r < bottom and c < right and r + rows > top and c + cols > left:
            packed = [raw[places[i] : places[i] + sizes[i]] for i in range(k, planes * across * down, across * down)]
            yield Block(r, c, rows, cols, bw, bands, h.dtype.str, h.one(COMPRESSION, 1), h.one(PREDICTOR, 1), packed)


def read_blocks(raw: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, values (rows, columns, bands)) of each stored block."""
    for block in stored_blocks(raw):
        yield block.row, block.col, block.values()


def head(grid: Grid, dtype: np.dtype, bands: int, names: list[str], sizes: list[int], tile: int) -> bytes:
    """Everything before the blocks of a tiled, deflated file whose blocks have these sizes; BigTIFF where it must be."""
    kind = {"u": 1, "i": 2, "f": 3}[np.dtype(dtype).kind]
    items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{_escaped(n)}</Item>' for i, n in enumerate(names))
    model = 2 if grid.srid is not None and _geographic(grid.srid) else 1
    keys = (1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, PROJECTED_KEY if model == 1 else GEOGRAPHIC_KEY, 0, 1, grid.srid or UNNAMED)
    big = sum(sizes) + 64 * len(sizes) + (1 << 16) >= 1 << 32
    word, step = ("Q", 8) if big else ("I", 4)
    tags = {WIDTH: ("I", (grid.width,)), HEIGHT: ("I", (grid.height,)), BITS: ("H", (np.dtype(dtype).itemsize * 8,) * bands), COMPRESSION: ("H", (8,)), PHOTOMETRIC: ("H", (1,)), SAMPLES: ("H", (bands,)), PLANAR: ("H", (1,)), TILE_W: ("I", (tile,)), TILE_H: ("I", (tile,)), TILES: (word, (0,) * len(sizes)), TILE_BYTES: (word, tuple(sizes)), FORMAT: ("H", (kind,) * bands), SCALE: ("d", (grid.res, grid.res, 0.0)), TIEPOINT: ("d", (0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0)), GEOKEYS: ("H", keys), NODATA: ("s", f"{grid.nodata:g}".encode() + b"\0")}
    if items:
        tags[METADATA] = ("s", f"<GDALMetadata>{items}</GDALMetadata>\0".encode())
    pack = lambda code, v: v if code == "s" else struct.pack(f"<{len(v)}{code}", *v)
    padded = lambda data: data + b"\0" * (-len(data) % 8)
    start = (16 + 8 if big else 8 + 2) + (4 + 2 * step) * len(tags) + step
    start += -start % 8
    extra = sum(len(padded(d)) for d in (pack(*t) for t in tags.values()) if len(d) > step)
    places, at = [], start + extra
    for n in sizes:
        places.append(at)
        at += n
    tags[TILES] = (word, tuple(places))
    numbers = {"B": 1, "s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}
    directory, tail = struct.pack("<Q" if big else "<H", len(tags)), b""
    for tag, (code, v) in sorted(tags.items()):
        data = pack(code, v)
        directory += struct.pack("<HH" + word, tag, numbers[code], len(v))
        if len(data) > step:
            directory += struct.pack("<" + word, start + len(tail))
            tail += padded(data)
        else:
            directory += data.ljust(step, b"\0")
    front = b"II" + (struct.pack("<HHHQ", 43, 8, 0, 16) if big else struct.pack("<HI", 42, 8))
    return (front + directory + struct.pack("<" + word, 0)).ljust(start, b"\0") + tail


def write(values: np.ndarray, grid: Grid, names: list[str] | None = None, tile: int = 256) -> bytes:
    """A tiled, deflated GeoTIFF of values (rows, columns, bands); NaN becomes the grid's NoData."""
    if values.ndim == 2:
        values = values[:, :, None]
    if values.dtype.kind == "f":
        values = np.where(np.isnan(values), grid.nodata, values).astype("<f4")
    values = values.astype(values.dtype.newbyteorder("<"))
    height, width, bands = values.shape
    blocks = []
    for r in range(0, height, tile):
        for c in range(0, width, tile):
            block = np.zeros((tile, tile, bands), values.dtype)
            part = values[r : r + tile, c : c + tile]
            block[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(block.tobytes()))
    return head(grid, values.dtype, bands, names or [], [len(b) for b in blocks], tile) + b"".join(blocks)


def write_raster(df: DataFrame, uri: str, grid: Grid, columns: list[str], dtype: str = "f4", nodata: float | None = None, tile: int = 256) -> None:
    """df(prow, pcol, columns) as one GeoTIFF with a band per column; NULL and missing pixels become NoData.

    Tiles are compressed where their pixels are and written to a table beside the file; sizes (a number per tile) make the
    header, and the tiles follow in order, of which the driver holds one partition at a time."""
    spark, kind, across, down = df.sparkSession, np.dtype(dtype).newbyteorder("<"), -(-grid.width // tile), -(-grid.height // tile)
    grid = replace(grid, nodata=grid.nodata if nodata is None else nodata)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = np.full((tile, tile, len(columns)), grid.nodata, kind)
        r, c = rows["prow"].to_numpy() % tile, rows["pcol"].to_numpy() % tile
        for k, name in enumerate(columns):
            have = rows[name].notna().to_numpy()
            block[r[have], c[have], k] = rows[name].to_numpy()[have]
        return pd.DataFrame({"block": [key[0]], "data": [zlib.compress(block.tobytes())]})

    place = (F.floor(F.col("prow") / tile) * across + F.floor(F.col("pcol") / tile)).cast("long").alias("block")
    beside = f"{uri}.blocks"
    df.select(place, "prow", "pcol", *columns).groupBy("block").applyInPandas(pack, "block long, data binary").write.mode("overwrite").parquet(beside)
    blocks = spark.read.schema("block long, data binary").parquet(beside)
    sizes = {r.block: r.n for r in blocks.select("block", F.octet_length("data").alias("n")).collect()}
    blank = zlib.compress(np.full((tile, tile, len(columns)), grid.nodata, kind).tobytes())

    def parts() -> Iterator[bytes]:
        yield head(grid, kind, len(columns), columns, [sizes.get(k, len(blank)) for k in range(across * down)], tile)
        at = 0
        for r in blocks.orderBy("block").toLocalIterator():
            yield blank * (r.block - at)
            yield bytes(r.data)
            at = r.block + 1
        yield blank * (across * down - at)

    store.write(spark, uri, parts())
    store.remove(spark, beside)


def _escaped(text: str) -> str:
    from xml.sax.saxutils import escape

    return escape(text)


def _geographic(srid: int) -> bool:
    from fieldgrid.plans.grid import is_geographic

    return is_geographic(srid)


#: What a stored block is on its way to the task that decodes it.
PACKED = "path string, names array<string>, nodata double, row int, col int, rows int, cols int, width int, bands int, dtype string, compression int, predictor int, planes array<binary>"


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content of the rasters below a folder or pattern, or of the very files that are listed."""
    if not isinstance(paths, str):
        paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]  # names, not patterns
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(paths)
    return files.select("path", "content")


def read_pixels(spark: SparkSession, paths: str | list[str], windows: dict[str, Window] | None = None) -> DataFrame:
    """path, band, prow, pcol, value (float, NoData as NULL) of all rasters under a path or pattern, or of a list of files.

    ``windows`` (first row and column, row and column behind the last) by path leave out the pixels elsewhere, and the
    blocks that hold no others aren't decoded. A file without a window is read whole."""
    shared = spark.sparkContext.broadcast(windows or {})  # four numbers a file

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                header = read_header(raw)
                for b in stored_blocks(raw, shared.value.get(name)):
                    yield pa.RecordBatch.from_pylist([{"path": name, "names": header.band_names, "nodata": header.nodata} | vars(b)], schema=packed)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                name, names, nodata = entry.pop("path"), entry.pop("names"), entry.pop("nodata")
                block = Block(**entry)
                top, left, bottom, right = shared.value.get(name) or (0, 0, 1 << 31, 1 << 31)
                r0, c0 = max(top - block.row, 0), max(left - block.col, 0)
                values = block.values()[r0 : max(bottom - block.row, 0), c0 : max(right - block.col, 0)]
                rows, cols, _ = values.shape
                pr, pc = (a.ravel().astype(np.int32) for a in np.mgrid[block.row + r0 : block.row + r0 + rows, block.col + c0 : block.col + c0 + cols])
                for k, band in enumerate(names):
                    v = values[:, :, k].ravel().astype(np.float32)
                    gone = ~np.isfinite(v) | (v == np.float32(nodata) if nodata is not None else False)
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(v)), pa.repeat(band, len(v)), pa.array(pr), pa.array(pc), pa.array(v, mask=gone)], names=["path", "band", "prow", "pcol", "value"])

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    packed = pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in PACKED.split(", "))])
    blocks = _files(spark, paths).mapInArrow(cut, PACKED).repartition("path", "row", "col")
    return blocks.mapInArrow(decode, "path string, band string, prow int, pcol int, value float")


def read_grids(spark: SparkSession, path: str) -> dict[str, tuple[Grid, list[str]]]:
    """Grid and band names per file; only headers come back to the driver."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = read_header(raw)
                g = h.grid
                rows.append((name, g.x0, g.y0, g.res, g.width, g.height, g.srid, g.nodata, h.band_names))
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "x0", "y0", "res", "width", "height", "srid", "nodata", "bands"), r, strict=True)) for r in rows], schema=pa.schema([("path", pa.string()), ("x0", pa.float64()), ("y0", pa.float64()), ("res", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("srid", pa.int32()), ("nodata", pa.float64()), ("bands", pa.list_(pa.string()))]))

    table = _files(spark, path).mapInArrow(heads, "path string, x0 double, y0 double, res double, width int, height int, srid int, nodata double, bands array<string>")
    return {r.path: (Grid(r.x0, r.y0, r.res, r.width, r.height, r.srid, r.nodata), r.bands) for r in table.collect()}


def write_tiles(df: DataFrame, path: str, tile: int = 1024) -> None:
    """The scalable raster sink: Parquet, partitioned by tile and sorted by pixel."""
    keyed = df.withColumn("tile_row", F.floor(F.col("prow") / tile).cast("int")).withColumn("tile_col", F.floor(F.col("pcol") / tile).cast("int"))
    keyed.repartition("tile_row", "tile_col").sortWithinPartitions("prow", "pcol").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(path)
