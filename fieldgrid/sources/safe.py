"""Scene folders: listing files, and the reference system from product metadata."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgrid.sources import store

METADATA = "MTD_TL.xml"


class CrsNotFound(ValueError):
    """Neither the raster nor its product metadata names a reference system."""


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path of every file below the root, relative to it. The contents aren't read: the column is pruned."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path")
    return files.select(F.substring_index("path", base + "/", -1).alias("path"))


def srid_from_xml(text: str | bytes) -> int | None:
    """The first non-empty HORIZONTAL_CS_CODE, whatever its namespace."""
    try:
        tree = ET.fromstring(text)
    except ET.ParseError as e:
        raise CrsNotFound(f"unreadable metadata: {e}") from e
    for node in tree.iter():
        if node.tag.rpartition("}")[2] == "HORIZONTAL_CS_CODE" and (node.text or "").strip():
            found = re.fullmatch(r"(?:EPSG:)?(\d+)", node.text.strip(), re.IGNORECASE)
            return int(found[1]) if found else None
    return None


def find_srid(spark: SparkSession, raster_srid: int | None, root: str, path: str) -> int:
    """The raster's own code, else that of the nearest product metadata above it, up to the imagery's root."""
    if raster_srid:
        return raster_srid
    folder = path
    while folder:
        folder = folder.rpartition("/")[0]
        uri = "/".join(x for x in (root.rstrip("/"), folder, METADATA) if x)
        if store.exists(spark, uri) and (srid := srid_from_xml(store.read(spark, uri))):
            return srid
    raise CrsNotFound(f"no reference system for {path}")
