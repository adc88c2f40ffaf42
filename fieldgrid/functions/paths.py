"""Tokens in scene file names: names are cut at delimiters and the pieces compared with sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Native resolutions in metres. Fixed values.
NATIVE = {"B02": 10.0, "B03": 10.0, "B04": 10.0, "B08": 10.0, "B05": 20.0, "B06": 20.0, "B07": 20.0, "B8A": 20.0, "B11": 20.0, "B12": 20.0}
#: Pieces of a name that tell its resolution, and what they mean in metres. Fixed values.
METRES = {"10M": 10.0, "20M": 20.0, "60M": 60.0, "R10M": 10.0, "R20M": 20.0, "R60M": 60.0}
#: Folders whose files are no imagery. Fixed values.
AUXILIARY = ("QI_DATA", "AUX_DATA", "DATASTRIP")
RASTERS = (".tif", ".tiff", ".jp2")


def spellings(band: str) -> list[str]:
    """How a band may be written, in capitals: B2 and B02 are one; B8A has one form."""
    number = band[1:]
    return [f"B{int(number)}", f"B0{int(number)}"] if number.isdigit() else [band.upper()]


def has_band(name: Column, band: str) -> Column:
    """Whether a piece between underscores or hyphens, up to its first point or space, names the band."""
    pieces = F.split(F.translate(F.upper(name), "- ", "_."), "_", -1)
    return F.exists(pieces, lambda piece: F.substring_index(piece, ".", 1).isin(spellings(band)))


def resolution(path: Column) -> Column:
    """Metres from the first telling piece of the file name or its last three folders; NULL if there is none."""
    tail = F.translate(F.upper(F.substring_index(path, "/", -4)), "\\/.-", "____")
    known = F.create_map(*[F.lit(x) for pair in METRES.items() for x in pair])
    return F.try_element_at(known, F.get(F.filter(F.split(tail, "_", -1), lambda piece: piece.isin(list(METRES))), F.lit(0)))


def safe_id(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_")


def is_auxiliary(path: Column) -> Column:
    return F.exists(F.split(F.regexp_replace(path, "[^/]*$", ""), "/", -1), lambda folder: folder.isin(list(AUXILIARY)))
