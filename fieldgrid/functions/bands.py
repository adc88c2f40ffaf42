"""Row-wise band arithmetic: safe ratios, the index catalog, validity and masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6
#: name, kind (nd: normalised difference, ratio), first band, second band. Fixed values; the order is the feature order.
INDICES = [
    ("NDVI", "nd", "B08", "B04"),
    ("RATIO_NIR_RED", "ratio", "B08", "B04"),
    ("NDWI", "nd", "B03", "B08"),
    ("NDBI", "nd", "B11", "B08"),
    ("NDMI", "nd", "B08", "B11"),
    ("RATIO_SWIR1_NIR", "ratio", "B11", "B08"),
    ("NBR", "nd", "B08", "B12"),
    ("RATIO_SWIR2_NIR", "ratio", "B12", "B08"),
    ("NDRE_B05", "nd", "B08", "B05"),
    ("NDRE_B8A_B05", "nd", "B8A", "B05"),
    ("RE_RATIO_B06_B05", "ratio", "B06", "B05"),
    ("RE_RATIO_B07_B05", "ratio", "B07", "B05"),
]


def safe_ratio(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """a / b, NULL where b is nearly zero."""
    return F.when(F.abs(b) >= F.lit(epsilon), a / b)


def normalized_difference(a: Column, b: Column) -> Column:
    return safe_ratio(a - b, a + b)


def index_expressions(columns: list[str], kind: str | None = None) -> dict[str, Column]:
    """The catalog's indices whose bands are among the columns; ``kind`` casts them ("float" for rasters)."""
    form = {"nd": normalized_difference, "ratio": safe_ratio}
    found = {name: form[how](F.col(a), F.col(b)) for name, how, a, b in INDICES if a in columns and b in columns}
    return {name: e.cast(kind) if kind else e for name, e in found.items()}


def add_indices(df: DataFrame, kind: str | None = None) -> DataFrame:
    return df.withColumns(index_expressions(df.columns, kind))


def is_finite(c: Column) -> Column:
    """Neither NULL nor NaN nor infinite; false, never NULL, otherwise."""
    d = c.cast("double")
    return F.coalesce(c.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))


def valid_value(c: Column, nodata: float | None = None) -> Column:
    fine = is_finite(c)
    return fine if nodata is None else fine & F.coalesce(c != F.lit(nodata), F.lit(False))


def all_valid(columns: list[str], nodata: float | None = None) -> Column:
    return reduce(lambda a, b: a & b, [valid_value(F.col(c), nodata) for c in columns], F.lit(True))


def clean_value(c: Column, nodata: float | None = None) -> Column:
    """NoData, NaN and infinities become NULL."""
    return F.when(valid_value(c, nodata), c)


def mask_common(df: DataFrame, raw: list[str], others: list[str] = (), nodata: float | None = None, inside: Column | None = None) -> DataFrame:
    """A pixel is kept if every raw band is valid (and it lies inside); otherwise all its bands are NULL."""
    keep = all_valid(raw, nodata) if inside is None else all_valid(raw, nodata) & inside
    df = df.withColumn("_keep", keep)
    return df.withColumns({c: F.when(F.col("_keep"), F.col(c)) for c in [*raw, *others]}).drop("_keep")


def is_cloud(mask: Column, mode: str = "nonzero", values: tuple[int, ...] = ()) -> Column:
    if mode == "nonzero":
        return mask != 0
    if mode != "values":
        raise ValueError(f"unknown cloud mask mode {mode!r}")
    if not values:
        raise ValueError("cloud mask mode 'values' needs invalid values")
    return mask.isin(*values)
