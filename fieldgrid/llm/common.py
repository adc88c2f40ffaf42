"""Helpers shared by the corpus operators: tables, the shared folder, word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
WHITESPACE = " \t\n\x0b\x0c\r"
WHITESPACE_RUN = r"[ \t\n\x0B\f\r]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset a folder of this machine stands
    in for it, but only if everything runs in this machine's one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fieldgrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/fieldgrid"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_scan(docs: DataFrame) -> bool:
    """Whether docs is a scan of files with deterministic projections and filters only."""
    node = docs._jdf.queryExecution().optimizedPlan()
    if not node.deterministic() or "_metadata" in docs.columns:
        return False
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    try:
        return node.nodeName() == "LogicalRelation" and bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII strings take Spark's fast path."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space, in order; an empty array for a text without words."""
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITESPACE_RUN, -1))


def _bytes_of(name: str, kind: str) -> Column:
    """About how much a value takes in memory."""
    c = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        size = F.octet_length(c)
    elif kind == "array<string>":
        size = F.aggregate(c, F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    elif kind.startswith("array"):
        size = 32 * F.size(c)
    else:
        size = F.lit(32)
    return F.coalesce(size, F.lit(0)) + 16


def fits_in_memory(df: DataFrame, limit_bytes: int) -> bool:
    """Measure df (one small aggregate) so that a side is broadcast only when it is proven to fit."""
    width = sum(_bytes_of(c, t) for c, t in df.dtypes)
    return (df.agg(F.sum(width.cast("long")).alias("b")).first().b or 0) <= limit_bytes


def broadcast_if_small(df: DataFrame, limit_bytes: int = 32 << 20) -> DataFrame:
    return F.broadcast(df) if fits_in_memory(df, limit_bytes) else df
