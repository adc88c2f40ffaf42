"""Raster, vector and score views over the plain test tables. The SQL runs in Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgrid.plans.grid import Grid

WIDTH, RES = 150, 10.0
REQUIRED = ["B02", "B03", "B04", "B08", "B11", "B12"]
OPTIONAL = ["B05", "B06", "B07", "B8A"]

PIXELS = """select cast(floor(o.o_orderkey/150.0) as int) as prow, cast(o.o_orderkey % 150 as int) as pcol,
 b.B02,b.B03,b.B04,b.B05,b.B06,b.B07,b.B08,b.B8A,b.B11,b.B12
from orders o left join (select l_orderkey,
 cast(count(*) as double) as B02, sum(round(l_quantity)) as B03, sum(round(l_discount*100)) as B04,
 min(round(l_quantity)) as B05, cast(count(distinct l_suppkey) as double) as B06,
 cast(sum(l_linenumber) as double) as B07, sum(round(l_extendedprice/100)) as B08,
 max(round(l_extendedprice/100)) as B8A, sum(round(l_tax*100)) as B11, max(round(l_quantity)) as B12
 from lineitem group by l_orderkey) b on b.l_orderkey=o.o_orderkey"""

POINTS = """select c_custkey as feature_id,
 cast((c_custkey*7919 % 15000) as double)/10.0 - case when c_custkey % 50 = 0 then 2000.0 else 0.0 end as x,
 h.hm - cast((c_custkey*104729 % cast(h.hm*10 as bigint)) as double)/10.0 as y,
 c_nationkey % 6 as label_num, c_mktsegment as label_text
from customer cross join (select cast(count(*) as double)/15.0 as hm from orders) h"""

SHAPES = """select n_nationkey as feature_id, cast(n_nationkey*577 % 1300 as double)+0.375 as x0,
 cast(n_nationkey*991 % cast(greatest(h.hm-80,1) as bigint) as double)+0.625 as y0,
 cast(60+n_nationkey as double) as w, cast(40+n_nationkey as double) as hgt,
 case when n_nationkey%2=0 then 'rect' else 'tri' end as kind, n_regionkey as label
from nation cross join (select cast(count(*) as double)/15.0 as hm from orders) h"""

SCENES = """select scene_id,scene_ord,prow,pcol,
 case when (prow*31+pcol*17)%13=0 then null else B04+scene_ord*1000 end as value,
 case when (prow*31+pcol*17)%11 in (3,8) then (prow*31+pcol*17)%11 else 0 end as mask
from f1 cross join (select 'S1' as scene_id,0 as scene_ord,0 as c0,89 as c1
                    union all select 'S2',1,60,149) s where pcol between c0 and c1"""

SCORED = """select o_orderkey as id, cast(substr(o_orderpriority,1,1) as int) as label,
 cast(case when o_orderkey % 7 < 5 then cast(substr(o_orderpriority,1,1) as int) else 1 + o_orderkey % 5 end as int) as prediction,
 cast(o_custkey % 5 as int) as fold from orders"""

CLASSES = """select cast(floor(o_orderkey/150.0) as int) as prow, cast(o_orderkey % 150 as int) as pcol,
 case when o_orderkey % 97 = 0 then null else cast(substr(o_orderpriority,1,1) as int) end as label from orders"""

#: scene, band: one scene lacks a required band, one an optional band.
CATALOG = [(s, b) for s in ("S1", "S2", "S3", "S4") for b in REQUIRED + OPTIONAL if (s, b) not in {("S3", "B12"), ("S2", "B05")}]
#: scene, path: several resolutions, short names, auxiliary files.
PATHS = [
    ("A", "T_B02_10m.jp2"),
    ("A", "T_B02_20m.jp2"),
    ("A", "X_FRE_B3.tif"),
    ("A", "T_B8A_20m.jp2"),
    ("A", "T_B8A_60m.jp2"),
    ("A", "T_B11_60m.jp2"),
    ("A", "QI_DATA/MSK_DETFOO_B02.jp2"),
    ("B", "R20m/T_B02.jp2"),
    ("B", "R60m/T_B02.jp2"),
    ("B", "one_B12.tif"),
    ("B", "two_B12.tif"),
]
#: path: files of three scenes, one of which lacks a band; masks lie beside the images or in an auxiliary folder.
FILES = [
    "X.SAFE/GRANULE/G1/IMG_DATA/R10m/T_B02_10m.jp2",
    "X.SAFE/GRANULE/G1/IMG_DATA/R20m/T_B02_20m.jp2",
    "X.SAFE/GRANULE/G1/IMG_DATA/R20m/T_B11_20m.jp2",
    "X.SAFE/GRANULE/G1/QI_DATA/MSK_CLOUDS_B00.jp2",
    "Y/a_B02_10m.tif",
    "Y/a_B11_20m.tif",
    "Y/a_B8A_20m.tif",
    "Y/notes.txt",
    "Z/a_B02_10m.tif",
    "Z/MSK_CLOUDS_Z.tif",
]
#: The pixel grid of the tables moved to the east of UTM zone 35 S, and a grid of zone 36 S over it.
EAST = (790_000.0, 7_200_000.0, 32735)
OVER = Grid(185_800.0, 7_199_600.0, 10.0, 200, 200, 32736)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    named = re.sub(r"\b(from|join) (orders|lineitem|customer|nation)\b", r"\1 {\2}", sql)
    return spark.sql(named, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", named))})


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PIXELS)


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    """The grid's height follows from the number of orders, which Parquet's footers tell."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    return Grid(0.0, n / 15.0, RES, WIDTH, n // WIDTH, 32735)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POINTS)


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_id, label and rings."""
    s = view(spark, sf_dir, SHAPES)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("hgt")
    rect, tri = F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1)), F.array(p(x0, y0), p(x1, y0), p(x0, y1))
    return s.select("feature_id", "label", F.array(F.when(F.col("kind") == "rect", rect).otherwise(tri)).alias("rings"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCENES.replace("from f1 ", "from {f1} "), f1=pixels(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCORED)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CLASSES)


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    raw = F.transform(F.slice("embedding", 1, 10), lambda v: F.greatest(F.abs(v.cast("double")), F.lit(1e-12)))
    e = e.select("vec_id", raw.alias("r"))
    return e.select("vec_id", F.transform("r", lambda v: v / F.aggregate("r", F.lit(0.0), lambda a, x: a + x)).alias("p"))
