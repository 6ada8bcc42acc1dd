"""Detections, layouts and a query log over the driver's tables.

Detections come from lineitem by integer arithmetic that means the same in
Spark and in SQL: four videos of 300 frames, three labels in clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT, GOP, FRAMES, VIDEOS = 1920, 1080, 30, 300, 4

#: (first_frame, last_frame, version, widths, heights), alike for every video.
RANGES = [
    (0, 299, 0, [1920], [1080]),
    (0, 149, 1, [960, 960], [544, 536]),
    (60, 89, 2, [640, 640, 640], [1080]),
]

#: (iteration, video, label, first, last, count)
LOG = [
    (1, "v0", "A", 0, 90, 1),
    (2, "v0", "R", 0, 90, 1),
    (3, "v0", "A", 0, 90, 1),
    (4, "v0", "A", 15, 20, 3),
    (5, "v1", "N", None, None, 1),
    (6, "v0", "A", 0, 90, 1),
]

#: Candidate layouts by id, for the regret queries.
CANDIDATES = {"A": ([288, 1632], [192, 888]), "A_R": ([288, 1152, 480], [192, 576, 312]), "R": ([1440, 480], [768, 312])}


def detections(spark: SparkSession, sf_dir: str, video: Column | None = None, *extra: Column) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    left = F.when(F.col("label") == "A", 64).when(F.col("label") == "N", 768).otherwise(1472) + F.col("l_partkey") % 97
    top = F.when(F.col("label") == "A", 64).when(F.col("label") == "N", 416).otherwise(768) + F.col("l_suppkey") % 53
    rows = lineitem.withColumn("label", F.col("l_returnflag"))
    return rows.select(
        (F.concat(F.lit("v"), (F.col("l_suppkey") % VIDEOS).cast("string")) if video is None else video).alias("video"),
        "label",
        (F.col("l_orderkey") % FRAMES).cast("int").alias("frame"),
        left.cast("int").alias("x1"),
        top.cast("int").alias("y1"),
        (left + 16 + F.col("l_quantity").cast("int")).cast("int").alias("x2"),
        (top + 16 + 8 * F.col("l_linenumber")).cast("int").alias("y2"),
        *extra,
    )


DETECTIONS_SQL = """det as (
  select concat('v', cast(l_suppkey % 4 as varchar)) as video, l_returnflag as label, cast(l_orderkey % 300 as integer) as frame,
    cast(bx + l_partkey % 97 as integer) as x1, cast(bt + l_suppkey % 53 as integer) as y1,
    cast(bx + l_partkey % 97 + 16 + cast(l_quantity as integer) as integer) as x2,
    cast(bt + l_suppkey % 53 + 16 + 8 * l_linenumber as integer) as y2
  from (select *, case l_returnflag when 'A' then 64 when 'N' then 768 else 1472 end as bx,
    case l_returnflag when 'A' then 64 when 'N' then 416 else 768 end as bt from lineitem)
), box as (
  select video, label, frame, x1 - x1 % 2 as x, y1 - y1 % 2 as y, (x2 - x1) + (x2 - x1) % 2 as w, (y2 - y1) + (y2 - y1) % 2 as h from det
)"""


def layouts(spark: SparkSession) -> DataFrame:
    rows = [(f"v{v}", a, b, n, (w, h)) for v in range(VIDEOS) for a, b, n, w, h in RANGES]
    return spark.createDataFrame(rows, "video string, first_frame int, last_frame int, version int, layout struct<widths:array<int>,heights:array<int>>")


def _ints(xs: list[int]) -> str:
    return "[" + ", ".join(map(str, xs)) + "]"


def _grid_sql(name: str, source: str, keys: str) -> str:
    """Tiles of a table of layouts with columns widths and heights."""
    return f"""{name} as (
  select {keys}, (r - 1) * len(widths) + c - 1 as tile_no, r - 1 as "row", c - 1 as col,
    cast(coalesce(list_sum(widths[1:c - 1]), 0) as integer) as tx, cast(coalesce(list_sum(heights[1:r - 1]), 0) as integer) as ty,
    widths[c] as tw, heights[r] as th
  from {source}, unnest(range(1, len(widths) + 1)) as cs(c), unnest(range(1, len(heights) + 1)) as rs(r)
)"""


LAYOUTS_SQL = (
    "lay as (select 'v' || cast(v as varchar) as video, first_frame, last_frame, version, widths, heights from range(4) as vs(v), (values "
    + ", ".join(f"({a}, {b}, {n}, {_ints(w)}, {_ints(h)})" for a, b, n, w, h in RANGES)
    + ") as l(first_frame, last_frame, version, widths, heights)), "
    + _grid_sql("grid", "lay", "video, first_frame, last_frame, version")
)



def all_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout of every row of lineitem: an order is a video, a line a version."""
    first, wide, tall = 30 * (F.col("l_partkey") % 10), 64 + 32 * (F.col("l_partkey") % 50), 64 + 32 * (F.col("l_suppkey") % 30)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("video"),
        first.cast("int").alias("first_frame"),
        (first + 30 * (1 + F.col("l_suppkey") % 5) - 1).cast("int").alias("last_frame"),
        (F.col("l_linenumber") - 1).cast("int").alias("version"),
        F.struct(F.array(wide.cast("int"), (WIDTH - wide).cast("int")).alias("widths"), F.array(tall.cast("int"), (HEIGHT - tall).cast("int")).alias("heights")).alias("layout"),
    )


ALL_LAYOUTS_SQL = """lay as (
  select 'o' || cast(l_orderkey as varchar) as video, cast(30 * (l_partkey % 10) as integer) as first_frame,
    cast(30 * (l_partkey % 10) + 30 * (1 + l_suppkey % 5) - 1 as integer) as last_frame, cast(l_linenumber - 1 as integer) as version,
    [cast(64 + 32 * (l_partkey % 50) as integer), cast(1920 - 64 - 32 * (l_partkey % 50) as integer)] as widths,
    [cast(64 + 32 * (l_suppkey % 30) as integer), cast(1080 - 64 - 32 * (l_suppkey % 30) as integer)] as heights
  from lineitem
), """ + _grid_sql("grid", "lay", "video, first_frame, last_frame, version")


def long_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of 1 to 1,000,000 frames of every row of lineitem: an order is a video, a line a version."""
    first = (F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104_729) % 500_000
    length = 1 + (F.col("l_suppkey") * 999_983 + F.col("l_partkey") * 15_485_863) % 1_000_000
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("video"),
        first.cast("int").alias("first_frame"),
        (first + length - 1).cast("int").alias("last_frame"),
        (F.col("l_linenumber") - 1).cast("int").alias("version"),
    )


LONG_RANGES_SQL = """far as (
  select 'o' || cast(l_orderkey as varchar) as video, cast((l_partkey * 7919 + l_linenumber * 104729) % 500000 as integer) as first_frame,
    cast((l_partkey * 7919 + l_linenumber * 104729) % 500000 + (l_suppkey * 999983 + l_partkey * 15485863) % 1000000 as integer) as last_frame,
    cast(l_linenumber - 1 as integer) as version
  from lineitem)"""

#: The newest range of each frame of each video.
STAB_SQL = """stab as (
  select video, frame, first_frame, version from (
    select l.video, cast(f as integer) as frame, first_frame, version,
      row_number() over (partition by l.video, f order by version desc, first_frame desc) as n
    from lay l, range(300) as fs(f) where f between first_frame and last_frame) where n = 1
)"""

MEET = "b.x < g.tx + g.tw and g.tx < b.x + b.w and b.y < g.ty + g.th and g.ty < b.y + b.h"


def query_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOG, "iteration int, video string, label string, first int, last int, count int")


def workload(spark: SparkSession) -> DataFrame:
    return query_log(spark).withColumnRenamed("iteration", "query_id")


def _value(x) -> str:
    return "cast(null as integer)" if x is None else repr(x)


LOG_SQL = "log as (select * from (values " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in LOG) + ") as q(query_id, video, label, first, last, cnt))"


def gops(spark: SparkSession) -> DataFrame:
    """(video, gop) of every group."""
    return spark.range(VIDEOS * FRAMES // GOP).select(F.concat(F.lit("v"), (F.col("id") % VIDEOS).cast("string")).alias("video"), F.expr(f"cast(id div {VIDEOS} as int)").alias("gop"))


def gop_layouts(spark: SparkSession, widths: list[int], heights: list[int]) -> DataFrame:
    made = F.struct(F.array(*map(F.lit, widths)).alias("widths"), F.array(*map(F.lit, heights)).alias("heights"))
    return gops(spark).withColumn("layout", made)


def candidates(spark: SparkSession) -> DataFrame:
    rows = [(k, (w, h)) for k, (w, h) in CANDIDATES.items()]
    made = spark.createDataFrame(rows, "layout_id string, layout struct<widths:array<int>,heights:array<int>>")
    return gops(spark).crossJoin(F.broadcast(made))  # as many layouts as CANDIDATES has


CANDIDATES_SQL = "cand as (select * from (values " + ", ".join(f"('{k}', {_ints(w)}, {_ints(h)})" for k, (w, h) in CANDIDATES.items()) + ") as c(layout_id, widths, heights)), " + _grid_sql("cgrid", "cand", "layout_id")
UNIFORM_SQL = "uni as (select [960, 960] as widths, [544, 536] as heights), " + _grid_sql("ugrid", "uni", "0 as one")


def cost_sql(name: str, grid: str, key: str = "") -> str:
    """Cost by query and group under a grid that holds for every group."""
    k = f", g.{key}" if key else ""
    k2 = f", {key}" if key else ""
    return f"""{name} as (
  select video, gop, query_id{k2}, sum(cast(tw as bigint) * th * (last - gop * 30 + 1)) as pixels, sum(last - gop * 30 + 1) as tiles from (
    select b.video, b.frame // 30 as gop, q.query_id{k}, g.tile_no, max(g.tw) as tw, max(g.th) as th, max(b.frame) as last
    from box b join log q on b.video = q.video and b.label = q.label and (q.first is null or (b.frame >= q.first and b.frame < q.last))
    join {grid} g on {MEET} group by all) group by all
)"""


def supplier_detections(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    """detections() with a video for each supplier, so that videos grow with the tables."""
    return detections(spark, sf_dir, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), *extra)


def supplier_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RANGES for each supplier's video."""
    ranges = [F.struct(F.lit(a).alias("first_frame"), F.lit(b).alias("last_frame"), F.lit(n).alias("version"), F.struct(F.array(*map(F.lit, w)).alias("widths"), F.array(*map(F.lit, h)).alias("heights")).alias("layout")) for a, b, n, w, h in RANGES]
    videos = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("video"), F.explode(F.array(*ranges)).alias("r"))
    return videos.select("video", "r.*")


SUPPLIER_DETECTIONS_SQL = DETECTIONS_SQL.replace("concat('v', cast(l_suppkey % 4 as varchar))", "concat('s', cast(l_suppkey as varchar))")
def crowded_detections(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    """supplier_detections() in which a third of all rows is in one frame."""
    hot = F.col("l_suppkey") % 3 == 0
    video = F.when(hot, "s1").otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    rows = detections(spark, sf_dir, video, hot.alias("hot"), *extra)
    return rows.withColumn("frame", F.when(F.col("hot"), 7).otherwise(F.col("frame"))).drop("hot")


CROWDED_DETECTIONS_SQL = DETECTIONS_SQL.replace("concat('v', cast(l_suppkey % 4 as varchar))", "if(l_suppkey % 3 = 0, 's1', concat('s', cast(l_suppkey as varchar)))").replace("l_orderkey % 300 as integer", "if(l_suppkey % 3 = 0, 7, l_orderkey % 300) as integer")
SUPPLIER_LAYOUTS_SQL = LAYOUTS_SQL.replace("'v' || cast(v as varchar)", "'s' || cast(v as varchar)").replace("range(4) as vs(v)", "(select s_suppkey from supplier) as vs(v)")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of every order: (iteration, video, label, first, last)."""
    first = 30 * (F.col("o_custkey") % 10)
    label = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("iteration"),
        F.concat(F.lit("v"), (F.col("o_custkey") % VIDEOS).cast("string")).alias("video"),
        label.alias("label"),
        first.cast("int").alias("first"),
        (first + 15 + 15 * (F.col("o_orderkey") % 4)).cast("int").alias("last"),
    )


def order_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, gop, iteration): groups re-tiled after a query, from the customers."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.groupBy(F.concat(F.lit("v"), (F.col("c_custkey") % VIDEOS).cast("string")).alias("video"), (F.col("c_custkey") % 7).cast("int").alias("gop")).agg(F.max(F.col("c_custkey") * 20).alias("iteration"))


ORDER_LOG_SQL = """asks as (
  select o_orderkey as iteration, 'v' || cast(o_custkey % 4 as varchar) as video, case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end as label,
    cast(30 * (o_custkey % 10) as integer) as first, cast(30 * (o_custkey % 10) + 15 + 15 * (o_orderkey % 4) as integer) as last from orders
), log as (
  select distinct concat_ws('/', video, label, first, last) as query_id, video, label, first, last from asks
), cleared as (
  select 'v' || cast(c_custkey % 4 as varchar) as video, cast(c_custkey % 7 as integer) as gop, max(c_custkey * 20) as iteration from customer group by all
)"""
