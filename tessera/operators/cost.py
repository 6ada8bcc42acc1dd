"""What a workload would decode: pixels and tile-frames, by group of pictures.

A tile is decoded from its group's first frame up to the last frame in which a
wanted box touches it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators.spread import meet


def touched(boxes: DataFrame, layouts: DataFrame, gop_len: int, keys: tuple[str, ...] = (), split: bool | None = None) -> DataFrame:
    """(video, gop, keys..., tile_no, width, height, last) of tiles that boxes touch.

    layouts has (video, gop, layout, keys...); boxes may have further columns
    named in by_gop's keys.
    split deals crowded groups over several tasks (spread.meet).
    """
    own = [c for c in keys if c in boxes.columns]
    at = boxes.select("video", F.expr(f"frame div {gop_len}").cast("int").alias("gop"), "frame", "box", *own)
    grids = layouts.withColumn("layout", G.with_edges(F.col("layout")))
    met = meet(at, grids, ["video", "gop"], split)
    return _tiles(met, ["video", "gop", *keys])


def _tiles(met: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., tile_no, last, width, height) of boxes beside a layout with edges.

    Columns, then rows are exploded and left where the box doesn't meet them:
    generated code, and summed up before any shuffle.
    """

    def met_along(rows: DataFrame, axis: str, number: str, start: str, size: str) -> DataFrame:
        edges = F.col(f"layout.{axis}")
        rows = rows.select(*rows.columns, F.posexplode(edges).alias(number, "_start"))
        begins, ends = F.col("_start") < F.col(f"box.{start}") + F.col(f"box.{size}"), F.col(f"box.{start}") < F.get(edges, F.col(number) + 1)
        return rows.where(begins & ends).drop("_start")  # beyond the last edge there is no tile: null

    hits = met_along(met_along(met.select(*keys, "frame", "box", "layout"), "xs", "col", "x", "width"), "ys", "row", "y", "height")
    tile_no = (F.col("row") * F.size("layout.widths") + F.col("col")).alias("tile_no")
    sizes = F.get("layout.widths", F.col("col")).alias("width"), F.get("layout.heights", F.col("row")).alias("height")
    return hits.select(*keys, "frame", tile_no, *sizes).groupBy(*keys, "tile_no").agg(F.max("frame").alias("last"), F.max("width").alias("width"), F.max("height").alias("height"))


def by_gop(boxes: DataFrame, layouts: DataFrame, gop_len: int, keys: tuple[str, ...] = (), split: bool | None = None) -> DataFrame:
    """(video, gop, keys..., pixels, tiles) of the groups that boxes touch."""
    return _summed(touched(boxes, layouts, gop_len, keys, split), gop_len, keys)


def _summed(tiles: DataFrame, gop_len: int, keys: tuple[str, ...]) -> DataFrame:
    n = F.col("last") - F.col("gop") * gop_len + 1
    return tiles.groupBy("video", "gop", *keys).agg(F.sum(F.col("width").cast("bigint") * F.col("height") * n).alias("pixels"), F.sum(n.cast("bigint")).alias("tiles"))


def of_queries(detections: DataFrame, queries: DataFrame, layouts: DataFrame, gop_len: int, keys: tuple[str, ...] = (), split: bool | None = None) -> DataFrame:
    """by_gop for every row of queries (query_id, video, label, first, last, ...).

    A null first asks for every frame; last is exclusive.  One plan serves the
    whole log: detections meet the layouts of their group once for their label,
    whatever the queries, and queries meet what is left of them: the tiles of
    each label, by frame only where a query has a range.  With a column
    wanted, a query is scored under the layout_ids in it only.
    """
    wanted = [c for c in queries.columns if c == "wanted"]
    asked = queries.select("query_id", "video", "label", "first", "last", *wanted)
    every = F.col("first").isNull()
    low, high = F.min(F.when(every, -(1 << 40)).otherwise(F.col("first"))), F.max(F.when(every, 1 << 40).otherwise(F.col("last")))
    ids = [F.array_distinct(F.flatten(F.collect_set("wanted"))).alias("wanted")] if wanted else []  # as many as there are layouts
    asks = asked.groupBy("video", "label").agg(low.alias("low"), high.alias("high"), F.bool_or(~every).alias("ranged"), *ids)
    grids = layouts.withColumn("layout", G.with_edges(F.col("layout"))).join(asks, "video").where(f"gop between low div {gop_len} and (high - 1) div {gop_len}")
    grids = grids.where(F.array_contains("wanted", F.col("layout_id"))).drop("wanted") if wanted else grids
    at = detections.select("video", "label", F.expr(f"frame div {gop_len}").cast("int").alias("gop"), "frame", G.box("x1", "y1", "x2", "y2").alias("box"))
    met = meet(at, grids, ["video", "gop", "label"], split).where("frame >= low and frame < high")
    tiles = _tiles(met.withColumn("at", F.when(F.col("ranged"), F.col("frame"))), ["video", "gop", "label", *keys, "at"])
    found = tiles.withColumnRenamed("last", "frame").join(asked, ["video", "label"]).where("first is null or (frame >= first and frame < last)")
    found = found.where(F.array_contains("wanted", F.col("layout_id"))) if wanted else found
    found = found.groupBy("video", "gop", "query_id", *keys, "tile_no").agg(F.max("frame").alias("last"), F.max("width").alias("width"), F.max("height").alias("height"))
    return _summed(found, gop_len, ("query_id", *keys))


def of_workload(per_query: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: the costs of all queries, each times its count."""
    summed = per_query.groupBy("query_id").agg(F.sum("pixels").alias("pixels"), F.sum("tiles").alias("tiles"))
    counted = queries.select("query_id", "count").join(summed, "query_id", "left")
    return counted.agg(F.coalesce(F.sum(F.col("pixels") * F.col("count")), F.lit(0)).alias("num_pixels"), F.coalesce(F.sum(F.col("tiles") * F.col("count")), F.lit(0)).alias("num_tiles"))
