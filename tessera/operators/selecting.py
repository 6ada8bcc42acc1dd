"""Which pixels answer a selection: objects, tiles or full frames, by number and place.

Only metadata is used here: the results prune the read of pixel tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import catalog
from tessera.operators.spread import meet

RANGE = ["video", "first_frame", "version"]


def hits(boxes: DataFrame, layouts: DataFrame, gop_len: int, split: bool | None = None) -> DataFrame:
    """boxes with a row for each tile of their frame's newest layout that they touch;
    split deals crowded frames over several tasks (spread.meet)."""
    placed = placed_frames(boxes.select("video", "frame").distinct(), layouts, gop_len)
    met = meet(boxes, placed.withColumn("layout", G.with_edges(F.col("layout"))), ["video", "frame"], split)
    return met.withColumn("t", F.explode(G.tiles_hit(F.col("box"), F.col("layout")))).withColumn("n_tiles", G.n_tiles(F.col("layout"))).drop("layout")


def placed_frames(frames: DataFrame, layouts: DataFrame, gop_len: int) -> DataFrame:
    return catalog.newest(frames, layouts, gop_len)


def tile_frames(boxes: DataFrame, layouts: DataFrame, gop_len: int) -> DataFrame:
    """(video, first_frame, version, tile_no, frame) in which a tile holds a wanted object."""
    return hits(boxes, layouts, gop_len).select(*RANGE, F.col("t.tile_no").alias("tile_no"), "frame").distinct()


def tile_boxes(boxes: DataFrame, layouts: DataFrame, gop_len: int, id_col: str, split: bool | None = None) -> DataFrame:
    """(video, first_frame, version, tile_no, frame, id_col): which boxes each tile holds a part of."""
    return hits(boxes, layouts, gop_len, split).select(*RANGE, F.col("t.tile_no").alias("tile_no"), "frame", id_col)


def decoded(boxes: DataFrame, layouts: DataFrame, gop_len: int) -> DataFrame:
    """(video, first_frame, version, tile_no, gop, first, last, width, height): what is decoded
    of each tile, from a group's first frame (or the range's, if later) to the last wanted."""
    gop = F.expr(f"frame div {gop_len}").alias("gop")
    found = hits(boxes, layouts, gop_len).groupBy(*RANGE, F.col("t.tile_no").alias("tile_no"), gop)
    found = found.agg(F.max("frame").alias("last"), F.first("t.width").alias("width"), F.first("t.height").alias("height"))
    return found.withColumn("first", F.greatest(F.col("gop") * gop_len, F.col("first_frame")))


def objects(boxes: DataFrame, layouts: DataFrame, gop_len: int) -> DataFrame:
    """A row for each wanted box and tile: the part of the box in the tile (x, y, width,
    height in the frame; left, top in the tile), with label and tile."""
    part = F.col("part")
    found = hits(boxes, layouts, gop_len).withColumn("part", G.overlap(F.col("box"), F.col("t")))
    return found.select(*RANGE, "frame", "label", F.col("t.tile_no").alias("tile_no"), *(part[c].alias(c) for c in ("x", "y", "width", "height")), (part["x"] - F.col("t.x")).alias("left"), (part["y"] - F.col("t.y")).alias("top"))


def prefix_objects(boxes: DataFrame, every_box: DataFrame, layouts: DataFrame, gop_len: int) -> DataFrame:
    """objects() and the boxes of the same selection in frames that are decoded only on the way to a wanted one.

    every_box is the selection without its frame range.
    """
    spans = decoded(boxes, layouts, gop_len).select(*RANGE, "tile_no", "gop", "first", "last")
    found = objects(every_box, layouts, gop_len).withColumn("gop", F.expr(f"frame div {gop_len}"))
    return found.join(spans, [*RANGE, "tile_no", "gop"]).where(F.col("frame").between(F.col("first"), F.col("last"))).drop("gop", "first", "last")


def whole_tiles(boxes: DataFrame, layouts: DataFrame, gop_len: int, include_prefix: bool = False) -> DataFrame:
    """(video, first_frame, version, tile_no, frame, width, height) of the tiles wanted.

    A layout of one tile is wanted in every frame asked for; include_prefix
    adds the frames that are decoded on the way.
    """
    if not include_prefix:
        found = hits(boxes, layouts, gop_len)
        return found.select(*RANGE, F.col("t.tile_no").alias("tile_no"), "frame", F.col("t.width").alias("width"), F.col("t.height").alias("height")).distinct()
    spans = decoded(boxes, layouts, gop_len)
    return spans.select(*RANGE, "tile_no", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("frame"), "width", "height")


def full_frames(boxes: DataFrame, layouts: DataFrame, gop_len: int) -> DataFrame:
    """(video, first_frame, version, frame, n_tiles) of the frames wanted."""
    placed = placed_frames(boxes.select("video", "frame").distinct(), layouts, gop_len)
    return placed.select(*RANGE, "frame", G.n_tiles(F.col("layout")).alias("n_tiles"))


def counters(boxes: DataFrame, layouts: DataFrame, gop_len: int) -> DataFrame:
    """(video, n_pixels, n_frames, n_tiles): pixels, tile-frames and tiles decoded."""
    n = (F.col("last") - F.col("first") + 1).cast("bigint")
    spans = decoded(boxes, layouts, gop_len)
    return spans.groupBy("video").agg(F.sum(n * F.col("width") * F.col("height")).alias("n_pixels"), F.sum(n).alias("n_frames"), F.count_distinct("first_frame", "version", "tile_no").alias("n_tiles"))


def with_bytes(spans: DataFrame, zones: DataFrame) -> DataFrame:
    """decoded() with n_bytes of each span, by what zones (video, version, gop, tile_no, n_frames, n_bytes) say of its frames."""
    n = (F.col("last") - F.col("first") + 1).cast("bigint")
    own = zones.select("video", "version", "gop", "tile_no", "n_frames", F.col("n_bytes").alias("zone_bytes"))
    met = spans.withColumn("gop", F.col("gop").cast("int")).join(own, ["video", "version", "gop", "tile_no"], "left")
    return met.withColumn("n_bytes", F.expr("zone_bytes div n_frames") * n).drop("n_frames", "zone_bytes")


def scan_counters(boxes: DataFrame, layouts: DataFrame, zones: DataFrame, gop_len: int) -> DataFrame:
    """(video, n_pixels, n_frames, n_bytes, n_tiles): counters() and the bytes that are read for them."""
    spans = decoded(boxes, layouts, gop_len)
    n_bytes = with_bytes(spans, zones).groupBy("video").agg(F.sum("n_bytes").alias("n_bytes"))
    return counters(boxes, layouts, gop_len).join(n_bytes, "video").select("video", "n_pixels", "n_frames", "n_bytes", "n_tiles")
