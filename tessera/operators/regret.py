"""Regret: what other layouts would have saved the queries so far, and when to re-tile.

A candidate layout is made around a set of labels.  Per group of pictures it
gains, for every query that touches the group, the decoding it would have
spared; a group whose best candidate has gained more than re-encoding costs is
re-tiled.  A log is scored as a whole, per epoch between two re-tilings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import cost, layouts

# Seconds of decoding per pixel and per tile-frame, of encoding
# per pixel, and the encoder's start.
PER_PIXEL, PER_TILE = 1.608e-06, 1.703e-01
ENCODE_PIXEL, ENCODE_START = 3.206e-06, 2.592


def saved(pixels: Column, tiles: Column) -> Column:
    return PER_PIXEL * pixels + PER_TILE * tiles


def encode_cost(width: int, height: int, gop_len: int) -> float:
    return ENCODE_PIXEL * width * height * gop_len + ENCODE_START


def candidates(log: DataFrame) -> DataFrame:
    """(video, layout_id, labels): each label by itself, and from the second new one on all labels so far."""
    first = log.groupBy("video", "label").agg(F.min("iteration").alias("since"))
    w = Window.partitionBy("video").orderBy("since", "label")
    seen = first.withColumn("so_far", F.collect_list("label").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sets = seen.select("video", F.explode(F.array(F.array("label"), F.array_sort("so_far"))).alias("labels")).distinct()
    return sets.select("video", F.concat_ws("_", "labels").alias("layout_id"), "labels")


def candidate_layouts(boxes: DataFrame, sets: DataFrame, gops: DataFrame, width: int, height: int, gop_len: int) -> DataFrame:
    """(video, gop, layout_id, layout) around the boxes of each candidate's labels; one tile where it has none."""
    named = sets.select("video", "layout_id", F.explode("labels").alias("label"))
    keyed = boxes.join(named, ["video", "label"]).withColumn("video", F.struct("video", "layout_id"))
    made = layouts.around_detections(keyed, width, height, gop_len).select("video.video", "video.layout_id", "gop", "layout")
    asked = gops.join(sets.select("video", "layout_id"), "video")
    return asked.join(made, ["video", "gop", "layout_id"], "left").select("video", "gop", "layout_id", F.coalesce("layout", layouts.single(F.lit(width), F.lit(height))).alias("layout"))


def by_gop_and_layout(detections: DataFrame, log: DataFrame, current: DataFrame, candidate: DataFrame, width: int, height: int, gop_len: int, cleared: DataFrame | None = None) -> DataFrame:
    """(video, gop, layout_id, regret, disqualified).

    log has (iteration, video, label, first, last); current (video, gop,
    layout); candidate (video, gop, layout_id, layout); cleared, if given,
    (video, gop, iteration): queries up to it no longer count for that group.
    A candidate that ever decodes USEFUL of the untiled pixels or more is
    disqualified for the group.
    """
    met = _scored(detections, log.withColumnRenamed("iteration", "query_id"), current, candidate, width, height, gop_len)
    if cleared is not None:
        old = cleared.select("video", "gop", F.col("iteration").alias("cleared"))
        met = met.join(old, ["video", "gop"], "left").where(F.col("cleared").isNull() | (F.col("query_id") > F.col("cleared")))
    gain = saved(F.col("base_pixels") - F.col("own_pixels"), F.col("base_tiles") - F.col("own_tiles"))
    return met.groupBy("video", "gop", "layout_id").agg(F.sum(gain).alias("regret"), F.bool_or("useless").alias("disqualified"))


def _scored(detections: DataFrame, asked: DataFrame, current: DataFrame, candidate: DataFrame, width: int, height: int, gop_len: int) -> DataFrame:
    """(video, gop, query_id, layout_id, own_pixels, own_tiles, base_pixels, base_tiles, useless) of queries that touch a group."""
    # all layouts in one pass over the detections: 0 the candidates, 1 the current one, 2 a single tile
    untiled = current.select("video", "gop", F.lit("").alias("layout_id"), F.lit(2).alias("kind"), layouts.single(F.lit(width), F.lit(height)).alias("layout"))
    known = current.select("video", "gop", F.lit("").alias("layout_id"), F.lit(1).alias("kind"), "layout")
    scored = candidate.select("video", "gop", "layout_id", F.lit(0).alias("kind"), "layout").union(known).union(untiled)
    costs = cost.of_queries(detections, asked, scored, gop_len, ("layout_id", "kind"))
    query = Window.partitionBy("video", "gop", "query_id")  # a row for each layout

    def of(kind: int, what: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(what))).over(query)

    met = costs.withColumns({"base_pixels": of(1, "pixels"), "base_tiles": of(1, "tiles"), "whole_pixels": of(2, "pixels")}).withColumnsRenamed({"pixels": "own_pixels", "tiles": "own_tiles"})
    met = met.where("kind = 0 and base_pixels is not null and whole_pixels is not null")
    return met.withColumn("useless", F.col("own_pixels") >= F.lit(layouts.USEFUL) * F.col("whole_pixels"))


def by_shape(detections: DataFrame, log: DataFrame, current: DataFrame, candidate: DataFrame, width: int, height: int, gop_len: int, cleared: DataFrame) -> DataFrame:
    """(video, gop, layout_id, pixels, tiles, regret, disqualified): by_gop_and_layout() for long logs.

    Queries that ask alike share their costs, so work grows with the shapes and
    only counts with the log; pixels and tiles are what they would have spared.
    """
    shape = F.to_json(F.struct("video", "label", "first", "last")).alias("query_id")
    shapes = log.select(shape, "video", "label", "first", "last").distinct()
    met = _scored(detections, shapes, current, candidate, width, height, gop_len)
    old = cleared.select("video", "gop", F.col("iteration").alias("cleared"))
    touched = met.select("video", "gop", "query_id").distinct().join(old, ["video", "gop"], "left")
    n = touched.join(log.select(shape, "iteration"), "query_id").where(F.col("cleared").isNull() | (F.col("iteration") > F.col("cleared"))).groupBy("video", "gop", "query_id").agg(F.count("*").alias("n"))
    summed = met.join(n, ["video", "gop", "query_id"]).groupBy("video", "gop", "layout_id").agg(
        F.sum(F.col("n") * (F.col("base_pixels") - F.col("own_pixels"))).alias("pixels"), F.sum(F.col("n") * (F.col("base_tiles") - F.col("own_tiles"))).alias("tiles"), F.bool_or("useless").alias("disqualified")
    )
    return summed.select("video", "gop", "layout_id", "pixels", "tiles", saved(F.col("pixels"), F.col("tiles")).alias("regret"), "disqualified")


def decide(regret: DataFrame, width: int, height: int, gop_len: int, threshold: float = 1.0) -> DataFrame:
    """(video, gop, layout_id, regret) of the groups to re-tile: the best candidate that is not
    disqualified, ties to the smaller id, if above zero and threshold times the encoding cost."""
    sound = regret.where(~F.col("disqualified"))
    best = sound.groupBy("video", "gop").agg(F.min(F.struct((-F.col("regret")).alias("loss"), "layout_id")).alias("b"))
    best = best.select("video", "gop", "b.layout_id", (-F.col("b.loss")).alias("regret"))
    return best.where((F.col("regret") > 0) & (F.col("regret") > threshold * encode_cost(width, height, gop_len)))


def clear(cleared: DataFrame, retiled: DataFrame, iteration: int) -> DataFrame:
    """cleared with the groups of retiled added, at their newest iteration."""
    added = retiled.select("video", "gop", F.lit(iteration).alias("iteration"))
    return cleared.select("video", "gop", "iteration").union(added).groupBy("video", "gop").agg(F.max("iteration").alias("iteration"))


def still_counting(log: DataFrame, touched: DataFrame, cleared: DataFrame) -> DataFrame:
    """Log rows of which some group (video, query_id, gop of touched) isn't cleared yet."""
    old = cleared.select("video", "gop", F.col("iteration").alias("cleared"))
    live = touched.join(old, ["video", "gop"], "left").where(F.col("cleared").isNull() | (F.col("query_id") > F.col("cleared")))
    return log.join(live.select("video", F.col("query_id").alias("iteration")).distinct(), ["video", "iteration"], "left_semi")
