"""Tile layouts: one tile, uniform grids, grids around detections, and the choice between them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geometry as G
from tessera.operators import cost

# The least tile sizes, their alignment, and the share of the
# untiled pixels that a layout must stay at or below to be worth its tiles.
LEAST_WIDTH, LEAST_HEIGHT, STEP = 256, 160, 32
USEFUL = 0.8


def single(width, height) -> Column:
    return F.struct(F.array(width).alias("widths"), F.array(height).alias("heights"))


def uniform_sizes(n, coded: Column, shown: Column) -> Column:
    """n sizes that share the coded length evenly, cut at the shown one."""
    n = F.lit(n) if isinstance(n, int) else n

    def edge(i: Column) -> Column:
        return F.least(F.floor(i * coded / n).cast("int"), shown)

    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: edge(i + 1) - edge(i))


def uniform(rows, columns, width: Column, height: Column) -> Column:
    """An even grid; coded sizes are the shown ones rounded up to whole blocks."""
    return F.struct(uniform_sizes(columns, G.coded(width), width).alias("widths"), uniform_sizes(rows, G.coded(height), height).alias("heights"))


def cut_around(spans: list[tuple], least: int, whole: int) -> list[int]:
    """Sizes along an axis with cuts between intervals (start, end[, how many there are]), where none is crossed.

    Intervals are visited by (start, end).  A cut may go before an interval, at
    its start rounded down to a step from the last cut, or after it, at its end
    rounded up; or `least` beyond the last cut if that clears the interval.  A
    cut must leave `least` to either side, lie strictly inside no other
    interval and not before the rounded end of the interval before.
    """
    spans = sorted((s[0], s[1], s[2] if len(s) > 2 else 1) for s in spans)
    starts, ends = [s for s, _, _ in spans], sorted((e, n) for _, e, n in spans)
    begun, ended = [0, *accumulate(n for _, _, n in spans)], [0, *accumulate(n for _, n in ends)]
    ends = [e for e, _ in ends]
    points: Counter[int] = Counter()
    for s, e, n in spans:
        points[s] += n if s == e else 0
    cuts: list[int] = []
    reached: int | None = None

    def last() -> int:
        return cuts[-1] if cuts else 0

    def crossed(at: int, own: int) -> bool:
        others = begun[bisect_left(starts, at)] - ended[bisect_right(ends, at)] + points[at]
        return others - (spans[own][0] < at < spans[own][1]) > 0

    def free(at: int) -> bool:
        return reached is None or at >= reached

    def visit(i: int, following: int | None) -> int:
        """Make the cuts around an interval, given where the next one starts; where this one's end comes to."""
        start, end, _ = spans[i]
        before = last() + (start - last()) // STEP * STEP
        if before - last() >= least and not crossed(before, i) and free(before):
            if whole - before >= least:
                cuts.append(before)
            elif whole - 2 * least >= last() and not crossed(whole - least, i):
                cuts.append(whole - least)
        after = last() - (last() - end) // STEP * STEP
        if after != last():
            beyond = last() + least
            if after - last() >= least and whole - after >= least:
                if not crossed(after, i) and free(after):
                    cuts.append(after)
            elif beyond >= end and free(beyond) and whole - beyond >= least:
                if following - beyond >= least if following is not None else last() < end:
                    cuts.append(beyond)
        return after

    for i, (start, _, n) in enumerate(spans):
        following = spans[i + 1][0] if i + 1 < len(spans) else None
        k = 0
        while k < n:
            state = len(cuts), reached
            reached = visit(i, following if k + 1 == n else start)
            # equal intervals follow each other; once one changes nothing, only the last can
            k = n - 1 if (len(cuts), reached) == state and k + 1 < n else k + 1
    return [b - a for a, b in zip([0, *cuts], [*cuts, whole], strict=True)]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _sizes(spans: pd.Series, least: pd.Series, whole: pd.Series) -> pd.Series:
    return pd.Series([cut_around([(s["start"], s["end"], s["n"]) for s in own], int(m), int(n)) for own, m, n in zip(spans, least, whole, strict=True)])


def coverage(boxes: DataFrame, gop_len: int) -> DataFrame:
    """(video, gop, axis, start, end, n): how often each interval occurs among a group's boxes along x (0) and y (1).

    Counts add up, so they are summed before the shuffle; a group has at most
    as many rows as there are intervals of whole pixels, however many its boxes.
    """

    def span(axis: int, start: str, size: str) -> Column:
        low = F.col(f"box.{start}")
        return F.struct(F.lit(axis).alias("axis"), low.alias("start"), (low + F.col(f"box.{size}")).alias("end"))

    rows = boxes.select("video", F.expr(f"frame div {gop_len}").cast("int").alias("gop"), F.explode(F.array(span(0, "x", "width"), span(1, "y", "height"))).alias("s"))
    return rows.groupBy("video", "gop", "s.axis", "s.start", "s.end").agg(F.count("*").alias("n"))


def around_detections(boxes: DataFrame, width: int, height: int, gop_len: int) -> DataFrame:
    """(video, gop, layout) for each group of pictures that has boxes."""
    spans = coverage(boxes, gop_len).groupBy("video", "gop", "axis").agg(F.collect_list(F.struct("start", "end", "n")).alias("spans"))
    is_x = F.col("axis") == 0
    sized = spans.select("video", "gop", "axis", _sizes("spans", F.when(is_x, LEAST_WIDTH).otherwise(LEAST_HEIGHT), F.when(is_x, width).otherwise(height)).alias("sizes"))
    both = sized.groupBy("video", "gop").agg(F.max(F.when(is_x, F.col("sizes"))).alias("widths"), F.max(F.when(~is_x, F.col("sizes"))).alias("heights"))
    return both.select("video", "gop", F.struct("widths", "heights").alias("layout"))


def filled(layouts: DataFrame, gops: DataFrame, width: int, height: int) -> DataFrame:
    """Layouts for all of gops (video, gop), one tile where there is none."""
    return gops.join(layouts, ["video", "gop"], "left").select("video", "gop", F.coalesce("layout", single(F.lit(width), F.lit(height))).alias("layout"))


def if_useful(boxes: DataFrame, layouts: DataFrame, gop_len: int, width: int, height: int) -> DataFrame:
    """layouts, with one tile for groups where tiling saves less than a fifth of the pixels."""
    untiled = layouts.select("video", "gop", single(F.lit(width), F.lit(height)).alias("layout"))
    own = cost.by_gop(boxes, layouts, gop_len).select("video", "gop", F.col("pixels").alias("own"))
    base = cost.by_gop(boxes, untiled, gop_len).select("video", "gop", F.col("pixels").alias("base"))
    useful = layouts.join(own, ["video", "gop"], "left").join(base, ["video", "gop"], "left")
    keep = F.coalesce(F.col("own") <= F.lit(USEFUL) * F.col("base"), F.lit(False))
    return useful.select("video", "gop", keep.alias("tiled"), F.when(keep, F.col("layout")).otherwise(single(F.lit(width), F.lit(height))).alias("layout"))


def by_gop(frames: DataFrame, layouts: DataFrame, gop_len: int) -> DataFrame:
    """frames (video, frame, ...) with the layout of their group; a frame of no known group is an error."""
    met = frames.withColumn("gop", F.expr(f"frame div {gop_len}").cast("int")).join(layouts, ["video", "gop"], "left")
    missing = F.raise_error(F.concat(F.lit("no layout for group "), F.col("gop"), F.lit(" of "), F.col("video")))
    return met.withColumn("layout", F.when(F.col("layout").isNull(), missing.cast(layouts.schema["layout"].dataType)).otherwise(F.col("layout")))


def exploded(layouts: DataFrame) -> DataFrame:
    """A row for each tile: the other columns and tile_no, row, col, x, y, width, height.

    Rows and columns are exploded one after the other, so that no tile is made
    before it is a row; edges are worked out only where x or y is asked for.
    """
    others = [c for c in layouts.columns if c != "layout"]
    known = layouts.select(*others, F.col("layout.widths").alias("widths"), F.col("layout.heights").alias("heights"))
    rows = known.select(*others, "widths", "heights", F.posexplode("heights").alias("row", "height"))
    tiles = rows.select(*others, "widths", "heights", "row", "height", F.posexplode("widths").alias("col", "width"))
    number = F.col("row") * F.size("widths") + F.col("col")
    x, y = G.before(F.col("widths"), F.col("col")), G.before(F.col("heights"), F.col("row"))
    return tiles.select(*others, number.alias("tile_no"), "row", "col", x.alias("x"), y.alias("y"), "width", "height")


def totals(layouts: DataFrame) -> DataFrame:
    """Sizes of each layout: whole, coded and of the largest tile."""
    wide, high = G.total(F.col("layout.widths")), G.total(F.col("layout.heights"))
    return layouts.withColumns(
        {"total_width": wide, "total_height": high, "coded_width": G.coded(wide), "coded_height": G.coded(high), "largest_width": F.array_max("layout.widths"), "largest_height": F.array_max("layout.heights"), "n_tiles": G.n_tiles(F.col("layout"))}
    ).drop("layout")
