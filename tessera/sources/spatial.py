"""An index in the order of places, for selections by a window of the frame.

A box is filed under its level, the least L with sides of up to 2**L, and the
cell of that level's grid that its corner is in, numbered along a Z-order
curve.  So a box lies in its cell and the next ones to the right and below, and
a window asks, for each level, for the cells that it touches and those before
them: a few stretches of the curve, which become conditions on one sorted
column and prune files, row groups and pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geometry as G
from tessera.sources import detections

LEVELS = 17  # sides of up to 65,536
SIDE = 16  # bits of a cell's number along an axis
STRETCHES = 8  # of the curve, for each level
PAGE_ROWS = 2000
PLACE = T.StructField("place", T.LongType(), False)


def _spread(c: Column) -> Column:
    """The low 16 bits of c, each with a zero before it."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def z_order(x: int, y: int) -> int:
    return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(SIDE))


def place(box: Column) -> Column:
    """A box's level and cell as one number; corners beyond an edge count as on it."""
    side = F.greatest(box["width"], box["height"], F.lit(1))
    level = F.least(F.when(side <= 1, 0).otherwise(F.length(F.bin((side - 1).cast("long")))), F.lit(LEVELS - 1))

    def cell(at: Column) -> Column:
        found = F.floor(F.greatest(at, F.lit(0)) / F.pow(F.lit(2.0), level)).cast("long")
        return F.least(found, F.lit((1 << SIDE) - 1))

    return F.shiftleft(level.cast("long"), 2 * SIDE).bitwiseOR(_spread(cell(box["x"])).bitwiseOR(F.shiftleft(_spread(cell(box["y"])), 1)))


def stretches(x: tuple[int, int], y: tuple[int, int], most: int = STRETCHES) -> list[tuple[int, int]]:
    """At most so many stretches (first, last) of the Z-order curve that hold all cells with x[0] <= x <= x[1], y alike.

    Squares that are partly outside are split, the largest first, while the
    stretches are few enough; what touches is one stretch.
    """

    def inside(s: tuple[int, int, int]) -> bool:
        return x[0] <= s[1] and s[1] + (1 << s[0]) - 1 <= x[1] and y[0] <= s[2] and s[2] + (1 << s[0]) - 1 <= y[1]

    def touched(s: tuple[int, int, int]) -> bool:
        return s[1] <= x[1] and s[1] + (1 << s[0]) > x[0] and s[2] <= y[1] and s[2] + (1 << s[0]) > y[0]

    def joined(squares: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for bits, at_x, at_y in sorted(squares, key=lambda s: z_order(s[1], s[2])):
            first = z_order(at_x, at_y)
            last = first + (1 << 2 * bits) - 1
            if out and out[-1][1] + 1 == first:
                out[-1] = (out[-1][0], last)
            else:
                out.append((first, last))
        return out

    squares = [(SIDE, 0, 0)]
    while True:
        partly = [s for s in squares if s[0] and not inside(s)]
        if not partly:
            return joined(squares)
        largest = max(partly)
        half = largest[0] - 1
        parts = [(half, largest[1] + (i << half), largest[2] + (j << half)) for j in (0, 1) for i in (0, 1)]
        split = [s for s in squares if s != largest] + [s for s in parts if touched(s)]
        if len(joined(split)) > most:
            return joined(squares)
        squares = split


def may_meet(x: int, y: int, width: int, height: int) -> Column:
    """Whether a row's place lets its box meet a window: true of all that do and of few others."""
    parts = []
    for level in range(LEVELS):
        most = (1 << SIDE) - 1
        along = [(min(max(0, (at >> level) - 1), most), min(max(0, at + size - 1) >> level, most)) for at, size in ((x, width), (y, height))]
        parts += [F.col("place").between((level << 2 * SIDE) + a, (level << 2 * SIDE) + b) for a, b in stretches(*along)]
    return reduce(lambda a, b: a | b, parts)


class SpatialIndex(detections.DetectionIndex):
    """Detections in the order of places."""

    schema = T.StructType([*detections.SCHEMA.fields, PLACE])

    def rows(self) -> DataFrame:
        return super().rows().drop("place")

    def within(self, x: int, y: int, width: int, height: int, video: str | None = None) -> DataFrame:
        """Detections with box, whose box meets a window."""
        rows = super().rows().where(may_meet(x, y, width, height))
        found = detections.boxes((rows if video is None else rows.where(F.col("video") == video)).drop("place"))
        window = G.box(F.lit(x), F.lit(y), F.lit(x + width), F.lit(y + height))
        return found.where(G.intersects(F.col("box"), window))

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in detections.SCHEMA)).withColumn("place", place(G.box("x1", "y1", "x2", "y2")))
        dealt = rows.repartitionByRange("video", "place").sortWithinPartitions("video", "place", "frame")
        dealt.write.mode(mode).option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("video").parquet(path)


detections.register_kind("spatial", SpatialIndex)
