"""Boxes and tile grids as column expressions.

A box is a struct<x:int,y:int,width:int,height:int>; a grid is a
struct<widths:array<int>,heights:array<int>>, its tiles numbered by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIGN = 32  # coded sizes are multiples of this


def box(x1, y1, x2, y2) -> Column:
    """The box between two corners, on even coordinates: odd corners move up and
    left, odd sizes grow by one.  Corners in the wrong order give an empty box."""
    x1, y1, x2, y2 = (F.col(c) if isinstance(c, str) else c for c in (x1, y1, x2, y2))

    def even(start: Column, size: Column) -> tuple[Column, Column]:
        size = F.greatest(size, F.lit(0))
        return (start - F.pmod(start, F.lit(2))).cast("int"), (size + F.pmod(size, F.lit(2))).cast("int")

    (x, width), (y, height) = even(x1, x2 - x1), even(y1, y2 - y1)
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def intersects(a: Column, b: Column) -> Column:
    """Overlap with half-open edges: boxes that only touch don't."""
    return (a["x"] < right(b)) & (b["x"] < right(a)) & (a["y"] < bottom(b)) & (b["y"] < bottom(a))


def contains_point(b: Column, x, y) -> Column:
    return (b["x"] <= x) & (x < right(b)) & (b["y"] <= y) & (y < bottom(b))


def overlap(a: Column, b: Column) -> Column:
    """The common part of two boxes, on even coordinates."""
    return box(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), F.least(right(a), right(b)), F.least(bottom(a), bottom(b)))


def union(a: Column, b: Column) -> Column:
    """The least box around two."""
    return box(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(right(a), right(b)), F.greatest(bottom(a), bottom(b)))


def area(b: Column) -> Column:
    return b["width"].cast("bigint") * b["height"]


def interval_contains(start, end, point) -> Column:
    """Membership of a closed interval."""
    return F.col(point).between(F.col(start), F.col(end))


def intervals_meet(start1, end1, start2, end2) -> Column:
    """Whether two closed intervals share a point."""
    return (F.col(start1) <= F.col(end2)) & (F.col(start2) <= F.col(end1))


def grid(widths: list[int], heights: list[int]) -> Column:
    return F.struct(F.array(*map(F.lit, widths)).alias("widths"), F.array(*map(F.lit, heights)).alias("heights"))


def total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def edges(sizes: Column) -> Column:
    """Where tiles begin along an axis, and where the last one ends."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def before(sizes: Column, i: Column) -> Column:
    """Where tile i begins along an axis."""
    return total(F.slice(sizes, F.lit(1), i))


def coded(size: Column) -> Column:
    return (F.ceil(size / ALIGN) * ALIGN).cast("int")


def n_tiles(g: Column) -> Column:
    return F.size(g["widths"]) * F.size(g["heights"])


def tiles(g: Column) -> Column:
    """All tiles of a grid: array<struct<tile_no,row,col,x,y,width,height>>."""
    columns, xs, ys = F.size(g["widths"]), edges(g["widths"]), edges(g["heights"])

    def tile(t: Column) -> Column:
        col, row = F.pmod(t, columns), F.floor(t / columns).cast("int")
        return F.struct(
            t.alias("tile_no"), row.alias("row"), col.alias("col"), F.get(xs, col).alias("x"), F.get(ys, row).alias("y"), F.get(g["widths"], col).alias("width"), F.get(g["heights"], row).alias("height")
        )

    return F.transform(F.sequence(F.lit(0), n_tiles(g) - 1), tile)


def with_edges(g: Column) -> Column:
    """A grid with its edges, worked out once for tiles_hit."""
    return F.struct(g["widths"].alias("widths"), g["heights"].alias("heights"), edges(g["widths"]).alias("xs"), edges(g["heights"]).alias("ys"))


def _tile(g: Column, row: Column, col: Column) -> Column:
    """A tile by row and column, of a grid with_edges."""
    return F.struct(
        (row * F.size(g["widths"]) + col).alias("tile_no"), row.alias("row"), col.alias("col"), F.get(g["xs"], col).alias("x"), F.get(g["ys"], row).alias("y"), F.get(g["widths"], col).alias("width"), F.get(g["heights"], row).alias("height")
    )


def tiles_hit(b: Column, g: Column) -> Column:
    """The tiles that a box intersects, of a grid with_edges.

    The rows and columns that it covers are found from the edges, so that only
    tiles that are hit are made, however many the grid has.
    """

    def covered(at: Column, start: Column, end: Column) -> Column:
        first = F.greatest(F.size(F.filter(at, lambda e: e <= start)) - 1, F.lit(0))
        beyond = F.least(F.size(F.filter(at, lambda e: e < end)), F.size(at) - 1)
        return F.when(beyond > first, F.sequence(first, beyond - 1)).otherwise(F.array().cast("array<int>"))

    columns = covered(g["xs"], b["x"], right(b))
    return F.flatten(F.transform(covered(g["ys"], b["y"], bottom(b)), lambda row: F.transform(columns, lambda col: _tile(g, row, col))))


def tile_at(g: Column, x: Column, y: Column) -> Column:
    """The tile of a point, or null outside the grid, of a grid with_edges: its row and column are counted from the edges."""

    def begun(at: Column, point: Column) -> Column:
        return F.size(F.filter(at, lambda e: e <= point)) - 1

    col, row = begun(g["xs"], x), begun(g["ys"], y)
    inside = (col >= 0) & (col < F.size(g["widths"])) & (row >= 0) & (row < F.size(g["heights"]))
    return F.when(inside, _tile(g, row, col))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
