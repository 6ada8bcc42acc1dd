"""Boxes of a frame that overlap, merged until none do."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = tuple[int, int, int, int]


def _meet(a: Box, b: Box) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def _sweep(boxes: list[Box]) -> tuple[list[Box], bool]:
    """Boxes merged where they overlap as a line moves over x, and whether any were.

    Boxes on the line never overlap in y, as two that did would have been
    merged: they are a sorted list of y intervals, in which a new box finds
    those that it meets by bisection.  A merged box may reach back over boxes
    that the line has left, so that another sweep is needed.
    """
    active: list[tuple[int, int, Box]] = []  # (y1, y2, box)
    done: list[Box] = []
    merged = False
    for box in sorted(boxes, key=lambda b: (b[0], b[2], b[1], b[3])):
        at, grew = box[0], True
        while grew:
            grew = False
            i = bisect_left(active, (box[1],))
            i -= i > 0 and active[i - 1][1] > box[1]
            while i < len(active) and active[i][0] < box[3]:
                other = active[i][2]
                if other[2] <= at:
                    done.append(active.pop(i)[2])
                elif _meet(box, other):
                    active.pop(i)
                    box = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]))
                    merged = grew = True
                else:
                    i += 1
        insort(active, (box[1], box[3], box))
    return done + [b for *_, b in active], merged


def fixed_point(corners: np.ndarray) -> np.ndarray:
    """Rows (x1, y1, x2, y2): every two that overlap become the box around both, again and again."""
    boxes, merged = [tuple(map(int, c)) for c in corners], True
    while merged:
        boxes, merged = _sweep(boxes)
    return np.array(sorted(boxes), np.int32).reshape(-1, 4)


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    x, y, w, h = (table.column(c).to_numpy() for c in ("x", "y", "width", "height"))
    found = fixed_point(np.stack((x, y, x + w, y + h), axis=1))
    n = len(found)
    return pa.table(
        {
            "video": pa.array([key[0].as_py()] * n, pa.string()),
            "frame": pa.array([key[1].as_py()] * n, pa.int32()),
            "x": found[:, 0], "y": found[:, 1], "width": found[:, 2] - found[:, 0], "height": found[:, 3] - found[:, 1],
        }
    )


def merged(boxes: DataFrame) -> DataFrame:
    """(video, frame, x, y, width, height): a frame's boxes, merged.

    Equal boxes of a frame become one before the shuffle; the others of one
    frame are one group.
    """
    distinct = boxes.select("video", "frame", F.col("box.*")).distinct()
    return distinct.groupBy("video", "frame").applyInArrow(_merge, "video string, frame int, x int, y int, width int, height int")
