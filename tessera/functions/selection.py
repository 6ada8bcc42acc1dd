"""What a query asks for, as predicates over detections.

Anything with `condition() -> Column` selects; labels also give `labels()`.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geometry import any_of


class Selection(Protocol):
    def condition(self) -> Column: ...


@dataclass(frozen=True)
class Label:
    """One label; it is a literal, whatever characters it holds."""

    name: str

    def condition(self) -> Column:
        return F.col("label") == F.lit(self.name)

    def labels(self) -> list[str]:
        return [self.name]


@dataclass(frozen=True)
class AnyOf:
    """Labels, or selections of labels, of which one has to hold."""

    parts: tuple

    @staticmethod
    def of(*parts) -> AnyOf:
        return AnyOf(tuple(Label(p) if isinstance(p, str) else p for p in parts))

    def condition(self) -> Column:
        if all(isinstance(p, Label) for p in self.parts):
            return F.col("label").isin(self.labels())
        return any_of([p.condition() for p in self.parts])

    def labels(self) -> list[str]:
        return sorted({x for p in self.parts for x in p.labels()})


@dataclass(frozen=True)
class FrameIs:
    frame: int

    def condition(self) -> Column:
        return F.col("frame") == self.frame


@dataclass(frozen=True)
class FrameRange:
    """Frames from first up to, but without, last."""

    first: int
    last: int

    def condition(self) -> Column:
        return (F.col("frame") >= self.first) & (F.col("frame") < self.last)


@dataclass(frozen=True)
class EveryFrame:
    def condition(self) -> Column:
        return F.lit(True)


def as_labels(labels) -> Selection:
    if isinstance(labels, str):
        return Label(labels)
    return AnyOf.of(*labels) if isinstance(labels, (list, tuple, set)) else labels


def as_frames(first: int | None = None, last: int | None = None) -> Selection:
    """No bounds: every frame; the first alone: that frame; both: a half-open range."""
    if first is None and last is None:
        return EveryFrame()
    return FrameIs(first) if last is None else FrameRange(first, last)
