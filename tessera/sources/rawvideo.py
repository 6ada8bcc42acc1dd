"""Files of raw frames, read whole or by ranges of frames.

``spark.read.format("rawvideo")`` gives (frame, width, height, pixels), RGBA, of
one file that has its frames one after the other.  Every frame is a key, so a
range is read by its offset: partitions are runs of frames, and conditions on
frame numbers drop those (and the parts of those) that can't hold any.  Options:
path, width, height, format (rgba or nv12), frames_per_partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessera.functions import pixels as P

BYTES = {"rgba": (4, 1), "nv12": (3, 2)}  # of a pixel, as a fraction
SCHEMA = "frame int, " + P.IMAGE
BATCH_BYTES = 16 << 20


class Run(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class RawVideo(DataSource):
    """Raw frames of one file."""

    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("format", "rgba")
        self.width, self.height = int(options["width"]), int(options["height"])
        if self.kind not in BYTES or self.width <= 0 or self.height <= 0:
            raise ValueError("a raw video needs a width, a height and a format of rgba or nv12")
        if self.kind == "nv12" and (self.width % 2 or self.height % 2):
            raise ValueError("an nv12 frame has even sides")
        above, below = BYTES[self.kind]
        self.frame_bytes = self.width * self.height * above // below
        self.per_partition = int(options.get("frames_per_partition", max(1, (64 << 20) // self.frame_bytes)))
        self.first, self.last = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the frame number; they are tested again after the read."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame",):
                self._bound(f)
            yield f

    def _bound(self, f: Filter) -> None:
        low = {EqualTo: 0, GreaterThanOrEqual: 0, GreaterThan: 1}.get(type(f))
        high = {EqualTo: 0, LessThanOrEqual: 0, LessThan: -1}.get(type(f))
        values = [v for v in f.value if v is not None] if isinstance(f, In) else []
        if low is not None or values:
            self.first = max(self.first, min(values) if values else f.value + low)
        if high is not None or values:
            at = max(values) if values else f.value + high
            self.last = at if self.last is None else min(self.last, at)

    def _opened(self):
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        return fs, at

    def partitions(self) -> list[InputPartition]:
        fs, at = self._opened()
        size = fs.get_file_info(at).size
        if size % self.frame_bytes:
            raise ValueError(f"{self.path} doesn't hold whole frames of {self.width} x {self.height}")
        last = size // self.frame_bytes - 1
        last = last if self.last is None else min(last, self.last)
        return [Run(a, min(a + self.per_partition - 1, last)) for a in range(self.first, last + 1, self.per_partition)] or [Run(0, -1)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        fs, at = self._opened()
        names = ["frame", "width", "height", "pixels"]
        with fs.open_input_file(at) as source:
            source.seek(partition.first * self.frame_bytes)
            step = max(1, BATCH_BYTES // self.frame_bytes)
            for a in range(partition.first, partition.last + 1, step):
                frames = range(a, min(a + step, partition.last + 1))
                raw = [source.read(self.frame_bytes) for _ in frames]
                raw = [P.nv12_to_rgba(r, self.width, self.height) for r in raw] if self.kind == "nv12" else raw
                n = len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.int32()), pa.array([self.width] * n, pa.int32()), pa.array([self.height] * n, pa.int32()), pa.array(raw, pa.binary())], names=names)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its conditions pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawVideo)
