"""The semantic index: a table of labelled boxes, partitioned by video.

Rows are sorted by label and frame within files, so that row-group statistics
prune scans the way a tree index would.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geometry as G
from tessera.functions.selection import as_frames, as_labels

SCHEMA = T.StructType(
    [T.StructField("video", T.StringType(), False), T.StructField("label", T.StringType(), False)]
    + [T.StructField(c, T.IntegerType(), False) for c in ("frame", "x1", "y1", "x2", "y2")]
)
COLUMNS = SCHEMA.names
LEGACY = T.StructType([T.StructField("label", T.StringType(), False)] + [T.StructField(c, T.IntegerType(), False) for c in ("frame", "x", "y", "width", "height")])


def from_legacy(rows: DataFrame, video: str) -> DataFrame:
    """Rows given by corner and size, distinct and of one video, as detections."""
    rows = rows.select(LEGACY.names).dropDuplicates()
    return rows.select(F.lit(video).alias("video"), "label", "frame", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"))


def to_legacy(rows: DataFrame) -> DataFrame:
    return rows.select("label", "frame", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height")).dropDuplicates()


def pick(rows: DataFrame, video: str | None, labels, first: int | None = None, last: int | None = None) -> DataFrame:
    """Detections of a video (None: of all), a label selection and frames."""
    rows = rows.where(as_labels(labels).condition() & as_frames(first, last).condition())
    return rows if video is None else rows.where(F.col("video") == video)


def ordered_frames(rows: DataFrame) -> DataFrame:
    """The distinct frames, in order."""
    return rows.select("frame").distinct().orderBy("frame")


def boxes(rows: DataFrame, max_width: int = 0, max_height: int = 0) -> DataFrame:
    """rows with a column box, on even coordinates; with limits, boxes are cut at
    them and those wholly beyond are dropped."""
    if max_width:
        rows = rows.where(F.col("x1") < max_width).withColumn("x2", F.least("x2", F.lit(max_width)))
    if max_height:
        rows = rows.where(F.col("y1") < max_height).withColumn("y2", F.least("y2", F.lit(max_height)))
    return rows.withColumn("box", G.box("x1", "y1", "x2", "y2"))


class DetectionIndex:
    """Detections stored as Parquet."""

    schema = SCHEMA

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All detections; none before the first write."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def of(self, video: str) -> DataFrame:
        """The detections of a video."""
        return self.rows().where(F.col("video") == video)

    def add(self, video: str, label: str, frame: int, x1: int, y1: int, x2: int, y2: int) -> None:
        self.add_bulk([(video, label, frame, x1, y1, x2, y2)])

    def add_bulk(self, rows: DataFrame | Iterable[tuple]) -> None:
        """Append rows as one write: all of them become visible, or none."""
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame(list(rows), SCHEMA)
        self._write(rows, self.path, "append")

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA))
        rows.repartitionByRange("video", "label", "frame").sortWithinPartitions("video", "label", "frame").write.mode(mode).partitionBy("video").parquet(path)

    def add_once(self, rows: DataFrame, staged: str) -> None:
        """Append rows that may be given again under the same name: written to staged, which is kept, and moved from there."""
        java = self.spark._jvm.org.apache.hadoop.fs
        at, index = java.Path(staged), java.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(java.Path(at, "_SUCCESS")):
            self._write(rows, staged, "overwrite")
        for folder in fs.listStatus(at):
            name = folder.getPath().getName()
            if folder.isDirectory() and name.startswith("video="):
                into = java.Path(index, name)
                fs.mkdirs(into)
                for file in fs.listStatus(folder.getPath()):
                    if not file.getPath().getName().startswith((".", "_")) and not fs.rename(file.getPath(), java.Path(into, file.getPath().getName())):
                        raise OSError(f"could not move {file.getPath()}")


class MemoryIndex:
    """Detections of this session only; no files are made."""

    def __init__(self, spark: SparkSession, *_):
        self.spark, self._frames, self._single = spark, [], []

    def rows(self) -> DataFrame:
        """All detections; rows added one by one are one table, however many they are."""
        return reduce(DataFrame.union, self._frames, self.spark.createDataFrame(self._single, SCHEMA))

    def of(self, video: str) -> DataFrame:
        return self.rows().where(F.col("video") == video)

    def add(self, video: str, label: str, frame: int, x1: int, y1: int, x2: int, y2: int) -> None:
        self.add_bulk([(video, label, frame, x1, y1, x2, y2)])

    def add_bulk(self, rows: DataFrame | Iterable[tuple]) -> None:
        if isinstance(rows, DataFrame):
            self._frames.append(rows.select(COLUMNS))
        else:
            self._single += [tuple(r) for r in rows]


class LegacyIndex(DetectionIndex):
    """Distinct (label, frame, x, y, width, height) rows, which name no video: they are any video's."""

    schema = LEGACY

    def rows(self) -> DataFrame:
        """All detections, of a video of no name."""
        return self.of("")

    def of(self, video: str) -> DataFrame:
        return from_legacy(DetectionIndex.rows(self), video)

    def add_bulk(self, rows: DataFrame | Iterable[tuple]) -> None:
        """Append rows given by two corners as corner and size; their video is not kept."""
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame(list(rows), SCHEMA)
        to_legacy(rows).repartitionByRange("label", "frame").sortWithinPartitions("label", "frame").write.mode("append").parquet(self.path)


KINDS = {"xy": DetectionIndex, "memory": MemoryIndex, "legacy": LegacyIndex}


def register_kind(name: str, kind: type) -> None:
    """Let stores open indexes of a kind of one's own: a class over (spark, path) with rows, of, add and add_bulk."""
    KINDS[name] = kind


def open_index(spark: SparkSession, kind: str = "xy", path: str = "labels.parquet"):
    """An index of a kind: xy, memory, legacy, spatial, or one that was registered."""
    return KINDS[kind](spark, path)
