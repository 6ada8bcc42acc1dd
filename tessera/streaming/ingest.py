"""Detections and queries as streams: keyed state over frames instead of wall-clock time.

A group of pictures is a window over frame numbers; detections that arrive
late for a group still count, as every batch is merged by key.  So there is no
watermark, and state grows with the number of keys: of groups and labels in
gop_activity, of labels in label_extent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.sources.detections import SCHEMA, DetectionIndex


def read_detections(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of detections from Parquet files as they are added below path."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def into_index(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Add a stream to an index, each batch once; rows added otherwise, before or later, stay in it.

    A batch is written beside the index first.  Its files are moved there when
    all of them stand, and a batch that is repeated after a failure only moves
    what is left.
    """

    def add(batch: DataFrame, number: int) -> None:
        DetectionIndex(batch.sparkSession, path).add_once(batch, f"{checkpoint}/batches/{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append")


def gop_activity(stream: DataFrame, gop_len: int) -> DataFrame:
    """(video, label, gop, boxes, first, last): running counts of each group and label (update mode)."""
    gop = F.expr(f"cast(frame div {gop_len} as int)").alias("gop")
    return stream.groupBy("video", "label", gop).agg(F.count("*").alias("boxes"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def label_extent(stream: DataFrame) -> DataFrame:
    """(video, label, boxes, x1, y1, x2, y2): running bounding boxes of labels (update mode)."""
    return stream.groupBy("video", "label").agg(
        F.count("*").alias("boxes"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
