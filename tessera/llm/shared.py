"""What several of the operators need: tables between stages, and components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


ROW_GROUP = 16 << 20  # bytes that a Parquet writer holds


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a new one in
    a session on one machine, and an error on a cluster."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        shared_dir.own = at
    return at.rstrip("/")


def stored(df: DataFrame, what: str = "stage") -> DataFrame:
    """df written as Parquet to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables as stored() returned them, once nothing that is still to run reads them."""
    for table in tables:
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge.

    Each round gives every node the least of itself and its neighbours, jumps
    twice along those pointers and contracts the edges; the rounds needed grow
    with the logarithm of the longest path.  Only the number of edges left
    comes to the driver.  Self-loops, repeated edges and nulls are allowed.
    """
    low, high = F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")
    edges = stored(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(low, high).distinct(), "edges")
    left, moves = edges.where("a < b"), []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        for _ in range(2):
            step = to.select(F.col("a").alias("p"), F.col("p").alias("q"))
            to = to.join(step, "p").select("a", F.col("q").alias("p"))
        moves.append(stored(to, "moves"))
        of_a, of_b = moves[-1].select("a", F.col("p").alias("x")), moves[-1].select(F.col("a").alias("b"), F.col("p").alias("y"))
        moved = left.join(of_a, "a").join(of_b, "b").where("x <> y")
        left = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    label = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    for to in moves:
        label = label.join(to, F.col("component") == F.col("a"), "left").select("node", F.coalesce("p", "component").alias("component"))
    return stored(label, "labels")


def with_values(docs: DataFrame, column: str, values, text_col: str = "text", slice_rows: int = 256) -> DataFrame:
    """docs and a column of doubles, values(array of texts) of every row.

    Rows go through Python in slices of Arrow buffers, so that never more than
    slice_rows texts are Python objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), slice_rows):
                rows = batch.slice(at, slice_rows)
                found = values(rows.column(rows.schema.names.index(text_col)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.float64())], names=[*rows.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
