"""Small records as files of one JSON line, which are made once and never changed.

A folder of numbered files is a log that several writers can share: a number
belongs to whoever creates its file, as far as the file system's create without
overwriting is exclusive.  A file that its writer did not finish holds no
record and is passed over.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def create(spark: SparkSession, path: str, record: dict) -> bool:
    """Whether the file was made: not if it was there."""
    at, fs = _at(spark, path)
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if fs.exists(at):
            return False
        raise e
    out.write(bytearray(json.dumps(record).encode() + b"\n"))
    out.close()
    return True


def append(spark: SparkSession, folder: str, record: dict, at_least: int = 0) -> int:
    """Add a record under the first free number, and return that."""
    number = at_least
    while not create(spark, f"{folder}/{number}.json", record | {"number": number}):
        number += 1
    return number


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The records below a folder, with columns of schema; number is theirs."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    lines = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return lines.where(F.col("number").isNotNull())


def next_number(spark: SparkSession, folder: str) -> int:
    """The number after the greatest in a folder."""
    at, fs = _at(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return 1 + max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=-1)
