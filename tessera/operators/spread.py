"""Joins of many rows with few where one key may hold a large part of the many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = "spark.tessera.splitCrowdedKeys"
PARTS = 1024  # a key of more than this part of all rows is crowded
LEAST = 1 << 12  # rows that a part has on average at least


def crowded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., parts) of the crowded keys: fewer than PARTS keys and 2 PARTS parts, whatever the input."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).scalar()
    parts = F.least(F.col("n") * PARTS / total, F.col("n") / LEAST)
    return counted.where(parts > 1).select(*keys, F.ceil(parts).cast("int").alias("parts"))


def dealt(many: DataFrame, few: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part, which is to be joined on as well: rows of a crowded key of many
    by their values and the partition that they come from, so that copies part too, and those
    of few once for each part.  Any other key is one part."""
    split = F.broadcast(crowded(many, keys))
    place = F.pmod(F.xxhash64(F.spark_partition_id(), *many.columns), F.col("parts")).cast("int")
    left = many.join(split, keys, "left").withColumn("part", F.coalesce(place, F.lit(0))).drop("parts")
    each = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return left, few.join(split, keys, "left").withColumn("part", F.explode(each)).drop("parts")


def meet(many: DataFrame, few: DataFrame, keys: list[str], split: bool | None = None) -> DataFrame:
    """many joined to few on keys; with split, crowded keys are dealt over several tasks.


    The rows are the same either way; a null key meets nothing.  Splitting reads many twice more to count
    its keys, so it is asked for: by split or, where that is None, by the
    session's setting SPLIT.
    """
    if split is None:
        split = many.sparkSession.conf.get(SPLIT, "false").lower() == "true"
    if not split:
        return many.join(few, keys)
    left, right = dealt(many, few, keys)
    return left.join(right, [*keys, "part"]).drop("part")
