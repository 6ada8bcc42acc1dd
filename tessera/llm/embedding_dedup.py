"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest pivots in order.  Inverted lists, one for
each label and pivot, hold the vectors that have the pivot among their nearest;
two vectors of a list that share enough pivots are candidates, and exact
cosines verify them.  A pair is looked at in the list of its least shared
pivot only.  Equal vectors are one entry with a count.  A long list is cut into
blocks, and each pair of blocks is a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import components, stored
from tessera.llm.topk_search import matrix, usable

MOST_PIVOTS = 4096
BLOCK = 1024


def _nearest(pivots, own: int):
    """Each vector's `own` nearest pivots by cosine, ties to the smaller number."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pivots.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                rows = batch.slice(at, 1024)
                v = matrix(pa.chunked_array([rows.column(rows.schema.names.index("v"))]), np.float64)
                width = max(v.shape[1], held.shape[1])
                wide = np.pad(v, ((0, 0), (0, width - v.shape[1])))
                wide /= np.linalg.norm(wide, axis=1, keepdims=True)
                near = np.argsort(-(wide @ np.pad(held, ((0, 0), (0, width - held.shape[1]))).T), axis=1, kind="stable")[:, :own]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=[*rows.schema.names, "near"])

    return describe


def roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id reachable in a symmetric matrix of links."""
    label = ids.copy()
    while True:
        least = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(label, least)
        if (new == label).all():
            return label
        label = new


def _links(threshold: float, shared: int):
    """Of a list, or of two of its blocks: (id, links, root) of the vectors that link."""

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pivot, one, two = (key[i].as_py() for i in (2, 3, 4))
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        v = matrix(table.column("v"), np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        near = matrix(table.column("near"), np.int64)
        known, place = np.unique(near, return_inverse=True)
        has = np.zeros((len(ids), len(known)), np.float32)
        has[np.arange(len(ids))[:, None], place.reshape(near.shape)] = 1
        lower = has[:, known < pivot]
        linked = (has @ has.T >= min(shared, near.shape[1])) & (lower @ lower.T == 0) & (v @ v.T >= threshold)
        if one != two:
            side = table.column("block").to_numpy()
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        root = roots(linked, ids)
        some = np.flatnonzero(linked.any(axis=1))
        return pa.table({"id": ids[some], "links": (linked[some] @ copies).astype(np.int64), "root": root[some]})

    return meet


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, own: int = 8, shared: int = 2, rows_per_pivot: int = 200, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors of equal, non-null label and equal length link when their cosine is
    at least threshold and they share `shared` of their `own` nearest pivots;
    equal vectors always link.  Null, empty or zero vectors, ones that hold
    null or non-finite components, and rows without an id link with nothing and
    are kept; a null id has a null component.  Repeated rows count as other
    vectors.  Pivots are the vectors of least hash, one for rows_per_pivot, from
    128 to MOST_PIVOTS.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v") & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    entries = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    entries = stored(entries.withColumn("size", F.size("v")), "entries")
    n_pivots = min(MOST_PIVOTS, max(128, -(-entries.count() // rows_per_pivot)))
    chosen = [r["v"] for r in entries.orderBy(F.xxhash64("v"), "id").limit(n_pivots).select("v").collect()]
    held = np.zeros((len(chosen), max(map(len, chosen), default=1)))
    for i, v in enumerate(chosen):
        held[i, : len(v)] = np.array(v) / np.linalg.norm(v)
    pivots = spark.sparkContext.broadcast(held)  # at most MOST_PIVOTS vectors

    kind = entries.schema["label"].dataType.simpleString()
    described = entries.mapInArrow(_nearest(pivots, own), f"label {kind}, v array<double>, id long, copies long, size int, near array<int>") if chosen else entries.withColumn("near", F.array().cast("array<int>"))
    described = stored(described, "described")
    listed = described.select("*", F.explode("near").alias("pivot"))
    lengths = listed.groupBy("label", "size", "pivot").count().select("label", "size", "pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = listed.join(lengths, ["label", "size", "pivot"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("label", "size", "pivot", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "copies", "v", "near")
    found = stored(dealt.groupBy("label", "size", "pivot", "one", "two").applyInArrow(_links(threshold, shared), "id long, links long, root long"), "links")

    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    of_entry = entries.join(linked, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    of_entry = of_entry.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    plain = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = rows.where("sound").join(of_entry, ["label", "v"]).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    return done.union(plain).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
