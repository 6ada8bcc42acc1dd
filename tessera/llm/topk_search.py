"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's dimensions are the terms and its integer components the weights.
Candidates are dealt into blocks, queries into groups, and each pair of the
two is one task: the block's postings (rows and weights of each term) are
scattered, term by term of a query, into a dense array of scores, from which a
partial selection takes the block's best.  A window merges them by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HITS = "query_id long, vec_id long, score long"
MOST = 1 << 62  # integer components must stay below it


def usable(vector: str | Column) -> Column:
    """True for a vector that is not null and holds finite components only."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, in double precision."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of a list column, filled with zeros up to the longest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    place = np.arange(len(scores))
    if len(scores) > k:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return place[np.lexsort((ids[place], -scores[place]))][:k]


def reach(rows: np.ndarray) -> int:
    """The largest absolute component; an error if it has no exact place in 64 bits."""
    most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    if most >= MOST:
        raise ValueError("a component times the scale is 2^62 or more")
    return most


def wide_scores(query: np.ndarray, postings: list, rows: int) -> np.ndarray:
    """Scores whose sums may pass 64 bits on the way, in whole numbers of any size; an error if one ends beyond."""
    scores = np.zeros(rows, object)
    for term in np.flatnonzero(query):
        own, weight = postings[term]
        scores[own] += int(query[term]) * weight.astype(object)
    if any(not -(1 << 63) <= x < 1 << 63 for x in scores.tolist()):
        raise ValueError("a score has no place in 64 bits")
    return scores.astype(np.int64)


def _search(k: int):
    def block(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked = candidates.column("id").to_numpy(), queries.column("id").to_numpy()
        weights = matrix(candidates.column("terms"), np.int64)
        postings, most = [], reach(weights)
        for column in weights.T:
            rows = np.flatnonzero(column)
            postings.append((rows, column[rows]))
        out: tuple[list, list, list] = ([], [], [])
        scores = np.empty(len(ids), np.int64)
        asking = matrix(queries.column("terms"), np.int64)
        narrow = reach(asking) * most * len(postings) < 1 << 63
        for own, query in zip(asked, asking[:, : len(postings)], strict=True):
            if narrow:
                scores[:] = 0
                for term in np.flatnonzero(query):
                    rows, weight = postings[term]
                    scores[rows] += query[term] * weight
            else:
                scores = wide_scores(query, postings, len(ids))
            other = np.flatnonzero(ids != own)
            top = other[best(scores[other], ids[other], k)]
            out[0].append(np.full(len(top), own))
            out[1].append(ids[top])
            out[2].append(scores[top])
        cut = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(cut, names=["query_id", "vec_id", "score"])

    return block


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x).

    Ties go to the smaller id and ranks count from 1.  Rows whose vector is
    null or holds null or non-finite components, and rows without an id, take
    no part; an empty vector scores 0 with everything, and of vectors of
    unequal length the shorter is filled with zeros.  A query never meets rows
    of its own id; of several query rows of one id the least vector is asked,
    and repeated candidate rows are candidates each.  Fewer than k candidates
    give fewer ranks.  Scores are exact: a component times the scale of 2^62 or
    more, or a score beyond 64 bits, is an error.  Other columns, whatever their names, are not read.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable("v"))
        return df.select("id", quantised("v", scale).alias("terms"))

    held, asked = clean(vectors), clean(queries).groupBy("id").agg(F.min("terms").alias("terms"))
    n_blocks = max(16, -(-held.count() // block_rows))
    n_groups = max(1, -(-asked.count() // query_rows))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    left = held.withColumn("block", dealt(n_blocks)).withColumn("group", every(n_groups))
    right = asked.withColumn("group", dealt(n_groups)).withColumn("block", every(n_blocks))
    hits = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(_search(k), HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
