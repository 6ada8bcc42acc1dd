"""Quality: a document classifier combined with site posteriors, hierarchical empirical Bayes.

Each document has its own evidence, the log-odds of a logistic regression over
shape features.  Hosts, and paths within hosts, have a Beta posterior of their
share of good documents, from grouped sums of that evidence over all
documents; the strength of each level's prior is estimated from how much the
groups differ, so sparse sites shrink towards their host and sparse hosts
towards the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored, with_values
from tessera.llm.words import blocks, text_bytes

SAMPLE_ROWS = 20_000
_ROWS = 512
_UNIT = 1_000_000  # shares are summed as whole millionths, so that sums don't depend on their order
_SENTENCE = np.zeros(256, bool)
_SENTENCE[list(b".,;:'\"()?-")] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SIGN &= ~_SENTENCE
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def shape(column: pa.Array) -> np.ndarray:
    """Features of each text: shares of capitals, odd signs, sentence signs and
    digits, share of distinct words, mean word length, and log of its words."""
    if len(column) > _ROWS:
        return np.concatenate([shape(column.slice(at, _ROWS)) for at in range(0, len(column), _ROWS)])
    raw, offsets = text_bytes(column)
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    out = np.zeros((len(size), 8))
    for j, wanted in enumerate((_UPPER, _SIGN, _SENTENCE, _DIGIT)) if len(full) else ():
        out[full, j] = np.add.reduceat(wanted[raw], offsets[full], dtype=np.int64) / size[full]
    for block in blocks(column, fold=True):
        n = np.diff(block.bounds)
        row = block.row_of_word()
        order = np.lexsort((block.hashes, row))
        h, r = block.hashes[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        distinct = np.bincount(r[new], minlength=block.rows)
        letters = np.bincount(row, block.end - block.start, minlength=block.rows)
        at = slice(block.first, block.first + block.rows)
        out[at, 4] = distinct / np.maximum(n, 1)
        out[at, 5] = np.minimum(letters / np.maximum(n, 1), 40)
        out[at, 6] = np.log1p(n)
        out[at, 7] = out[at, 4] * out[at, 6]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised columns: (mean, scale, weights)."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps if len(np.unique(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """Function of an array of texts: their log-odds of quality, fitted on the sample_rows
    labelled rows of least hash (0 throughout without labels of both kinds)."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("long").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(shape(batch.column(0))), pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    # the sample is bounded by sample_rows rows of two integers
    rows = texts.join(F.broadcast(known), "id").select("text", "label").mapInArrow(measure, "x array<double>, label long").toArrow()
    x, y = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, 8), rows.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    mean, scale, w = logistic(x[order], y[order])

    def log_odds(texts: pa.Array) -> np.ndarray:
        return np.clip(w[0] + ((shape(texts) - mean) / scale) @ w[1:], -30, 30)

    return log_odds


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _bounded(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, shift) from rows of (host, path, log_odds), host and path not null.

    shift is what a path's posterior adds to a document's log-odds.  A level's
    prior strength is m(1 - m)/v - 1, between 1 and 10,000, m and v being the
    mean and the variance between the groups' shares beyond their own noise.
    """
    p = F.round(_UNIT / (1 + F.exp(-F.col("log_odds")))).cast("long")
    paths = stored(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")).withColumn("s", F.col("s") / _UNIT), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")

    m = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    if m is None:
        return paths.select("host", "path", F.lit(0.0).alias("shift"))
    m = min(max(m, 1e-6), 1 - 1e-6)

    def strength(groups: DataFrame, about: Column) -> float:
        gap = F.col("s") / F.col("n") - about
        v, noise = groups.agg(F.sum(F.col("n") * gap * gap) / F.sum("n"), F.count("*") / F.sum("n")).first()
        return min(max(m * (1 - m) / max(v - m * (1 - m) * noise, 1e-9) - 1, 1.0), 1e4)

    k_host = strength(hosts, F.lit(m))
    k_path = strength(paths.join(hosts.select("host", (F.col("s") / F.col("n")).alias("of_host")), "host"), F.col("of_host"))
    of_host = hosts.select("host", ((F.col("s") + k_host * m) / (F.col("n") + k_host)).alias("of_host"))
    of_path = _bounded((F.col("s") + k_path * F.col("of_host")) / (F.col("n") + k_path))
    return stored(paths.join(of_host, "host").select("host", "path", (_logit(of_path) - float(np.log(m / (1 - m)))).alias("shift")), "sites")


def with_posterior(docs: DataFrame, labels: DataFrame, column: str, host: str = "source", path: str = "lang", text_col: str = "text", keep_text: bool = True, **fitting) -> DataFrame:
    """docs and a column with the posterior probability that the document is good.

    Null hosts and paths form a group of their own, null texts count as empty,
    repeated rows count each.  Every column of docs is kept as it is (without
    keep_text, all but the text).  Each text is measured once: rows and their
    evidence are a stored table, of which the sites' sums read three columns.
    """
    log_odds = fit(docs.select("doc_id", F.col(text_col).alias("text")), labels, **fitting)
    own = f"__log_odds_{column}"
    measured = with_values(docs, own, log_odds, text_col)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    measured = stored(measured.select(*kept, own), "evidence")
    keys = {f"__{level}_{column}": F.coalesce(F.col(c).cast("string"), F.lit("\0")) for level, c in (("host", host), ("path", path))}
    keyed = measured.withColumns(keys)
    sites = site_posteriors(keyed.select(*(F.col(k).alias(level) for k, level in zip(keys, ("host", "path"), strict=True)), F.col(own).alias("log_odds")))
    sites = sites.select(F.col("host").alias(f"__host_{column}"), F.col("path").alias(f"__path_{column}"), F.col("shift").alias(f"__shift_{column}"))
    joined = keyed.join(sites, list(keys), "left")
    total = F.col(own) + F.coalesce(F.col(f"__shift_{column}"), F.lit(0.0))
    return joined.select(*kept, (1 / (1 + F.exp(-total))).alias(column))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, score, keep) of every row: keep where the posterior is at least threshold."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in (options.get("host", "source"), options.get("path", "lang"))))
    scored = with_posterior(thin, labels, "score", keep_text=False, **options)
    return scored.select("doc_id", "score", (F.col("score") >= threshold).alias("keep"))
