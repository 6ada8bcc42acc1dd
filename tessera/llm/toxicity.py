"""Toxicity scores: gradient-boosted trees over dense features, isotonic calibration.

The lexicon is a fixed seed list and units (words, word beginnings) learned
from labelled texts; trees and calibration are fitted in numpy on features of a
bounded, documented sample of labelled rows; scoring covers every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored, with_values

# Common insults, second-person words and look-alike characters.
SEED = "bastard clown crap creep disgusting dumb dumbass fool idiot imbecile jerk loser lowlife moron pathetic pig scum shit stupid trash ugly worthless".split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch sie tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo".split())
LOOKALIKE = str.maketrans("013457@$!*", "oleastasi ")

SAMPLE_ROWS = 20_000
LEXICON_UNITS = 600
PREFIXES = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_MIXED = re.compile(r"(?<![A-Za-z0-9@$*!.])[A-Za-z]+[0134579@$*!]+[A-Za-z]+(?![A-Za-z0-9@.])")
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
NEAR = 5


def units(text: str) -> set[str]:
    """Words of a text, and beginnings marked with ``*``."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


class Features:
    """Dense features of a text under a lexicon of units."""

    def __init__(self, lexicon: list[str]):
        self.words = {u for u in lexicon if not u.endswith("*")}
        self.begins = {n: {u[:-1] for u in lexicon if u.endswith("*") and len(u) == n + 1} for n in PREFIXES}
        self.seed = frozenset(SEED)

    def hit(self, word: str) -> bool:
        return word in self.seed or word in self.words or any(word[:n] in known for n, known in self.begins.items())

    def row(self, text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        counts = Counter(words)
        n = max(1, len(words))
        found = {w: c for w, c in counts.items() if self.hit(w)}
        hits = sum(found.values())
        asked = sum(counts[w] for w in SECOND_PERSON if w in counts)
        near = 0
        if hits and asked:
            at = np.array([i for i, w in enumerate(words) if w in found])
            you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
            after = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(after, len(you) - 1)] - at), np.abs(you[np.maximum(after - 1, 0)] - at))
            near = int((gap <= NEAR).sum())
        letters = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        size = max(1, int(letters.sum()))
        mixed = _MIXED.findall(text)
        hidden = sum(self.hit(w.lower().translate(LOOKALIKE)) for w in mixed)
        return [
            hits / n,
            np.log1p(hits),
            len(found),
            sum(c for w, c in found.items() if w in self.seed) / n,
            asked / n,
            near / n,
            letters[65:91].sum() / max(1, letters[_LETTERS].sum()),
            len(_SHOUT.findall(text)) / n,
            letters[33] / n,
            letters[63] / n,
            letters[_SIGNS].sum() / size,
            letters[48:58].sum() / size,
            len(mixed) / n,
            np.log1p(hidden),
        ]

    def table(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(x or "") for x in texts], dtype=np.float64).reshape(len(texts), -1)


@dataclass
class Boosted:
    """Trees of logistic gradient boosting on binned features, kept as arrays."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature (-1: leaf), bin, value; children of i: 2i + 1, 2i + 2

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out = self.bins(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                rows = np.flatnonzero(inner)
                at = node[rows]
                node[rows] = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, n_bins: int = 32, least: int = 5, ridge: float = 1.0) -> Boosted:
    """Fit trees by second-order logistic boosting; without both classes there are none."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else [np.zeros(0)] * x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(edges, float(np.log(share / (1 - share))), [])
    if len(np.unique(y)) < 2:
        return model
    binned, score = model.bins(x), np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for at in range(size):
            rows = np.flatnonzero(node == at)
            if not len(rows):
                continue
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value[at] = rate * total_g / (total_h + ridge)
            if at >= 2**depth - 1 or len(rows) < 2 * least:
                continue
            best = 1e-6
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                gain[(left_n < least) | (len(rows) - left_n < least)] = 0
                if gain.max() > best:
                    best, feature[at], cut[at] = gain.max(), j, int(gain.argmax())
            if feature[at] >= 0:
                node[rows] = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
        score += value[node]
        model.trees.append((feature, cut, value))
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit: (scores, values) to interpolate between."""
    if not len(score):
        return np.zeros(1), np.full(1, 0.5)
    places, which = np.unique(score, return_inverse=True)
    weight, total = np.bincount(which).astype(float), np.bincount(which, y)
    stack: list[list[float]] = []
    for i in range(len(places)):
        stack.append([total[i], weight[i], i])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            t, w, i0 = stack.pop()
            stack[-1][0] += t
            stack[-1][1] += w
            stack[-1][2] = i0
    ends = np.array([int(s[2]) for s in stack])
    starts = np.concatenate(([0], ends[:-1] + 1))
    values = np.array([s[0] / s[1] for s in stack])
    return np.stack((places[starts], places[ends]), axis=1).ravel(), np.repeat(values, 2)


@dataclass
class Model:
    features: Features
    trees: Boosted
    at: np.ndarray
    value: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return np.clip(np.interp(self.trees.raw(self.features.table(texts)), self.at, self.value), 0, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no part of the model may learn from: crc32 of the id as text, mod 3, is 1."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, label = [], []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = units(text or "")
            out += own
            label += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(label, pa.int64())], names=["unit", "label"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon_units: int = LEXICON_UNITS, evidence: float = 20.0) -> Model:
    """Learn from the sample_rows labelled rows (outside held_out) of least hash.

    Rows without a label or an id are left out; an id labelled more than once
    counts as toxic if any label does.  Units enter the lexicon by a
    likelihood-ratio statistic of at least `evidence`.  Without labels the
    model knows the seed words only and scores everything alike.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("long").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    # the sample is bounded by sample_rows rows of two integers
    sample = texts.join(F.broadcast(known), "id").select("text", "label", F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)).alias("part"))
    sample = stored(sample, "labelled")  # read three times
    taught = sample.where("part <> 0")  # what calibration uses must not shape the features
    total = taught.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    n, toxic = total["n"], total["t"]
    lexicon: list[str] = []
    if 0 < toxic < n:
        seen = taught.select("text", "label").mapInArrow(_unit_rows, "unit string, label long").groupBy("unit").agg(F.count("*").alias("n"), F.sum("label").alias("t"))
        share, a, b = toxic / n, F.col("t"), F.col("n") - F.col("t")
        ratio = 2 * (a * F.log(F.greatest(a, F.lit(1)) / F.col("n") / share) + b * F.log(F.greatest(b, F.lit(1)) / F.col("n") / (1 - share)))
        picked = seen.where((F.col("t") >= 3) & (F.col("t") > F.col("n") * max(0.6, share))).withColumn("g", ratio).where(F.col("g") >= evidence)
        lexicon = [r["unit"] for r in picked.orderBy(F.desc("g"), "unit").limit(lexicon_units).collect()]
    features = Features(lexicon)
    width = len(features.row(""))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features.table(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "label", "part"])

    rows = sample.mapInArrow(measure, "x array<double>, label long, part long").toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, width)
    y, part = rows.column("label").to_numpy().astype(float), rows.column("part").to_numpy()
    order = np.lexsort((*x.T, y, part))  # the same whatever order tasks end in
    x, y, part = x[order], y[order], part[order]
    trees = boost(x[part != 0], y[part != 0])
    at, value = isotonic(trees.raw(x[part == 0]), y[part == 0])
    if not len(np.unique(y)) == 2:
        at, value = np.zeros(1), np.full(1, float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0)
    return Model(features, trees, at, value)


def with_score(docs: DataFrame, model: Model, column: str, text_col: str = "text") -> DataFrame:
    """docs and a column with the calibrated probability that the text is toxic."""
    return with_values(docs, column, lambda texts: model.score(texts.to_pylist()), text_col)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    A null text is scored as an empty one, a null id is held out of nothing and
    stays null; repeated rows give repeated results.  Only the text enters the
    score: columns of other names are not read.
    """
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), fit(docs, labels, **fitting), "score")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
