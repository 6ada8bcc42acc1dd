"""URL filter: site rules first, then a ratio of two character language models.

Both models are variable-order Markov models over the characters of host and
path, smoothed by interpolating each order with the one below.  Their counts
are exact, grouped over all URLs that a rule decides; the order of a byte's
model is that of the longest context that was seen, up to four bytes.  While
all counts take little they are broadcast; beyond, the grams that the URLs ask
are joined with them, which gives the same scores.  The threshold on the length-normalised difference of the two
log-likelihoods is calibrated on those URLs, each scored by the model of the
half that it isn't in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, stored

ORDERS = 5
SYMBOL = 9  # bits of a byte plus 1; 0 is what comes before a text
TOP = ORDERS - 1
GRAM_BYTES = 64 << 20  # of all grams' counts, 40 bytes each, that may be broadcast; beyond, they are joined
SPREAD = 4096  # keys of more than this part of all rows are broadcast in a join, so there are fewer of them than this
UNIT = 1 << 33  # logarithms are added up as whole numbers of this part, so that sums don't depend on their order
BINS = 400
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matched_rule(host: str, path: str, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict), or null.

    rules are (verdict, ``host/path``) pairs and become one expression: meant
    for up to some hundreds of them.
    """
    fits = []
    for verdict, rule in rules:
        rule_host, _, tail = rule.partition("/")
        on_host = (F.col(host) == rule_host) | F.endswith(F.col(host), F.lit("." + rule_host))
        entry = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(on_host & F.startswith(F.col(path), F.lit("/" + tail)), entry))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, ruled): the longest rule that fits and its verdict, or nulls."""
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    host, path = url_parts("url")
    urls = urls.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", matched_rule("host", "path", rules))
    return urls.select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The gram (order, bytes before, byte; exact) of each order and byte, and the rows' offsets; digits count as 0."""
    from tessera.llm.words import text_bytes

    raw, offsets = text_bytes(column)
    symbol = np.where((raw >= 48) & (raw <= 57), 48, raw.astype(np.int64)) + 1
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    found = np.zeros((ORDERS, len(raw)), np.int64)
    before = np.zeros(len(raw), np.int64)
    for order in range(ORDERS):
        if order:
            shifted = np.zeros(len(raw), np.int64)
            shifted[order:] = symbol[:-order]
            shifted[place < order] = 0
            before |= shifted << (SYMBOL * (order - 1))
        found[order] = (order << (SYMBOL * ORDERS)) | (before << SYMBOL) | symbol
    return found, offsets


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a gram is in URLs of a half and class (which: twice the half, plus 1 if accepted)."""
    for batch in _slices(batches):
        found, offsets = grams(batch.column(0))
        which = np.repeat(batch.column(1).to_numpy() * 2 + batch.column(2).to_numpy(), np.diff(offsets))
        for order in range(ORDERS):
            key, n = np.unique(found[order] * 4 + which, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 2), pa.array(key & 3), pa.array(n.astype(np.int64))], names=["gram", "which", "n"])


@dataclass
class Counts:
    """Grams in order and how often each is in each class; the same of their contexts."""

    gram: np.ndarray
    n: np.ndarray
    context: np.ndarray
    total: np.ndarray

    @staticmethod
    def of(gram: np.ndarray, n: np.ndarray) -> Counts:
        context, first = np.unique(gram >> SYMBOL, return_index=True)
        return Counts(gram, n, context, np.add.reduceat(n, first, axis=0) if len(first) else n)


def _at(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def mixed(seen: Iterable[tuple[np.ndarray, np.ndarray]], weight: float) -> np.ndarray:
    """P(byte | bytes before it) from (how often the byte was seen there, how often any) of each order, lowest first."""
    p = 1 / 256
    for n, total in seen:
        p = (n + weight * p) / (total + weight)
    return p


def chances(found: np.ndarray, counts: Counts, weight: float) -> np.ndarray:
    """P(byte | bytes before it) by class, for each column of grams; a context not seen leaves the order below."""
    if not len(counts.gram):
        return np.full((found.shape[1], counts.n.shape[1]), 1 / 256)

    def seen(order: int) -> tuple[np.ndarray, np.ndarray]:
        at, known = _at(counts.gram, found[order])
        n = np.where(known[:, None], counts.n[at], 0)
        at, known = _at(counts.context, found[order] >> SYMBOL)
        return n, np.where(known[:, None], counts.total[at], 0)

    return mixed(map(seen, range(ORDERS)), weight)


def ratio_units(p: np.ndarray) -> np.ndarray:
    """log P(accepted) - log P(rejected) in whole UNITs; p: of rejected and of accepted URLs."""
    logs = np.log(p)
    return np.rint((logs[:, 1] - logs[:, 0]) * UNIT).astype(np.int64)


def log_ratio(column: pa.Array, counts: Counts, weight: float) -> np.ndarray:
    """Mean over a text's bytes of log P(accepted) - log P(rejected); 0 for an empty text.

    counts: of rejected and of accepted URLs.
    """
    found, offsets = grams(column)
    summed = np.concatenate((np.zeros(1, np.int64), np.cumsum(ratio_units(chances(found, counts, weight)))))
    return (summed[offsets[1:]] - summed[offsets[:-1]]) / UNIT / np.maximum(np.diff(offsets), 1)


def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's columns, joined on keys; right has each key once, and in copies how many rows of left have it."""
    total = right.agg(F.sum("copies")).first()[0] or 0
    crowded = F.col("copies") * SPREAD > total
    few = right.where(crowded).drop("copies").withColumn("crowded", F.lit(True))
    both = left.join(F.broadcast(few), keys, "left")  # fewer than SPREAD rows
    rest = both.where(F.col("crowded").isNull()).select(*left.columns).join(right.where(~crowded).drop("copies"), keys, "left")
    return both.where("crowded").drop("crowded").unionByName(rest)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, gram, times): the grams of the highest order of each text, a text being the pair of hashes a, b."""
    for batch in _slices(batches, 256):
        found, offsets = grams(batch.column(2))
        row, gram = np.repeat(np.arange(len(batch)), np.diff(offsets)), found[TOP]
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))))
        times = np.diff(np.append(first, len(row)))
        a, b = (batch.column(i).to_numpy()[row[first]] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(gram[first]), pa.array(times.astype(np.int64))], names=["a", "b", "gram", "times"])


def _ratios(weight: float):
    """(gram, copies, r0, r1, r2): ratios by the models of the second half, of the first, and of both."""

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [[np.stack([batch.column(f"{kind}{order}_{i}").to_numpy() for i in range(4)], axis=1).astype(float).reshape(-1, 2, 2) for kind in "nt"] for order in range(ORDERS)]
            models = (lambda x: x[:, 1], lambda x: x[:, 0], lambda x: x.sum(axis=1))
            found = [ratio_units(mixed(((own(n), own(total)) for n, total in seen), weight)) for own in models]
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("copies"), *map(pa.array, found)], names=["gram", "copies", "r0", "r1", "r2"])

    return ratios


def joined_scores(urls: DataFrame, counts: DataFrame, weight: float) -> DataFrame:
    """urls (with chars) and r0, r1, r2: their scores by the models of the second half, of the first, and of both.

    counts (gram, n0 to n3) stay distributed.  A text's bytes are looked up by
    their grams of the highest order, as these determine those of all lower ones.
    """
    urls = urls.withColumn("a", F.xxhash64("chars")).withColumn("b", F.xxhash64(F.lit(1), "chars"))
    texts = stored(urls.groupBy("a", "b").agg(F.min("chars").alias("chars"), F.count("*").alias("copies")), "texts")
    asked = stored(texts.select("a", "b", "chars").mapInArrow(_asked, "a long, b long, gram long, times long"), "asked")
    grams_asked = asked.groupBy("gram").agg(F.count("*").alias("copies"))
    columns = [f"n{i}" for i in range(4)]
    totals = counts.groupBy(F.shiftright("gram", SYMBOL).alias("context")).agg(*(F.sum(c).alias(c) for c in columns))
    for order in range(ORDERS):
        low = F.col("gram").bitwiseAND(F.lit((1 << SYMBOL * (order + 1)) - 1))
        at = low.bitwiseOR(F.lit(order << SYMBOL * ORDERS))
        of_order = F.shiftright("gram", SYMBOL * ORDERS) == order
        n = counts.where(of_order).select(F.col("gram").alias("key"), *(F.col(c).alias(f"n{order}_{c[1]}") for c in columns))
        t = totals.where(F.shiftright("context", SYMBOL * TOP) == order).select(F.col("context").alias("key"), *(F.col(c).alias(f"t{order}_{c[1]}") for c in columns))
        for side, key in ((n, at), (t, F.shiftright(at, SYMBOL))):
            side = F.broadcast(side) if order < 2 else side  # at most 257 ** 2 rows
            grams_asked = grams_asked.withColumn("key", key).join(side, "key", "left").drop("key")
    ratios = stored(grams_asked.na.fill(0).mapInArrow(_ratios(weight), "gram long, copies long, r0 long, r1 long, r2 long"), "ratios")
    mean = [(F.sum(F.col("times") * F.col(r)) / F.lit(float(UNIT)) / F.sum("times")).alias(r) for r in ("r0", "r1", "r2")]
    scores = met(asked, ratios, ["gram"]).groupBy("a", "b").agg(*mean)
    scores = stored(texts.drop("chars").join(scores, ["a", "b"], "left").na.fill(0.0, ["r0", "r1", "r2"]), "scores")
    discard(texts, asked, ratios)
    return met(urls, scores, ["a", "b"]).drop("a", "b")


def cut_between(binned: DataFrame) -> float:
    """The threshold that parts accepted from rejected best, from (bin, accepted) of decided URLs."""
    curve = np.zeros((2, BINS))
    for row in binned.groupBy("bin", "accepted").count().collect():
        curve[row["accepted"], row["bin"]] = row["count"]
    share = curve / np.maximum(curve.sum(axis=1, keepdims=True), 1)
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(share, axis=1)), axis=1)
    balance = below[0] - below[1]  # rejected URLs below the cut, less accepted ones
    flat_top = np.flatnonzero(balance >= balance.max() - 1e-12)
    return float((flat_top[0] + flat_top[-1]) / 2 / BINS * 8 - 4)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", weight: float = 4.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    The longest rule that fits gives the verdict; else the models do, by score
    against the calibrated threshold.  A null or malformed URL has an empty
    host and path and a score of 0.  If the rules decide no URL, or all alike,
    nothing can be learned: scores are then 0 and every other URL is allowed.
    Repeated rows give repeated results; other columns are not read.  Every
    gram's counts are a stored table; they come to the driver and are broadcast
    if they take GRAM_BYTES at most, else URLs are joined with them.
    """
    spark = pages.sparkSession
    urls = ruled(pages, rules, id_col, url_col).select("page_id", "host", "path", F.concat("host", "path").alias("chars"), "rule", "ruled")
    half, accepted = F.pmod(F.xxhash64("chars"), F.lit(2)), (F.col("ruled") == "allow").cast("long")
    decided = urls.where(F.col("ruled").isNotNull()).select("chars", half.alias("half"), accepted.alias("accepted"))
    each = [F.sum(F.when(F.col("which") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(4)]
    by_gram = stored(decided.mapInArrow(_count, "gram long, which long, n long").groupBy("gram").agg(*each), "grams")
    size = by_gram.agg(F.count("*").alias("rows"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(4))).first()
    learned = bool(size["rows"]) and all(size[f"n{i}"] > 0 for i in range(4))
    threshold = 0.0

    def judged(scored: DataFrame) -> DataFrame:
        verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
        return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

    if not learned:
        discard(by_gram)
        return judged(urls.withColumn("score", F.lit(0.0)))
    if size["rows"] * 40 > GRAM_BYTES:
        scored = joined_scores(urls, by_gram, weight)
        score = F.when(half == 0, F.col("r0")).otherwise(F.col("r1"))
        place = F.least(F.greatest((score + 4) / 8 * BINS, F.lit(0.0)), F.lit(float(BINS - 1))).cast("long")
        threshold = cut_between(scored.where(F.col("ruled").isNotNull()).select(place.alias("bin"), accepted.alias("accepted")))
        discard(by_gram)
        return judged(scored.withColumnRenamed("r2", "score"))
    kept = by_gram.toArrow().sort_by("gram")
    discard(by_gram)
    n = np.stack([kept.column(f"n{i}").to_numpy() for i in range(4)], axis=1).astype(float).reshape(-1, 2, 2)
    held = spark.sparkContext.broadcast((kept.column("gram").to_numpy(), n))

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = held.value
        others = [Counts.of(gram, n[:, 1 - h]) for h in (0, 1)]
        for batch in _slices(batches):
            halves = batch.column(1).to_numpy()
            score = np.zeros(len(batch))
            for h in (0, 1):
                own = np.flatnonzero(halves == h)
                score[own] = log_ratio(batch.column(0).take(pa.array(own)), others[h], weight)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((score + 4) / 8 * BINS, 0, BINS - 1).astype(np.int64)), batch.column(2)], names=["bin", "accepted"])

    threshold = cut_between(decided.mapInArrow(crossed, "bin long, accepted long"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = held.value
        counts = Counts.of(gram, n.sum(axis=1))
        for batch in _slices(batches):
            column = batch.column(batch.schema.names.index("chars"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log_ratio(column, counts, weight))], names=[*batch.schema.names, "score"])

    return judged(urls.mapInArrow(judge, "page_id long, host string, path string, chars string, rule string, ruled string, score double"))
