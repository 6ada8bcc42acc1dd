"""How the sources of a language differ in their use of words.

Terms that enough documents of a language have are its dictionary, cut into
chunks of neighbouring terms: a sorted array of terms, in which a term's place
is its id.  Ids keep the order of UTF-8 bytes, so ties need no strings.  For
each chunk the counts of every source become a dense vector, and two sources
are compared by whole vectors, a block of sources against a block at a time.

A null text, lang or source counts as ''.  Rows are documents each, repeated
ones too; ids and other columns are not looked at.  Without documents there is
no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import discard, stored

LEAST_DOCS, TOP = 10, 10
CHUNK, BLOCK = 4096, 256  # terms of a chunk, sources of a block (on average)
HELD = 200_000  # counts that a task holds before it hands them on
PIECE = 4 << 20  # bytes of a text that are split at a time
ROWS = 65_536  # rows of whole terms that are looked at together
ONE = 1_000_000_000  # the unit of shares
_FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
COUNTS = "lang binary, source binary, term binary, n_docs long, n long"
ENCODED = "lang binary, chunk long, source binary, ids array<int>, counts array<long>, terms array<binary>"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """Runs of letters and of bytes beyond ASCII, A-Z lower-cased, some of a long text at a time."""
    text, at = raw.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if at + PIECE < len(text) else len(text)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (lang, source, term), summed within the task as far as memory allows.

    Every group has a row of the empty term, which no text has.
    """
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, all_) in held.items():
            names = [b"", *all_]
            columns = [pa.array([lang] * len(names), pa.binary()), pa.array([source] * len(names), pa.binary()), pa.array(names, pa.binary())]
            columns += [pa.array([0, *(docs[t] for t in all_)], pa.int64()), pa.array([0, *all_.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n_docs", "n"])

    for batch in batches:
        for text, lang, source in zip(*batch.columns, strict=True):
            docs, all_ = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(all_), None
            for terms in terms_of(text.as_buffer().to_pybytes()):
                all_.update(terms)
                seen = set(terms) if seen is None else seen | set(terms)
            docs.update(seen or ())
            size += len(all_) - before
            if size >= HELD:
                yield from handed()
                held, size = {}, 0
    yield from handed()


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n_docs, n), as binary: documents with a term and its occurrences."""
    bare = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    partial = bare.mapInArrow(_counted, COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def _objects(column: pa.ChunkedArray) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, lang, terms, sources, counts) of the rows whose term is frequent enough: runs of whole
    terms of one lang, from rows in the order of (lang, term)."""

    def judged(rows: tuple, runs: np.ndarray) -> Iterator[tuple]:
        lang, term, source, n_docs, n, part = rows
        keep = np.repeat(np.add.reduceat(n_docs[: runs[-1]], runs[:-1]) >= least, np.diff(runs))
        edges = np.flatnonzero(np.append(lang[1 : runs[-1]] != lang[: runs[-1] - 1], True)) + 1
        start = 0
        for end in edges:
            own = np.flatnonzero(keep[start:end]) + start
            if len(own):
                yield part, lang[start], term[own], source[own], n[own]
            start = end

    rest: pa.Table | None = None

    def rows_of(table: pa.Table) -> tuple:
        return (*(_objects(table.column(c)) for c in ("lang", "term", "source")), table.column("n_docs").to_numpy(), table.column("n").to_numpy(), table.column("part")[0].as_py())

    for batch in batches:
        if not len(batch):
            continue
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if len(rest) < ROWS:
            continue
        rows = rows_of(rest)
        starts = np.flatnonzero(np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
        if len(starts) > 1:  # the last term may go on in the next batch
            yield from judged(rows, starts)
            rest = rest.slice(starts[-1])
    if rest is not None:
        rows = rows_of(rest)
        starts = np.flatnonzero(np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
        yield from judged(rows, np.append(starts, len(rest)))


def _encoder(least: int, chunk: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each source of a chunk, and one without source that has its terms and their counts in the lang."""
        held: list[tuple] = []
        made = 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            part, lang = held[0][:2]
            term, source, n = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
            kept = np.unique(term)
            ids = np.searchsorted(kept, term)
            order = np.argsort(source, kind="stable")
            cuts = np.flatnonzero(np.append(True, source[order][1:] != source[order][:-1]))
            number = (part << 32) + made
            totals = np.bincount(ids, weights=n, minlength=len(kept)).astype(np.int64)  # exact up to 2**53
            rows = [(lang, number, None, None, totals, kept)]
            rows += [(lang, number, source[own[0]], ids[own], n[own], None) for own in np.split(order, cuts[1:])]
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "chunk", "source", "ids", "counts", "terms"])
            held, made = [], made + 1

        n_terms = 0
        for part, lang, term, source, n in _frequent(batches, least):
            starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            ends = np.append(starts[1:], len(term))
            at = 0
            while at < len(starts):
                if held and (held[0][1] != lang or n_terms >= chunk):
                    yield from closed()
                    n_terms = 0
                last = min(at + chunk - n_terms, len(starts))
                own = slice(starts[at], ends[last - 1])
                held.append((part, lang, term[own], source[own], n[own]))
                n_terms, at = n_terms + last - at, last
        if held:
            yield from closed()

    return encode


def encoded(counts: DataFrame, least: int = LEAST_DOCS, chunk: int = CHUNK) -> DataFrame:
    """Chunks of the dictionary and the counts of each source by ids; counts must be a stored table."""
    rows = counts.where(F.length("term") > 0).repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_encoder(least, chunk), ENCODED)


def share(counts: np.ndarray, total, v) -> np.ndarray:
    """1 + floor(ONE * (counts + 2) / (total + 2 v)), by long division in steps of 1000: exact up to totals of 9e15."""
    above, below = counts + 2, np.maximum(np.asarray(total, np.int64) + 2 * v, 1)
    found, rest = np.divmod(above, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        found = found * 1000 + digit
    return 1 + found


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _scorer(top: int):
    def score(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of a chunk: sums over its terms for the pairs of two blocks, and the best terms of a block's sources."""
        lang, _, a, b = (k.as_py() for k in key)
        rows = table.to_pylist()
        head = next(r for r in rows if r["size"] is not None)
        size, v, of_lang = head["size"], head["v"], head["of_lang"]
        known = sorted((s["source"], s["total"], r["block"]) for r in rows if r["members"] for s in r["members"])
        place = {s: i for i, (s, _, _) in enumerate(known)}
        dense = np.zeros((len(known), size), np.int64)
        for r in rows:
            if r["source"] is not None:
                dense[place[r["source"]]] = np.bincount(np.array(r["ids"], np.int64), weights=np.array(r["counts"], np.int64), minlength=size).astype(np.int64)
        totals, blocks = np.array([t for _, t, _ in known], np.int64), np.array([x for _, _, x in known])
        p = share(dense, totals[:, None], v)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i in range(len(known)):
            others = np.flatnonzero(blocks[i + 1 :] + blocks[i] == a + b) + i + 1
            for x, value in zip(others, apart(p[i], p[others]).sum(axis=1), strict=True):
                for c, w in zip(out, (known[i][0], "pair", known[x][0], int(value)), strict=True):
                    c.append(w)
        if a == b and size:
            q, terms = share(np.array(head["counts"], np.int64), of_lang, v), head["terms"]
            for i in range(len(known)):
                own = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                f = apart(p[i, own], q[own])
                for at in np.lexsort((own, -f))[:top]:
                    for c, w in zip(out, (known[i][0], "term", terms[own[at]], int(f[at])), strict=True):
                        c.append(w)
        source, part, item, value = out
        return pa.table({"lang": pa.array([lang] * len(source), pa.binary()), "source": pa.array(source, pa.binary()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.binary()), "value": pa.array(value, pa.int64())})

    return score


def _empty(**kinds: str) -> list[Column]:
    return [F.lit(None).cast(k).alias(c) for c, k in kinds.items()]


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank).

    part 'pair': how far each other source of the lang is; part 'term': the
    terms that set the source off from its lang most.
    """
    counts = stored(counted(docs), "terms")
    coded = stored(encoded(counts, least_docs, chunk), "chunks")
    summed = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    heads = coded.where("source is null").select("lang", "chunk", "counts", "terms", F.size("terms").alias("size"), summed.alias("n"))
    members = counts.where(F.length("term") == 0).select("lang", "source")
    own = coded.where("source is not null").groupBy("lang", "source").agg(F.sum(summed).alias("total"))
    n_sources = members.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    langs = stored(n_sources.join(heads.groupBy("lang").agg(F.sum("size").cast("long").alias("v"), F.sum("n").alias("of_lang")), "lang", "left").fillna(0, ["v", "of_lang"]), "langs")
    of = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    listed = members.join(own, ["lang", "source"], "left").join(langs, "lang").select("lang", of, F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("m"))
    listed = stored(listed.groupBy("lang", "block").agg(F.collect_list("m").alias("members")), "blocks")  # about `block` of them
    # a lang without a dictionary has one chunk of no terms
    bare = langs.where("v = 0").select("lang", F.lit(-1).cast("long").alias("chunk"), *_empty(counts="array<long>", terms="array<binary>"), F.lit(0).alias("size"))
    chunks = heads.drop("n").unionByName(bare).join(langs, "lang")
    two = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.transform(F.sequence(x, F.col("blocks") - 1), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    tasks = chunks.withColumn("two", two).select("lang", "chunk", "two.a", "two.b", "size", "v", "of_lang", *(F.when(F.col("two.a") == F.col("two.b"), F.col(c)).alias(c) for c in ("counts", "terms")))
    sides = F.explode(F.array_distinct(F.array("a", "b"))).alias("block")
    lists = tasks.select("lang", "chunk", "a", "b", sides).join(listed, ["lang", "block"])
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("a"), F.greatest(x, "block").alias("b"))))
    vectors = coded.where("source is not null").drop("terms").join(langs.select("lang", "blocks"), "lang").withColumn("block", of).withColumn("two", meets)
    nothing = {"size": "int", "v": "long", "of_lang": "long", "counts": "array<long>", "terms": "array<binary>", "block": "int", "members": listed.schema["members"].dataType.simpleString(), "source": "binary", "ids": "array<int>"}

    def alike(df: DataFrame) -> DataFrame:
        return df.select("lang", "chunk", "a", "b", *((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in nothing.items()))

    met = alike(tasks).union(alike(lists)).union(alike(vectors.select("lang", "chunk", "two.a", "two.b", "source", "ids", "counts")))
    scored = stored(met.groupBy("lang", "chunk", "a", "b").applyInArrow(_scorer(top), "lang binary, source binary, part string, item binary, value long"), "scores")
    discard(counts, coded, langs, listed)
    pairs = scored.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order))

    # apart, so that each task hands on no more than the best terms of a group
    found = ranked(pairs).unionByName(ranked(scored.where("part = 'term'")).where(F.col("rank") <= top))
    return found.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source")), "part", F.col("item").cast("string").alias("item"), "value", "rank")
