"""Removal of passages that an earlier document has, by prefix-partitioned suffix trees.

A suffix starts at every word.  Only suffixes whose first `window` words occur
in two documents matter, and all of them hold a common anchor: the least of the
window's hashed word runs.  Anchors are exchanged first, so that of all other
suffixes nothing is.  The suffixes left are dealt into memory-sized groups by a
prefix of variable length, which ends with the anchor: all prefixes that end
with the same run of words are of one group, so suffixes that start at adjacent
words mostly travel together, as one segment of text.  Where many suffixes hold
an anchor, the prefix is lengthened to `window` words.  Each group sorts its
suffixes by prefix doubling and takes the common prefixes of neighbours in that
order; the intervals of neighbours with `window` common words or more are the
deep internal nodes of the group's tree, and of the documents below such a node
the least keeps the passage.  Segments end where the anchor changes, so a long
repeat is a chain of nodes, put together again in the rows: the passages
reported are maximal runs of words below such nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Block, blocks, mix, sequences, sliding_min

ANCHOR = 5
LEAST_CELLS, MOST_CELLS = 1 << 14, 1 << 22  # of counted anchors; 8 bytes each
_FLUSH = 1 << 20
_NONE = -(1 << 63)
_U = np.uint64
_PART = "part int, h binary, doc binary"
_REPLY = "grp int, h binary, doc binary"
_SEGMENTS = "part int, h binary, doc binary, size binary, words binary, bytes long"


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return doc % 1000003 * 7919 % groups


def group_of(doc: Column, groups: int) -> Column:
    """The group of documents that an id belongs to, as _group has it."""
    return F.pmod(F.pmod(doc, F.lit(1000003)) * 7919, F.lit(groups)).cast("int")


def _anchors(block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window of a block, and which windows are of one row."""
    h, ok = sequences(block, window)
    if not len(h):
        return h, ok
    run, _ = sequences(block, ANCHOR)
    return sliding_min(run, window - ANCHOR + 1)[: len(h)], ok


def _unique(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document) entries in order, and which are a hash's first."""
    by = np.lexsort((doc, h))
    h, doc = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    return h, doc, first


class _Mail:
    """Collects (anchor, document) entries of a task and sends them off in parcels:
    questions by part, and answers that the task itself can give by -1 - group."""

    def __init__(self, groups: int, parts: int):
        self.groups, self.parts, self.held = groups, parts, 0
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, h: np.ndarray, doc: np.ndarray) -> None:
        self.entries.append((h, doc))
        self.held += len(h)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        h, doc, first = _unique(*(np.concatenate(x) for x in zip(*self.entries, strict=True)))
        self.entries, self.held = [], 0
        part = ((h >> _U(24)) % _U(self.parts)).astype(np.int64)
        asks = first.copy()
        asks[1:] |= first[:-1] & ~first[1:]  # two documents of a task tell the others that they share; the rest is answered here
        yield _parcels(np.where(asks, part, -1 - _group(doc, self.groups)), h, doc)


def _parcels(part: np.ndarray, h: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """One row for each part: hashes, and documents as steps from one to the next."""
    by = np.lexsort((h, doc, part))
    part, h, doc = part[by], h[by], doc[by]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    parcels = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        steps = np.diff(doc[a:b])
        kind = "<u4" if not len(steps) or steps.max() < 1 << 32 else "<u8"
        parcels.append((int(part[a]), h[a:b].tobytes(), int(doc[a]).to_bytes(8, "little", signed=True) + steps.astype(kind).tobytes()))
    parts, hashes, docs = zip(*parcels, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(hashes, pa.binary()), pa.array(docs, pa.binary())], names=["part", "h", "doc"])


def _open(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    hashes, docs = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for h, steps in zip(table.column("h").to_pylist(), table.column("doc").to_pylist(), strict=True):
        hashes.append(np.frombuffer(h, _U))
        wide = (len(steps) - 8) == (len(hashes[-1]) - 1) * 8 and len(hashes[-1]) > 1
        step = np.frombuffer(steps, "<u8" if wide else "<u4", offset=8).astype(np.int64)
        docs.append(int.from_bytes(steps[:8], "little", signed=True) + np.concatenate(([0], np.cumsum(step))))
    return np.concatenate(hashes), np.concatenate(docs)


_EMPTY = {"h": pa.array([], pa.binary()), "doc": pa.array([], pa.binary())}


def _told(grp: np.ndarray, h: np.ndarray, doc: np.ndarray) -> pa.Table:
    if not len(h):
        return pa.table({"grp": pa.array([], pa.int32())} | _EMPTY)
    return pa.Table.from_batches([_parcels(grp, h, doc)]).rename_columns(["grp", "h", "doc"])


def _sharing(groups: int):
    """Of a part's anchors the documents to tell: all that share one."""

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, doc = _open(table)
        part = key[0].as_py()
        if part < 0:
            return _told(np.full(len(h), -1 - part), h, doc)
        h, doc, first = _unique(h, doc)
        shared = ~first
        shared[:-1] |= first[:-1] & ~first[1:]
        return _told(_group(doc[shared], groups), h[shared], doc[shared])

    return answer


def suffix_tree(words: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of `least` words or more in order, and the common prefix of each with the next.

    words are those of all segments in a row, left how many words of its segment
    start at each.  Both together are the tree: its internal nodes of depth d
    are the longest intervals whose common prefixes are d or more, with one of d.
    """
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    depth, deepest = 1, int(left.max(initial=0))
    while depth < deepest:  # a rank tells the first `depth` words apart; 0 is the end of a segment
        then = np.zeros(len(rank), np.int64)
        then[:-depth] = np.where(left[:-depth] > depth, rank[depth:], 0)
        kinds, rank = np.unique(rank * (len(rank) + 1) + then, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        depth *= 2
        if len(kinds) == len(rank):
            break
    at = np.flatnonzero(left >= least)
    at = at[np.argsort(rank[at], kind="stable")]
    common = np.zeros(max(len(at) - 1, 0), np.int64)
    alike, depth = np.arange(len(common)), 0
    while len(alike):
        alike = alike[np.minimum(left[at[alike]], left[at[alike + 1]]) > depth]
        alike = alike[words[at[alike] + depth] == words[at[alike + 1] + depth]]
        depth += 1
        common[alike] = depth
    return at, common


def deep_nodes(common: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order the number of the topmost node of depth `least` or more that it is below."""
    return np.concatenate(([0], np.cumsum(common < least)))


def _repeated(groups: int, window: int):
    """Of a group of suffixes the documents to tell: those below a deep node but the least."""

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part < 0:
            h, doc = _open(table)
            return _told(np.full(len(h), -1 - part), h, doc)
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("doc").to_pylist()])
        sizes = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("size").to_pylist()])
        codec = pa.Codec("zstd")
        data = b"".join(codec.decompress(w, n, asbytes=True) for w, n in zip(table.column("words").to_pylist(), table.column("bytes").to_pylist(), strict=True))
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        block = next(blocks(texts, block_bytes=1 << 62))
        row = block.row_of_word()
        left = block.bounds[row + 1] - np.arange(len(row))
        at, common = suffix_tree(block.hashes, left, window)
        node, doc = deep_nodes(common, window), docs[row[at]]
        start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        told = doc > np.minimum.reduceat(doc, start)[node]
        h, _ = sequences(block, window)
        h, doc, _ = _unique(h[at[told]], doc[told])
        return _told(_group(doc, groups), h, doc)

    return answer


def _ask_anchors(window: int, groups: int, parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = _Mail(groups, parts)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for block in blocks(batch.column("text")):
                anchor, ok = _anchors(block, window)
                row = block.first + block.row_of_word()[: len(anchor)]
                new = ok.copy()
                new[1:] &= (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
                mail.add(anchor[new], ids[row[new]])
                if mail.held >= _FLUSH:
                    yield from mail.flush()
        yield from mail.flush()

    return ask


def _count_anchors(window: int, cells: int):
    """How many suffixes have an anchor, by cell of anchors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                anchor, ok = _anchors(block, window)
                total += np.bincount((anchor[ok] % _U(cells)).astype(np.int64), minlength=cells)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["cell", "n"])

    return count


def _member(h: np.ndarray, row: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which (row, hash) pairs are among the known ones, by one mixed value of both."""
    if not len(h) or not len(known[0]):
        return np.zeros(len(h), bool)
    with np.errstate(over="ignore"):
        asked = mix(h + mix(row.astype(_U)))
        held = np.sort(mix(known[0] + mix(known[1].astype(_U))))
    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    return held[at] == asked


def _replies(table: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows that the answers of a group name; rows of one id get the same."""
    h, doc = _open(table)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    lo, hi = np.searchsorted(sorted_ids, doc, "left"), np.searchsorted(sorted_ids, doc, "right")
    many = hi - lo
    at = np.arange(many.sum()) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.repeat(lo, many) if len(many) else np.zeros(0, np.int64)
    return np.repeat(h, many), order[at.astype(np.int64)]


def _segments(part: np.ndarray, doc: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """One row for each part: the documents, sizes and compressed texts of its segments."""
    by = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], part[by][1:] != part[by][:-1], [True])))
    codec, rows = pa.Codec("zstd", compression_level=1), []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = [texts[i] for i in by[a:b].tolist()]
        data = b"".join(own)
        rows.append((int(part[by[a]]), b"", doc[by[a:b]].tobytes(), np.array([len(x) for x in own], np.int32).tobytes(), codec.compress(data, asbytes=True), len(data)))
    return _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    types = [("part", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("size", pa.binary()), ("words", pa.binary()), ("bytes", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def _deal_suffixes(window: int, groups: int, parts: int, limit: int, counts):
    """Suffixes whose anchor is shared, as segments of text, by the group of their prefix.

    Of equal windows in this group of documents the least document's is dealt,
    the others are answered here.
    """

    def deal(docs: pa.Table, answers: pa.Table) -> pa.Table:
        weight = counts.value
        ids = docs.column("id").to_numpy()
        known = _replies(answers, ids)
        held: list[tuple[Block, np.ndarray, np.ndarray, np.ndarray]] = []  # block, places, window hashes, documents
        for block in blocks(docs.column("text")) if len(known[0]) else ():
            anchor, ok = _anchors(block, window)
            row = block.first + block.row_of_word()[: len(anchor)]
            inside = (known[1] >= block.first) & (known[1] < block.first + block.rows)
            keep = np.flatnonzero(ok & _member(anchor, row, (known[0][inside], known[1][inside])))
            if len(keep):
                held.append((block, keep, sequences(block, window)[0][keep], ids[row[keep]]))
        if not held:
            return pa.Table.from_batches([_batch([])])
        h, doc = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        by = np.lexsort((doc, h))
        first = np.concatenate(([True], h[by][1:] != h[by][:-1]))
        least = doc[by][np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
        asks = np.zeros(len(by), bool)
        asks[by[first]] = True
        later = by[doc[by] != least]
        part_of, doc_of, texts, at = [], [], [], 0
        for block, keep, hashes, owner in held:
            own = asks[at : at + len(keep)]
            at += len(keep)
            place, hashes, owner = keep[own], hashes[own], owner[own]
            if not len(place):
                continue
            anchor = _anchors(block, window)[0][place]
            many = weight[(anchor % _U(len(weight))).astype(np.int64)] > limit
            prefix = mix(np.where(many, hashes, anchor))
            new = np.concatenate(([True], (place[1:] != place[:-1] + 1) | (prefix[1:] != prefix[:-1])))
            begin, end = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(place)) - 1
            raw = block.data.tobytes()
            texts += [raw[a:b] + b" " for a, b in zip(block.start[place[begin]].tolist(), block.end[place[end] + window - 1].tolist(), strict=True)]
            part_of.append((prefix[begin] % _U(parts)).astype(np.int64))
            doc_of.append(owner[begin])
        out = [_segments(np.concatenate(part_of), np.concatenate(doc_of), texts)]
        if len(later):
            h, doc, _ = _unique(h[later], doc[later])
            told = _parcels(-1 - _group(doc, groups), h, doc).to_pydict()
            out.append(_batch([(*x, b"", b"", 0) for x in zip(told["part"], told["h"], told["doc"], strict=True)]))
        return pa.Table.from_batches(out)

    return deal


def _remove(window: int, columns: list[str], rejoin: bool):
    """The rows of a group without their repeated passages."""

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids = docs.column("id").to_numpy()
        known = _replies(answers, ids)
        n_words, n_removed, kept, spans = [], [], [], []
        text = docs.column("text").combine_chunks() if isinstance(docs.column("text"), pa.ChunkedArray) else docs.column("text")
        hit = np.zeros(len(ids), bool)
        hit[known[1]] = True
        for at in range(0, len(ids), 64):
            part = text.slice(at, 64)
            texts = part.to_pylist()
            words_of = [x.encode().split() if x is not None else [] for x in texts]
            flags: dict[int, np.ndarray] = {}
            wanted = np.flatnonzero(hit[at : at + 64])
            if len(wanted):
                for block in blocks(part.take(pa.array(wanted))):
                    h, ok = sequences(block, window)
                    row = at + wanted[block.first + block.row_of_word()[: len(h)]]
                    inside = np.isin(known[1], np.unique(row))
                    gone = np.flatnonzero(ok & _member(h, row, (known[0][inside], known[1][inside])))
                    step = np.zeros(len(block.hashes) + 1, np.int64)
                    np.add.at(step, gone, 1)
                    np.add.at(step, np.minimum(gone + window, len(block.hashes)), -1)
                    cover = np.cumsum(step)[:-1] > 0
                    for i in range(block.rows):
                        flags[int(wanted[block.first + i])] = cover[block.bounds[i] : block.bounds[i + 1]]
            for i, words in enumerate(words_of):
                cover = flags.get(i)
                n_words.append(len(words))
                if cover is None or not cover.any():
                    n_removed.append(0)
                    spans.append([])
                    kept.append(b" ".join(words).decode() if rejoin else texts[i])
                    continue
                n_removed.append(int(cover.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(np.int8), [0]))))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                kept.append(b" ".join([w for w, c in zip(words, cover.tolist(), strict=True) if not c]).decode())
        other = [docs.column(c) for c in columns]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([*other, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)], names=[*columns, "n_words", "n_removed", "kept", "passages"])

    return remove


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", rejoin: bool = True, group_rows: int = 2000, group_bytes: int = 4 << 20, most_suffixes: int = 1000) -> DataFrame:
    """docs' columns and n_words, n_removed, kept and passages.

    Words are runs of other than ASCII white space.  Every word is removed that
    a window of `window` consecutive words covers whose sequence also starts in
    a document of a smaller id, windows being judged on the input.  kept is the
    rest, joined by one space (without rejoin, a text that loses nothing is kept as
    it is); passages are the removed ranges of words.  A null text has no words; a null id is no document's
    neighbour and keeps everything; rows of one id are parts of one document.
    Anchors that at least most_suffixes windows have (more in large inputs) get
    longer prefixes.  Words are compared by 64-bit hashes each, so a false match
    needs two words of one hash in otherwise equal windows; only within a group
    of documents are windows compared by one hash.
    Columns of docs that have the names of the new ones are replaced.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", "passages")]
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    groups, parts = max(128, -(-n // group_rows), -(-size // group_bytes)), max(256, -(-n // 1000), -(-size // (group_bytes // 2)))
    own = [f"c{i}" for i in range(len(columns))]
    doc_id = F.col(id_col).cast("long")
    keyed = docs.select(
        F.coalesce(doc_id, F.lit(_NONE)).alias("id"),
        F.when(doc_id.isNotNull(), group_of(doc_id, groups)).otherwise(F.pmod(F.xxhash64(F.col(text_col)), F.lit(groups))).cast("int").alias("grp"),
        F.col(text_col).alias("text"),
        *(F.col(c).alias(o) for c, o in zip(columns, own, strict=True) if c != text_col),
    )
    named = keyed.where(F.col("id") != _NONE)
    size_of = min(max(1 << (16 * parts - 1).bit_length(), LEAST_CELLS), MOST_CELLS)
    cells = named.select("text").mapInArrow(_count_anchors(window, size_of), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weight = np.zeros(size_of, np.int64)
    weight[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    total = int(weight.sum())
    limit = max(most_suffixes, total // parts, 8 * total // size_of)
    counts = spark.sparkContext.broadcast(weight)  # at most MOST_CELLS values, whatever the input

    def grouped(df: DataFrame):
        return df.groupBy("grp")

    anchors = named.select("id", "grp", "text").mapInArrow(_ask_anchors(window, groups, parts), _PART).groupBy("part").applyInArrow(_sharing(groups), _REPLY)
    suffixes = grouped(keyed).cogroup(grouped(anchors)).applyInArrow(_deal_suffixes(window, groups, parts, limit, counts), _SEGMENTS)
    repeats = suffixes.groupBy("part").applyInArrow(_repeated(groups, window), _REPLY)
    others = [o for c, o in zip(columns, own, strict=True) if c != text_col]
    fields = ", ".join([*(f"{o} {keyed.schema[o].dataType.simpleString()}" for o in others), "n_words long, n_removed long, kept string, passages array<struct<start:long,end:long>>"])
    done = grouped(keyed).cogroup(grouped(repeats)).applyInArrow(_remove(window, others, rejoin), fields)
    back = [F.col(o).alias(c) for c, o in zip(columns, own, strict=True) if c != text_col]
    return done.select(*back, "n_words", "n_removed", "kept", "passages")
