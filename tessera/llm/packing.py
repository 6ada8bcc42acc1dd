"""Lexical retrieval packing of token sequences.

Every document is tokenised once; its full windows are sequences of their own
and what remains is dealt to a shard by content: by the least hash of its
tokens, so that two remainders meet with the chance that is their token sets'
Jaccard similarity.  The documents of a frequent least hash are dealt by a second one as
well, and those of a frequent pair by their ids, so no shard is crowded.  Each
shard builds a BM25 inverted index
over the remainders' tokens.  Seeds, longest first, ask it for neighbours; the
unused ones that fit fill the seed's window best first, and the longest unused
remainders that fit close the gap that is left; a gap that none fits takes the
head of the longest one.  A shard's last window is cut at powers of two, at
which a sequence needs no padding.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.shared import stored
from tessera.llm.words import mix

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
K1, B = 1.2, 0.75
MOST_SENT = 1 << 20  # crowded keys that may be broadcast
ADDED = {"<|endoftext|>": 50256}  # the added token of byte_bpe_50k.json, which the rank file lacks


def least_hashes(rest: np.ndarray) -> tuple[int, int]:
    """The least of a remainder's tokens under either of two hashes; 0 for none."""
    if not len(rest):
        return 0, 0
    own = rest.astype(np.uint64)
    return tuple(int(mix(own + np.uint64(seed << 32)).min() >> np.uint64(1)) for seed in (1, 2))


def _tokenised(ranks_path: str, pattern: str, window: int, end_id: int):
    """(one, two, doc_id, tokens, crcs, rest): least hashes, the checksum of each full window, and the ids of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoding(ranks_path, pattern)
        kind = _kind(max(enc.max_token_value, end_id, *ADDED.values()))
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for doc_id, text in zip(ids_of, texts, strict=True):
                codes = np.append(bpe.ids_of(text, enc, pattern, ADDED), np.array([end_id], "<u4"))
                raw = memoryview(codes.tobytes())
                full = len(codes) // window * window
                crcs = [zlib.crc32(raw[i * 4 : (i + window) * 4]) for i in range(0, full, window)]
                rows.append((*least_hashes(codes[full:-1]), doc_id, len(codes), np.array(crcs, "<u4").tobytes(), codes[full:].astype(kind).tobytes()))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["one", "two", "doc_id", "tokens", "crcs", "rest"])

    return run


class Index:
    """A BM25 inverted index of a shard's remainders, by token."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray):
        n = len(terms)
        self.n, self.terms = n, terms
        term = np.concatenate(terms) if n else np.zeros(0, np.uint32)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        tf = np.concatenate(counts).astype(np.float64) if n else np.zeros(0)
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if n else 1.0))
        order = np.argsort(term, kind="stable")
        self.known, self.at, df = np.unique(term[order], return_index=True, return_counts=True)
        self.df = df
        self.idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)  # terms of half the shard weigh nothing
        self.doc = doc[order]
        self.weight = tf[order] * (K1 + 1) / (tf[order] + norm[self.doc])

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents of a positive score, best first, ties to the smaller place."""
        own = np.searchsorted(self.known, self.terms[seed])
        own = own[self.idf[own] > 0]
        if not len(own):
            return own
        size = self.df[own]
        place = np.arange(size.sum()) + np.repeat(self.at[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        score = np.bincount(self.doc[place], np.repeat(self.idf[own], size) * self.weight[place], minlength=self.n)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def fill(sizes: np.ndarray, neighbours, window: int, least_gap: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (remainder, begin, length); neighbours(seed) ranks candidates."""
    left, begin = sizes.astype(np.int64), [0] * len(sizes)
    unused = np.ones(len(sizes), bool)
    free = sorted((int(n), -i) for i, n in enumerate(left))  # of equal length the smallest place is last
    out: list[list[tuple[int, int, int]]] = []

    def take(i: int, room: int) -> int:
        """Put as much of remainder i as there is room for into the last window; the room then left."""
        size = int(left[i])
        free.pop(bisect.bisect_left(free, (size, -i)))
        used = min(size, room)
        out[-1].append((i, begin[i], used))
        if used < size:
            begin[i] += used
            left[i] -= used
            bisect.insort(free, (size - used, -i))
        else:
            unused[i] = False
        return room - used

    for seed in np.argsort(-sizes, kind="stable").tolist():
        if not unused[seed]:
            continue
        out.append([])
        room = take(seed, window)
        if free and room >= free[0][0]:
            near = neighbours(seed)
            near = near[unused[near] & (left[near] <= room)]
            for i in near.tolist():
                if left[i] <= room:
                    room = take(i, room)
        while free and room >= free[0][0]:
            room = take(-free[bisect.bisect_left(free, (room + 1,)) - 1][1], room)
        if free and room > least_gap:
            take(-free[-1][1], room)
    return out


def halves(members: list[tuple[int, int, int]], window: int, least_gap: int) -> list[list[tuple[int, int, int]]]:
    """A window as it is if nearly full, else cut at the powers of two of its length."""
    total = sum(m[2] for m in members)
    if window - total <= least_gap:
        return [members]
    out, members = [], list(reversed(members))
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        if room:
            out.append([])
        while room:
            i, begin, size = members.pop()
            used = min(size, room)
            out[-1].append((i, begin, used))
            room -= used
            if used < size:
                members.append((i, begin + used, size - used))
    return out


def _kind(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


def _packed(window: int, least_gap: int, kind: str):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tokens", "ascending"), ("crcs", "ascending"), ("rest", "ascending")])
        ids = table.column("doc_id").to_pylist()
        tokens = table.column("tokens").to_numpy()
        crcs = [np.frombuffer(x, "<u4") for x in table.column("crcs").to_pylist()]
        rests = [np.frombuffer(x, kind) for x in table.column("rest").to_pylist()]
        left = [i for i, x in enumerate(rests) if len(x)]
        sizes = np.array([len(rests[i]) for i in left], np.int64)
        found = [np.unique(rests[i], return_counts=True) for i in left]
        index = Index([f[0] for f in found], [f[1] for f in found], sizes.astype(float))
        windows = fill(sizes, index.neighbours, window, least_gap)
        first = int(key[0].as_py()) << 40
        flat = []
        for d, own in enumerate(crcs):
            flat += [(d, n * window, window, crc, first + len(flat) + n, 0) for n, crc in enumerate(own.tolist())]
        first += len(flat)
        for members in windows:
            for cut in halves(members, window, least_gap):
                offset = 0
                for m, begin, size in cut:
                    d = left[m]
                    crc = zlib.crc32(rests[d][begin : begin + size].astype("<u4").tobytes())
                    flat.append((d, len(crcs[d]) * window + begin, size, crc, first, offset))
                    offset += size
                first += 1
        d, start, length, crc, sequence, offset = map(list, zip(*flat, strict=True))
        columns = [pa.array([ids[i] for i in d], pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens[d], sequence, offset))]
        return pa.table(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    return pack


def pack(docs: DataFrame, ranks_path: str, pattern: str, window: int = 1024, end_id: int = 0, shard_rows: int = 1000, least_gap: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    A document is its ids, with those of ADDED where their strings occur, and
    end_id; a null text counts as empty and so has
    one token.  Full windows are cut from a document's start; gaps of up to
    least_gap tokens stay.  Repeated rows and null ids are packed like others;
    other columns are not read.  A shard holds about shard_rows documents; a
    seed asks all its terms.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(_tokenised(ranks_path, pattern, window, end_id), "one long, two long, doc_id long, tokens long, crcs binary, rest binary")
    rows = stored(rows, "tokens")
    kind = _kind(max(bpe.encoding(ranks_path, pattern).max_token_value, end_id, *ADDED.values()))
    return sharded(rows, shard_rows).groupBy("shard").applyInArrow(_packed(window, least_gap, kind), PIECES)


def sharded(rows: DataFrame, shard_rows: int) -> DataFrame:
    """rows (one, two, doc_id, tokens, crcs, rest) with the shard that they are dealt to instead of their hashes."""
    shards = max(64, -(-rows.count() // shard_rows))
    most = max(1, shard_rows // 4)  # rows of one key
    pairs = stored(rows.groupBy("one", "two").agg(F.count("*").alias("pair")), "pairs")
    crowded = pairs.groupBy("one").agg(F.sum("pair").alias("single")).where(F.col("single") > most)
    # there are at most rows / most crowded hashes, and as many crowded pairs
    parts = pairs.where(F.col("pair") > most).select("one", "two", F.ceil(F.col("pair") / most).alias("parts"))

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= MOST_SENT else df

    met = rows.join(sent(crowded), "one", "left").join(sent(parts), ["one", "two"], "left")
    spread = F.pmod(F.xxhash64("doc_id", "tokens", "rest"), F.coalesce("parts", F.lit(1)))
    key = F.xxhash64("one", F.when(F.col("single").isNotNull(), F.col("two")).otherwise(0), spread)
    return met.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), "doc_id", "tokens", "crcs", "rest")
