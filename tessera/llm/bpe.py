"""Byte-level BPE encoding and decoding of whole texts.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel.
The split pattern looks only to the right, so once two neighbours have a
pre-token boundary in common they agree from there on: the first common
boundary in the overlap is where they are stitched, and the piece between two
stitches is encoded by itself.  A text of one chunk has nothing to stitch, one
of some chunks is stitched where it is read, and the chunks of a very long one
are dealt over the cluster.  Decoding concatenates the ids' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CODES = "doc_id long, n_tokens long, ids binary, decoded binary"


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file (a base64 token and its rank in each line)."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _compiled(pattern: str):
    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> list[int]:
    """Where the pre-tokens of text start."""
    return [m.start() for m in _compiled(pattern).finditer(text)]


def parts(text: str, pattern: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in pieces of about size characters that can be encoded one by one."""
    start, step = 0, size
    while len(text) - start > step:
        at = boundaries(text[start : start + step], pattern)[1:-2]  # the last two may be what the cut made
        cut = next((x for x in reversed(at) if not text[start + x - 1].isspace()), 0)  # spaces at a piece's end would join
        if not cut:
            step *= 2
            continue
        yield text[start : start + cut]
        start, step = start + cut, size
    yield text[start:]


def ids_of(text: str | None, enc: tiktoken.Encoding, pattern: str, added: dict[str, int] | None = None) -> np.ndarray:
    """Ids of a whole text, whose Python objects exist for one part at a time.

    A string of added has its own id wherever it occurs, and what is before and
    after it is encoded by itself.
    """
    found: list[np.ndarray] = []
    between = [text or ""] if not added else regex.split("(" + "|".join(map(regex.escape, added)) + ")", text or "")
    for i, piece in enumerate(between):
        if i % 2:
            found.append(np.array([added[piece]], "<u4"))
        else:
            found += [np.array(enc.encode_ordinary(part), "<u4") for part in parts(piece, pattern)]
    return np.concatenate(found)


def _codes(ids: list[int], enc: tiktoken.Encoding, digest: bool) -> tuple[int, bytes, bytes]:
    raw, back = np.array(ids, dtype="<u4").tobytes(), enc.decode_bytes(ids)
    if digest:
        return len(ids), hashlib.sha256(raw).hexdigest().encode(), hashlib.sha256(back).hexdigest().encode()
    return len(ids), raw, back


def _begins(length: int, size: int, overlap: int) -> range:
    """Where the chunks of a text begin; the last is the first that reaches the end."""
    return range(0, max(1, length - overlap), size)


def _ends(begin: int, chunk: str, last: bool, size: int, overlap: int, pattern: str) -> tuple[list[int], list[int]]:
    """Pre-token boundaries near a chunk's begin, and those it shares with the next, as places in the whole text."""
    at = boundaries(chunk, pattern)
    sure = at if last else at[:-2]  # what the cut may have changed
    return [begin + x for x in sure if x < overlap], [begin + x for x in sure if x >= size]


def stitched(text: str, pattern: str, size: int, overlap: int) -> list[str]:
    """The pieces between the stitches of a text's chunks; the text itself where two chunks have no common boundary."""
    begins, starts, shared = _begins(len(text), size, overlap), [0], []
    for begin in begins if len(begins) > 1 else ():
        head, tail = _ends(begin, text[begin : begin + size + overlap], begin == begins[-1], size, overlap, pattern)
        if begin:
            common = set(head).intersection(shared)
            if not common:
                return [text]
            starts.append(min(common))
        shared = tail
    return [text[a:b] for a, b in zip(starts, [*starts[1:], None], strict=True)]


def _near(ranks_path: str, pattern: str, digest: bool, size: int, overlap: int):
    """Codes of texts whose chunks are stitched within the task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.slice(at, 512)
                out = [_codes([i for piece in stitched(x or "", pattern, size, overlap) for i in enc.encode_ordinary(piece)], enc, digest) for x in rows.column(1).to_pylist()]
                n, ids, back = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encode


def _chunks(size: int, overlap: int):
    """Each text's chunks of size characters and the overlap with the next, 64 a batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row, doc_id, text = (batch.column(c)[i].as_py() for c in range(3))
                begins = _begins(len(text), size, overlap)
                for at in range(0, len(begins), 64):
                    own = begins[at : at + 64]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(at, at + n), pa.int32()), pa.array(own, pa.int64()), pa.array([size] * n, pa.int64()),
                            pa.array([b + size + overlap >= len(text) for b in own]), pa.array([text[b : b + size + overlap] for b in own], pa.string()),
                        ],
                        names=["row", "doc_id", "part", "begin", "size", "last", "chunk"],
                    )

    return cut


def _glued(digest: bool):
    """The codes of a text's pieces, in order, as one."""

    def glue(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pieces = table.sort_by("part")
        joined = [b"".join(pieces.column(c).to_pylist()) for c in ("ids", "decoded")]
        if digest:
            joined = [hashlib.sha256(x).hexdigest().encode() for x in joined]
        ends = [pa.array([x], pa.binary()) for x in joined]
        keys = [pa.array([k.as_py()], pa.int64()) for k in key]
        return pa.table([*keys, pa.array([sum(pieces.column("n_tokens").to_pylist())], pa.int64()), *ends], names=["row", "doc_id", "n_tokens", "ids", "decoded"])

    return glue


def _marks(pattern: str, overlap: int):
    """Boundaries near each chunk's ends, as places in the whole text."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail = [], []
            for begin, size, last, text in zip(*(batch.column(c).to_pylist() for c in ("begin", "size", "last", "chunk")), strict=True):
                near, shared = _ends(begin, text, last, size, overlap, pattern)
                head.append(near)
                tail.append(shared)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])

    return mark


def _pieces(ranks_path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            out = []
            for begin, start, stop, text in zip(*(batch.column(c).to_pylist() for c in ("begin", "start", "stop", "chunk")), strict=True):
                out.append(_codes(enc.encode_ordinary(text[start - begin : None if stop is None else stop - begin]), enc, False))
            n, ids, back = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("part"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["row", "doc_id", "part", "n_tokens", "ids", "decoded"])

    return encode


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, long_chars: int = 65536, chunk_chars: int = 16384, overlap: int = 1024, near_chars: int = 2048, near_overlap: int = 256) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row: ids as little-endian unsigned
    32-bit integers and the bytes that they decode to; with digest their SHA-256
    in lowercase hex as strings instead.

    A null text counts as empty and has no ids; a null id stays null; repeated
    rows give repeated results; other columns are not read.  Texts of over
    long_chars characters go by chunks of chunk_chars, dealt over the cluster,
    others by chunks of near_chars within a task; a text whose chunks have no
    common boundary in an overlap (one word longer than it, say) is encoded as
    one piece.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > long_chars
    near = _near(ranks_path, pattern, digest, near_chars, near_overlap)
    short = texts.where(~is_long).mapInArrow(near, CODES)

    whole = texts.where(is_long).withColumn("row", F.xxhash64("doc_id", "text"))
    whole = whole.groupBy("row", "doc_id", "text").agg(F.count("*").alias("copies"))
    parts = whole.select("row", "doc_id", "text").mapInArrow(_chunks(chunk_chars, overlap), "row long, doc_id long, part int, begin long, size long, last boolean, chunk string").repartition("row", "part")
    marked = parts.mapInArrow(_marks(pattern, overlap), "row long, doc_id long, part int, begin long, size long, last boolean, chunk string, head array<long>, tail array<long>")
    order = Window.partitionBy("row", "doc_id").orderBy("part")
    start = F.when(F.col("part") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    cut = marked.select("row", "doc_id", "part", "begin", "last", "chunk", start.alias("start"))
    cut = cut.withColumn("stop", F.lead("start").over(order)).withColumn("next", F.lead("part").over(order))
    cut = cut.withColumn("joined", F.min(F.col("start").isNotNull()).over(Window.partitionBy("row", "doc_id")))
    coded = cut.where("joined").mapInArrow(_pieces(ranks_path, pattern), "row long, doc_id long, part int, n_tokens long, ids binary, decoded binary")

    glued = coded.groupBy("row", "doc_id").applyInArrow(_glued(digest), "row long, doc_id long, n_tokens long, ids binary, decoded binary")
    done = glued.join(whole.select("row", F.col("doc_id").alias("doc"), "copies"), ["row"]).where(F.col("doc_id").eqNullSafe(F.col("doc")))
    done = done.withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))"))).select("doc_id", "n_tokens", "ids", "decoded")
    rest = whole.join(cut.where(~F.col("joined")).select("row").distinct(), "row", "left_semi")
    rest = rest.withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))"))).select("doc_id", "text")
    result = short.union(done).union(rest.mapInArrow(near, CODES))
    return result.withColumns({"ids": F.col("ids").cast("string"), "decoded": F.col("decoded").cast("string")}) if digest else result


def decode(coded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes of ids held as little-endian unsigned 32-bit integers (null: none)."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            out = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(back, "doc_id long, decoded binary")
