"""WARC archives: written as one gzip stream each, normalised to a member for each record, read by offset.

``write`` makes whole-file streams, as crawlers that compress a finished file
do: nothing in them can be read without all that stands before it.
``normalise`` inflates such a stream once, in pieces, and writes every record
anew as a gzip member of its own, with a sidecar of offsets next to the
archive.  ``read`` takes the records from there: it seeks to each one's offset.

Of records with equal payloads one is a response and the others are revisits,
which name it and have no payload of their own.

A null payload is an empty one, a null url is left out, a null id stays null.
Of equal payloads the greatest id is the response, null ids last; of several
rows with that id the one of the greatest url (null last), and of rows alike in
all three, one.  The row columns are only those named; others are not looked
at.  Without rows there are no archives and no records.

Files are named by the task that wrote them and count only if that task's row
in the stored manifest says so: what a lost or repeated task left behind is
never read.  The folder must be one that pyarrow opens (file, hdfs, s3, gs) and
that driver and executors share.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import discard, shared_dir, stored

ARCHIVE_BYTES = 128 << 20  # of records, before compression, in an archive
PIECE = 1 << 20
RUN_BYTES = 8 << 20  # of an archive that are read together
SALTS = 16
ALIKE = 10_000  # of rows alike in everything, revisits that are made together
MOST_SENT = 500_000  # groups of copies, of some 100 bytes, that may be broadcast
LEVEL = 6

# Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2000-01-01T00:00:00Z"

MANIFEST = "archive string, records long"
RECORD = "page_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string"


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def _record_uuid(*parts) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>".encode()


def _clean(url: bytes) -> bytes:
    """A url that fits a header line: controls and spaces as %XX."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url)


def record(row: dict, name: str) -> bytes:
    """The bytes of one record: (page_id, url, payload, n_bytes, digest, top, top_url, revisit)."""
    digest, page = base64.b32encode(bytes.fromhex(row["digest"])), row["page_id"]
    kind = b"revisit" if row["revisit"] else b"response"
    headers = [b"WARC-Type: " + kind]
    if row["revisit"]:
        headers += [b"WARC-Record-ID: " + _record_uuid(name), b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + _record_uuid(row["top"], row["digest"])]
        headers += [b"WARC-Refers-To-Page: " + str(row["top"]).encode()] if row["top"] is not None else []
        headers += [b"WARC-Refers-To-Target-URI: " + _clean(row["top_url"])] if row["top_url"] is not None else []
    else:
        headers += [b"WARC-Record-ID: " + (_record_uuid(page, row["digest"]) if row["top_n"] else _record_uuid(name))]
    headers += [b"WARC-Date: " + DATE, b"WARC-Payload-Digest: sha1:" + digest, b"Content-Type: application/http; msgtype=response"]
    headers += [b"WARC-Page: " + str(page).encode()] if page is not None else []
    headers += [b"WARC-Target-URI: " + _clean(row["url"])] if row["url"] is not None else []
    # a revisit keeps the length of the payload that it stands for
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % row["n_bytes"] + END
    block += b"" if row["revisit"] else row["payload"]
    return b"\r\n".join([VERSION, *headers, b"Content-Length: %d" % len(block)]) + END + block + END


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, payload, n_bytes, digest, top, top_url, top_n, revisit): what each row's record is;
    and the stored table of groups that this reads.

    Equal payloads agree in SHA-1, length and a second hash.  Only keys of
    groups that have copies are joined to the rows: broadcast when they are
    few, else dealt with a salt, so that a payload of any number of copies is
    spread.
    """
    payload = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").cast("binary").alias("url"), payload.alias("payload"))
    keyed = rows.withColumns({"digest": F.sha1("payload"), "n_bytes": F.length("payload").cast("long"), "check": F.xxhash64("payload")})
    keys = ["digest", "n_bytes", "check"]
    each = keyed.groupBy(*keys, "page_id", "url").agg(F.count("*").alias("n"))
    groups = each.groupBy(*keys).agg(F.max(F.struct("page_id", "url", "n")).alias("t"), F.sum("n").alias("rows")).where(f"rows > 1 and n_bytes >= {int(least_bytes)}")
    groups = stored(groups.select(*keys, F.col("t.page_id").alias("top"), F.col("t.url").alias("top_url"), F.col("t.n").alias("top_n")), "copies")
    if groups.count() <= MOST_SENT:
        met = keyed.join(F.broadcast(groups), keys, "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")
    is_top = F.col("page_id").eqNullSafe(F.col("top")) & F.col("url").eqNullSafe(F.col("top_url")) & F.col("top_n").isNotNull()
    columns = ["page_id", "url", "payload", "n_bytes", "digest", "top", "top_url", "top_n"]
    once = met.where(~is_top | (F.col("top_n") == 1) | F.col("top_n").isNull()).select(*columns, (F.col("top_n").isNotNull() & ~is_top).alias("revisit"))
    if groups.where("top_n > 1").isEmpty():
        return once, groups
    # rows alike in everything: one response; the revisits need no payload and are made from their number
    copies = [*keys, "top", "top_url", "top_n"]
    alike = met.where(is_top & (F.col("top_n") > 1)).groupBy(*copies).agg(F.first("payload").alias("payload")).withColumn("revisit", F.lit(False))
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(top_n - 2) div {ALIKE}"))).alias("some")
    blocks = groups.where("top_n > 1").select(*copies, some).repartition("digest", "some")
    revisits = blocks.withColumn("i", F.explode(F.expr(f"sequence(some * {ALIKE} + 2, least((some + 1) * {ALIKE} + 1, top_n))")))
    revisits = revisits.withColumns({"payload": F.lit(None).cast("binary"), "revisit": F.lit(True)})
    both = alike.unionByName(revisits.select(alike.columns)).withColumns({"page_id": F.col("top"), "url": F.col("top_url")})
    return once.union(both.select(*columns, "revisit")), groups


class _Stream:
    """An archive being written as one gzip stream, all of it or in members."""

    def __init__(self, path: str):
        fs, at = _filesystem(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.path, self.out, self.at, self.gzip = path, fs.open_output_stream(at, compression=None), 0, None

    def write(self, data: bytes) -> None:
        if self.gzip is None:
            self.gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self._put(self.gzip.compress(data))

    def end_member(self) -> None:
        if self.gzip is not None:
            self._put(self.gzip.flush())
            self.gzip = None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.end_member()
        self.out.close()


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows of decided() as archives of one gzip stream each; the stored manifest (archive, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, done, size, n = None, "", [], 0, 0
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if out is None:
                    name, size, n = uuid.uuid4().hex, 0, 0
                    out = _Stream(f"{folder}/{name}.warc.gz")
                data = record(row, f"{name}/{n}")
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((out.path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((out.path, n))
        if done:
            yield _rows(done, MANIFEST)

    return stored(rows.mapInArrow(run, MANIFEST), "manifest")


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or many, in pieces; a file that ends early is an error."""
    gzip, data = None, source.read(PIECE)
    while data:
        gzip = gzip or zlib.decompressobj(31)
        yield gzip.decompress(data, PIECE)
        while gzip.unconsumed_tail:
            yield gzip.decompress(gzip.unconsumed_tail, PIECE)
        data = gzip.unused_data
        if gzip.eof:
            gzip = None
        data = data or source.read(PIECE)
    if gzip is not None:
        raise EOFError("the gzip stream ends early")


class _Reader:
    """Bytes up to a mark, or so many of them, from an iterator of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def _more(self) -> bool:
        more = next(self.pieces, None)
        self.held, self.at = self.held[self.at :] + (more or b""), 0
        return more is not None

    def head(self) -> bytes | None:
        """A record's header with its end, or None at the end of the stream."""
        while (end := self.held.find(END, self.at)) < 0:
            if not self._more():
                if self.held.strip():
                    raise EOFError("the last record has no end of header")
                return None
        found, self.at = self.held[self.at : end + len(END)], end + len(END)
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self._more():
                raise EOFError("a record ends early")
            part = self.held[self.at : self.at + n]
            self.at, n = self.at + len(part), n - len(part)
            yield part


def headers(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    lines = head.decode("utf-8", "surrogateescape").strip("\r\n").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def normalised(source, target: _Stream, line: Callable[[str], None]) -> int:
    """Every record of a gzip stream as a member of target, a line of the sidecar for each; their number."""
    stream, n = _Reader(inflated(source)), 0
    while (head := stream.head()) is not None:
        if not head.lstrip(b"\r\n").startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        own, start = headers(head), target.at
        target.write(head.lstrip(b"\r\n"))
        for part in stream.take(int(own["content-length"]) + len(END)):
            target.write(part)
        target.end_member()
        line(f"{start} {target.at - start} {own['warc-type']} {own['warc-record-id']}\n")
        n += 1
    return n


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Archives with a member for each record, and sidecars (.idx: offset, length, type, id); the stored manifest.

    One archive is one stream and so the work of one task; archives are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = _Stream(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                fs, at = _filesystem(path)
                side, at_side = _filesystem(out.path + ".idx")
                with fs.open_input_stream(at, compression=None) as source, side.open_output_stream(at_side, compression=None) as index:
                    n = normalised(source, out, lambda text: index.write(text.encode("utf-8", "surrogateescape")))
                out.close()
                yield _rows([(out.path, n)], MANIFEST)

    return stored(manifest.select("archive").repartition(max(1, manifest.count())).mapInArrow(run, MANIFEST), "manifest")


def index(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(archive, offset, length, record_type, record_id) from the sidecars of the archives that the manifest names."""
    if manifest.isEmpty():
        return spark.createDataFrame([], "archive string, offset long, length long, record_type string, record_id string")
    part = F.split("value", " ")
    lines = spark.read.text(f"{folder}/*.idx").select(F.regexp_extract("_metadata.file_name", r"^(.*)\.idx$", 1).alias("name"), part.alias("p"))
    named = manifest.select("archive", F.substring_index("archive", "/", -1).alias("name"))
    met = lines.join(named, "name")
    return met.select("archive", F.col("p")[0].cast("long").alias("offset"), F.col("p")[1].cast("long").alias("length"), F.col("p")[2].alias("record_type"), F.col("p")[3].alias("record_id"))


def parsed(data: bytes) -> tuple:
    """(page_id, record_type, target_uri, payload_bytes, payload_digest, refers_to, payload) of one record.

    The payload of a response must have the digest that its header states.
    """
    head, _, rest = data.partition(END)
    own = headers(head)
    block = rest[: int(own["content-length"])]
    http, _, payload = block.partition(END)
    digest = own["warc-payload-digest"].removeprefix("sha1:")
    if own["warc-type"] == "revisit":
        n, payload = int(headers(http)["content-length"]), None
    else:
        n = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {own['warc-record-id']} has another digest than its header says")
    url = own.get("warc-target-uri")
    url = url if url is None else url.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return own.get("warc-page"), own["warc-type"], url, n, digest, own.get("warc-refers-to-page"), payload


def read(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of index(), each inflated at its offset, with their payloads if asked for.

    Neighbours in an archive are read by one task, a stretch of RUN_BYTES at a time.
    """
    schema = RECORD + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            out, size = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != opened:
                    if source is not None:
                        source.close()
                    fs, at = _filesystem(archive)
                    opened, source = archive, fs.open_input_file(at)
                source.seek(offset)
                row = parsed(zlib.decompress(source.read(length), 31))
                out.append(row if with_payload else row[:-1])
                size += len(row[-1] or b"") if with_payload else 0
                if size >= RUN_BYTES:
                    yield _rows(out, schema)
                    out, size = [], 0
            if out:
                yield _rows(out, schema)
        if source is not None:
            source.close()

    stretch = F.expr(f"offset div {RUN_BYTES}")
    dealt = records.select("archive", "offset", "length").repartition("archive", stretch).sortWithinPartitions("archive", "offset")
    found = dealt.mapInArrow(run, schema)
    return found.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Pages as WARC records, written, normalised and read back.

    (page_id, record_type, target_uri, payload_bytes, payload_digest,
    refers_to[, payload]).  The archives stay in folder.
    """
    spark = pages.sparkSession
    folder = (folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").rstrip("/")
    rows, groups = decided(pages, least_bytes=least_bytes)
    whole = write(rows, f"{folder}/whole")
    members = normalise(whole, f"{folder}/members")
    fs, at = _filesystem(f"{folder}/whole")
    if fs.get_file_info(at).type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(at)  # all of it has been rewritten
    discard(whole, groups)
    return read(index(spark, members, f"{folder}/members"), with_payload)
