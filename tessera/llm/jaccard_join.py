"""N-gram Jaccard self-join by grouped prefixes.

A document's set is its distinct shingles.  In one total order, rare shingles
first, two sets of Jaccard similarity t or more share a shingle of their
prefixes.  Documents of the same prefix and size form one group; prefixes
index groups, so that group pairs are found and filtered by size before their
members are expanded and verified exactly.  Equal sets are one member.  Only
pairs whose sketches leave similarity possible have their sets shuffled; a
sketch tells whether the members in each of its cells are odd in number.

Long postings, which near copies of one text make, are not paired: members are
verified against a few pivots, and only what is still in different components
afterwards is paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import components, stored
from tessera.llm.words import Block, blocks, mix, sequences

CELLS = 1 << 20
SEGMENT = 1 << 14
SHORT = 16
PIVOTS = 2
ROUNDS = 4
BLOCK = 512
PAIRED = 4  # pairs a row of long postings may make on average before pivots thin them out
SALTS = 16  # parts of one token's rows
PIVOT_BYTES = 16 << 20  # of pivots' sets that may be broadcast; beyond, both sides of a pair are shuffled
BITS = 1 << 26
CELLS_EACH = 2  # cells of a sketch for each member of its set, at least
MOST_CELLS = 1 << 18
MOST_SENT = 1 << 20  # endpoints of pairs that may be broadcast (24 bytes each); beyond, both sides are shuffled
_FLUSH = 1 << 20
_NONE = -(1 << 63)
_PAIR = ["u1", "u2", "r1", "r2"]
_PAIRS = "u1 long, u2 long, r1 long, r2 long"
_U = np.uint64
_ENTRY = "bucket int, kind int, a binary, b binary, c binary, d binary, key binary, bins binary"
_ENTRY_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]
_FOUND = "kind int, a long, b long, n int, doc long, key long, bins binary"


def row_sets(block: Block, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): runs of k words, or all words of a row of fewer."""
    full, _ = sequences(block, k)
    shorter = {j: sequences(block, j)[0] for j in range(1, k)}
    bounds = block.bounds.tolist()
    for row in range(block.rows):
        at, n = bounds[row], bounds[row + 1] - bounds[row]
        if n >= k:
            own = np.sort(full[at : at + n - k + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield row, own[keep]
        else:
            yield row, shorter[n][at : at + 1] if n else full[:0]


def set_id(own: np.ndarray) -> int:
    """One 64-bit value for a set; 0 for the empty one."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(own).sum(dtype=_U) + _U(len(own))], _U))[0]) if len(own) else 0


def _count(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), fold=True):
                h, ok = sequences(block, k)
                total += np.bincount((h[ok] % _U(CELLS)).astype(np.int64), minlength=CELLS)
        parts = np.minimum(total, 65535).astype("<u2").reshape(-1, SEGMENT)
        used = np.flatnonzero(parts.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["segment", "counts"])

    return count


def _sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros(SEGMENT, np.int64)
    for counts in table.column("counts"):
        total += np.frombuffer(counts.as_buffer(), "<u2")
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})


def _weights(texts: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each of CELLS hash cells occur in all texts: rare ones come first."""
    counted = texts.select("text").mapInArrow(_count(k), "segment int, counts binary").groupBy("segment").applyInArrow(_sum, "segment int, counts binary")
    weight = np.zeros((CELLS // SEGMENT, SEGMENT), np.int32)
    for row in counted.collect():
        weight[row["segment"]] = np.frombuffer(row["counts"], "<i4")
    return weight.ravel()


def sketch_bytes(n: int) -> int:
    """Length of the sketch of n members: a power of two, 8 at least."""
    return min(max(64, 1 << (CELLS_EACH * n - 1).bit_length() if n else 0), MOST_CELLS) // 8


def sketch(own: np.ndarray) -> bytes:
    """A bit for each cell of hashes: whether an odd number of members is in it."""
    cells = 8 * sketch_bytes(len(own))
    odd = np.bincount((own & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches as those of fewer cells."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Of each pair of sketches the cells that differ: at least so many members have only one of both sets."""
    wide = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(x), np.int64)
    for p, q in np.unique(wide, axis=0).tolist():
        at = np.flatnonzero((wide[:, 0] == p) & (wide[:, 1] == q))
        step = max(1, _FLUSH // max(p, q))
        for part in (at[i : i + step] for i in range(0, len(at), step)):
            a, b = (_folded(np.frombuffer(b"".join([s[i] for i in part]), _U).reshape(len(part), -1), min(p, q) // 8) for s in (x, y))
            out[part] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def _entries(k: int, percent: int, order, buckets: int):
    """Prefix entries (token, group, size), one for each group of a task, and a profile of each row."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = order.value
        seen: set[int] = set()
        tokens: list[np.ndarray] = []
        owners: list[tuple[int, int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            token = np.concatenate(tokens)
            each = [x[2] for x in owners]
            group = np.repeat(np.array([x[0] for x in owners], _U), each)
            size = np.repeat(np.array([x[1] for x in owners], np.int32), each)
            place = ((token >> _U(20)) % _U(buckets)).astype(np.int32)
            by = np.argsort(place, kind="stable")
            cut = np.searchsorted(place[by], np.arange(buckets + 1))
            used = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            parts = [[x[by[cut[b] : cut[b + 1]]].tobytes() for b in used] for x in (token, group, size)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([1] * len(used), pa.int32()), *(pa.array(p, pa.binary()) for p in parts), *(pa.nulls(len(used), pa.binary()) for _ in range(3))], names=_ENTRY_NAMES)

        for batch in batches:
            docs, keys = batch.column(0).fill_null(_NONE).to_numpy(), batch.column(2).to_numpy()
            for block in blocks(batch.column(1), fold=True):
                ids, groups, sizes = np.zeros(block.rows, _U), np.zeros(block.rows, _U), np.zeros(block.rows, np.int32)
                bins = []
                for row, own in row_sets(block, k):
                    n = len(own)
                    ids[row], sizes[row] = set_id(own), n
                    bins.append(sketch(own))
                    if not n:
                        continue
                    prefix = own[np.argsort(weight[(own % _U(CELLS)).astype(np.int64)], kind="stable")[: n - (n * percent + 99) // 100 + 1]]
                    group = set_id(prefix ^ _U(n))
                    groups[row] = group
                    if group not in seen and docs[block.first + row] != _NONE:
                        seen.add(group)
                        tokens.append(prefix)
                        owners.append((group, n, len(prefix)))
                        held += len(prefix)
                own_docs, own_keys = (x[block.first : block.first + block.rows] for x in (docs, keys))
                parts = [*(x.tobytes() for x in (own_docs, ids, groups, sizes, own_keys)), b"".join(bins)]
                bucket = int(own_docs[0] % buckets) if block.rows else 0
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([0], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=_ENTRY_NAMES)
                if held >= _FLUSH:
                    yield flush()
                    tokens.clear()
                    owners.clear()
                    held = 0
        if held:
            yield flush()

    return index


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in column.to_pylist()] or [np.zeros(0, dtype)])


def _rows(kind: int, a, b, n=None, doc=None, key=None, bins: list | None = None) -> pa.RecordBatch:
    none = np.zeros(len(a), np.int64)
    long = [np.asarray(none if x is None else x).astype(np.int64, copy=False) for x in (a, b, doc, key)]  # hashes wrap around
    n = np.asarray(none if n is None else n, np.int32)
    columns = [pa.array(np.full(len(a), kind, np.int32)), pa.array(long[0]), pa.array(long[1]), pa.array(n), pa.array(long[2]), pa.array(long[3]), pa.array(bins or [None] * len(a), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])


def _postings(percent: int):
    """Of each bucket: profiles (0), group pairs of short postings (1), entries of long ones (2)."""

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        profile = table.filter(pc.equal(table.column("kind"), 0))
        ids, groups, sizes, docs, keys = (_joined(profile.column(c), kind) for c, kind in (("b", _U), ("c", _U), ("d", np.int32), ("a", np.int64), ("key", np.int64)))
        ends = np.cumsum([sketch_bytes(n) for n in sizes.tolist()]).tolist()
        sketches = b"".join(profile.column("bins").to_pylist())
        bins = [sketches[i:j] for i, j in zip([0, *ends], ends)]
        out = [_rows(0, ids, groups, sizes, docs, keys, bins)]
        entry = table.filter(pc.equal(table.column("kind"), 1))
        token, group, size = _joined(entry.column("a"), _U), _joined(entry.column("b"), _U), _joined(entry.column("c"), np.int32)
        by = np.lexsort((group, token))
        token, group, size = token[by], group[by], size[by]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
        token, group, size = token[new], group[new], size[new]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        many = np.diff(np.concatenate((first, [len(token)])))
        pairs = []
        for m in range(2, SHORT + 1):
            at = first[many == m]
            if len(at):
                i, j = np.triu_indices(m, 1)
                x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                fits = np.minimum(size[x], size[y]).astype(np.int64) * 100 >= percent * np.maximum(size[x], size[y]).astype(np.int64)
                pairs.append(np.stack((group[x[fits]], group[y[fits]]), axis=1))
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), _U)
        out.append(_rows(1, found[:, 0], found[:, 1]))
        long = np.repeat(many > SHORT, many)
        out.append(_rows(2, token[long], group[long], size[long]))
        return pa.Table.from_batches(out)

    return meet


def _sets(k: int, wanted):
    """(u, own): the sets of rows whose id is marked in a bitmap of BITS bits."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = wanted.value
        for batch in batches:
            batch = batch.filter(pa.array([bool(marked[h >> 3] >> (h & 7) & 1) for h in batch.column(0).to_pylist()], pa.bool_()))
            for block in blocks(batch.column(1), fold=True):
                own = [x for _, x in row_sets(block, k) if len(x)]
                ids = np.array([set_id(x) for x in own], _U).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in own], pa.binary())], names=["u", "own"])

    return gather


def _likely(percent: int):
    """Pairs whose sketches leave similarity possible: they differ by no more than the sets may."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n, x, y = (batch.column(batch.schema.names.index(c)) for c in ("both", "x", "y"))
            ok = apart(x.to_pylist(), y.to_pylist()) * (100 + percent) <= (100 - percent) * n.to_numpy()  # |difference| <= (1 - t) / (1 + t) of both sizes
            yield batch.filter(pa.array(ok)).select(_PAIR)

    return keep


def _crossing(percent: int):
    """Of a long posting, or two of its blocks: likely pairs of different components,
    each in the least of the long postings that it shares only (tokens: a member's lesser ones)."""

    def cross(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, one, two = (k.as_py() for k in key)
        u, n, rep, component, block = (table.column(c).to_numpy() for c in ("u", "n", "r", "component", "block"))
        bins = table.column("bins").to_pylist()
        tokens = table.column("tokens").combine_chunks()
        owner, flat = np.repeat(np.arange(len(u)), np.diff(tokens.offsets.to_numpy())), tokens.flatten().to_numpy()
        known, place = np.unique(flat, return_inverse=True)
        lower = np.zeros((len(u), len(known)), np.float32)
        lower[owner, place] = 1
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        found = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(left), 64):
            i = left[at : at + 64]
            low, high = np.minimum(n[i, None], n[right]).astype(np.int64), np.maximum(n[i, None], n[right]).astype(np.int64)
            ok = (component[i, None] != component[right]) & (low * 100 >= high * percent) & (lower[i] @ lower[right].T == 0)
            if one == two:
                ok &= i[:, None] < right
            x, y = np.nonzero(ok)
            differ = apart([bins[a] for a in i[x]], [bins[b] for b in right[y]])
            fits = differ * (100 + percent) <= (100 - percent) * (n[i[x]].astype(np.int64) + n[right[y]])
            found.append(np.stack((i[x[fits]], right[y[fits]]), axis=1))
        pair = np.concatenate(found)
        swap = rep[pair[:, 0]] > rep[pair[:, 1]]
        pair[swap] = pair[swap][:, ::-1]
        return pa.table({"u1": u[pair[:, 0]], "u2": u[pair[:, 1]], "r1": rep[pair[:, 0]], "r2": rep[pair[:, 1]]})

    return cross


def _similar(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                a, b = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(_PAIR)

    return verify


def _sized(percent: int) -> Column:
    return F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent


def _node(i: int | str = "") -> Column:
    """A unit as a node of the graph: ordered by its least document first."""
    return F.struct(F.col(f"r{i}").alias("r"), F.col(f"u{i}").alias("u"))


def _of_token(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows (token, u, ...) with the columns of tokens (token, ...), a frequent token's rows in SALTS parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)))
    copies = tokens.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["token", "salt"]).drop("salt")


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_key: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, row_key, kept) of every row.

    Words are runs of other than ASCII white space with A-Z lower-cased; two
    documents link when 100 * common >= percent * union.  component_id is the
    least doc_id reachable by links.  An empty or null text has an empty set
    and links with nothing; rows of one id are one document if their sets are
    equal (equal set_id) and linked as any others if not; a null id has a null
    component and takes no part.  kept is true for rows of the least document
    of a component, and for those that take no part; row_key, a column of docs
    that is carried along, tells the rows of one id apart.  Other columns are
    not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.lit(0) if row_key is None else row_key, F.lit(0)).cast("long").alias("key"))
    buckets = max(128, -(-texts.count() // 2000))
    order = spark.sparkContext.broadcast(_weights(texts, k))  # CELLS values, whatever the input

    found = texts.mapInArrow(_entries(k, percent, order, buckets), _ENTRY).groupBy("bucket").applyInArrow(_postings(percent), _FOUND)
    found = stored(found, "postings")
    profiles = found.where("kind = 0").select(F.when(F.col("doc") != _NONE, F.col("doc")).alias("doc_id"), F.col("a").alias("u"), F.col("b").alias("g"), "n", "key", "bins")
    units = stored(profiles.where("n > 0 and doc_id is not null").groupBy("u").agg(F.min("g").alias("g"), F.min("n").alias("n"), F.min("doc_id").alias("r"), F.min("bins").alias("bins")), "units")

    def sent(asked: DataFrame) -> DataFrame:
        return F.broadcast(asked) if asked.count() <= MOST_SENT else asked

    # sketches of only those units that may be in a pair are shuffled
    pairs = stored(found.where("kind = 1").select(F.col("a").alias("g1"), F.col("b").alias("g2")).distinct(), "groups")
    groups = stored(units.groupBy("g").agg(F.count("*").alias("members")).where("members > 1"), "groups")
    met = stored(pairs.select(F.col("g1").alias("g")).union(pairs.select("g2")).union(groups.select("g")).distinct(), "groups")
    near = units.join(sent(met), "g", "left_semi").join(sent(groups), "g", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    near = stored(near, "units")
    plain, crowded = near.where(F.col("members") <= SHORT), near.where(F.col("members") > SHORT)

    def side(members: DataFrame, i: int) -> DataFrame:
        return members.select(*(F.col(c).alias(f"{c}{i}") for c in ("g", "u", "n", "r", "bins")))

    def likely(candidates: DataFrame) -> DataFrame:
        kept = candidates.where(_sized(percent)).select(*_PAIR, (F.col("n1") + F.col("n2")).cast("long").alias("both"), F.col("bins1").alias("x"), F.col("bins2").alias("y"))
        return kept.mapInArrow(_likely(percent), _PAIRS)

    big = crowded.select("g").distinct()
    across = pairs.join(side(plain, 1), "g1").join(side(plain, 2), "g2")
    several = plain.where("members > 1")
    within = side(several, 1).join(side(several, 2), (F.col("g1") == F.col("g2")) & (F.col("u1") < F.col("u2")))
    first = stored(likely(across.unionByName(within)), "pairs")
    mixed = pairs.join(big.withColumnRenamed("g", "g1"), "g1", "left_semi").union(pairs.join(big.withColumnRenamed("g", "g2"), "g2", "left_semi").select("g1", "g2")).distinct()
    token = F.xxhash64("g1", "g2").alias("token")
    runs = [
        found.where("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("g")),
        crowded.select(F.col("g").alias("token"), "g").distinct(),
        mixed.select(token, F.col("g1").alias("g")),
        mixed.select(token, F.col("g2").alias("g")),
    ]
    long = stored(reduce(DataFrame.union, runs).distinct().join(units.select("g", "u", "n", "r"), "g").select("token", "u", "n", "r"), "long")

    wanted = first.select(F.col("u1").alias("u"), F.col("r1").alias("r")).union(first.select("u2", "r2")).union(long.select("u", "r")).distinct()
    wanted = stored(wanted, "wanted")
    cell = _bit(F.col("r"))
    marks = wanted.select(cell.alias("h")).groupBy(F.expr("bitmap_bucket_number(h + 1)").alias("at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h + 1))").alias("bits")).collect()
    bitmap = bytearray(BITS // 8)  # 8 MB, whatever the input
    for row in marks:
        bitmap[(row["at"] - 1) * 4096 : row["at"] * 4096] = row["bits"]
    marked = spark.sparkContext.broadcast(bytes(bitmap))
    candidates = texts.where("doc_id is not null").select(_bit(F.col("doc_id")).alias("h"), "text")
    asked = sent(wanted.select("u"))
    sets = stored(candidates.mapInArrow(_sets(k, marked), "u long, own binary").join(asked, "u", "left_semi"), "sets")
    sketches = stored(units.select("u", "bins").join(sent(long.select("u").distinct()), "u", "left_semi"), "sketches")

    def verified(candidates: DataFrame) -> DataFrame:
        """Links among pairs: both sets of a pair are shuffled."""
        ends = candidates.select(*_PAIR, F.explode(F.array(F.struct(F.col("u1").alias("u"), F.lit(1).alias("end")), F.struct(F.col("u2").alias("u"), F.lit(2).alias("end")))).alias("e")).select(*_PAIR, "e.*")
        if candidates.count() * 2 <= MOST_SENT:
            ends = F.broadcast(ends)
        met = sets.join(ends, "u").groupBy(*_PAIR).agg(F.max(F.when(F.col("end") == 1, F.col("own"))).alias("x"), F.max(F.when(F.col("end") == 2, F.col("own"))).alias("y"))
        return linked(met)

    def linked(met: DataFrame) -> DataFrame:
        return stored(met.mapInArrow(_similar(percent), _PAIRS).select(_node(1).alias("src"), _node(2).alias("dst")), "links")

    def verified_with(candidates: DataFrame) -> DataFrame:
        """verified for pairs of which few units are u1: their sets are broadcast if they take PIVOT_BYTES at most."""
        pivots = sets.join(F.broadcast(candidates.select(F.col("u1").alias("u")).distinct()), "u", "left_semi") if candidates.count() <= MOST_SENT else None
        if pivots is None or (pivots.agg(F.sum(F.octet_length("own"))).first()[0] or 0) > PIVOT_BYTES:
            return verified(candidates)
        own = sets.select(F.col("u").alias("u2"), F.col("own").alias("y")).join(F.broadcast(candidates), "u2")
        return linked(own.join(F.broadcast(pivots.select(F.col("u").alias("u1"), F.col("own").alias("x"))), "u1").select(*_PAIR, "x", "y"))

    def component(known: DataFrame, i: int | str) -> DataFrame:
        return known.select("node.*", F.col("component").alias(f"c{i}")).select(F.col("u").alias(f"u{i}"), f"c{i}")

    def settled(candidates: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """links and those among candidates that join components; components after the first half of these.

        Each member and its least likely partner come first: what these links join needs no other pair.
        """
        ordered = candidates.select(*(F.when(_node(1) < _node(2), F.col(f"{c}{i}")).otherwise(F.col(f"{c}{3 - i}")).alias(f"{c}{i}") for c in "ur" for i in (1, 2))).distinct()
        star = stored(ordered.groupBy("u2", "r2").agg(F.min(_node(1)).alias("p")).select("p.u", "u2", "p.r", "r2").toDF(*_PAIR), "star")
        links = verified(star) if links is None else links.union(verified(star))
        known = components(links)
        rest = ordered.join(component(known, 1), "u1", "left").join(component(known, 2), "u2", "left").where(F.coalesce("c1", _node(1)) != F.coalesce("c2", _node(2)))
        return links.union(verified(stored(rest.join(star, ["u1", "u2"], "left_anti").select(_PAIR), "pairs"))), known

    links, known = settled(first)
    members, worth = sketches.count(), True  # whether the round before linked a fair part of the members
    for turn in range(ROUNDS + 1):
        if long.isEmpty():
            break
        known = components(links) if turn else known
        long = long.select("token", "u", "n", "r").join(component(known, ""), "u", "left").withColumn("c", F.coalesce("c", _node()))
        split = long.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
        long = stored(_of_token(long, split), "long")
        runs = long.groupBy("token", "c").count().groupBy("token").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("own"))
        rows, crossings = runs.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.col("m") * F.col("m") - F.col("own")), F.lit(0))).first()
        last = turn == ROUNDS or not worth or crossings <= 2 * PAIRED * rows
        if last:
            blocks_of = long.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
            dealt = _of_token(long, blocks_of).withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
            dealt = dealt.join(sketches.join(long.groupBy("u").agg(F.collect_set("token").alias("tokens")), "u"), "u")
            dealt = dealt.withColumn("tokens", F.expr("filter(tokens, t -> t < token)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            dealt = dealt.select("token", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "u", "n", "r", F.col("c.u").alias("component"), "bins", "tokens")
            fresh = dealt.groupBy("token", "one", "two").applyInArrow(_crossing(percent), _PAIRS).distinct()
            fresh = stored(fresh, "pairs")
            links = links.union(verified(fresh)) if fresh.count() <= members else settled(fresh, links)[0]
            break
        # pivots are picked by a hash of the unit, so that tokens of the same members pick the same
        member = F.struct("u", "n", "r", "c")
        picks = [F.min(F.struct(F.xxhash64(F.col("u"), F.lit(turn * PIVOTS + i)).alias("h"), member.alias("m"))).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = long.groupBy("token").agg(*picks).select("token", F.explode(F.array(*(F.col(f"p{i}.m") for i in range(PIVOTS)))).alias("m")).distinct()
        pivots = pivots.select("token", *(F.col(f"m.{c}").alias(f"{c}1") for c in ("u", "n", "r", "c")))
        crossing = _of_token(long, pivots).withColumnsRenamed({c: f"{c}2" for c in ("u", "n", "r", "c")}).where((F.col("c1") != F.col("c2")) & _sized(percent))
        fresh = crossing.select("u1", "u2", "r1", "r2", "n1", "n2").distinct()
        for i in (1, 2):
            fresh = fresh.join(sketches.select(F.col("u").alias(f"u{i}"), F.col("bins").alias(f"bins{i}")), f"u{i}")
        fresh = stored(likely(fresh), "pairs")
        new = verified_with(fresh)
        worth = new.count() * 20 >= members
        links = links.union(new)

    label = components(links).select("node.*", F.col("component.r").alias("least"), (F.col("node") == F.col("component")).alias("first"))
    named = units.select("u", "r").join(label.select("u", "least", "first"), "u", "left")
    out = profiles.join(named, "u", "left")
    takes_part = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    kept = ~takes_part | ((F.col("doc_id") == F.col("r")) & F.coalesce("first", F.lit(True)))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "r", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(takes_part, own).otherwise(F.col("doc_id")).alias("component_id"), F.col("u").alias("set_id"), F.col("key").alias("row_key"), F.coalesce(kept, F.lit(True)).alias("kept"))


def _bit(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BITS))
