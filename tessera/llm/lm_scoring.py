"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network sees the words on both sides of a masked position, never the word
itself: learned rows for (word, offset) are summed and squashed into a hidden
vector, which is asked at every node from the root of a binary tree down to the
word's leaf.  Words that are frequent enough have a leaf and rows of their own,
and more of them are the larger the corpus is; the others share one leaf, below
which a byte model, counted on all of their occurrences, spells them out to the
end of the word.  So every word's probability given both sides is normalised.
Every task trains a copy, in numpy, on all positions of its share of the
documents, and passes on what it moved: rows that its words never asked stay
with it.  Spark adds the moves up in a tree of groups, a row's average is over
the copies that moved it, and a further round goes on from there.
A document's score is the sum of its words' conditional log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, stored
from tessera.llm.words import PLAIN, Block, blocks

OTHERS = 1024  # rows that the rarer words share, as neighbours
HIDDEN = 16
OFFSETS = (-2, -1, 1, 2)
SIDE = 2
FIRST, SMALL, LARGE = 1 << 17, 1024, 8192  # positions a step: until FIRST are trained, and from there on
HELD = 1 << 16  # positions that are shuffled among each other
RATE = 0.2
AFTER = 50  # steps that the first positions of a later round stand for in their sums of squared gradients
ROUNDS = 2
END = 32  # the byte before and after a word
SMOOTH = 2.0
_FIXED = 1 << 11  # moves are added up as 16-bit fixed-point numbers, so that sums don't depend on their order
_CHUNK = 1 << 10  # rows of parameters whose moves travel together
_FAN = 256  # tasks, or groups of them, whose moves one group adds up
_LEVELS = 3  # so there may be _FAN ** 3 tasks
_MOVES = "chunk long, part long, who binary, value binary, weight binary"
_MERGE = 1 << 20  # distinct words that a task counts at once
_U = np.uint64


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _order(ids: np.ndarray) -> np.ndarray:
    """A stable order of ids from -1 on; small ones fit 16 bits, which sort faster."""
    shifted = ids + 1
    return np.argsort(shifted.astype(np.uint16) if shifted.max(initial=0) < 1 << 16 else shifted, kind="stable")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of its words; a word may come several times."""
    keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        own = counted(np.concatenate([keys[:0], *waiting]))
        return summed(np.concatenate((keys, own[0])), np.concatenate((counts, own[1])))

    def flush() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 1 << 16):
            own = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array(counts[own])], names=["word", "n"])

    for batch in batches:
        for block in blocks(batch.column(0), fold=True, apart=PLAIN):
            waiting.append(block.hashes)
            if sum(map(len, waiting)) >= _MERGE:
                keys, counts = merged()
                waiting.clear()
        if len(keys) > _MERGE:
            yield from flush()
            keys, counts = keys[:0], counts[:0]
    keys, counts = merged()
    yield from flush()


@dataclass
class Vocabulary:
    """Hashes of words in order, and their ids: 1 for the most frequent one; 0 is any other word."""

    hashes: np.ndarray
    ids: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)

    def look(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], 0).astype(np.int32)


def vocabulary_of(texts: DataFrame, floor: int | None = None) -> Vocabulary:
    """All words that occur at least floor times; by default an eighth of the root
    of the corpus's words, so that the vocabulary grows with about that root.

    The counts of all words are a stored table; only the vocabulary comes to
    the driver, of which there can't be more than 8 times that root.
    """
    counts = stored(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    if floor is None:
        floor = max(4, int((counts.agg(F.sum("n")).first()[0] or 0) ** 0.5 / 8))
    found = counts.where(F.col("n") >= floor).toArrow()
    discard(counts)
    words, n = found.column("word").to_numpy().view(_U), found.column("n").to_numpy()
    order = np.lexsort((words, -n))
    ids = np.empty(len(words), np.int32)
    ids[order] = np.arange(1, len(words) + 1)
    by = np.argsort(words)
    return Vocabulary(words[by], ids[by])


@dataclass
class Network:
    rows: np.ndarray  # offset, word or shared row or edge of a document, hidden
    bias: np.ndarray
    nodes: np.ndarray  # node of the tree (its children are 2 i and 2 i + 1), hidden + 1

    @staticmethod
    def start(words: int, seed: int = 7) -> Network:
        """A network for a vocabulary of so many words."""
        draw = np.random.default_rng(seed)
        depth = max(1, int(words).bit_length())
        rows = draw.normal(0, 0.1, (len(OFFSETS), words + 1 + OTHERS + 1, HIDDEN)).astype(np.float32)
        return Network(rows, np.zeros(HIDDEN, np.float32), np.zeros((1 << depth, HIDDEN + 1), np.float32))

    @property
    def depth(self) -> int:
        return len(self.nodes).bit_length() - 1

    def parts(self) -> list[np.ndarray]:
        return [self.rows, self.bias, self.nodes]

    def copy(self) -> Network:
        return Network(*(p.copy() for p in self.parts()))

    def tables(self) -> list[np.ndarray]:
        """The parameters as tables of rows; a row is what one word, edge or node asks."""
        return [self.rows.reshape(-1, HIDDEN), self.bias.reshape(1, HIDDEN), self.nodes]

    def moves(self, start: Network) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(chunk, rows of it, how far they moved) of every row that isn't where start has it."""
        limit = (1 << 15) - 1
        for number, (own, old) in enumerate(zip(self.tables(), start.tables(), strict=True)):
            for at in range(0, len(own), _CHUNK):
                moved = np.clip(np.round((own[at : at + _CHUNK] - old[at : at + _CHUNK]) * _FIXED), -limit, limit).astype("<i2")
                who = np.flatnonzero(moved.any(axis=1))
                if len(who):
                    yield number << 40 | at, who.astype("<u2"), moved[who]

    def move(self, chunk: int, who: np.ndarray, total: np.ndarray, weight: np.ndarray) -> None:
        """Move rows of a chunk by the average of moves whose weighted sum is total."""
        table = self.tables()[chunk >> 40]
        table[(chunk & (1 << 40) - 1) + who] += (total / (weight[:, None] * float(_FIXED))).astype(np.float32)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.bias + self.rows[0].take(context[:, 0], axis=0)
        for j in range(1, len(OFFSETS)):
            total += self.rows[j].take(context[:, j], axis=0)
        out = np.ones((len(context), HIDDEN + 1), np.float32)
        np.tanh(total, out=out[:, :HIDDEN])
        return out

    def log_p(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log P(token | the words around it)."""
        out = np.zeros(len(token))
        h = self.hidden(context)
        leaf = token.astype(np.int64) + len(self.nodes)
        for up in range(1, self.depth + 1):
            z = np.einsum("ij,ij->i", self.nodes.take(leaf >> up, axis=0), h)
            z *= 1 - 2 * ((leaf >> (up - 1)) & 1).astype(np.float32)
            out -= np.log1p(np.exp(np.clip(z, -80, 80)))  # -log of the chance to go the leaf's way
        return out

    def step(self, context: np.ndarray, token: np.ndarray, seen: Network, move: bool = True) -> None:
        """One Adagrad step on a batch in order of its tokens; seen holds the sums of
        squared gradients.  Without move only those are added up."""
        n = len(token)
        h = self.hidden(context)
        back = np.zeros_like(h)
        leaf = token.astype(np.int64) + len(self.nodes)
        for up in range(1, self.depth + 1):
            node = leaf >> up
            own = self.nodes.take(node, axis=0)
            g = 1 / (1 + np.exp(np.clip(-np.einsum("ij,ij->i", own, h), -80, 80)))
            g -= ((leaf >> (up - 1)) & 1).astype(np.float32)
            g = g[:, None]
            back += g * own
            _adagrad(self.nodes, seen.nodes, node, g * h, n, move)
        inner = back[:, :HIDDEN] * (1 - h[:, :HIDDEN] ** 2)
        grad = inner.sum(axis=0) / n
        seen.bias += grad * grad
        if move:
            self.bias -= RATE * grad / (np.sqrt(seen.bias) + 1e-6)
        for j in range(len(OFFSETS)):
            order = _order(context[:, j])
            _adagrad(self.rows[j], seen.rows[j], context[:, j].take(order), inner.take(order, axis=0), n, move)


def _adagrad(value: np.ndarray, seen: np.ndarray, at: np.ndarray, grad: np.ndarray, n: int, move: bool) -> None:
    """Move the rows of value named by at, which is in order, by the sums of their gradients."""
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    who, total = at[first], np.add.reduceat(grad, first, axis=0)
    total /= n
    squares = seen.take(who, axis=0) + total * total
    seen[who] = squares
    if move:
        value[who] -= RATE * total / (np.sqrt(squares) + 1e-6)


def positions(block: Block, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, contexts): of each word its id, and the rows of the words around it, -1 beyond its document."""
    token = vocabulary.look(block.hashes)
    shared = len(vocabulary) + 1 + (block.hashes % _U(OTHERS)).astype(np.int32)
    at = np.arange(len(token)) + SIDE * (block.row_of_word() + 1)
    spaced = np.full(len(token) + SIDE * (block.rows + 1), -1, np.int32)
    spaced[at] = np.where(token > 0, token, shared)
    return token, np.stack([spaced[at + offset] for offset in OFFSETS], axis=1)


def spelling(block: Block, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, before, byte) of each byte of the words at which, and of their ends:
    before holds the two bytes before it, of the word or END."""
    start, size = block.start[which], block.end[which] - block.start[which] + 1
    owner = np.repeat(np.arange(len(which)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
    at = start[owner] + place

    def byte(back: int) -> np.ndarray:
        own = block.data.take(at - back, mode="clip").astype(np.int32)
        own[place < back] = END
        return own

    here = byte(0)
    here[place == size[owner] - 1] = END
    return owner, byte(2) << 8 | byte(1), here


class Speller:
    """log P(byte | the two before), from counts of before << 8 | byte; each order is smoothed by the one below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        three = np.zeros((65536, 1), np.int32)
        used = np.unique(keys >> 8)
        three[used, 0] = np.arange(1, len(used) + 1)
        self.row = three[:, 0]  # 0: not seen
        two = np.zeros((256, 256))
        np.add.at(two, (keys >> 8 & 255, keys & 255), counts)
        one = (two.sum(axis=0) + 1) / (two.sum() + 256)
        two = (two + SMOOTH * one) / (two.sum(axis=1, keepdims=True) + SMOOTH)
        full = np.zeros((len(used) + 1, 256))
        full[self.row[keys >> 8], keys & 255] = counts
        full[1:] = (full[1:] + SMOOTH * two[used & 255]) / (full[1:].sum(axis=1, keepdims=True) + SMOOTH)
        full[0] = 1
        self.full, self.two = np.log(full).astype(np.float32), np.log(two).astype(np.float32)

    def log_p(self, before: np.ndarray, byte: np.ndarray) -> np.ndarray:
        row = self.row[before]
        return np.where(row > 0, self.full[row, byte], self.two[before & 255, byte]).astype(np.float64)


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    speller: Speller

    def word_scores(self, block: Block) -> np.ndarray:
        """log P of each word of a block given the words around it."""
        token, context = positions(block, self.vocabulary)
        out = np.concatenate([self.network.log_p(context[i : i + (1 << 14)], token[i : i + (1 << 14)]) for i in range(0, len(token), 1 << 14)] or [np.zeros(0)])
        rare = np.flatnonzero(token == 0)
        for i in range(0, len(rare), 1 << 16):
            owner, before, byte = spelling(block, rare[i : i + (1 << 16)])
            out[rare[i : i + (1 << 16)]] += np.bincount(owner, self.speller.log_p(before, byte))
        return out


def _trained(held, later: bool):
    """What a copy has moved after all positions of a task, each row with the number of
    those positions as its weight, and the counts of its rare words' bytes (chunk below 0)."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start = held.value
        network, seen = start.copy(), start.copy()
        for p in seen.parts():
            p[...] = 1e-8
        trained, waiting = 0, 0
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def learn() -> int:
            token, context = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.random.default_rng(len(token)).permutation(len(token))
            size = SMALL if trained < FIRST and not later else LARGE
            for warm in (True, False) if later and not trained else (False,):
                for at in range(0, len(order), size):
                    own = order[at : at + size]
                    own = own[_order(token[own])]
                    network.step(context[own], token[own], seen, move=not warm)
                if warm:
                    for p in seen.parts():
                        p *= AFTER * size / max(size, len(order))
            return len(token)

        for batch in batches:
            for block in blocks(batch.column(0), fold=True, apart=PLAIN):
                if not len(block.hashes):
                    continue
                kept.append(positions(block, vocabulary))
                rare = np.flatnonzero(kept[-1][0] == 0)
                waiting += len(block.hashes)
                for i in range(0, len(rare), HELD):
                    _, before, byte = spelling(block, rare[i : i + HELD])
                    own = counted((before << 8 | byte).astype(np.uint32))
                    keys, counts = summed(np.concatenate((keys, own[0])), np.concatenate((counts, own[1])))
                if waiting >= HELD:
                    trained += learn()
                    kept, waiting = [], 0
        if kept:
            trained += learn()
        if not trained:
            return
        rows = [(chunk, who.tobytes(), moved.tobytes(), np.full(len(who), trained, "<i8").tobytes()) for chunk, who, moved in network.moves(start)]
        for part in np.unique(keys >> 20).tolist():
            own = keys >> 20 == part
            rows.append((-1 - part, keys[own].astype("<i8").tobytes(), b"", counts[own].astype("<i8").tobytes()))
        for at in range(0, len(rows), 64):
            columns = zip(*rows[at : at + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["chunk", "who", "value", "weight"])

    return train


def _added(first: bool):
    """Add up the moves of a chunk, which at first are unweighted, or the counts of bytes."""

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk, part = (k.as_py() for k in key)
        parts = [table.column(c).to_pylist() for c in ("who", "value", "weight")]
        if chunk < 0:
            who, weight = summed(*(np.frombuffer(b"".join(x), "<i8") for x in (parts[0], parts[2])))
            value = b""
        else:
            width = HIDDEN + 1 if chunk >> 40 == 2 else HIDDEN
            total, weights = np.zeros((_CHUNK, width), np.int64), np.zeros(_CHUNK, np.int64)
            for own, moved, n in zip(*parts, strict=True):
                own, n = np.frombuffer(own, "<u2"), np.frombuffer(n, "<i8")
                moved = np.frombuffer(moved, "<i2" if first else "<i8").astype(np.int64).reshape(-1, width)
                total[own] += moved * n[:, None] if first else moved
                weights[own] += n
            who = np.flatnonzero(weights).astype("<u2")
            value, weight = total[who].tobytes(), weights[who]
        binary = [pa.array([x], pa.binary()) for x in (who.tobytes(), value, weight.astype("<i8").tobytes())]
        return pa.Table.from_arrays([pa.array([chunk], pa.int64()), pa.array([part // _FAN], pa.int64()), *binary], names=["chunk", "part", "who", "value", "weight"])

    return add


def fit(docs: DataFrame, text_col: str = "text", floor: int | None = None, rounds: int = ROUNDS) -> Model:
    """The model of all documents.

    Each round has its share of the documents, by a hash of the text, and
    starts from the average of the round before; so every position is trained
    on once.  A copy weighs as many positions as it trained on, for the rows
    that it moved.  Without words the network is the untrained one.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    vocabulary = vocabulary_of(texts, floor)
    network = Network.start(len(vocabulary))
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done = False
    for turn in range(rounds):
        held = spark.sparkContext.broadcast((vocabulary, network))  # grows with the root of the corpus
        share = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn)
        moves = share.mapInArrow(_trained(held, done), "chunk long, who binary, value binary, weight binary")
        moves = moves.withColumn("part", F.floor(F.spark_partition_id() / _FAN))
        for level in range(_LEVELS):
            moves = moves.groupBy("chunk", "part").applyInArrow(_added(level == 0), _MOVES)
        found = moves.toArrow()
        for chunk, who, value, weight in zip(*(found.column(c).to_pylist() for c in ("chunk", "who", "value", "weight")), strict=True):
            weight = np.frombuffer(weight, np.int64)
            if chunk < 0:
                keys, counts = summed(np.concatenate((keys, np.frombuffer(who, np.int64))), np.concatenate((counts, weight)))
            else:
                network.move(chunk, np.frombuffer(who, "<u2").astype(np.int64), np.frombuffer(value, np.int64).reshape(len(weight), -1), weight)
                done = True
    return Model(vocabulary, network, Speller(keys, counts))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every row.

    A token is a run of other than ASCII white space, full stops and commas,
    with A-Z lower-cased; log_prob is the pseudo-likelihood, the sum of the log
    of each token's probability given both sides.  A text without tokens, or a
    null one, has 0 tokens, a log_prob of 0 and a null mean; null ids and
    repeated rows are scored like others; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, **fitting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for block in blocks(batch.column(1), fold=True, apart=PLAIN):
                total = np.concatenate(([0.0], np.cumsum(model.word_scores(block))))
                own = total[block.bounds[1:]] - total[block.bounds[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(np.diff(block.bounds), pa.int64()), pa.array(own)], names=["doc_id", "n_tokens", "log_prob"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, log_prob double")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
