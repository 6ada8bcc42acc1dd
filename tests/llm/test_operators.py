"""Each operator against a plain version, and on awkward input."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, embedding_dedup, jaccard_join, lm_scoring, packing, quality, substring_dedup, topk_search, toxicity, url_filter, words
from tessera.llm import queries as Q
from tessera.llm.shared import components
from tests.llm import brute

DATA = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS_ONE = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n_words string, u string, id string, grp string"


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), 0.5, "x", "y", "z", "w", "v") for i, t in rows], DOCS)


def sample(spark, n):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(n).collect()]


def awkward():
    draw = random.Random(3)
    base = [f"w{draw.randrange(500)}" for _ in range(60)]
    long = " ".join(f"v{draw.randrange(900)}" for _ in range(40_000))
    return [
        (10, " ".join(base)),
        (3, " ".join(base)),
        (7, "\t".join(base[:58]) + "\nother words"),
        (8, " ".join(base[5:40])),
        (20, None),
        (21, ""),
        (22, " \n\t "),
        (23, "one"),
        (24, "One"),
        (25, "a b c d"),
        (26, "a a a a a " * 30),
        (27, "a a a a a " * 30 + "end"),
        (30, long),
        (31, long + " more"),
        (40, "x" * 70_000),
        (-5, "\u00a0nbsp\u2003wide \u1e9e ÀÉ 'll don't  two   spaces\x1fsep"),
        (41, " ".join(reversed(base))),
    ]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "src long, dst long")).isEmpty()


# 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, score string, terms string, v string")


def odd_vectors(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(0, 0.3, 8)], i % 2, "a", "b", "c", "d") for i in range(60)]
    same = [float(x) for x in draw.normal(0, 0.3, 8)]
    rows += [(100 + i, same, 1, "a", "b", "c", "d") for i in range(30)]
    rows += [(200, None, 1, "", "", "", ""), (220, [1.0, None] + [0.0] * 6, 1, "", "", "", ""), (240, [math.nan] * 8, 1, "", "", "", ""), (260, [math.inf] + [0.0] * 7, 1, "", "", "", "")]
    rows += [(280, [0.0] * 8, 1, "", "", "", ""), (300, same, None, "", "", "", ""), (320, [], 1, "", "", "", ""), (None, same, 1, "", "", "", ""), (340, [-0.31] * 8, 0, "", "", "", ""), (340, [-0.31] * 8, 0, "", "", "", "")]
    return rows


def test_top_k(spark):
    rows = odd_vectors(spark)
    df = vectors(spark, rows)
    got = topk_search.exact_top_k(df, df.where("vec_id % 20 = 0"), k=5, block_rows=16, query_rows=2)
    sound = [(i, [math.floor(64 * np.float64(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in sound if i % 20 == 0}.items():
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk_search.exact_top_k(df.limit(0), df.limit(0)).isEmpty()
    assert topk_search.exact_top_k(df, df.limit(0)).isEmpty()


def test_top_k_of_large_components(spark):
    rows = [(20, [3e9, 2.0**40]), (1, [2.0**40, -3e9]), (2, [2.0**40, -3e9 + 1]), (3, [-1.0, 2.0]), (4, [5.0, 0.0])]  # sums that pass 64 bits on the way
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.exact_top_k(df.where("vec_id <> 20"), df.where("vec_id = 20"))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(whole[20], whole[i])), i) for i in (1, 2, 3, 4))
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(i, -s) for s, i in want]
    for v in ([1e30, 1.0], [2.0**40, 2.0**40]):  # a component, then a score, without a place in 64 bits
        with pytest.raises(Exception, match="64 bits|2\\^62"):
            topk_search.exact_top_k(df, spark.createDataFrame([(40, v)], df.schema)).collect()


# 2


def lm_block(texts):
    return next(iter(words.blocks(pa.array(texts), fold=True, apart=words.PLAIN, block_bytes=1 << 30)))


def test_lm_scores(spark):
    docs = sample(spark, 300)
    df = table(spark, docs + [(None, "a b"), (900, None), (901, ""), (902, "one"), (1, docs[1][1])])
    rows = lm_scoring.score(df).collect()
    assert len(rows) == 305
    by = {r["doc_id"]: r for r in rows}
    assert (by[900]["n_tokens"], by[900]["log_prob"], by[900]["mean_log_prob"]) == (0, 0.0, None)
    assert by[902]["n_tokens"] == 1 and by[902]["log_prob"] < 0
    model = lm_scoring.fit(df)
    text = docs[3][1]
    block = lm_block([text])
    ids, net, v = model.vocabulary.look(block.hashes), model.network, len(model.vocabulary)
    spelled = re.findall(r"[^\x20\x09-\x0D.,]+", text.translate(brute.FOLD))
    assert len(spelled) == len(ids) == by[docs[3][0]]["n_tokens"]
    total = 0.0
    for i, t in enumerate(ids):  # one position, node and byte after another
        around = [i + o for o in lm_scoring.OFFSETS]
        rows_of = [-1 if not 0 <= j < len(ids) else ids[j] or v + 1 + int(block.hashes[j]) % lm_scoring.OTHERS for j in around]
        h = np.append(np.tanh(sum(net.rows[j][w] for j, w in enumerate(rows_of)) + net.bias), 1)
        node = 1
        for bit in f"{t:0{net.depth}b}":
            p = 1 / (1 + np.exp(-(net.nodes[node] @ h)))
            total += np.log(p if bit == "1" else 1 - p)
            node = 2 * node + int(bit)
        if not t:
            raw = b"  " + spelled[i].encode() + b" "
            for j in range(2, len(raw)):
                row = model.speller.row[raw[j - 2] << 8 | raw[j - 1]]
                total += model.speller.full[row, raw[j]] if row else model.speller.two[raw[j - 1], raw[j]]
    assert by[docs[3][0]]["log_prob"] == pytest.approx(total, rel=1e-4)
    assert lm_scoring.score(df.limit(0)).isEmpty()


def test_lm_probabilities_sum_to_one(spark):
    model = lm_scoring.fit(table(spark, sample(spark, 100)))
    size = len(model.network.nodes)
    context = np.array([[1, 2, 3, -1]] * size)
    assert np.exp(model.network.log_p(context, np.arange(size))).sum() == pytest.approx(1, abs=1e-4)
    for before in (lm_scoring.END << 8 | lm_scoring.END, ord("a") << 8 | ord("b"), 5 << 8 | 6):
        assert np.exp(model.speller.log_p(np.full(256, before), np.arange(256))).sum() == pytest.approx(1, abs=1e-3)


def test_lm_beats_unigram_and_bigram_and_ranks_bad_documents_low(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = lm_scoring.fit(docs.where("doc_id % 10 <> 3"))
    taught, held = (lm_block([r["text"] for r in docs.where(f"doc_id % 10 {c} 3 and doc_id < 5000").orderBy("doc_id").collect()]) for c in ("<>", "="))
    own = [lm_scoring.positions(b, model.vocabulary) for b in (taught, held)]
    size = len(model.vocabulary) + 1
    one = np.bincount(own[0][0], minlength=size) + 1.0
    one /= one.sum()
    before = [np.where(c[:, 1] < size, np.maximum(c[:, 1], -1), 0) for _, c in own]  # the word to the left
    pairs = Counter(zip(before[0].tolist(), own[0][0].tolist(), strict=True))
    left = Counter(before[0].tolist())
    two = np.mean([np.log((pairs[a, b] + 20 * one[b]) / (left[a] + 20)) for a, b in zip(before[1].tolist(), own[1][0].tolist(), strict=True)])
    net = model.network.log_p(own[1][1], own[1][0]).mean()
    assert net > np.log(one)[own[1][0]].mean() + 0.3 and net > two
    known = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = lm_scoring.score(spark.read.parquet(f"{DATA}/documents.parquet")).join(known, "doc_id").where("n_tokens > 0").collect()
    good, bad = (np.array([r["mean_log_prob"] for r in rows if r["quality"] == q]) for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.6  # bad documents of repeated lines are easy to predict, so not near 1


def test_lm_step_is_the_gradient():
    """One step on a few positions moves each row against the numeric gradient of their mean -log P, by Adagrad's rule."""
    draw = np.random.default_rng(3)
    net = lm_scoring.Network.start(6)
    net.nodes[...] = draw.normal(0, 0.5, net.nodes.shape)
    token = np.sort(draw.integers(0, 7, 12)).astype(np.int32)
    context = draw.integers(-1, 7, (12, len(lm_scoring.OFFSETS))).astype(np.int32)
    wide = lm_scoring.Network(*(p.astype(np.float64) for p in net.parts()))

    def loss():
        h = np.tanh(wide.bias + sum(wide.rows[j][context[:, j]] for j in range(context.shape[1])))
        h, total = np.column_stack([h, np.ones(len(h))]), 0.0
        for one, t in zip(h, token.tolist(), strict=True):
            node = 1
            for bit in f"{t:0{net.depth}b}":
                z = wide.nodes[node] @ one
                total += np.log1p(np.exp(-z if bit == "1" else z))
                node = 2 * node + int(bit)
        return total / len(token)

    after, seen = net.copy(), net.copy()
    for p in seen.parts():
        p[...] = 1e-8
    after.step(context, token, seen)
    for before, now, free in zip(net.parts(), after.parts(), wide.parts(), strict=True):
        for at in draw.permutation(before.size)[:200].tolist():
            at = np.unravel_index(at, before.shape)
            old = free[at]
            free[at] = old + 1e-5
            up = loss()
            free[at] = old - 1e-5
            slope = (up - loss()) / 2e-5
            free[at] = old
            assert now[at] - before[at] == pytest.approx(-lm_scoring.RATE * slope / (np.sqrt(slope * slope + 1e-8) + 1e-6), abs=2e-3)


def test_lm_averages_only_what_copies_moved():
    """Sums over three levels are those of a plain loop, and rows that no copy moved stay."""
    draw = np.random.default_rng(4)
    start = lm_scoring.Network.start(3000)
    copies, rows = [], []
    for n in range(7):
        own = start.copy()
        for p, size in zip(own.tables(), (400, 1, 300), strict=True):
            p[draw.choice(len(p), size, replace=False)] += draw.normal(0, 0.2, (size, p.shape[1]))
        copies.append((own, 10 + n))
        rows += [(chunk, n // 3, who.tobytes(), moved.tobytes(), np.full(len(who), 10 + n, "<i8").tobytes()) for chunk, who, moved in own.moves(start)]
    assert sum(len(r[2]) // 2 for r in rows) == 7 * 701
    for first in (True, False):
        groups = {}
        for r in rows:
            groups.setdefault((r[0], r[1] if first else 0), []).append(r)
        rows = []
        for key, own in groups.items():
            made = lm_scoring._added(first)(tuple(map(pa.scalar, key)), pa.table({n: [r[i] for r in own] for i, n in enumerate(("chunk", "part", "who", "value", "weight"))}))
            rows += [tuple(r.values()) for r in made.to_pylist()]
    got = start.copy()
    for chunk, _, who, value, weight in rows:
        weight = np.frombuffer(weight, np.int64)
        got.move(chunk, np.frombuffer(who, "<u2").astype(np.int64), np.frombuffer(value, np.int64).reshape(len(weight), -1), weight)
    for i, (table, old) in enumerate(zip(got.tables(), start.tables(), strict=True)):
        moved = np.stack([(c.tables()[i] != old).any(axis=1) * n for c, n in copies])
        far = sum((c.tables()[i] - old) * n for c, n in copies)
        want = old + far / np.maximum(moved.sum(axis=0), 1)[:, None]
        assert np.abs(table - want).max() < 1e-3
        still = moved.sum(axis=0) == 0
        assert (table[still] == old[still]).all() and (i == 1 or still.any())


def test_lm_awkward(spark):
    docs = awkward()
    long = " ".join(f"v{i % 977} common" for i in range(300_000))
    df = table(spark, docs + [(50, long), (None, "a b"), (10, docs[0][1])])
    by = {}
    for r in lm_scoring.score(df).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, by.values())) == len(docs) + 3 and by[10][0] == by[10][1]
    assert by[50][0]["n_tokens"] == 600_000 and all(np.isfinite(r["log_prob"]) and r["log_prob"] <= 0 for x in by.values() for r in x)
    assert all(by[i][0]["mean_log_prob"] is None for i in (20, 21, 22))


def test_lm_vocabulary_grows_and_rare_words_differ(spark):
    docs = [(i, f"{'a b c d ' * 40}w{i % 20}") for i in range(400)] + [(1000, "zqxing"), (1001, "abcing"), (1002, "\ud55c\uae00 zqxing")]
    df = table(spark, docs)
    names = ["a", "b", "c", "d", *(f"w{i}" for i in range(20))]
    small, large = lm_scoring.fit(df, floor=30), lm_scoring.fit(df, floor=20)
    assert [t > 0 for t in small.vocabulary.look(lm_block([" ".join(names)]).hashes)] == [True] * 4 + [False] * 20
    assert (large.vocabulary.look(lm_block([" ".join(names)]).hashes) > 0).all() and large.network.rows.shape[1] > small.network.rows.shape[1]
    by = {r["doc_id"]: r for r in lm_scoring.score(df, floor=30).collect()}
    assert by[1000]["n_tokens"] == 1 and len({round(by[i]["log_prob"], 6) for i in (1000, 1001, 1002)}) == 3
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    assert len(lm_scoring.vocabulary_of(texts.limit(100))) < len(lm_scoring.vocabulary_of(texts))


# 3


def digests(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in df.collect()}


def test_substring_dedup(spark):
    docs = awkward() + [(1000 + i, t) for i, t in sample(spark, 150)] + [(5000 + i, t[10:700]) for i, t in sample(spark, 20)]
    got = digests(substring_dedup.remove_repeats(table(spark, docs)))
    assert got == brute.substring_dedup(dict(docs))


def test_substring_dedup_long_prefixes(spark):
    draw = random.Random(4)
    often = "b c d e f g h i j k l m n o p"
    docs = [(i, " ".join(f"x{draw.randrange(9)}" for _ in range(draw.randrange(9))) + f" {often} " + " ".join(f"x{draw.randrange(9)}" for _ in range(draw.randrange(30)))) for i in range(400)]
    got = digests(substring_dedup.remove_repeats(table(spark, docs), group_rows=20, most_suffixes=1))
    assert got == brute.substring_dedup(dict(docs))


def test_suffix_tree():
    draw = random.Random(2)
    for least in (1, 3, 5):
        texts = [[draw.randrange(3) for _ in range(draw.randrange(1, 25))] for _ in range(30)]
        suffixes = sorted((t[i:], n, i) for n, t in enumerate(texts) for i in range(len(t)) if len(t) - i >= least)
        symbols = np.array([x for t in texts for x in t], np.uint64) * np.uint64(77)
        left = np.array([len(t) - i for t in texts for i in range(len(t))])
        at, common = substring_dedup.suffix_tree(symbols, left, least)
        ordered = [(symbols[a : a + left[a]] // np.uint64(77)).tolist() for a in at.tolist()]
        assert ordered == [s for s, _, _ in suffixes]
        assert common.tolist() == [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(ordered, ordered[1:])]
        node = substring_dedup.deep_nodes(common, least).tolist()
        heads = sorted({tuple(s[:least]) for s in ordered})
        assert [heads[n] for n in node] == [tuple(s[:least]) for s in ordered]


def test_substring_dedup_awkward(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = table(spark, [(1, text), (1, text), (None, text), (2, "pre " + text + " post"), (3, None)])
    rows = substring_dedup.remove_repeats(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in rows) == [(0, 30, 0), (1, 30, 0), (1, 30, 0), (2, 32, 30), (3, 0, 0)]
    two = next(r for r in rows if r["doc_id"] == 2)
    assert two["kept"] == "pre post" and [tuple(p) for p in two["passages"]] == [(1, 31)] and two["u"] == "z"
    assert substring_dedup.remove_repeats(df.limit(0)).isEmpty()
    same = substring_dedup.remove_repeats(table(spark, [(1, "a  b\nc")]), rejoin=False)
    assert same.first()["kept"] == "a  b\nc"


# 4, 5


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    scored = Q.op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    found = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    hit, missed, wrong = found[1, 1], found.get((1, 0), 0), found.get((0, 1), 0)
    assert hit / (hit + missed) > 0.85 and hit / (hit + wrong) > 0.97


def test_toxicity_awkward(spark):
    docs = awkward() + [(None, "you idiot"), (10, "you stupid moron")]
    df = table(spark, docs)
    for known in ([], [(10, 1, 1)], [(10, 1, None), (None, 1, 1), (3, 1, 0), (3, 1, 1)]):
        rows = toxicity.score_toxicity(df, labels(spark, known)).collect()
        assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    held = {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"] is not None}
    assert held == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in held}
    assert toxicity.score_toxicity(df.limit(0), labels(spark, [])).isEmpty()


def test_isotonic_and_trees():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = toxicity.boost(x, y)
    assert ((model.raw(x) > 0) == (y > 0)).mean() > 0.9
    at, value = toxicity.isotonic(np.array([1.0, 2, 3, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert np.interp([1, 2, 3, 4], at, value) == pytest.approx([0, 1 / 3, 1 / 3, 1])


def test_quality(spark):
    known = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = Q.op5_quality_classifier(spark, DATA).join(known, "doc_id").collect()
    assert sum(r["keep"] == bool(r["quality"]) for r in rows) / len(rows) > 0.97
    assert all(r["keep"] for r in rows if r["quality"]) or sum(not r["keep"] for r in rows if r["quality"]) <= 2


def test_quality_held_out(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.classify(docs, known.where("doc_id % 2 = 0")).join(known.where("doc_id % 2 = 1"), "doc_id")
    found = {(r["quality"], r["keep"]): r["count"] for r in scored.groupBy("quality", "keep").count().collect()}
    good, bad = (found.get((q, True), 0) / sum(n for (x, _), n in found.items() if x == q) for q in (1, 0))
    assert good > 0.97 and bad < 0.1


def test_quality_awkward(spark):
    docs = awkward() + [(None, "words"), (10, "again")]
    df = table(spark, docs).withColumn("source", F.when(F.col("doc_id") > 5, F.col("source")))
    for known in ([], [(10, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (7, None, 0)]):
        rows = quality.classify(df, labels(spark, known)).collect()
        assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.with_posterior(df, labels(spark, []), "p").columns == [*df.columns, "p"]
    assert quality.classify(df.limit(0), labels(spark, [])).isEmpty()


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 3.0)] * 200 + [("bad", "a", -3.0)] * 200 + [("tiny", "a", -3.0)] + [("mixed", str(i % 4), 3.0 if i % 2 else -3.0) for i in range(40)]
    shift = {(r["host"], r["path"]): r["shift"] for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, log_odds double")).collect()}
    assert shift["big", "a"] > 1 and shift["bad", "a"] < -1
    assert shift["bad", "a"] < shift["tiny", "a"] < 0


# 6


def whole(text, ranks):
    held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={})
    return enc.encode_ordinary(text or "")


@pytest.mark.parametrize("sizes", [{}, {"long_chars": 300, "chunk_chars": 100, "overlap": 40}, {"near_chars": 60, "near_overlap": 30}])
def test_bpe(spark, sizes):
    docs = [d for d in awkward() if d[0] != 30] + [(None, "null id"), (9, "twice " * 100), (9, "twice " * 100), (50, "<|endoftext|> " * 40)] + [(1000 + i, t) for i, t in sample(spark, 60)]
    rows = bpe.encode(table(spark, docs), RANKS, public_tokenizers.PATTERN, **sizes).collect()
    got = sorted((r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"])) for r in rows)
    assert got == sorted((i or 0, np.array(whole(t, RANKS), "<u4").tobytes(), (t or "").encode()) for i, t in docs)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    back = bpe.decode(bpe.encode(table(spark, docs[:5]), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back.collect()} == {i: (t or "").encode() for i, t in docs[:5]}


def test_bpe_parts():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for _, text in awkward():
        for size in (50, 1000):
            pieces = list(bpe.parts(text or "", public_tokenizers.PATTERN, size))
            assert "".join(pieces) == (text or "")
            assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text or "")


def test_bpe_stitches():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    many = 0
    for _, text in awkward():
        for size, overlap in ((20, 12), (50, 30), (1000, 100)):
            pieces = bpe.stitched(text or "", public_tokenizers.PATTERN, size, overlap)
            many += len(pieces) > 1
            assert "".join(pieces) == (text or "")
            assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text or "")
    assert many > 3


def test_bpe_empty(spark):
    assert bpe.encode(table(spark, [(1, "a")]).limit(0), RANKS, public_tokenizers.PATTERN).isEmpty()


# 7


def judged(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        path = rest[len(host) :]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        host = host.translate(brute.FOLD)
    best = None
    for verdict, rule in Q.URL_RULES:
        on, _, tail = rule.partition("/")
        if (host == on or host.endswith("." + on)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


URLS = [None, "", "no scheme.com/", "http://", "http://com/", "http://COM", "https://a.example.com/en/x?y://z", "https://www.EXAMPLE.com/en/", "ftp://www.example.com/en", "http://x.net/fr/1#/es/", "http://notcom/", "http://a.com?b/c", "http://ünï.net/es/é", "x://y://z.net/es/", "http://a.com/\n/en", "http://" + "a" * 5000 + ".org/" + "b" * 20000]


def test_url_rules(spark):
    pages = [(i, u, "html", "h") for i, u in enumerate(URLS + ["http://r.com/x"] * 3)] + [(None, "http://n.net/es/", "", "")]
    pages += [(1000 + r["page_id"], r["url"], "", "") for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    rows = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string, host string"), Q.URL_RULES).collect()
    assert len(rows) == len(pages)
    urls = {i: u for i, u, *_ in pages}
    for r in rows:
        host, path, best = judged(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")


def test_url_models(spark):
    good = [(i, f"http://a{i % 7}.com/news/{i}") for i in range(300)]
    bad = [(1000 + i, f"http://b{i % 7}.net/fr/xq-zz{i}") for i in range(300)]
    ask = [(5000, "http://c.org/news/77"), (5001, "http://c.org/fr/xq-zz77")]
    found = url_filter.filter_urls(spark.createDataFrame(good + bad + ask, "page_id long, url string"), Q.URL_RULES)
    got = {r["page_id"]: r["verdict"] for r in found.where("page_id >= 5000").collect()}
    assert got == {5000: "allow", 5001: "block"}
    assert url_filter.filter_urls(spark.createDataFrame(ask, "page_id long, url string"), []).where("verdict = 'allow' and score = 0").count() == 2
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), Q.URL_RULES).isEmpty()


def plain_scores(decided, asked, weight=4.0):
    """Scores of asked texts by models of decided ones: (text, accepted)."""
    fold = lambda text: re.sub(rb"[0-9]", b"0", text.encode())
    n, total = Counter(), Counter()
    for text, accepted in decided:
        raw = fold(text)
        for i, order in ((i, o) for i in range(len(raw)) for o in range(5)):
            context = (order, b"\0" * (order - i) + raw[max(0, i - order) : i])
            n[accepted, context, raw[i]] += 1
            total[accepted, context] += 1
    for text in asked:
        raw, score = fold(text), 0.0
        for i in range(len(raw)):
            p = [1 / 256, 1 / 256]
            for order in range(5):
                context = (order, b"\0" * (order - i) + raw[max(0, i - order) : i])
                p = [(n[c, context, raw[i]] + weight * p[c]) / (total[c, context] + weight) for c in (0, 1)]
            score += math.log(p[1]) - math.log(p[0])
        yield score / max(len(raw), 1)


@pytest.mark.parametrize("spread", [4, 4096])
def test_url_scores(spark, monkeypatch, spread):
    """Scores by a plain loop; broadcast and joined counts give the same rows, also where one URL is a third of all."""
    monkeypatch.setattr(url_filter, "SPREAD", spread)
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").orderBy("page_id").limit(300).collect()]
    pages += [(9001, "http://new.org/ünï/42"), (9002, None), (9003, "x://"), (9004, "http://new.org/" + "ab" * 4000), (None, "http://r.com/x")]
    pages += [(10_000 + i, "http://hot.com/en/1") for i in range(150)]
    df = spark.createDataFrame([(i, u, "", "", 0.0, 0, 0) for i, u in pages], "page_id long, url string, rule string, verdict string, score double, a int, gram int")
    key = lambda r: (r["page_id"] is None, r["page_id"], r["score"])
    rows = sorted(url_filter.filter_urls(df, Q.URL_RULES).collect(), key=key)
    decided = [(r["host"] + r["path"], int(r["verdict"] == "allow")) for r in rows if r["rule"]]
    want = plain_scores(decided, [r["host"] + r["path"] for r in rows])
    assert [r["score"] for r in rows] == pytest.approx(list(want), abs=1e-9)
    monkeypatch.setattr(url_filter, "GRAM_BYTES", 0)
    joined = sorted(url_filter.filter_urls(df, Q.URL_RULES).collect(), key=key)
    assert [tuple(r)[:5] for r in joined] == [tuple(r)[:5] for r in rows]
    assert [r["score"] for r in joined] == pytest.approx([r["score"] for r in rows], abs=1e-12)
    assert url_filter.filter_urls(df.limit(0), Q.URL_RULES).isEmpty()


def test_url_chances_add_up():
    found, _ = url_filter.grams(pa.array(["abcabd", "zabc", "é1"]))
    gram, n = np.unique(found, return_counts=True)
    counts = url_filter.Counts.of(gram, np.stack([n, n * 2], axis=1))
    whole = np.zeros(2)
    for byte in range(256):
        asked = (found[:, 2:3] >> url_filter.SYMBOL << url_filter.SYMBOL) | (byte + 1)
        whole += url_filter.chances(asked, counts, 4.0)[0]
    assert whole == pytest.approx([1, 1])


# 8


def test_embedding_dedup(spark):
    draw = np.random.default_rng(11)
    rows = odd_vectors(spark)
    for c in range(25):
        centre = draw.normal(size=8)
        rows += [(1000 + c * 20 + i, [float(x) for x in centre + draw.normal(0, 0.12, 8)], c % 3, "", "", "", "") for i in range(12)]
    found = {(r["vec_id"], r["n_links"]): r for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    sound = [(i, np.float32(v).astype(float), l) for i, v, l, *_ in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    groups, links = brute.Groups({i for i, *_ in sound}), {}
    for a, (i, v, l) in enumerate(sound):
        for b, (j, w, m) in enumerate(sound):
            if a != b and l == m and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                groups.join(i, j)
                links[a] = links.get(a, 0) + 1
    true, got = sum(links.values()), sum(r["n_links"] for r in found.values())
    assert got <= true and len(found) <= len(rows)
    assert got / (true + 1) >= 0.9
    plain = {r["vec_id"]: r for r in found.values()}
    for i in (200, 220, 240, 260, 280, 300, 320):
        assert (plain[i]["n_links"], plain[i]["component_id"], plain[i]["kept"]) == (0, i, True)
    assert plain[115]["n_links"] == 29 and plain[115]["component_id"] == 100 and not plain[115]["kept"] and plain[100]["kept"]
    assert plain[None]["component_id"] is None and plain[None]["kept"]
    assert embedding_dedup.near_duplicates(vectors(spark, rows).limit(0)).isEmpty()


@pytest.mark.parametrize("block", [1024, 8])
def test_embedding_recall(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(60, 64))
    rows = []
    for i in range(360):
        v = centres[i % 60] + draw.normal(0, 0.22, 64)
        rows.append((i, [float(x) for x in v], 0, "", "", "", ""))
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    v = np.array([np.float32(r[1]) for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = (v @ v.T >= 0.93).sum(axis=1) - 1
    assert all(got[i] <= true[i] for i in got)
    assert sum(got.values()) >= 0.9 * true.sum() > 100


# 9


@pytest.mark.parametrize("short, paired, sent", [(16, 4, 1 << 20), (2, 0, 1 << 20), (2, 4, 0)])
def test_jaccard_join(spark, short, paired, sent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    monkeypatch.setattr(jaccard_join, "MOST_SENT", sent)
    draw = random.Random(9)
    base = [f"t{i}" for i in range(80)]
    near = []
    for i in range(25):  # near copies of one text, each changed elsewhere
        own = list(base)
        for _ in range(draw.randrange(3)):
            own[draw.randrange(80)] = f"new{i}"
        near.append((500 + i, " ".join(own)))
    line = " ".join(f"c{i}" for i in range(12))
    shared = [(700 + i, line + " " + " ".join(f"d{draw.randrange(50)}" for _ in range(4))) for i in range(25)]
    docs = awkward() + near + shared
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(table(spark, docs)).collect()}
    assert got == brute.jaccard_join(dict(docs))


@pytest.mark.parametrize("changes", [3, 5])  # any two copies link, or hardly any (a Jaccard similarity of some 0.82 or 0.71)
def test_jaccard_pairs_of_near_copies(spark, changes, monkeypatch):
    """Sets are shuffled for about as many pairs as there are documents, not for all pairs of a long posting."""
    draw, base = random.Random(21), [f"w{i}" for i in range(300)]
    docs = []
    for i in range(120):
        own = list(base)
        for at in range(changes):
            own[draw.randrange(280 * at // changes + 5, 280 * (at + 1) // changes - 5)] = f"own{i}x{at}"
        docs.append((i, " ".join(own)))
    pairs, real = spark.sparkContext.accumulator(0), jaccard_join._similar

    def counting(percent):
        verify = real(percent)

        def count(batches):
            for batch in batches:
                pairs.add(len(batch))
                yield from verify(iter([batch]))

        return count

    monkeypatch.setattr(jaccard_join, "_similar", counting)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(table(spark, docs)).collect()}
    assert got == brute.jaccard_join(dict(docs))
    assert len({c for _, c in got.values()}) == 1 if changes == 3 else len({c for _, c in got.values()}) > 110
    assert (119 if changes == 3 else 0) <= pairs.value <= 240


def test_jaccard_sketches():
    draw = np.random.default_rng(5)
    for n in (0, 1, 40, 700, 5000):
        own = np.unique(draw.integers(0, 1 << 63, n, np.uint64))
        for m in (0, n // 10, n // 4):
            other = np.unique(np.concatenate((own[m:], draw.integers(0, 1 << 63, 2 * m, np.uint64))))
            x, y = jaccard_join.sketch(own), jaccard_join.sketch(other)
            assert len(x) == jaccard_join.sketch_bytes(len(own)) and len(y) == jaccard_join.sketch_bytes(len(other))
            true = len(np.setxor1d(own, other))
            assert 0.6 * true <= jaccard_join.apart([x], [y])[0] == jaccard_join.apart([x, y], [y, x])[1] <= true


def test_jaccard_awkward(spark):
    df = table(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (9, None)])
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.link(df).collect())
    assert [r[:2] for r in rows] == [(0, 2), (2, 2), (5, 2), (5, 2), (9, 0)]
    assert [r[2] for r in rows] == [None, 2, 2, 2, 9]
    kept = sorted((r["doc_id"] or 0, r["kept"]) for r in jaccard_join.link(df).collect())
    assert kept == [(0, True), (2, True), (5, False), (5, False), (9, True)]
    assert jaccard_join.link(df.limit(0)).isEmpty()


def test_jaccard_ids_of_two_texts(spark):
    draw, docs = random.Random(12), []
    for i in range(24):
        base = [f"p{draw.randrange(10**6)}" for _ in range(104)]
        other = list(base)
        for at in (20, 45, 70):  # of 100 shingles 15 are others: under 80 of 100 in common
            other[at] = f"q{draw.randrange(10**6)}"
        docs += [(100 * i, " ".join(base)), (100 * i, " ".join(other)), (100 * i + 9, " ".join([*base, "end"]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(table(spark, docs)).collect()}
    assert {i: c for i, c in got.items() if i % 100} == {100 * i + 9: 100 * i for i in range(24)}


# 10


def test_packing(spark):
    docs = [d for d in awkward()] + [(None, "null id " * 50), (9, "twice"), (9, "twice")] + [(1000 + i, t) for i, t in sample(spark, 120)]
    pieces = packing.pack(table(spark, docs), RANKS_ONE, public_tokenizers.PATTERN).collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [0] for i, t in docs}
    seen, sequences = {}, {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] > 0 and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, spans in seen.items():
        copies = 2 if i == 9 else 1
        assert sum(n for _, n in spans) == copies * len(ids[i])
        if copies == 1:
            assert [s for s, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]]
    assert set(seen) == set(ids)
    padded = 0
    for spans in sequences.values():
        spans.sort()
        total = sum(n for _, n in spans)
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and total <= 1024
        padded += 0 if total & (total - 1) == 0 else 1024 - total
    assert padded <= 0.02 * sum(map(len, ids.values()))
    assert packing.pack(table(spark, docs).limit(0), RANKS_ONE, public_tokenizers.PATTERN).isEmpty()


def test_packing_ids_are_those_of_the_json(spark):
    text = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x\n\n<|endoftext|>\n\nword <|endoftext", "plain  text"]
    text.append("word\n\n" * 40 + "<|endoftext|>" + "two  words " * 30)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(table(spark, list(enumerate(text))), RANKS_ONE, public_tokenizers.PATTERN).collect()
    want = {i: own.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(text)}
    assert 50256 in want[0] and {p["doc_id"] for p in pieces} == set(want)
    for p in pieces:
        part = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(want[p["doc_id"]]) and zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
    enc = bpe.encoding(RANKS_ONE, public_tokenizers.PATTERN)
    for size in range(8, 40):  # wherever the cuts fall
        for t in text:
            assert sum((enc.encode_ordinary(x) for x in bpe.parts(t, public_tokenizers.PATTERN, size)), []) == enc.encode_ordinary(t)


def test_bm25_scores(spark):
    draw = random.Random(8)
    docs = [[draw.randrange(60) for _ in range(draw.randrange(1, 90))] for _ in range(50)]
    found = [np.unique(np.array(d, np.uint32), return_counts=True) for d in docs]
    index = packing.Index([f[0] for f in found], [f[1] for f in found], np.array([len(d) for d in docs], float))
    mean = sum(map(len, docs)) / len(docs)
    idf = {t: max(0.0, math.log((len(docs) - n + 0.5) / (n + 0.5))) for t in range(60) if (n := sum(t in d for d in docs))}
    for seed in range(50):
        score = [sum(idf[t] * d.count(t) * (packing.K1 + 1) / (d.count(t) + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in set(docs[seed]) if t in d) for d in docs]
        ranked = index.neighbours(seed).tolist()
        assert sorted(ranked) == [i for i, x in enumerate(score) if x > 0]
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(ranked, ranked[1:]))


def test_packing_shards_by_content_and_not_crowded(spark):
    draw = random.Random(5)
    rows, n = [], 4000
    for i in range(n):
        if i % 3 == 0:  # one text makes up a third of all
            tokens = list(range(100, 160))
        else:  # pairs of near copies
            own = random.Random(i // 6)
            tokens = [own.randrange(50_000) for _ in range(60)]
            tokens[draw.randrange(60)] = draw.randrange(50_000)
        one, two = packing.least_hashes(np.array(tokens, np.uint32))
        rows.append((one, two, i, len(tokens) + 1, b"", np.array(tokens, "<u2").tobytes()))
    df = spark.createDataFrame(rows, "one long, two long, doc_id long, tokens long, crcs binary, rest binary")
    got = {r["doc_id"]: r["shard"] for r in packing.sharded(df, 200).collect()}
    sizes = Counter(got.values())
    assert len(got) == n and max(sizes.values()) < 3 * 200
    pairs = [(i, j) for i in range(n) for j in range(i + 1, min(n, i // 6 * 6 + 6)) if i % 3 and j % 3]
    assert sum(got[i] == got[j] for i, j in pairs) / len(pairs) > 0.85
    assert packing.least_hashes(np.zeros(0, np.uint32)) == (0, 0)


def test_packing_prefers_neighbours():
    draw = random.Random(4)
    topics = [[f"{t}{i}" for i in range(40)] for t in "abcdefgh"]
    terms, where = [], []
    for i in range(64):
        t = draw.randrange(8)
        where.append(t)
        terms.append(np.unique([t * 100 + draw.randrange(40) for _ in range(30)]).astype(np.uint32))
    sizes = np.full(64, 200)
    index = packing.Index(terms, [np.ones(len(t), np.uint8) for t in terms], sizes.astype(float))
    windows = packing.fill(sizes, index.neighbours, 1024, 30)
    alike = [where[m[0]] == where[w[0][0]] for w in windows[:8] for m in w[1:]]
    assert sum(alike) / len(alike) > 0.8 and len(topics) == 8
