"""Whitening against exact arithmetic and plain linear algebra."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening as W
from tessera.llm import queries as Q

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, component string, n string, deviation string, part string, at string"


def frame(spark, rows):
    """Vectors with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in rows], SCHEMA)


def drawn(n, d, seed=1):
    draw = np.random.default_rng(seed)
    mix = draw.normal(0, 1, (d, d))
    return [(i, [float(x) for x in np.float32(mix @ draw.normal(0, 1, d))]) for i in range(n)]


def exact(rows, scale=64, offset=1_000_000):
    """(x, sums, covariance as fractions) of usable rows."""
    x = [[math.floor(scale * float(np.float32(c))) + offset for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    apart = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in apart), n**3) for j in range(d)] for i in range(d)]
    return apart, sums, cov


def check(got, rows, k):
    apart, sums, cov = exact(rows)
    n, d = len(rows), len(sums)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vectors = values[::-1], vectors.T[::-1]
    k = min(k, d)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by) == sorted(i for i, _ in rows)
    want = np.array(apart, float) / n @ vectors[:k].T / np.sqrt(values[:k])
    found = np.array([[by[i][c]["whitened"] for c in range(1, k + 1)] for i, _ in rows])
    sign = np.sign((want * found).sum(axis=0))
    assert np.abs(want * sign - found).max() < 1e-8
    assert np.abs(np.cov(found.T, bias=True) - np.eye(k)).max() < 1e-8
    for (i, _), a in zip(rows, apart, strict=True):
        assert sorted(by[i]) == list(range(1, k + 1))
        for c, r in by[i].items():
            assert (r["n"], r["deviation"]) == (n, sum(x * x for x in a))
            assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_whitened(spark, d):
    rows = drawn(150, d)
    check(W.whiten(frame(spark, rows).repartition(5)).collect(), rows, 32)


def test_parts_and_scale_of_states(spark, monkeypatch):
    """Many small tasks, merged in several levels, give the same."""
    monkeypatch.setattr(W, "MOST_TASKS", 27)
    monkeypatch.setattr(W, "FAN", 3)
    rows = drawn(200, 6, seed=4)
    check(W.whiten(frame(spark, rows).repartition(40), k=4).collect(), rows, 4)


def test_odd_vectors(spark):
    rows = drawn(60, 5, seed=2)
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf")] * 5), (104, []), (105, [1.0, 2.0])]
    check(W.whiten(frame(spark, rows + odd)).collect(), rows, 32)


def test_repeated_rows_and_null_ids(spark):
    rows = drawn(30, 3, seed=3)
    got = W.whiten(frame(spark, [*rows, rows[0], rows[0], (None, rows[1][1])])).collect()
    assert len(got) == 33 * 3 and {r["n"] for r in got} == {33}
    same = {(r["component"], r["whitened"], r["deviation"]) for r in got if r["vec_id"] == 0}
    assert len(same) == 3  # ties are equal rows
    _, _, cov = exact([*rows, rows[0], rows[0], (99, rows[1][1])])
    trace = float(sum(cov[i][i] for i in range(3)))
    top = max(np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov])))
    assert next(r["explained"] for r in got if r["component"] == 1) == pytest.approx(top / trace, rel=1e-12)


def test_nothing_varies(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert W.whiten(frame(spark, rows)).collect() == []
    # one of three directions only
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    got = W.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_large_numbers(spark):
    """Deviations beyond 63 bits are exact; components without room for exactness are an error."""
    rows = [(i, [float(2**40 * ((i * 7) % 11)), float(i)]) for i in range(25)]
    apart, _, _ = exact(rows)
    got = {r["vec_id"]: int(r["deviation"]) for r in W.whiten(frame(spark, rows)).collect()}
    assert got == {i: sum(x * x for x in a) for (i, _), a in zip(rows, apart, strict=True)}
    assert max(got.values()) > 2**63
    with pytest.raises(Exception, match="2\\*\\*52"):
        W.whiten(frame(spark, [(1, [1e30, 1.0]), (2, [0.0, 1.0])])).collect()


@pytest.mark.parametrize("d", [1, 2, 3, 10, 80])
def test_symmetric_qr(d):
    draw = np.random.default_rng(d)
    a = draw.normal(0, 1, (d, d))
    for m in (a + a.T, np.zeros((d, d)), np.eye(d), np.diag(np.arange(d) * 1.0), a @ a.T * 1e12, np.outer(a[0], a[0]), np.ones((d, d))):
        values, rows = W.symmetric_qr(m)
        scale = max(1e-300, np.abs(m).max()) * d
        assert np.all(np.diff(values) <= 0)
        assert np.abs(np.sort(values) - np.linalg.eigvalsh(m)).max() <= 1e-13 * scale
        assert np.abs(rows @ rows.T - np.eye(d)).max() <= 1e-12
        assert np.abs(rows @ m - values[:, None] * rows).max() <= 1e-12 * scale


def test_running_states_merge_exactly():
    """A large offset costs no digits, in whatever parts."""
    draw = random.Random(6)
    x = np.array([[10**15 + draw.randrange(50), draw.randrange(10**6)] for _ in range(90)], np.int64)
    whole = W.Running.at(x[0])
    whole.add(x)
    parts = []
    for at in (slice(0, 1), slice(1, 40), slice(40, 90)):
        parts.append(W.Running.at(x[at][0]))
        parts[-1].add(x[at])
    for p in parts[1:]:
        parts[0].merge(p)
    want = np.cov((x - x[0]).T.astype(float), bias=True)
    for s in (whole, parts[0]):
        assert s.sums == [sum(int(v) for v in c) for c in x.T] and s.n == 90
        assert s.covariance() == pytest.approx(want, rel=1e-12)


def test_query(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding is not null").collect()]
    rows = [(i, v) for i, v in rows if all(x is not None and math.isfinite(x) for x in v)]
    got = Q.op12_embedding_whitening(spark, DATA)
    assert got.schema["deviation"].dataType.simpleString() == "bigint"
    check(got.where(F.lit(True)).collect(), rows, 32)
