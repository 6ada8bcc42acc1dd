"""The stages of the pipeline, on small tables, each against its operator's plain version."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import queries as Q
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"  # the smallest one has labels of 11 toxic documents, too few to learn from


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_filters_keep_columns_and_clean_rows(spark):
    docs, known = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    for stage, label in ((P.good_quality, "quality = 1"), (P.not_toxic, "toxic = 0")):
        kept = stage(spark, docs.union(odd), LABELLED)
        assert kept.columns == docs.columns
        clean = docs.join(known.where(label), "doc_id").count()
        assert kept.where("text is not null").join(known.where(label), "doc_id").count() >= 0.98 * clean
        gone = docs.join(known.where(f"not ({label})"), "doc_id").count()
        assert kept.join(known.where(f"not ({label})"), "doc_id").count() <= 0.7 * gone
        assert stage(spark, docs.limit(0), LABELLED).isEmpty()
    clash = docs.withColumn("quality_score", F.lit("x")).withColumn("toxic_score", F.lit("y"))
    assert P.good_quality(spark, clash, LABELLED).columns == clash.columns
    assert P.not_toxic(spark, clash, LABELLED).columns == clash.columns


def test_one_of_each_group(spark, docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = sorted(i for i, (_, c) in brute.jaccard_join(text).items() if i == c)
    extra = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    kept = P.one_of_each_group(spark, docs.union(extra), DATA)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want
    assert kept.where("doc_id is null").count() == 1
    assert P.one_of_each_group(spark, docs.limit(0), DATA).isEmpty()


def test_without_repeats(spark, docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute.substring_dedup(text)
    rows = P.without_repeats(spark, docs, DATA)
    assert rows.columns == docs.columns
    for r in rows.collect():
        n, removed, _ = want[r["doc_id"]]
        assert len(brute.words(r["text"])) == n - removed and r["n_chars"] == len(r["text"])
        if not removed:
            assert r["text"] == text[r["doc_id"]]


def rows_of(spark, rows):
    """Documents with further columns of names that the operators use themselves."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words long, n_removed int, passages string, set_id string, row_key string, score string, u string"
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "mine", 77, 5, "p", "s", "k", "x", "y") for i, t in rows], kind)


def test_stages_judge_rows_and_not_ids(spark):
    t, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(2, t), (5, t), (5, other), (7, "x y z " * 9), (7, "x y z " * 9), (8, None), (8, None), (9, ""), (None, t), (None, t), (11, "p  q r s t u"), (11, "p q r s t u")]
    docs = rows_of(spark, rows)
    kept = P.one_of_each_group(spark, docs, DATA)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert [i for i, _ in got] == [0, 0, 2, 5, 7, 8, 9, 11] and (5, other) in got and got.count((2, t)) == 1
    assert all(r["kept"] == "mine" and r["n_words"] == 77 and r["score"] == "x" for r in kept.collect())


def test_awkward_rows_through_every_stage(spark):
    long = " ".join(f"z{i % 9000}" for i in range(60_000))
    t = " ".join(f"w{i}" for i in range(40))
    docs = rows_of(spark, [(1, t), (2, "pre " + t), (3, None), (4, ""), (5, long), (6, long + " end"), (6, t), (None, t), (7, "a"), (7, "a")])
    step = docs
    for name, stage in P.STAGES:
        step = stage(spark, step, LABELLED)
        if name != "packing":
            assert step.columns == docs.columns, name
            assert all(r["kept"] == "mine" and r["n_words"] == 77 and r["passages"] == "p" for r in step.collect()), name
    cut = P.without_repeats(spark, docs, DATA).collect()
    assert {r["text"] for r in cut if r["doc_id"] == 2} == {"pre"} and {r["text"] for r in cut if r["doc_id"] is None} == {t}
    assert [r["text"] for r in cut if r["doc_id"] == 3] == [None]
    pieces = P.packed(spark, docs, DATA).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 3) == 1 and {p["doc_id"] for p in pieces} == {1, 2, 3, 4, 5, 6, 7, None}


def test_run_joins_the_stages(spark, docs):
    assert [name for name, _ in P.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "substring dedup", "packing"]
    step = docs
    for _, stage in P.STAGES:
        step = stage(spark, step, DATA)
    by_hand = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in step.collect())
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in P.run(spark, DATA).collect()) == by_hand


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    answer = con.execute(Q.ORACLES[name])
    columns = [d[0] for d in answer.description]
    got = Q.queries()[name](spark, DATA).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(answer.fetchall())
