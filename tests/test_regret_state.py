"""Regret that is kept and added to equals regret worked out from the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.api import TileStore
from tessera.functions import pixels as P
from tessera.operators import layouts, regret
from tessera.operators.regret_state import RegretState
from tessera.sources import detections as D

W, H, GOP, FRAMES = 1280, 720, 5, 20
LABELS = ["boat", "fish", "whale"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(8)
    at = {"boat": (10, 10), "fish": (600, 300), "whale": (1000, 500)}
    found = [("v", name, f, at[name][0] + draw.randrange(40), at[name][1] + draw.randrange(40), at[name][0] + 100, at[name][1] + 100) for name in LABELS for f in range(FRAMES) if draw.random() < 0.8]
    return spark.createDataFrame(found, D.SCHEMA).cache()


def everything(spark, rows, log, cleared, current):
    """From the log as a whole, under the candidates of all labels so far."""
    flat = spark.createDataFrame([(i, "v", name, a, b) for i, (names, a, b) in enumerate(log) for name in names], "iteration int, video string, label string, first int, last int")
    made = regret.candidate_layouts(D.boxes(rows), regret.candidates(flat), current.select("video", "gop"), W, H, GOP)
    old = spark.createDataFrame([("v", g, i) for g, i in cleared.items()], "video string, gop int, iteration int")
    return regret.by_gop_and_layout(rows, flat, current, made, W, H, GOP, old)


def values(df):
    return {(r["gop"], r["layout_id"]): (pytest.approx(r["regret"], rel=1e-9, abs=1e-9), r["disqualified"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [2])
def test_any_order_of_queries_candidates_and_retilings(spark, tmp_path, rows, seed):
    draw = random.Random(seed)
    state = RegretState(spark, f"{tmp_path}/r", "v")
    assert state.policy is None
    state.activate("v", 0.5)
    log, cleared = [], {}
    grids = {g: 1 for g in range(FRAMES // GOP)}

    def current():
        rows = [("v", g, n) for g, n in grids.items()]
        return spark.createDataFrame(rows, "video string, gop int, n int").select("video", "gop", F.when(F.col("n") == 1, layouts.single(F.lit(W), F.lit(H))).otherwise(layouts.uniform(2, 2, F.lit(W), F.lit(H))).alias("layout"))

    shapes = [(["fish"], None, None), (["fish"], 3, 9), (["boat", "fish"], 0, 12), (["whale"], 10, 11), (["boat"], 12, 20)]
    for step in range(4):
        for _ in range(draw.randrange(1, 4)):
            log.append(shapes[draw.randrange(min(len(shapes), 2 + step))])
            assert state.ask(*log[-1]) == len(log) - 1
        if step % 2:
            state = RegretState(spark, f"{tmp_path}/r", "v")  # nothing is kept but what is written
        newest = state.score(rows, current(), W, H, GOP)
        assert newest == len(log) - 1
        assert {k: (v[0].expected, v[1]) for k, v in values(everything(spark, rows, log, cleared, current())).items()} == values(state.regret())
        if draw.random() < 0.7:
            gops = draw.sample(sorted(grids), 2)
            state.clear(gops, newest)
            for g in gops:
                cleared[g], grids[g] = newest, 3 - grids[g]
    before = values(state.regret())
    n = state._table("own", "shape string, gop int, layout_id string, batch string").count()
    state.score(rows, current(), W, H, GOP)  # nothing is missing
    assert state._table("own", "shape string, gop int, layout_id string, batch string").count() == n
    assert before.keys() == values(state.regret()).keys()


def test_a_batch_that_failed_does_not_count(spark, tmp_path, rows, monkeypatch):
    state = RegretState(spark, f"{tmp_path}/r", "v")
    state.activate("v", 0.5)
    state.ask(["fish"], None, None)
    current = spark.createDataFrame([("v", g) for g in range(4)], "video string, gop int").withColumn("layout", layouts.single(F.lit(W), F.lit(H)))
    with monkeypatch.context() as m:
        m.setattr("tessera.operators.regret_state.lines.append", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            state.score(rows, current, W, H, GOP)
    assert state.regret().isEmpty()
    state.score(rows, current, W, H, GOP)
    assert values(state.regret()) == {k: (v[0].expected, v[1]) for k, v in values(everything(spark, rows, [(["fish"], None, None)], {}, current)).items()}


def test_a_new_session_goes_on(spark, tmp_path):
    """Two selections in one store, one in the next: it re-tiles as one store would have."""
    w, h = 640, 480
    video = P.synthetic(spark.range(4).select(F.col("id").cast("int").alias("frame")), w, h)
    first = TileStore(spark, "xy", f"{tmp_path}/labels", f"{tmp_path}/v")
    first.add_bulk_metadata([("v", "fish", f, 4, 4, 60, 60) for f in range(4)])
    first.store(video, "v", 2)
    first.activate_regret_based_tiling("v", threshold=0.1)
    first.select_places("v", "fish")
    first.regret("v").count()
    first.select_places("v", "fish", 0, 2)
    again = TileStore(spark.newSession(), "xy", f"{tmp_path}/labels", f"{tmp_path}/v")
    again.select_places("v", "fish")
    assert again.retile_based_on_regret("v") == [0, 1]
    third = TileStore(spark, "xy", f"{tmp_path}/labels", f"{tmp_path}/v")
    assert third.retile_based_on_regret("v") == []  # the tombstones hold
    third.deactivate_regret_based_tiling("v")
    assert TileStore(spark, "xy", f"{tmp_path}/labels", f"{tmp_path}/v").retile_based_on_regret("v") == []
