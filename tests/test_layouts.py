"""Fine layouts: answers worked by hand, and properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import layouts, regret
from tessera.sources import detections as D

SPANS = st.lists(st.tuples(st.integers(0, 900), st.integers(0, 400)).map(lambda p: (p[0] * 2, p[0] * 2 + p[1] * 2)), max_size=12)


@pytest.mark.parametrize(
    "spans, least, whole, sizes",
    [
        ([], 256, 1920, [1920]),  # nothing to cut around
        ([(4, 260)], 256, 1920, [288, 1632]),  # the end rounded up to a step
        ([(640, 900)], 256, 1920, [640, 288, 992]),  # before and after
        ([(650, 900)], 256, 1920, [640, 288, 992]),  # the start rounded down
        ([(100, 130)], 256, 1920, [256, 1664]),  # too near the edge for a tile of its own: a least one clears it
        ([(1800, 1916)], 256, 1920, [1664, 256]),  # the cut before moves back to leave a least tile
        ([(640, 1280), (800, 900)], 256, 1920, [640, 640, 640]),  # no cut through the longer one
        ([(640, 900), (640, 900)], 256, 1920, [640, 288, 992]),  # repeated intervals cut once
        ([(800, 1070)], 160, 1080, [800, 280]),  # an end too near the edge is no cut
    ],
)
def test_cuts_worked_by_hand(spans, least, whole, sizes):
    assert layouts.cut_around(spans, least, whole) == sizes


@settings(max_examples=400, deadline=None)
@given(SPANS)
def test_cuts_keep_to_the_whole_and_to_least_sizes(spans):
    for least, whole in ((256, 1920), (160, 1080)):
        sizes = layouts.cut_around([(s, e) for s, e in spans if e <= whole], least, whole)
        assert sum(sizes) == whole and (len(sizes) == 1 or min(sizes) >= least)


@settings(max_examples=200, deadline=None)
@given(SPANS)
def test_cuts_do_not_cross_lone_intervals(spans):
    apart, end = [], -1
    for s, e in sorted(spans):  # intervals that don't overlap
        if s > end and e <= 1920:
            apart.append((s, e))
            end = e
    edges = [0]
    for size in layouts.cut_around(apart, 256, 1920):
        edges.append(edges[-1] + size)
    assert not any(s < c < e for c in edges for s, e in apart)


def test_frames_without_a_layout_fail(spark):
    known = spark.createDataFrame([("v", 0, ([64], [48]))], "video string, gop int, layout struct<widths:array<int>,heights:array<int>>")
    frames = spark.createDataFrame([("v", 3), ("v", 9)], "video string, frame int")
    assert layouts.by_gop(frames, known, 10).count() == 2
    with pytest.raises(Exception, match="no layout for group 1 of v"):
        layouts.by_gop(frames.union(spark.createDataFrame([("v", 10)], "video string, frame int")), known, 10).collect()


def test_cleared_groups(spark):
    cleared = spark.createDataFrame([("v", 0, 2)], "video string, gop int, iteration int")
    again = regret.clear(cleared, spark.createDataFrame([("v", 0), ("v", 1)], "video string, gop int"), 5)
    assert sorted(tuple(r) for r in again.collect()) == [("v", 0, 5), ("v", 1, 5)]
    log = spark.createDataFrame([(i, "v", "fish") for i in (1, 2, 3)], "iteration int, video string, label string")
    touched = spark.createDataFrame([("v", i, g) for i in (1, 2, 3) for g in (0,)] + [("v", 1, 1)], "video string, query_id int, gop int")
    assert sorted(r["iteration"] for r in regret.still_counting(log, touched, cleared).collect()) == [1, 3]


def test_intervals(spark):
    met = spark.createDataFrame([(0, 5, 5, 9), (0, 4, 5, 9), (3, 3, 0, 9)], "a int, b int, c int, d int")
    assert [r["m"] for r in met.select(G.intervals_meet("a", "b", "c", "d").alias("m")).collect()] == [True, False, True]
    assert [r["m"] for r in met.select(G.interval_contains("a", "b", "c").alias("m")).collect()] == [True, False, False]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 40), min_size=1, max_size=6), st.lists(st.integers(1, 40), min_size=1, max_size=6), st.lists(st.tuples(*[st.integers(0, 120)] * 4), min_size=1, max_size=8))
def test_tiles_hit_are_those_that_intersect(spark, widths, heights, corners):
    boxes = spark.createDataFrame([(i, min(a, c), min(b, d), max(a, c), max(b, d)) for i, (a, b, c, d) in enumerate(corners)], "i int, x1 int, y1 int, x2 int, y2 int")
    g = G.with_edges(G.grid(widths, heights))
    rows = boxes.withColumn("box", G.box("x1", "y1", "x2", "y2")).select(G.tiles_hit(F.col("box"), g).alias("hit"), F.filter(G.tiles(g), lambda t: G.intersects(F.col("box"), t)).alias("all")).collect()
    assert all([tuple(t) for t in r["hit"]] == [tuple(t) for t in r["all"]] for r in rows)


def test_known_layouts(spark):
    fish, horse = (5, 5, 260, 166), (1800, 800, 1915, 1070)
    rows = [("v", n, f, *b) for f in range(10) for n, b in (("fish", fish), ("horse", horse))]
    boxes = D.boxes(spark.createDataFrame(rows, D.SCHEMA))

    def made(*labels):
        r = layouts.around_detections(boxes.where(F.col("label").isin(*labels)), 1920, 1080, 30).first()
        return list(r["layout"]["widths"]), list(r["layout"]["heights"])

    assert made("fish") == ([288, 1632], [192, 888])
    assert made("horse") == ([1664, 256], [800, 280])
    assert made("fish", "horse") == ([288, 1376, 256], [192, 608, 280])
    gops = spark.createDataFrame([("v", 0), ("v", 1)], "video string, gop int")
    filled = {r["gop"]: list(r["layout"]["widths"]) for r in layouts.filled(layouts.around_detections(boxes, 1920, 1080, 30), gops, 1920, 1080).collect()}
    assert filled[1] == [1920]


def test_known_regret(spark):
    fish, horse = (5, 5, 260, 166), (1800, 800, 1915, 1070)
    rows = spark.createDataFrame([("v", n, f, *b) for f in range(10) for n, b in (("fish", fish), ("horse", horse))], D.SCHEMA)
    asked = ["fish", "horse", "fish", "fish", "fish", "fish"]
    log = spark.createDataFrame([(i + 1, "v", n, None, None) for i, n in enumerate(asked)], "iteration int, video string, label string, first int, last int")
    gops = spark.createDataFrame([("v", 0)], "video string, gop int")
    current = gops.withColumn("layout", layouts.single(F.lit(1920), F.lit(1080)))
    made = regret.candidate_layouts(D.boxes(rows), regret.candidates(log), gops, 1920, 1080, 30)
    found = regret.by_gop_and_layout(rows, log, current, made, 1920, 1080, 30)
    gained = {r["layout_id"]: round(r["regret"], 4) for r in found.collect()}
    assert gained == {"fish": 172.3117, "horse": 91.8798, "fish_horse": 194.4625}
    assert [r["layout_id"] for r in regret.decide(found, 1920, 1080, 30, 0.5).collect()] == ["fish_horse"]
    assert regret.decide(found, 1920, 1080, 30, 1.0).isEmpty()
    cleared = spark.createDataFrame([("v", 0, 6)], "video string, gop int, iteration int")
    assert regret.by_gop_and_layout(rows, log, current, made, 1920, 1080, 30, cleared).isEmpty()


def test_uniform(spark):
    r = spark.range(1).select(layouts.uniform(2, 2, F.lit(320), F.lit(240)).alias("l")).first()["l"]
    assert (list(r["widths"]), list(r["heights"])) == ([160, 160], [128, 112])


@pytest.mark.parametrize(
    "box, tile, met",
    [((0, 0, 10, 10), (10, 0, 20, 10), False), ((5, 5, 5, 8), (0, 0, 10, 10), False), ((4, 4, 4, 4), (0, 0, 10, 10), True), ((0, 4, 0, 6), (0, 0, 10, 10), False), ((8, 2, 14, 6), (0, 0, 10, 10), True)],
)
def test_edges(spark, box, tile, met):
    one, two = (G.box(*map(F.lit, b)) for b in (box, tile))
    got = spark.range(1).select(G.intersects(one, two).alias("m")).first()["m"]
    assert got is (met if box != (5, 5, 5, 8) else True)


def test_tiles_are_exploded_in_generated_code(spark):
    """no tile is made by an interpreted lambda, and a grid without rows or columns has none."""
    grids = spark.createDataFrame([("a", ([3, 4], [5, 6, 7])), ("b", ([2], [9])), ("none", ([], [9]))], "k string, layout struct<widths:array<int>,heights:array<int>>")
    tiles = layouts.exploded(grids)
    plan = tiles.select("k", "tile_no", "width", "height")._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "aggregate(" not in plan and plan.count("* Generate") + plan.count(") Generate") == 2
    got = sorted(tuple(r) for r in tiles.collect())
    want = [("a", row * 2 + col, row, col, (0, 3)[col], (0, 5, 11)[row], (3, 4)[col], (5, 6, 7)[row]) for row in range(3) for col in range(2)]
    assert got == sorted([*want, ("b", 0, 0, 0, 0, 0, 2, 9)])
