"""Costs of queries: what the plan makes of each box, and ranges of queries."""

from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import cost

BOXES = [("v", "A", 3, 0, 0, 40, 40), ("v", "A", 8, 30, 0, 70, 20), ("v", "B", 9, 0, 60, 10, 90), ("v", "A", 12, 90, 90, 200, 200), ("w", "A", 1, 0, 0, 10, 10), ("v", "A", 4, -20, 0, 0, 10)]
QUERIES = [("q1", "v", "A", None, None), ("q2", "v", "A", 0, 8), ("q2", "v", "B", 0, 10), ("q3", "v", "A", 12, 13), ("q4", "x", "A", None, None), ("q5", "v", "A", 20, 30)]
GRIDS = [(v, g, k, (w, h)) for v in "vw" for g in (0, 1) for k, w, h in (("one", [100], [100]), ("four", [50, 50], [50, 50]))]


def tables(spark):
    return (
        spark.createDataFrame(BOXES, "video string, label string, frame int, x1 int, y1 int, x2 int, y2 int"),
        spark.createDataFrame(QUERIES, "query_id string, video string, label string, first int, last int"),
        spark.createDataFrame(GRIDS, "video string, gop int, layout_id string, layout struct<widths:array<int>,heights:array<int>>"),
    )


def test_queries_share_their_tiles(spark):
    boxes, queries, grids = tables(spark)
    last = {}
    for q, v, label, a, b in QUERIES:
        for w, other, f, x1, y1, x2, y2 in BOXES:
            for u, g, k, (ws, hs) in GRIDS:
                if v == w == u and label == other and g == f // 10 and (a is None or a <= f < b):
                    n = 100 // ws[0]
                    for t in range(n * n):
                        x, y = t % n * ws[0], t // n * hs[0]
                        if x < x2 and x1 < x + ws[0] and y < y2 and y1 < y + hs[0]:
                            last[v, g, q, k, t] = max(f, last.get((v, g, q, k, t), (0,))[0]), ws[0] * hs[0]
    want = {}
    for (v, g, q, k, _), (f, area) in last.items():
        pixels, tiles = want.get((v, g, q, k), (0, 0))
        want[v, g, q, k] = pixels + area * (f - g * 10 + 1), tiles + f - g * 10 + 1
    for split in (False, True):
        got = {(r["video"], r["gop"], r["query_id"], r["layout_id"]): (r["pixels"], r["tiles"]) for r in cost.of_queries(boxes, queries, grids, 10, ("layout_id",), split).collect()}
        assert got == want


def test_a_box_meets_layouts_once_for_all_queries(spark):
    """before, each box was copied for each query and layout, and its tiles made by interpreted lambdas."""
    boxes, queries, grids = tables(spark)
    many = spark.range(500).select(F.col("id").cast("string").alias("query_id"), F.lit("v").alias("video"), F.lit("A").alias("label"), F.lit(0).alias("first"), F.lit(100).alias("last"))
    plans = [cost.of_queries(boxes, many, grids, 10, ("layout_id",)), cost.touched(boxes.withColumn("box", G.box("x1", "y1", "x2", "y2")), grids, 10)]
    for found in plans:
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Generate posexplode") == 2 and "transform(" not in text
    joins = [line for line in plans[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) >= 2 and "query_id" not in "".join(joins[1:])  # queries meet tiles, in the topmost join
    assert plans[0].count() == 500 * 2 * 2


def test_only_wanted_layouts_are_scored(spark):
    boxes, queries, grids = tables(spark)
    asked = queries.withColumn("wanted", F.when(F.col("query_id") == "q2", F.array(F.lit("one"))).otherwise(F.array(F.lit("one"), F.lit("four"))))
    every = cost.of_queries(boxes, queries, grids, 10, ("layout_id",)).where("query_id <> 'q2' or layout_id = 'one'")
    got = cost.of_queries(boxes, asked, grids, 10, ("layout_id",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
