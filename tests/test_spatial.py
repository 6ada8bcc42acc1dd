"""Windows over an index in the order of places."""

import random

import pytest

from tessera.api import TileStore
from tessera.functions import geometry as G
from tessera.plans import fixtures as X
from tessera.plans import registry
from tessera.sources import detections as D
from tessera.sources import spatial as S
from tests.test_storage import scanned

DATA = "/root/testdata/sf0.01"


def test_stretches_hold_every_cell():
    draw = random.Random(1)
    for _ in range(300):
        a, b = draw.randrange(60), draw.randrange(60)
        x, y, most = (a, a + draw.randrange(9)), (b, b + draw.randrange(9)), draw.choice([1, 2, 8, 1000])
        found = S.stretches(x, y, most)
        held = {c for first, last in found if last - first < 100_000 for c in range(first, last + 1)}
        cells = {S.z_order(i, j) for i in range(x[0], x[1] + 1) for j in range(y[0], y[1] + 1)}
        assert len(found) <= most and all(any(f <= c <= t for f, t in found) for c in cells)
        if most == 1000:
            assert held == cells
    assert S.stretches((0, 65_535), (0, 65_535)) == [(0, (1 << 32) - 1)]


@pytest.mark.parametrize("window", [(0, 0, 1, 1), (700, 400, 900, 420), (64, 64, 30, 2000), (-50, -50, 60, 60), (5000, 5000, 10, 10)])
def test_every_box_that_meets_a_window(spark, tmp_path_factory, window):
    draw = random.Random(7)
    rows = []
    for f in range(400):
        x, y, side = draw.randrange(-40, 2000), draw.randrange(-40, 1200), draw.choice([1, 2, 5, 33, 300, 1500])
        rows.append((f"v{f % 2}", "a", f, x, y, x + draw.randrange(side + 1), y + draw.randrange(side + 1)))
    rows += [("v0", "a", 999, 100_000, 100_000, 170_000, 170_001), ("v0", "a", 998, 0, 0, 200_000, 5), ("v0", "a", 997, 9, 9, 3, 3)]
    index = S.SpatialIndex(spark, str(tmp_path_factory.getbasetemp() / "spatial"))
    if index.rows().isEmpty():
        index.add_bulk(rows)
    b = S.F.col("box")
    asked = G.box(*(S.F.lit(v) for v in (window[0], window[1], window[0] + window[2], window[1] + window[3])))
    want = D.boxes(spark.createDataFrame(rows, D.SCHEMA)).where(G.intersects(b, asked))
    assert sorted(map(tuple, index.within(*window).select(D.COLUMNS).collect())) == sorted(map(tuple, want.select(D.COLUMNS).collect()))
    assert index.within(*window, video="v1").count() == want.where("video = 'v1'").count()


def test_a_window_skips_rows_and_gives_the_same(spark, tmp_path):
    store = TileStore(spark, "spatial", f"{tmp_path}/labels", f"{tmp_path}/v")
    rows = X.detections(spark, DATA)
    store.add_bulk_metadata(rows)
    assert store.index.rows().count() == rows.count() and sorted(store.index.of("v1").columns) == sorted(D.COLUMNS)
    n = rows.count()
    corner = store.index.within(60, 60, 30, 30)  # in the first of three clusters
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = scanned(corner, "labels")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    found = corner.count()
    assert 0 < found <= read < 0.5 * n
    window = (700, 400, 900, 420)
    same = registry.overlap_rectangles(spark, DATA).count()
    assert store.index.within(*window).where("frame < 60").count() == same
