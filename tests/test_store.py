"""The facade end to end on synthetic pixels, the index kinds, colour and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.api import CostElements, Images, Query, TiledVideo, TileStore, Workload, WorkloadCostEstimator
from tessera.functions import pixels as P
from tessera.functions.selection import AnyOf, FrameIs, FrameRange, Label
from tessera.operators import catalog, layouts
from tessera.sources import detections as D
from tessera.streaming import ingest

W, H, GOP = 64, 48, 10


@pytest.fixture(scope="module")
def frames(spark):
    return P.synthetic(spark.range(30).select(F.col("id").cast("int").alias("frame")), W, H).cache()


@pytest.fixture
def store(spark, tmp_path):
    s = TileStore(spark, "xy", f"{tmp_path}/labels", f"{tmp_path}/videos")
    s.add_bulk_metadata([("cam", "fish", f, 4, 6, 20, 18) for f in range(5, 25)] + [("cam", "it's", 12, 30, 10, 50, 40)])
    return s


def check_pixels(row):
    raw = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], 4)
    assert tuple(raw[0, 0]) == (row["x"] % 256, row["y"] % 256, row["frame"] % 256, 255)
    assert tuple(raw[-1, -1]) == ((row["x"] + row["width"] - 1) % 256, (row["y"] + row["height"] - 1) % 256, row["frame"], 255)


def test_select_objects_and_frames(store, frames):
    store.store_with_uniform_layout(frames, "cam", 2, 2, GOP)
    got = store.select("cam", "fish", 8, 12).collect()
    assert {r["frame"] for r in got} == {8, 9, 10, 11}
    for r in got:
        check_pixels(r)
    prefix = store.select("cam", "fish", 8, 12, include_gop_prefix=True)
    assert {r["frame"] for r in prefix.select("frame").collect()} == {5, 6, 7, 8, 9, 10, 11}
    parts = store.select("cam", "it's").collect()  # one box over four tiles
    assert len(parts) == 4 and sum(r["width"] * r["height"] for r in parts) == 20 * 30
    whole = store.select_frames("cam", AnyOf.of("fish", "it's"), 12).collect()
    assert [(r["frame"], r["width"], r["height"]) for r in whole] == [(12, W, H)]
    assert whole[0]["pixels"] == frames.where("frame = 12").first()["pixels"]
    tiles = store.select_tiles("cam", "fish", 24)
    assert [(r["tile_no"], r["width"]) for r in tiles.collect()] == [(0, 32)]
    assert store.select("cam", "nothing").count() == 0
    images = Images(store.select("cam", "fish", 8))
    assert images.next().numpy_array().shape == (12, 16, 3) and images.next().is_empty()


def test_cost_and_layouts(store, frames):
    store.store(frames, "cam", GOP)
    video = TiledVideo(store, "cam")
    assert video.gop_length() == GOP and video.layout_for_frame(3).num_cols == 1
    work = Workload([Query("cam", "fish"), Query("cam", "fish", 8, 12)], [2, 1])
    n = 2 * (10 + 10 + 5) + (10 + 2)
    assert WorkloadCostEstimator.estimate_cost(work, video, store) == CostElements(n * W * H, n)
    with pytest.raises(ValueError):
        Workload([Query("cam", "fish")], [1, 2])


def test_retile(spark, store, frames):
    store.store(frames, "cam", GOP)
    chosen = spark.createDataFrame([("cam", 0), ("cam", 2)], "video string, gop int").withColumn("layout", layouts.uniform(1, 2, F.lit(W), F.lit(H)))
    store.catalog.retile("cam", chosen)
    newest = catalog.newest(spark.range(30).select(F.lit("cam").alias("video"), F.col("id").cast("int").alias("frame")), store.catalog.layouts(), GOP)
    assert {r["frame"]: r["version"] for r in newest.collect()} == {f: int(f // GOP != 1) for f in range(30)}
    spans = {(r["first_frame"], r["last_frame"], r["version"]) for r in store.catalog.layouts().collect()}
    assert spans == {(0, 29, 0), (0, 9, 1), (20, 29, 1)}
    for r in store.select("cam", "fish").collect():
        check_pixels(r)


def test_a_failed_write_leaves_no_rows(store, frames, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(type(store.catalog), "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.store_with_uniform_layout(frames, "cam", 2, 2, GOP)
    assert store.catalog.tiles().isEmpty()
    store.store_with_uniform_layout(frames, "cam", 2, 2, GOP)
    assert store.select("cam", "it's").count() == 4 and store.catalog.tiles().count() == 30 * 4
    assert store.select_frames("cam", "fish", 8).first()["pixels"] == frames.where("frame = 8").first()["pixels"]


def test_selections_by_position(store, frames):
    store.store_with_uniform_layout(frames, "other", 2, 2, GOP, metadata_id="cam")
    n = lambda df: sorted(r["frame"] for r in df.collect())
    assert n(store.select("other", "cam", "fish")) == list(range(5, 25))
    assert n(store.select("other", "cam", "fish", 8)) == [8] == n(store.select_frames("other", "cam", "fish", 8))
    assert n(store.select("other", "cam", "fish", 8, 11)) == [8, 9, 10] == n(store.select_tiles("other", "cam", "fish", 8, 11))
    assert n(store.select("other", "fish")) == [] == n(store.select("other", "fish", 8, 11))


@pytest.mark.parametrize("force", [True, False])
def test_nonuniform_layouts(spark, tmp_path, force):
    big = TileStore(spark, "memory", catalog_path=f"{tmp_path}/v")
    video = P.synthetic(spark.range(4).select(F.col("id").cast("int").alias("frame")), 640, 480)
    big.add_bulk_metadata([("v", "fish", f, 4, 4, 60, 60) for f in range(2)] + [("v", "whale", f, 2, 2, 638, 478) for f in range(2, 4)])
    big.add_metadata("v", "whale", 0, 2, 2, 638, 478)
    big.store_with_nonuniform_layout(video, "v", "v", "fish", force=force, frame_rate=2)
    assert TiledVideo(big, "v").layout_for_frame(0).widths_of_cols == [256, 384] and TiledVideo(big, "v").layout_for_frame(2).num_cols == 1
    for r in big.select("v", "fish").collect():
        check_pixels(r)
    again = TileStore(spark, "memory", catalog_path=f"{tmp_path}/w{force}")
    again.add_bulk_metadata([("v", "edge", f, 200, 150, 440, 330) for f in range(2)])
    again.store_with_nonuniform_layout(video.where("frame < 2"), "v", "v", "edge", force=force, frame_rate=2)
    for r in again.select("v", "edge").collect():
        check_pixels(r)


def test_legacy_index(spark, tmp_path, frames):
    spark.createDataFrame([("fish", f, 4, 6, 16, 12) for f in range(3)] * 2, D.LEGACY).write.parquet(f"{tmp_path}/old")
    old = TileStore(spark, "legacy", f"{tmp_path}/old", f"{tmp_path}/videos")
    assert sorted(tuple(r) for r in old.index.of("any").collect()) == [("any", "fish", f, 4, 6, 20, 18) for f in range(3)]
    old.add_metadata("ignored", "fish", 7, 30, 10, 50, 40)
    old.store_with_uniform_layout(frames, "cam", 2, 2, GOP)
    got = old.select("cam", "fish").collect()
    assert {r["frame"] for r in got} == {0, 1, 2, 7} and all(r["video"] == "cam" for r in got)
    for r in got:
        check_pixels(r)


def test_regret_loop(spark, tmp_path):
    big = TileStore(spark, "memory", catalog_path=f"{tmp_path}/v")
    w, h = 640, 480
    video = P.synthetic(spark.range(4).select(F.col("id").cast("int").alias("frame")), w, h)
    big.add_bulk_metadata([("v", "fish", f, 4, 4, 60, 60) for f in range(4)])
    big.store(video, "v", 2)
    assert big.retile_based_on_regret("v") == []
    big.activate_regret_based_tiling("v", threshold=0.1)
    for _ in range(3):
        big.select("v", "fish")
    assert big.retile_based_on_regret("v") == [0, 1]
    assert TiledVideo(big, "v").layout_for_frame(0).num_cols == 2
    assert big.retile_based_on_regret("v") == []
    for r in big.select("v", "fish").collect():
        check_pixels(r)
    big.deactivate_regret_based_tiling("v")
    assert big.retile_based_on_regret("v") == []


def test_index_kinds(spark, tmp_path):
    index = D.open_index(spark, "xy", f"{tmp_path}/a")
    assert index.rows().isEmpty()
    index.add("video", "fish", 1, 0, 0, 0, 0)
    index.add("video", "fish", 1, 1, 0, 0, 0)
    assert index.rows().count() == 2
    memory = D.open_index(spark, "memory", f"{tmp_path}/b")
    memory.add_bulk([("video", "fish", i, 0, 0, 0, 0) for i in range(10)] + [("video", "cat", i, 0, 0, 0, 0) for i in range(8, 20)])
    assert not (tmp_path / "b").exists()
    frames = lambda *a: [r["frame"] for r in D.ordered_frames(D.pick(memory.rows(), "video", *a)).collect()]
    assert frames("fish") == list(range(10)) and frames("fish", 5) == [5] and frames("fish", 3, 9) == [3, 4, 5, 6, 7, 8]
    assert memory.rows().where(FrameRange(3, 5).condition() & Label("fish").condition()).count() == 2
    assert memory.rows().where(FrameIs(9).condition()).count() == 2
    wh = spark.createDataFrame([("fish", 1, 2, 3, 4, 5)] * 2, D.LEGACY)
    assert [tuple(r) for r in D.from_legacy(wh, "v").collect()] == [("v", "fish", 1, 2, 3, 6, 8)]
    wrong = D.boxes(index.rows()).select("box.*").collect()
    assert {(r["x"], r["width"]) for r in wrong} == {(0, 0)}


def test_colour(spark):
    raw = np.array([[16, 235], [81, 81], [128, 128]], np.uint8)
    rgba = np.frombuffer(P.nv12_to_rgba(raw.tobytes(), 2, 2), np.uint8).reshape(2, 2, 4)
    assert rgba[0, 0].tolist() == [0, 0, 0, 255] and rgba[0, 1].tolist()[0] >= 254
    df = spark.createDataFrame([(bytearray(raw.tobytes()), 2, 2)], "pixels binary, width int, height int")
    assert bytes(df.select(P.to_rgba("pixels", "width", "height").alias("p")).first()["p"]) == rgba.tobytes()
    same = spark.createDataFrame([(bytearray(b"\x00" * 4), bytearray(b"\x00" * 4)), (bytearray(b"\x00" * 4), bytearray(b"\xff" * 4))], "a binary, b binary")
    assert [r["p"] for r in same.select(P.psnr(P.squared_error("a", "b")).alias("p")).collect()] == [None, 0.0]


def test_streams(spark, tmp_path):
    D.DetectionIndex(spark, f"{tmp_path}/in").add_bulk([("v", "fish", f, 1, 1, 5, 5) for f in range(25)])
    stream = ingest.read_detections(spark, f"{tmp_path}/in")
    query = ingest.gop_activity(stream, 10).writeStream.format("memory").queryName("activity").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["gop"], r["boxes"], r["last"]) for r in spark.table("activity").collect()) == [(0, 10, 9), (1, 10, 19), (2, 5, 24)]
    query = ingest.into_index(stream, f"{tmp_path}/out", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    assert D.DetectionIndex(spark, f"{tmp_path}/out").rows().count() == 25
