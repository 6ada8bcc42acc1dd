"""Writes that show whole or not at all, reads that skip what isn't wanted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.api import TileStore
from tessera.functions import pixels as P
from tessera.operators import storage
from tessera.sources import detections as D
from tessera.sources import lines, rawvideo
from tessera.streaming import ingest

W, H, GOP = 64, 48, 10


@pytest.fixture(scope="module")
def frames(spark):
    return P.synthetic(spark.range(20).select(F.col("id").cast("int").alias("frame")), W, H).cache()


@pytest.fixture
def store(spark, tmp_path):
    s = TileStore(spark, "memory", catalog_path=f"{tmp_path}/videos")
    s.add_bulk_metadata([("cam", "fish", f, 4, 6, 20, 18) for f in range(5, 15)])
    return s


def test_a_video_of_a_failed_write_does_not_show(store, frames, monkeypatch):
    """A first write at one frame rate fails; the next, at another, is the only one."""
    with monkeypatch.context() as m:
        m.setattr(storage.lines, "create", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.store(frames, "cam", GOP)
    assert store.catalog.videos().isEmpty() and store.catalog.layouts().isEmpty() and store.catalog.tiles().isEmpty() and store.catalog.zones().isEmpty()
    store.store_with_uniform_layout(frames, "cam", 2, 2, 5)
    assert store.catalog.videos().count() == 1 and store.catalog.gop_len("cam") == 5
    assert {r["gop"] for r in store.catalog.tiles().select("gop").collect()} == set(range(4))


def test_a_known_video_keeps_its_rate_and_size(store, frames):
    store.store(frames, "cam", GOP)
    with pytest.raises(ValueError, match="frame_rate"):
        store.store(frames, "cam", 5)
    small = P.synthetic(frames.select("frame"), 32, 32)
    with pytest.raises(ValueError, match="width"):
        store.store(small, "cam", GOP)
    assert store.catalog.layouts().select("version").distinct().count() == 1
    with pytest.raises(ValueError, match="whole"):
        store.store(frames, "other", 0)


def test_two_writers_get_two_versions(store, frames, monkeypatch):
    """Both read the same next version; the file that claims it exists once."""
    monkeypatch.setattr(storage.Catalog, "version", lambda *_: 0)
    store.store(frames, "cam", GOP)
    store.store_with_uniform_layout(frames, "cam", 2, 2, GOP)
    assert sorted(r["version"] for r in store.catalog.commits().collect()) == [0, 1]
    places = store.select_places("cam", "fish", 8, 9).collect()
    assert [r["version"] for r in places] == [1]
    assert store.select("cam", "fish", 8, 9).count() == 1


def test_a_first_writer_that_comes_second_must_agree(spark, store, frames):
    """Its video was unknown when it began; another write at another rate was committed meanwhile."""
    about = {"video": "cam", "metadata_id": "cam", "width": W, "height": H, "frame_rate": 5, "gop_len": 5, "n_frames": 20}
    store.store(frames, "cam", GOP)
    spans = store.catalog.layouts().where("video = 'cam'").drop("version")
    old, store.catalog.version = store.catalog.version, lambda *_: 0
    with pytest.raises(ValueError, match="frame_rate"):
        store.catalog._commit("cam", "late", spans, about)
    store.catalog.version = old
    assert store.catalog.layouts().count() == 1 and store.catalog.videos().count() == 1


def test_numbered_records(spark, tmp_path):
    at = f"{tmp_path}/log"
    assert lines.next_number(spark, at) == 0 and lines.read(spark, at, "number int, x string").isEmpty()
    assert [lines.append(spark, at, {"x": "a"}), lines.append(spark, at, {"x": "b"}), lines.append(spark, at, {"x": "c"}, 7)] == [0, 1, 7]
    assert lines.next_number(spark, at) == 8 and not lines.create(spark, f"{at}/1.json", {"x": "z"})
    (tmp_path / "log" / "9.json").write_text("")  # a writer that died
    assert sorted((r["number"], r["x"]) for r in lines.read(spark, at, "number int, x string").collect()) == [(0, "a"), (1, "b"), (7, "c")]


def scanned(df, folder):
    """Rows that scans of a folder give."""
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if f"/{folder}" in leaf.toString() and leaf.metrics().contains("numOutputRows"):
            n += leaf.metrics().apply("numOutputRows").value()
    return n


def test_one_tile_of_a_fine_grid(spark, tmp_path):
    """Of 400 tiles one is wanted: under 2 % of the rows are read, and its pixels are right."""
    fine = TileStore(spark, "memory", catalog_path=f"{tmp_path}/v")
    w, h = 320, 320
    fine.add_bulk_metadata([("v", "fish", f, 50, 34, 60, 44) for f in range(120)])
    video = P.synthetic(spark.range(0, 120, 1, 2).select(F.col("id").cast("int").alias("frame")), w, h)
    fine.store_with_uniform_layout(video, "v", 20, 20, 30)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = fine.select_tiles("v", "fish")
        read = scanned(got, "tiles")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    rows = got.collect()
    assert len(rows) == 120 and {r["tile_no"] for r in rows} == {2 * 20 + 3}
    assert 120 <= read < 0.02 * 120 * 400
    for r in rows:
        tile = P.image(r["pixels"], 16, 16)
        assert tile[0, 0].tolist() == [48, 32, r["frame"] % 256, 255] and tile[-1, -1].tolist() == [63, 47, r["frame"] % 256, 255]


@pytest.mark.parametrize(("zones", "spans"), [(1000, 1), (1, 32), (0, 0)])
def test_whatever_is_pruned_the_pixels_are_the_same(spark, store, frames, monkeypatch, zones, spans):
    monkeypatch.setattr(storage, "MOST_ZONES", zones)
    monkeypatch.setattr(storage, "MOST_SPANS", spans)
    store.add_bulk_metadata([("cam", "whale", f, 0, 0, 64, 48) for f in (3, 12)])
    store.store_with_uniform_layout(frames, "cam", 2, 2, GOP)
    store.catalog.retile("cam", spark.createDataFrame([("cam", 1)], "video string, gop int").withColumn("layout", F.struct(F.array(F.lit(W)).alias("widths"), F.array(F.lit(H)).alias("heights"))))
    assert sorted((r["frame"], r["tile_no"]) for r in store.select("cam", "whale").collect()) == [(3, 0), (3, 1), (3, 2), (3, 3), (12, 0)]
    whole = {r["frame"]: r["pixels"] for r in store.select_frames("cam", ["whale"]).collect()}
    assert whole == {r["frame"]: r["pixels"] for r in frames.where("frame in (3, 12)").collect()}
    assert store.select("cam", "nothing").collect() == []


def test_bytes_are_those_stored(spark, store, frames):
    store.store_with_uniform_layout(frames, "cam", 2, 2, GOP)
    stored = store.catalog.tiles().groupBy("gop", "tile_no").agg(F.count("*").alias("n_frames"), F.sum(F.length("pixels")).alias("n_bytes"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, store.catalog.zones().select("gop", "tile_no", "n_frames", "n_bytes").collect()))
    r = store.scan_counters("cam", "fish", 8, 12).first()  # frames 0-9 of one tile, 10 and 11 of it
    assert (r["n_frames"], r["n_pixels"], r["n_bytes"], r["n_tiles"]) == (12, 12 * 32 * 32, 12 * 32 * 32 * 4, 1)


    seen = store.catalog.probe().first()
    assert (seen["codec"], seen["width"], seen["frame_rate"], seen["n_frames"]) == ("raw", W, GOP, 20)
    assert (seen["n_bytes"], seen["bits_per_second"]) == (20 * W * H * 4, W * H * 4 * 8 * GOP)


def test_rows_of_a_stream_and_others_share_an_index(spark, tmp_path):
    D.DetectionIndex(spark, f"{tmp_path}/in").add_bulk([("v", "fish", f, 1, 1, 5, 5) for f in range(10)] + [("w x/y", "cat", 1, 1, 1, 2, 2)])
    index = D.DetectionIndex(spark, f"{tmp_path}/out")
    index.add("v", "before", 1, 1, 1, 5, 5)
    query = ingest.into_index(ingest.read_detections(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    assert index.rows().count() == 12
    index.add_bulk([("v", "after", f, 1, 1, 5, 5) for f in range(5)])
    assert index.rows().count() == 17 and index.of("w x/y").count() == 1


def test_a_repeated_batch_counts_once(spark, tmp_path, monkeypatch):
    index = D.DetectionIndex(spark, f"{tmp_path}/out")
    rows = spark.createDataFrame([(f"v{f % 3}", "fish", f, 1, 1, 5, 5) for f in range(12)], D.SCHEMA)
    index.add_once(rows, f"{tmp_path}/staged/0")
    index.add_once(rows, f"{tmp_path}/staged/0")
    assert index.rows().count() == 12
    # one that failed before all of its files stood, and one that failed while they were moved
    index._write(rows.limit(5), f"{tmp_path}/staged/1", "overwrite")
    (tmp_path / "staged" / "1" / "_SUCCESS").unlink()
    index.add_once(rows, f"{tmp_path}/staged/1")
    assert index.rows().count() == 24
    index._write(rows, f"{tmp_path}/staged/2", "overwrite")
    first = next((tmp_path / "staged" / "2").glob("video=*/part-*"))
    first.rename(tmp_path / "out" / first.parent.name / first.name)
    index.add_once(rows, f"{tmp_path}/staged/2")
    assert index.rows().count() == 36


@pytest.fixture(scope="module")
def raw(spark):
    rawvideo.register(spark)
    return lambda path, **options: spark.read.format("rawvideo").options(path=str(path), **{k: str(v) for k, v in options.items()}).load()


def test_raw_video(spark, tmp_path, frames, raw):
    whole = {r["frame"]: bytes(r["pixels"]) for r in frames.collect()}
    (tmp_path / "cam.rgba").write_bytes(b"".join(whole[f] for f in sorted(whole)))
    video = raw(tmp_path / "cam.rgba", width=W, height=H, frames_per_partition=6)
    assert video.rdd.getNumPartitions() == 4
    assert {r["frame"]: bytes(r["pixels"]) for r in video.collect()} == whole
    for condition, n in (("frame >= 7 and frame < 9", 1), ("frame = 13", 1), ("frame in (2, 4)", 1), ("frame > 18", 1), ("frame > 30", 1), ("frame <= 6", 2)):
        some = video.where(condition)
        assert sorted(r["frame"] for r in some.select("frame").collect()) == sorted(r["frame"] for r in frames.where(condition).select("frame").collect())
        assert some.rdd.getNumPartitions() == n
    store = TileStore(spark, "memory", catalog_path=f"{tmp_path}/v")
    store.add_metadata("cam", "fish", 8, 4, 6, 20, 18)
    store.store_with_uniform_layout(video, "cam", 2, 2, GOP)
    assert store.select_frames("cam", "fish").first()["pixels"] == whole[8]
    with pytest.raises(Exception, match="whole frames"):
        raw(tmp_path / "cam.rgba", width=W + 2, height=H).count()


def test_raw_nv12(tmp_path, raw):
    draw = np.random.default_rng(1)
    planes = [draw.integers(0, 256, 8 * 4 * 3 // 2, dtype=np.uint8).tobytes() for _ in range(5)]
    (tmp_path / "x.nv12").write_bytes(b"".join(planes))
    got = raw(tmp_path / "x.nv12", width=8, height=4, format="nv12", frames_per_partition=2).orderBy("frame").collect()
    assert [bytes(r["pixels"]) for r in got] == [P.nv12_to_rgba(p, 8, 4) for p in planes]


def test_structural_similarity(spark):
    draw = np.random.default_rng(2)

    def plain(a, b, side):
        values = []
        side = min(side, *a.shape)
        for y in range(a.shape[0] - side + 1):
            for x in range(a.shape[1] - side + 1):
                p, q = (m[y : y + side, x : x + side].astype(float) for m in (a, b))
                c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
                both = ((p - p.mean()) * (q - q.mean())).mean()
                values.append((2 * p.mean() * q.mean() + c1) * (2 * both + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (p.var() + q.var() + c2)))
        return sum(values) / len(values)

    for h, w in ((5, 9), (8, 8), (20, 13), (1, 1)):
        a, b = (draw.integers(0, 256, (h, w), dtype=np.uint8) for _ in range(2))
        for two in (b, a, (a // 2).astype(np.uint8), np.zeros_like(a)):
            assert P.structural_similarity(a, two) == pytest.approx(plain(a, two, 8), abs=1e-9)
    image = draw.integers(0, 256, (10, 12, 4), dtype=np.uint8)
    other = image.copy()
    other[..., 3] = 0  # the alpha doesn't count
    df = spark.createDataFrame([(bytearray(image.tobytes()), bytearray(other.tobytes()), 12)], "a binary, b binary, w int")
    assert df.select(P.ssim("a", "b", "w").alias("s")).first()["s"] == pytest.approx(1, abs=1e-12)
