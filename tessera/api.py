"""The facade: a tile store over a detection index and a catalogue of videos."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import wraps
from numbers import Integral

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixels as P
from tessera.functions.selection import as_labels
from tessera.operators import catalog, cost, layouts, regret, selecting
from tessera.operators.regret_state import RegretState
from tessera.operators.storage import Catalog
from tessera.package import ship
from tessera.sources import detections, spatial  # noqa: F401  spatial makes its kind known

VIDEO = ("video", "metadata_id", "width", "height", "frame_rate", "gop_len", "n_frames")
DEFAULTS = {"default_db_path": "labels.parquet", "catalog_path": "resources"}


def configure_environment(options: dict[str, str]) -> None:
    """Where new stores keep their index and their videos."""
    DEFAULTS.update({k: v for k, v in options.items() if k in DEFAULTS})


@dataclass(frozen=True)
class Image:
    width: int
    height: int
    pixels: bytes

    def is_empty(self) -> bool:
        return not self.pixels

    def array(self) -> bytes:
        return self.pixels

    def numpy_array(self) -> np.ndarray:
        """Height x width x 3: the alpha is dropped."""
        return P.image(self.pixels, self.width, self.height)[:, :, :3]


class Images:
    """Images of a selection, one at a time."""

    def __init__(self, rows: DataFrame):
        self.rows, self._left = rows, None

    def __iter__(self) -> Iterator[Image]:
        for r in self.rows.select("width", "height", "pixels").toLocalIterator():
            yield Image(r["width"], r["height"], bytes(r["pixels"]))

    def next(self) -> Image:
        """The next image, or an empty one at the end."""
        self._left = self._left or iter(self)
        return next(self._left, Image(0, 0, b""))


@dataclass(frozen=True)
class Query:
    """A video, a label and frames; last is exclusive, and 0 or None for no bound."""

    video: str
    label: str
    first: int | None = None
    last: int | None = None
    metadata_id: str | None = None

    def bounds(self) -> tuple[int | None, int | None]:
        if self.first is None or self.last == 0:
            return None, None
        return self.first, self.first + 1 if self.last is None else self.last


@dataclass
class Workload:
    queries: list[Query]
    _counts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.queries = [self.queries] if isinstance(self.queries, Query) else list(self.queries)
        self._counts = list(self._counts) or [1] * len(self.queries)
        if len(self._counts) != len(self.queries):
            raise ValueError("a workload needs a count for each query")

    def counts(self) -> list[int]:
        return self._counts

    def frame(self, spark: SparkSession, video: str | None = None) -> DataFrame:
        """(query_id, video, label, first, last, count), video being the metadata's name."""
        rows = [(i, q.metadata_id or video or q.video, q.label, *q.bounds(), n) for i, (q, n) in enumerate(zip(self.queries, self._counts, strict=True))]
        return spark.createDataFrame(rows, "query_id int, video string, label string, first int, last int, count int")


@dataclass(frozen=True)
class CostElements:
    num_pixels: int
    num_tiles: int

    def add(self, other: CostElements) -> CostElements:
        return CostElements(self.num_pixels + other.num_pixels, self.num_tiles + other.num_tiles)

    def __str__(self) -> str:
        return f"{self.num_pixels} pixels, {self.num_tiles} tiles"


class TiledVideo:
    """A stored video's layouts."""

    def __init__(self, store: TileStore, video: str, metadata_id: str | None = None):
        self.store, self.video, self.metadata_id = store, video, metadata_id or video

    def gop_length(self) -> int:
        return self.store.catalog.gop_len(self.video)

    def layouts(self) -> DataFrame:
        return self.store.catalog.layouts().where(F.col("video") == self.video)

    def layout_for_frame(self, frame: int) -> TileLayout:
        one = self.store.spark.createDataFrame([(self.video, frame)], "video string, frame int")
        found = catalog.newest(one, self.layouts(), self.gop_length()).first()
        if found is None:
            raise KeyError(f"no layout holds frame {frame} of {self.video}")
        return TileLayout(list(found["layout"]["widths"]), list(found["layout"]["heights"]))


@dataclass(frozen=True)
class TileLayout:
    widths_of_cols: list[int]
    heights_of_rows: list[int]

    @property
    def num_cols(self) -> int:
        return len(self.widths_of_cols)

    @property
    def num_rows(self) -> int:
        return len(self.heights_of_rows)


class WorkloadCostEstimator:
    @staticmethod
    def estimate_cost(workload: Workload, video: TiledVideo, store: TileStore) -> CostElements:
        """What the workload decodes of a video under its newest layouts."""
        asked = workload.frame(store.spark, video.metadata_id)
        rows, gop_len = store.index.of(video.metadata_id), video.gop_length()
        current = store.gop_layouts(video.video).withColumn("video", F.lit(video.metadata_id))
        found = cost.of_workload(cost.of_queries(rows, asked, current, gop_len), asked).first()
        return CostElements(found["num_pixels"], found["num_tiles"])


def _overloaded(method):
    """Selections also by position with a metadata id before the label: (video, metadata_id, label, ...)."""

    @wraps(method)
    def call(self, video: str, *asked, **options):
        if len(asked) > 1 and asked[1] is not None and not isinstance(asked[1], Integral):
            options["metadata_id"], asked = asked[0], asked[1:]
        return method(self, video, *asked, **options)

    return call


class TileStore:
    """Store videos as tiles, index detections, and select pixels by label and frame."""

    def __init__(self, spark: SparkSession, kind: str = "xy", path: str | None = None, catalog_path: str | None = None):
        self.spark = ship(spark)
        self.index = detections.open_index(spark, kind, path or DEFAULTS["default_db_path"])
        self.catalog = Catalog(spark, catalog_path or DEFAULTS["catalog_path"])
        self._states: dict[str, RegretState] = {}

    # detections

    def add_metadata(self, video: str, label: str, frame: int, x1: int, y1: int, x2: int, y2: int) -> None:
        self.index.add(video, label, frame, x1, y1, x2, y2)

    def add_bulk_metadata(self, rows: DataFrame | Iterable[tuple]) -> None:
        self.index.add_bulk(rows)

    # videos

    def _store(self, frames: DataFrame, video: str, layout_of, frame_rate: int, metadata_id: str | None) -> None:
        frames = frames.withColumn("video", F.lit(video))
        size = frames.agg(F.max("width").alias("w"), F.max("height").alias("h"), F.count("*").alias("n")).first()
        about = dict(zip(VIDEO, (video, metadata_id or video, size["w"], size["h"], frame_rate, frame_rate, size["n"]), strict=True))
        known = self.catalog.video(video)
        if known:
            self.catalog.check(known, about)
        gops = frames.select("video", F.expr(f"cast(frame div {frame_rate} as int)").alias("gop")).distinct()
        self.catalog.write(video, frames, layout_of(gops, size["w"], size["h"]), frame_rate, None if known else about)

    def store(self, frames: DataFrame, video: str, frame_rate: int = 30, metadata_id: str | None = None) -> None:
        """Frames (frame, width, height, pixels) under one tile."""
        self._store(frames, video, lambda gops, w, h: gops.withColumn("layout", layouts.single(F.lit(w), F.lit(h))), frame_rate, metadata_id)

    def store_with_uniform_layout(self, frames: DataFrame, video: str, rows: int, columns: int, frame_rate: int = 30, metadata_id: str | None = None) -> None:
        self._store(frames, video, lambda gops, w, h: gops.withColumn("layout", layouts.uniform(rows, columns, F.lit(w), F.lit(h))), frame_rate, metadata_id)

    def store_with_nonuniform_layout(self, frames: DataFrame, video: str, metadata_id: str, label, force: bool = True, frame_rate: int = 30) -> None:
        """Tiles around a label's detections; without force only where that saves enough."""

        def layout_of(gops: DataFrame, w: int, h: int) -> DataFrame:
            found = detections.boxes(detections.pick(self.index.of(metadata_id), metadata_id, label)).withColumn("video", F.lit(video))
            made = layouts.filled(layouts.around_detections(found, w, h, frame_rate), gops, w, h)
            return made if force else layouts.if_useful(found, made, frame_rate, w, h).drop("tiled")

        self._store(frames, video, layout_of, frame_rate, metadata_id)

    def gop_layouts(self, video: str) -> DataFrame:
        """(video, gop, layout): the newest layout at each group's first stored frame."""
        own, gop_len = self.catalog.layouts().where(F.col("video") == video), self.catalog.gop_len(video)
        gops = own.select("video", F.explode(F.sequence(F.expr(f"first_frame div {gop_len}"), F.expr(f"last_frame div {gop_len}"))).alias("gop")).distinct()
        frames = gops.select("video", (F.col("gop") * gop_len).cast("int").alias("frame"))
        return catalog.newest(frames, own, gop_len).select("video", F.expr(f"cast(frame div {gop_len} as int)").alias("gop"), "layout")

    # selections

    def _wanted(self, video: str, metadata_id: str | None, label, first, last) -> DataFrame:
        size = self.catalog.video(video)
        rows = detections.pick(self.index.of(metadata_id or video), metadata_id or video, label, first, last)
        boxes = detections.boxes(rows, size["width"], size["height"]).withColumn("video", F.lit(video))
        if state := self._regret(video):
            state.ask(as_labels(label).labels(), first, first + 1 if first is not None and last is None else last)
        return boxes

    def _own(self, video: str) -> tuple[DataFrame, int]:
        return self.catalog.layouts().where(F.col("video") == video), self.catalog.gop_len(video)

    @_overloaded
    def select_places(self, video: str, label, first: int | None = None, last: int | None = None, metadata_id: str | None = None, include_gop_prefix: bool = False) -> DataFrame:
        """Where the wanted objects are, without reading pixels."""
        boxes, own = self._wanted(video, metadata_id, label, first, last), self._own(video)
        if not include_gop_prefix:
            return selecting.objects(boxes, *own)
        every = detections.boxes(detections.pick(self.index.of(metadata_id or video), metadata_id or video, label)).withColumn("video", F.lit(video))
        return selecting.prefix_objects(boxes, every, *own)

    @_overloaded
    def select(self, video: str, label, first: int | None = None, last: int | None = None, metadata_id: str | None = None, include_gop_prefix: bool = False) -> DataFrame:
        """Objects: (video, frame, label, tile_no, x, y, width, height, pixels) of each box and tile."""
        met = self.catalog.tile_pixels(self.select_places(video, label, first, last, metadata_id, include_gop_prefix))
        return met.select("video", "frame", "label", "tile_no", "x", "y", "width", "height", P.crop("pixels", "tile_width", "left", "top", "width", "height").alias("pixels"))

    def images(self, *asked, **options) -> Images:
        """select(), one image at a time."""
        return Images(self.select(*asked, **options))

    @_overloaded
    def select_tiles(self, video: str, label, first: int | None = None, last: int | None = None, metadata_id: str | None = None, include_gop_prefix: bool = False) -> DataFrame:
        boxes = self._wanted(video, metadata_id, label, first, last)
        return self.catalog.tile_pixels(selecting.whole_tiles(boxes, *self._own(video), include_gop_prefix)).select("video", "frame", "tile_no", "width", "height", "pixels")

    @_overloaded
    def select_frames(self, video: str, label, first: int | None = None, last: int | None = None, metadata_id: str | None = None) -> DataFrame:
        return self.catalog.frames(video, self._wanted(video, metadata_id, label, first, last))

    # re-tiling

    def _regret(self, video: str) -> RegretState | None:
        """The state of a video under a policy, as it was when this store first asked for it or changed it."""
        if video not in self._states:
            self._states[video] = RegretState(self.spark, self.catalog.folder("regret", video), video)
        return self._states[video] if self._states[video].policy else None

    def activate_regret_based_tiling(self, video: str, metadata_id: str | None = None, threshold: float = 1.0) -> None:
        """Log this video's selections from now on, here and in later sessions."""
        self._regret(video)
        self._states[video].activate(metadata_id or video, threshold)

    def deactivate_regret_based_tiling(self, video: str) -> None:
        self._regret(video)
        self._states[video].deactivate()

    def _scored(self, video: str) -> int:
        """Bring the costs of a video up to date; the newest query's number."""
        state, size = self._states[video], self.catalog.video(video)
        rows = self.index.of(state.policy["metadata_id"]).withColumn("video", F.lit(video))
        return state.score(rows, self.gop_layouts(video), size["width"], size["height"], size["gop_len"])

    def regret(self, video: str) -> DataFrame:
        """(video, gop, layout_id, regret, disqualified) of the log since each group was re-tiled."""
        state = self._regret(video)
        if not state:
            raise KeyError(f"{video} isn't under a policy")
        self._scored(video)
        return state.regret()

    def retile_based_on_regret(self, video: str) -> list[int]:
        """Re-tile the groups whose best candidate has gained enough; their numbers."""
        state = self._regret(video)
        if not state or (newest := self._scored(video)) < 0:
            return []
        size = self.catalog.video(video)
        chosen = regret.decide(state.regret(), size["width"], size["height"], size["gop_len"], state.policy["threshold"]).cache()
        gops = [r["gop"] for r in chosen.select("gop").orderBy("gop").collect()]  # groups of one video
        if gops:
            self.catalog.retile(video, chosen.join(state.candidates(), ["video", "gop", "layout_id"]).select("video", "gop", "layout"))
            state.clear(gops, newest)
        chosen.unpersist()
        return gops

    def scan_counters(self, video: str, label, first: int | None = None, last: int | None = None, metadata_id: str | None = None) -> DataFrame:
        """(video, n_pixels, n_frames, n_bytes, n_tiles) that a selection decodes and reads."""
        return selecting.scan_counters(self._wanted(video, metadata_id, label, first, last), self._own(video)[0], self.catalog.zones(), self.catalog.gop_len(video))


def store_from_legacy(spark: SparkSession, path: str, catalog_path: str | None = None) -> TileStore:
    """A store over an index of corner-and-size rows."""
    return TileStore(spark, "legacy", path, catalog_path)
