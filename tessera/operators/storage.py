"""Videos on disk: append-only tables of layouts and of tile pixels.

Every write has an id that its rows carry in all tables: videos, layouts, zones
and tiles.  It shows, as a whole, when it is committed, which is its last step:
a file that is made once claims a version of the video for it.  What a failed
write left behind never shows, and two writers never get one version.

Tiles are partitioned by video and write, and sorted by tile and frame within
files of small pages, so that a read of some tiles skips the others' pages.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import pixels as P
from tessera.operators import catalog, selecting
from tessera.sources import lines

LAYOUTS = "video string, first_frame int, last_frame int, layout struct<widths:array<int>,heights:array<int>>, write_id string"
TILES = "video string, write_id string, first_frame int, gop int, tile_no int, frame int, x int, y int, width int, height int, pixels binary"
ZONES = "video string, gop int, tile_no int, n_frames long, n_bytes long, write_id string"
VIDEOS = "video string, metadata_id string, width int, height int, frame_rate int, gop_len int, n_frames long"
COMMITS = "video string, number int, write_id string"
ROW_GROUP, PAGE_ROWS = 16 << 20, 32
MOST_ZONES, MOST_SPANS = 1000, 32  # zones that come to the driver, and those of a write that become a predicate each


class Catalog:
    """The tables videos, layouts, zones and tiles below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        if not lines.exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def folder(self, name: str, video: str) -> str:
        """A video's own folder of small records."""
        return f"{self.path}/{name}/{hashlib.sha1(video.encode()).hexdigest()}"

    def commits(self) -> DataFrame:
        """(video, version, write_id) of the writes that show."""
        return lines.read(self.spark, f"{self.path}/commits", COMMITS).withColumnRenamed("number", "version")

    def _committed(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema).join(self.commits(), ["video", "write_id"])

    def videos(self) -> DataFrame:
        """A row for each video, as its first write says."""
        known = self._committed("videos", VIDEOS + ", write_id string")
        columns = [c.split()[0] for c in VIDEOS.split(", ")]
        return known.groupBy("video").agg(F.min_by(F.struct(*columns), "version").alias("first")).select("first.*")

    def layouts(self) -> DataFrame:
        """(video, first_frame, last_frame, version, layout)."""
        return self._committed("layouts", LAYOUTS).select("video", "first_frame", "last_frame", "version", "layout")

    def zones(self) -> DataFrame:
        """(video, version, gop, tile_no, n_frames, n_bytes): what is stored of a tile in a group of pictures."""
        return self._committed("zones", ZONES).drop("write_id")

    def tiles(self) -> DataFrame:
        """The tiles of all writes that show."""
        return self._committed("tiles", TILES)

    def video(self, video: str):
        return self.videos().where(F.col("video") == video).first()

    def probe(self) -> DataFrame:
        """(video, codec, width, height, frame_rate, gop_len, n_frames, n_bytes, bits_per_second) of what is stored, all versions.

        A frame that is stored in several versions counts in each of them.
        """
        frames = F.expr("n_frames * 1d")
        tiles = self.zones().groupBy("video", "version", "gop").agg(F.max("n_frames").alias("n_frames"), F.sum("n_bytes").alias("n_bytes"))
        sizes = tiles.groupBy("video").agg(F.sum("n_frames").alias("n_frames"), F.sum("n_bytes").alias("n_bytes"))
        met = self.videos().drop("n_frames").join(sizes, "video")
        rate = F.floor(F.col("n_bytes") * 8 * F.col("frame_rate") / frames).cast("bigint")
        return met.select("video", F.lit("raw").alias("codec"), "width", "height", "frame_rate", "gop_len", "n_frames", "n_bytes", rate.alias("bits_per_second"))

    def version(self, video: str) -> int:
        """The version that the next write of a video gets, if no other comes first."""
        return lines.next_number(self.spark, self.folder("commits", video))

    def gop_len(self, video: str) -> int:
        return self.video(video)["gop_len"]

    def write(self, video: str, frames: DataFrame, layouts: DataFrame, gop_len: int, about: dict | None = None) -> int:
        """Cut frames (video, frame, width, height, pixels) by the layouts of their groups (video, gop, layout).

        about describes a video that isn't known yet; a group of pictures is one
        second, so frame rates must be whole.  Returns the version.
        """
        if about and (about["frame_rate"] != int(about["frame_rate"]) or about["frame_rate"] <= 0):
            raise ValueError("the frame rate must be a positive whole number")
        spans = catalog.gop_ranges(layouts, gop_len)
        last = frames.groupBy("video").agg(F.max("frame").alias("last"))
        spans = spans.join(last, "video").withColumn("last_frame", F.least("last_frame", "last")).drop("last")
        spans = spans.select("video", *(F.col(c).cast("int").alias(c) for c in ("first_frame", "last_frame")), F.lit(0).alias("version"), "layout")
        gop = F.expr(f"cast(frame div {gop_len} as int)").alias("gop")
        placed = catalog.newest(frames.select("video", "frame"), spans, gop_len)
        write_id = uuid.uuid4().hex
        # every frame has a layout, and an outer join never broadcasts its left side, the pixels
        whole = frames.join(placed, ["video", "frame"], "left").select("video", "first_frame", gop, "frame", "width", "pixels", G.tiles(F.col("layout")).alias("tiles"))
        tiles = P.cut(whole).select("video", F.lit(write_id).alias("write_id"), "first_frame", "gop", "tile_no", "frame", "x", "y", "width", "height", "pixels")
        # in order of tiles, so that statistics of pages prune the read of some tiles
        tiles = tiles.sortWithinPartitions("video", "first_frame", "tile_no", "frame").write.mode("append").partitionBy("video", "write_id")
        tiles.option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/tiles")
        sizes = placed.groupBy("video", gop, "layout").agg(F.count("*").alias("n_frames")).withColumn("t", F.explode(G.tiles(F.col("layout"))))
        n_bytes = F.col("n_frames") * F.col("t.width").cast("long") * F.col("t.height") * P.CHANNELS
        sizes = sizes.select("video", "gop", "t.tile_no", "n_frames", n_bytes.alias("n_bytes"))
        sizes.groupBy("video", "gop", "tile_no").agg(F.sum("n_frames").alias("n_frames"), F.sum("n_bytes").alias("n_bytes")).withColumn("write_id", F.lit(write_id)).write.mode("append").parquet(f"{self.path}/zones")
        return self._commit(video, write_id, spans.drop("version"), about)

    def _commit(self, video: str, write_id: str, spans: DataFrame, about: dict | None) -> int:
        named = F.lit(write_id).alias("write_id")
        spans.select("*", named).write.mode("append").parquet(f"{self.path}/layouts")
        if about:
            self.spark.createDataFrame([about], VIDEOS).select("*", named).write.mode("append").parquet(f"{self.path}/videos")
        version, folder = self.version(video), self.folder("commits", video)
        while not lines.create(self.spark, f"{folder}/{version}.json", {"video": video, "number": version, "write_id": write_id}):
            if about and (first := self.video(video)):  # another writer was first
                self.check(first, about)
            version += 1
        return version

    @staticmethod
    def check(known, about: dict) -> None:
        """A video keeps its frame rate and size: groups of pictures and tiles are numbered by them."""
        for c in ("frame_rate", "width", "height"):
            if known[c] != about[c]:
                raise ValueError(f"{known['video']} is stored with {c} {known[c]}, not {about[c]}")

    # reading

    def near(self, places: DataFrame) -> Column | None:
        """What tiles at places (video, version, frame[, tile_no]) must satisfy, in literals that prune a scan.

        It holds for all of them and for few others; the places themselves are
        still to be joined.  None if they are in too many tiles to say it briefly.
        """
        tile = F.col("tile_no") if "tile_no" in places.columns else F.lit(None).cast("int").alias("tile_no")
        spans = places.select("video", "version", tile, "frame").groupBy("video", "version", "tile_no").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
        spans = spans.join(self.commits(), ["video", "version"])
        found = spans.limit(MOST_ZONES + 1).collect()
        if len(found) > MOST_ZONES:
            whole = spans.groupBy("video", "version", "write_id").agg(F.min("tile_no").alias("tile_no"), F.max("tile_no").alias("to"), F.min("first").alias("first"), F.max("last").alias("last"))
            found = whole.limit(MOST_SPANS + 1).collect()
            if len(found) > MOST_SPANS:
                return None
        by_write: dict[tuple[str, str], list[tuple]] = {}
        for r in found:
            own = r.asDict()
            by_write.setdefault((r["video"], r["write_id"]), []).append((r["tile_no"], own.get("to", r["tile_no"]), r["first"], r["last"]))
        parts = []
        for (video, write_id), own in by_write.items():
            if len(own) > MOST_SPANS:
                own = [(min(o[0] for o in own), max(o[1] for o in own), min(o[2] for o in own), max(o[3] for o in own))]
            inside = [(F.lit(True) if a is None else F.col("tile_no").between(a, b)) & F.col("frame").between(c, d) for a, b, c, d in own]
            parts.append((F.col("video") == video) & (F.col("write_id") == write_id) & reduce(lambda x, y: x | y, inside))
        return reduce(lambda x, y: x | y, parts) if parts else F.lit(False)

    def tiles_near(self, places: DataFrame) -> DataFrame:
        """The tiles that may be at places: pages of others are not read."""
        near = self.near(places)
        tiles = self._read("tiles", TILES)
        return (tiles if near is None else tiles.where(near)).join(self.commits(), ["video", "write_id"])

    def frames(self, video: str, wanted: DataFrame | None = None) -> DataFrame:
        """(video, frame, width, height, pixels) put together from all tiles of the newest version of each frame."""
        layouts = self.layouts().where(F.col("video") == video)
        frames = self.tiles().where(F.col("video") == video) if wanted is None else wanted
        placed = catalog.newest(frames.select("video", "frame").distinct(), layouts, self.gop_len(video)).select("video", "frame", "first_frame", "version")
        return P.pasted(self.tiles_near(placed).join(placed, ["video", "frame", "first_frame", "version"]), ["video", "frame"])

    def retile(self, video: str, layouts: DataFrame) -> int:
        """Write the groups of layouts (video, gop, layout) anew, as the next version."""
        gop_len = self.gop_len(video)
        wanted = layouts.select("video", F.explode(F.sequence(F.col("gop") * gop_len, (F.col("gop") + 1) * gop_len - 1)).alias("frame"))
        return self.write(video, self.frames(video, wanted), layouts, gop_len)

    def tile_pixels(self, places: DataFrame) -> DataFrame:
        """The stored tiles at places (video, first_frame, version, tile_no, frame, ...); few others are read."""
        keys = [*selecting.RANGE, "tile_no", "frame"]
        stored = self.tiles_near(places).select(*keys, F.col("width").alias("tile_width"), F.col("height").alias("tile_height"), "pixels")
        return places.join(stored, keys)
