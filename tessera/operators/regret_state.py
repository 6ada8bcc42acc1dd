"""Regret that outlives a session and is never worked out twice.

A video's queries, re-tilings and policies are files of one record each
(sources/lines.py); costs are tables that only grow:

* own:     what a query shape (labels and frames) decodes of a group under a candidate,
* base:    the same under the layout that the group had when the query was asked, and untiled,
* layouts: the candidates' layouts by group.

Scoring adds what is missing: new shapes under all candidates, new candidates
for the shapes that still count, and the base of shapes asked since the last
time.  Queries of one shape share its costs.  A group that is re-tiled leaves a
tombstone with the newest query's number; queries up to it no longer count
there.  Each scoring is one batch, which counts once its record is written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cost, layouts, regret
from tessera.sources import detections, lines

POLICY = "number int, active boolean, metadata_id string, threshold double"
LOG = "number int, shape string, labels array<string>, first int, last int"
CLEARED = "number int, iteration int, gops array<int>"
SCORED = "number int, batch string, after int, upto int"
OWN = "shape string, gop int, layout_id string, pixels long, tiles long, batch string"
BASE = "shape string, gop int, base_pixels long, base_tiles long, whole_pixels long, batch string"
MADE = "gop int, layout_id string, layout struct<widths:array<int>,heights:array<int>>, batch string"


class RegretState:
    """The regret of one video, below a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str, video: str):
        self.spark, self.folder, self.video = spark, folder, video
        newest = lines.read(spark, f"{folder}/policies", POLICY).orderBy(F.desc("number")).first()
        self.policy = newest if newest and newest["active"] else None

    def activate(self, metadata_id: str, threshold: float) -> None:
        """Begin anew: queries of earlier policies no longer count."""
        self._decide(active=True, metadata_id=metadata_id, threshold=float(threshold))

    def deactivate(self) -> None:
        if self.policy:
            self._decide(active=False)

    def _decide(self, **policy) -> None:
        lines.append(self.spark, f"{self.folder}/policies", policy, lines.next_number(self.spark, f"{self.folder}/policies"))
        self.__init__(self.spark, self.folder, self.video)

    def _at(self, name: str) -> str:
        return f"{self.folder}/{self.policy['number']}/{name}"

    def _table(self, name: str, schema: str) -> DataFrame:
        """The rows of whole batches."""
        if not lines.exists(self.spark, self._at(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at(name)).join(F.broadcast(self.scored().select("batch")), "batch", "left_semi")

    def log(self) -> DataFrame:
        """(number, shape, labels, first, last) of every query."""
        return lines.read(self.spark, self._at("log"), LOG)

    def scored(self) -> DataFrame:
        return lines.read(self.spark, self._at("scored"), SCORED)

    def cleared(self) -> DataFrame:
        """(gop, cleared): the newest query before a group's last re-tiling."""
        rows = lines.read(self.spark, self._at("cleared"), CLEARED)
        return rows.select(F.explode("gops").alias("gop"), "iteration").groupBy("gop").agg(F.max("iteration").alias("cleared"))

    def ask(self, labels: list[str], first: int | None, last: int | None) -> int:
        """Log a query; last is exclusive, first null asks for every frame."""
        labels = sorted(set(labels))
        record = {"shape": json.dumps([labels, first, last]), "labels": labels, "first": first, "last": last}
        return lines.append(self.spark, self._at("log"), record, lines.next_number(self.spark, self._at("log")))

    def clear(self, gops: list[int], iteration: int) -> None:
        lines.append(self.spark, self._at("cleared"), {"iteration": iteration, "gops": gops}, lines.next_number(self.spark, self._at("cleared")))

    def shapes(self) -> DataFrame:
        """(shape, labels, first, last, newest): each kind of query and the last one of it."""
        return self.log().groupBy("shape", "labels", "first", "last").agg(F.max("number").alias("newest"))

    def live(self) -> DataFrame:
        """Shapes of which a query counts for some group that it touches, or wasn't scored yet."""
        touched = self._table("base", BASE).select("shape", "gop").distinct().join(self.cleared(), "gop", "left")
        all_shapes = self.shapes()
        counts = touched.join(all_shapes.select("shape", "newest"), "shape").where(F.col("cleared").isNull() | (F.col("newest") > F.col("cleared"))).select("shape")
        new = all_shapes.where(F.col("newest") > self._upto()).select("shape")
        return all_shapes.join(counts.union(new).distinct(), "shape", "left_semi")

    def _upto(self) -> int:
        return self.scored().agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("n")).first()["n"]

    def score(self, rows: DataFrame, current: DataFrame, width: int, height: int, gop_len: int) -> int:
        """Add the costs that are missing, given detections and the current layouts (video, gop, layout); the newest query's number."""
        after, upto = self._upto(), lines.next_number(self.spark, self._at("log")) - 1
        if upto == after:
            return upto
        batch, log = uuid.uuid4().hex, self.log().where(F.col("number") <= upto)
        asked = log.select(F.lit(self.video).alias("video"), F.explode("labels").alias("label"), F.col("number").alias("iteration"))
        sets = regret.candidates(asked)
        known = {r["layout_id"] for r in self._table("layouts", MADE).select("layout_id").distinct().collect()}
        ids = sorted(r["layout_id"] for r in sets.select("layout_id").collect())  # two for each label at most
        if fresh := [i for i in ids if i not in known]:
            made = regret.candidate_layouts(detections.boxes(rows), sets.where(F.col("layout_id").isin(fresh)), current.select("video", "gop"), width, height, gop_len)
            self._add("layouts", made.select("gop", "layout_id", "layout"), MADE, batch)
        candidate = self._raw("layouts", MADE).where(F.col("batch").isin([batch, *(r["batch"] for r in self.scored().select("batch").collect())]))
        done = self._table("own", OWN).where(F.col("gop").isNull()).select("shape", "layout_id")
        missing = self.live().where(F.col("newest") <= upto).withColumn("layout_id", F.explode(F.array(*map(F.lit, ids)))).join(done, ["shape", "layout_id"], "left_anti")
        wanted = missing.groupBy("shape", "labels", "first", "last").agg(F.collect_list("layout_id").alias("wanted"))  # as many as ids at most
        own = cost.of_queries(rows, self._queries(wanted), candidate.select(F.lit(self.video).alias("video"), "gop", "layout_id", "layout"), gop_len, ("layout_id",))
        marks = missing.select("shape", F.lit(None).cast("int").alias("gop"), "layout_id", *(F.lit(None).cast("long").alias(c) for c in ("pixels", "tiles")))
        self._add("own", own.select(F.col("query_id").alias("shape"), "gop", "layout_id", "pixels", "tiles").union(marks), OWN, batch)
        recent = log.where(F.col("number") > after).select("shape", "labels", "first", "last").distinct()
        single = current.select("video", "gop", F.lit(2).alias("kind"), layouts.single(F.lit(width), F.lit(height)).alias("layout"))
        both = cost.of_queries(rows, self._queries(recent), current.select("video", "gop", F.lit(1).alias("kind"), "layout").union(single), gop_len, ("kind",))
        of = {c: F.max(F.when(F.col("kind") == k, F.col(v))).alias(c) for c, k, v in (("base_pixels", 1, "pixels"), ("base_tiles", 1, "tiles"), ("whole_pixels", 2, "pixels"))}
        self._add("base", both.groupBy(F.col("query_id").alias("shape"), "gop").agg(*of.values()), BASE, batch)
        lines.append(self.spark, self._at("scored"), {"batch": batch, "after": after, "upto": upto}, lines.next_number(self.spark, self._at("scored")))
        return upto

    def _queries(self, shapes: DataFrame) -> DataFrame:
        extra = ["wanted"] if "wanted" in shapes.columns else []
        return shapes.select(F.col("shape").alias("query_id"), F.lit(self.video).alias("video"), F.explode("labels").alias("label"), "first", "last", *extra)

    def _raw(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._at(name)) if lines.exists(self.spark, self._at(name)) else self.spark.createDataFrame([], schema)

    def _add(self, name: str, rows: DataFrame, schema: str, batch: str) -> None:
        rows = rows.withColumn("batch", F.lit(batch)).select(*(F.col(f.split()[0]) for f in schema.replace("struct<widths:array<int>,heights:array<int>>", "x").split(", ")))
        rows.write.mode("append").parquet(self._at(name))

    def candidates(self) -> DataFrame:
        """(video, gop, layout_id, layout)."""
        return self._table("layouts", MADE).select(F.lit(self.video).alias("video"), "gop", "layout_id", "layout")

    def regret(self) -> DataFrame:
        """(video, gop, layout_id, regret, disqualified) of the queries scored so far that still count."""
        batches = F.broadcast(self.scored().select("batch", "after", "upto"))
        base = self._table("base", BASE).join(batches, "batch").join(self.cleared(), "gop", "left")
        asked = base.join(self.log().select("shape", "number"), "shape")
        counted = asked.where((F.col("number") > F.greatest("after", F.coalesce("cleared", F.lit(-1)))) & (F.col("number") <= F.col("upto")))
        counted = counted.groupBy("shape", "gop", "batch", "base_pixels", "base_tiles", "whole_pixels").agg(F.count("*").alias("n"))
        own = self._table("own", OWN).where(F.col("gop").isNotNull()).select("shape", "gop", "layout_id", "pixels", "tiles")
        met = counted.join(own, ["shape", "gop"]).where("base_pixels is not null and whole_pixels is not null")
        gain = F.col("n") * regret.saved(F.col("base_pixels") - F.col("pixels"), F.col("base_tiles") - F.col("tiles"))
        useless = F.col("pixels") >= F.lit(layouts.USEFUL) * F.col("whole_pixels")
        found = met.groupBy("gop", "layout_id").agg(F.sum(gain).alias("regret"), F.bool_or(useless).alias("disqualified"))
        return found.select(F.lit(self.video).alias("video"), "gop", "layout_id", "regret", "disqualified")
