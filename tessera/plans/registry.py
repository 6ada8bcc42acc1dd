"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import pixels as P
from tessera.functions.selection import AnyOf
from tessera.operators import catalog, cost, layouts, merging, regret, selecting
from tessera.plans import fixtures as X
from tessera.sources import detections as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _det(sql: str) -> str:
    return f"with {X.DETECTIONS_SQL} {sql}"


def _boxes(spark: SparkSession, sf_dir: str, video: str | None, labels, first=None, last=None) -> DataFrame:
    return D.boxes(D.pick(X.detections(spark, sf_dir), video, labels, first, last))


# The semantic index


@query(_det("select distinct frame from det where video = 'v0' and label = 'A'"))
def ordered_frames_all(spark, sf_dir):
    return D.ordered_frames(D.pick(X.detections(spark, sf_dir), "v0", "A"))


@query(_det("select distinct frame from det where video = 'v0' and label = 'A' and frame = 5"))
def ordered_frames_eq(spark, sf_dir):
    return D.ordered_frames(D.pick(X.detections(spark, sf_dir), "v0", "A", 5))


@query(_det("select distinct frame from det where video = 'v0' and label = 'A' and frame >= 3 and frame < 90"))
def ordered_frames_range(spark, sf_dir):
    return D.ordered_frames(D.pick(X.detections(spark, sf_dir), "v0", "A", 3, 90))


@query(_det("select distinct frame from det where video = 'v2' and (label = 'A' or label = 'R') and frame >= 10 and frame < 50"))
def ordered_frames_or_labels(spark, sf_dir):
    return D.ordered_frames(D.pick(X.detections(spark, sf_dir), "v2", AnyOf.of("A", "R"), 10, 50))


_RECT = "select video, label, frame, x, y, w as width, h as height from box"


def _rects(boxes: DataFrame) -> DataFrame:
    return boxes.select("video", "label", "frame", "box.*")


@query(
    f"""with {X.DETECTIONS_SQL}, c as (
      select video, label, frame, x1, y1, least(x2, 1600) as x2, least(y2, 850) as y2 from det
      where video = 'v1' and label = 'R' and frame = 7 and x1 < 1600 and y1 < 850)
    select video, label, frame, x1 - x1 % 2 as x, y1 - y1 % 2 as y, (x2 - x1) + (x2 - x1) % 2 as width, (y2 - y1) + (y2 - y1) % 2 as height from c"""
)
def rects_for_frame_clamped(spark, sf_dir):
    return _rects(D.boxes(D.pick(X.detections(spark, sf_dir), "v1", "R", 7), 1600, 850))


@query(_det(f"{_RECT} where video = 'v0' and label = 'A' and frame >= 15 and frame < 20"))
def rects_for_frames(spark, sf_dir):
    return _rects(_boxes(spark, sf_dir, "v0", "A", 15, 20))


@query(_det("select video, label, count(*) as n, count(distinct frame) as n_frames from det group by all"))
def bulk_insert_counts(spark, sf_dir):
    return X.detections(spark, sf_dir).groupBy("video", "label").agg(F.count("*").alias("n"), F.count_distinct("frame").alias("n_frames"))


@query(_det("select video, frame, cast(sum(case when 100 >= x and 100 < x + w and 100 >= y and 100 < y + h then 1 else 0 end) as bigint) as hits, cast(sum(cast(w as bigint) * h) as bigint) as covered from box group by all"))
def point_hits_and_area(spark, sf_dir):
    boxes = _boxes(spark, sf_dir, None, ["A", "N", "R"])
    b = F.col("box")
    return boxes.groupBy("video", "frame").agg(F.sum(G.contains_point(b, 100, 100).cast("bigint")).alias("hits"), F.sum(G.area(b)).alias("covered"))


# Layouts

@query(
    f"""with {X.DETECTIONS_SQL}, {X.LAYOUTS_SQL}, {X.STAB_SQL}, f as (
      select distinct s.video, s.frame, l.widths, l.heights from stab s join lay l using (video, first_frame, version) join det d on d.video = s.video and d.frame = s.frame and d.label = 'N'
    ), s as (
      select *, case when lag(frame) over w is null or frame <> lag(frame) over w + 1 or widths <> lag(widths) over w or heights <> lag(heights) over w then 1 else 0 end as starts
      from f window w as (partition by video order by frame)
    ), i as (select *, sum(starts) over (partition by video order by frame) as island from s)
    select video, min(frame) as first_frame, max(frame) as last_frame, cast(len(first(widths)) * len(first(heights)) as integer) as n_tiles from i group by video, island"""
)
def layout_groups_islands(spark, sf_dir):
    frames = D.pick(X.detections(spark, sf_dir), None, "N").select("video", "frame").distinct()
    placed = catalog.newest(frames, X.layouts(spark), X.GOP).select("video", "frame", "layout")
    return catalog.ranges(placed).select("video", "first_frame", "last_frame", G.n_tiles(F.col("layout")).alias("n_tiles"))


@query(f"""with {X.DETECTIONS_SQL}, {X.LAYOUTS_SQL}, {X.STAB_SQL}
    select distinct g.video, g.first_frame, g.version, cast(g.tile_no as integer) as tile_no, b.frame from box b join stab s using (video, frame)
    join grid g on g.video = s.video and g.first_frame = s.first_frame and g.version = s.version and {X.MEET} where b.label = 'A'""")
def tile_frames_with_objects(spark, sf_dir):
    return selecting.tile_frames(_boxes(spark, sf_dir, None, "A"), X.layouts(spark), X.GOP)


def _as_int(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("int") for n in names})


# Selection

_HITS = f"""with {X.DETECTIONS_SQL}, {X.LAYOUTS_SQL}, {X.STAB_SQL}, hit as (
    select b.*, g.* exclude (video, last_frame) from box b join stab s using (video, frame)
    join grid g on g.video = s.video and g.first_frame = s.first_frame and g.version = s.version and {X.MEET}
    where <wanted>
  ), part as (
    select *, greatest(x, tx) as px, greatest(y, ty) as py, least(x + w, tx + tw) - greatest(x, tx) as pw, least(y + h, ty + th) - greatest(y, ty) as ph from hit
  )"""


def _hits(wanted: str) -> str:
    return _HITS.replace("<wanted>", wanted)


@query(
    _hits("b.label = 'N' and b.frame < 120")
    + " select video, first_frame, version, frame, label, cast(tile_no as integer) as tile_no, px - px % 2 as x, py - py % 2 as y, pw + pw % 2 as width, ph + ph % 2 as height, px - px % 2 - tx as \"left\", py - py % 2 - ty as top from part"
)
def select_objects_geometry(spark, sf_dir):
    return selecting.objects(_boxes(spark, sf_dir, None, "N", 0, 120), X.layouts(spark), X.GOP)


@query(
    (_hits("b.label = 'A'")).replace("hit as (", "allhit as (").replace("from hit", "from allhit")
    + """, span as (
      select video, first_frame, version, tile_no, frame // 30 as gop, max(frame) as last from part where frame >= 15 and frame < 20 group by all)
    select p.video, p.first_frame, p.version, p.frame, p.label, cast(p.tile_no as integer) as tile_no, px - px % 2 as x, py - py % 2 as y, pw + pw % 2 as width, ph + ph % 2 as height,
      px - px % 2 - tx as "left", py - py % 2 - ty as top
    from part p join span s on p.video = s.video and p.first_frame = s.first_frame and p.version = s.version and p.tile_no = s.tile_no and p.frame // 30 = s.gop
      and p.frame between greatest(s.gop * 30, s.first_frame) and s.last"""
)
def select_objects_with_prefix(spark, sf_dir):
    return selecting.prefix_objects(_boxes(spark, sf_dir, None, "A", 15, 20), _boxes(spark, sf_dir, None, "A"), X.layouts(spark), X.GOP)


@query(_hits("b.label = 'A'") + " select distinct video, first_frame, version, cast(tile_no as integer) as tile_no, frame, tw as width, th as height from hit")
def select_tiles_ids(spark, sf_dir):
    return selecting.whole_tiles(_boxes(spark, sf_dir, None, "A"), X.layouts(spark), X.GOP)


_SPAN = """, span as (
      select video, first_frame, version, tile_no, frame // 30 as gop, max(frame) as last, max(tw) as tw, max(th) as th from hit group by all
    ), dec as (select *, greatest(gop * 30, first_frame) as first from span)"""


@query(f"""with {X.DETECTIONS_SQL}, {X.LAYOUTS_SQL}, {X.STAB_SQL}
    select distinct s.video, s.first_frame, s.version, s.frame, cast(len(widths) * len(heights) as integer) as n_tiles
    from det d join stab s using (video, frame) join lay l on l.video = s.video and l.first_frame = s.first_frame and l.version = s.version where d.label = 'R' and d.frame >= 30 and d.frame < 200""")
def select_frames_ids(spark, sf_dir):
    return selecting.full_frames(_boxes(spark, sf_dir, None, "R", 30, 200), X.layouts(spark), X.GOP)


@query(
    _hits("b.label = 'A'")
    + _SPAN
    + " select video, cast(sum(cast(last - first + 1 as bigint) * tw * th) as bigint) as n_pixels, cast(sum(last - first + 1) as bigint) as n_frames, count(distinct (first_frame, version, tile_no)) as n_tiles from dec group by video"
)
def decode_counters(spark, sf_dir):
    return selecting.counters(_boxes(spark, sf_dir, None, "A"), X.layouts(spark), X.GOP)


@query(
    f"""with {X.DETECTIONS_SQL}, b as (select *, 700 as wx, 400 as wy, 900 as ww, 420 as wh from box where frame < 60), m as (
      select video, label, frame, greatest(x, wx) as ax, greatest(y, wy) as ay, least(x + w, wx + ww) as bx, least(y + h, wy + wh) as b2
      from b where x < wx + ww and wx < x + w and y < wy + wh and wy < y + h)
    select video, label, frame, ax - ax % 2 as x, ay - ay % 2 as y, (bx - ax) + (bx - ax) % 2 as width, (b2 - ay) + (b2 - ay) % 2 as height from m"""
)
def overlap_rectangles(spark, sf_dir):
    window = G.box(F.lit(700), F.lit(400), F.lit(1600), F.lit(820))
    boxes = _boxes(spark, sf_dir, None, ["A", "N", "R"], 0, 60).where(G.intersects(F.col("box"), window))
    return boxes.withColumn("box", G.overlap(F.col("box"), window)).select("video", "label", "frame", "box.*")


@query(_det("select video, frame, min(x) as x, min(y) as y, max(x + w) - min(x) as width, max(y + h) - min(y) as height from box group by all"))
def rect_union_by_frame(spark, sf_dir):
    b = F.col("box")
    found = _boxes(spark, sf_dir, None, ["A", "N", "R"]).groupBy("video", "frame").agg(F.min(b["x"]).alias("x"), F.min(b["y"]).alias("y"), F.max(G.right(b)).alias("r"), F.max(G.bottom(b)).alias("b"))
    return found.select("video", "frame", "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("b") - F.col("y")).alias("height"))


@query(
    _det(""", i as (select distinct video, label, frame, x as s, x + w as e from box), o as (
      select *, max(e) over (partition by video, label, frame order by s, e rows between unbounded preceding and 1 preceding) as before from i
    ), n as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by video, label, frame order by s, e rows unbounded preceding) as island from o)
    select video, label, frame, min(s) as "start", max(e) as "end" from n group by video, label, frame, island""")
)
def coalesced_intervals(spark, sf_dir):
    b = F.col("box")
    spans = _boxes(spark, sf_dir, None, ["A", "N", "R"]).select("video", "label", "frame", b["x"].alias("start"), G.right(b).alias("end"))
    return catalog.joined_intervals(spans, ["video", "label", "frame"])


# Costs

_UNI = ([960, 960], [544, 536])


@query(f"with {X.DETECTIONS_SQL}, {X.UNIFORM_SQL}, {X.LOG_SQL}, {X.cost_sql('c', 'ugrid')} select video, gop, query_id, cast(pixels as bigint) as pixels, cast(tiles as bigint) as tiles from c")
def cost_by_gop(spark, sf_dir):
    return cost.of_queries(X.detections(spark, sf_dir), X.workload(spark), X.gop_layouts(spark, *_UNI), X.GOP)


@query(f"with {X.DETECTIONS_SQL}, {X.UNIFORM_SQL}, {X.LOG_SQL}, {X.cost_sql('c', 'ugrid')} select query_id, cast(sum(pixels) * max(cnt) as bigint) as pixels, cast(sum(tiles) * max(cnt) as bigint) as tiles from c join log using (query_id) group by query_id")
def cost_for_query(spark, sf_dir):
    asked = X.workload(spark)
    found = cost.of_queries(X.detections(spark, sf_dir), asked, X.gop_layouts(spark, *_UNI), X.GOP).groupBy("query_id").agg(F.sum("pixels").alias("pixels"), F.sum("tiles").alias("tiles"))
    return found.join(asked.select("query_id", "count"), "query_id").select("query_id", (F.col("pixels") * F.col("count")).alias("pixels"), (F.col("tiles") * F.col("count")).alias("tiles"))


@query(f"with {X.DETECTIONS_SQL}, {X.UNIFORM_SQL}, {X.LOG_SQL}, {X.cost_sql('c', 'ugrid')} select cast(sum(pixels * cnt) as bigint) as num_pixels, cast(sum(tiles * cnt) as bigint) as num_tiles from c join log using (query_id)")
def cost_for_workload(spark, sf_dir):
    asked = X.workload(spark)
    return cost.of_workload(cost.of_queries(X.detections(spark, sf_dir), asked, X.gop_layouts(spark, *_UNI), X.GOP), asked)


@query(
    f"""with {X.DETECTIONS_SQL}, {X.UNIFORM_SQL}, t as (
      select b.video, b.frame // 30 as gop, g.tile_no, max(tw) as tw, max(th) as th, max(b.frame) as last from box b join ugrid g on {X.MEET} where b.label = 'N' group by all
    ), own as (select video, gop, sum(cast(tw as bigint) * th * (last - gop * 30 + 1)) as pixels from t group by all
    ), base as (select video, frame // 30 as gop, 1920 * 1080 * (max(frame) - frame // 30 * 30 + 1) as pixels from box where label = 'N' group by video, frame // 30
    ), every as (select 'v' || cast(v as varchar) as video, cast(g as integer) as gop from range(4) as vs(v), range(10) as gs(g))
    select e.video, e.gop, coalesce(o.pixels <= 0.8 * b.pixels, false) as tiled from every e left join own o using (video, gop) left join base b using (video, gop)"""
)
def smart_layout_choice(spark, sf_dir):
    boxes = _boxes(spark, sf_dir, None, "N")
    return layouts.if_useful(boxes, X.gop_layouts(spark, *_UNI), X.GOP, X.WIDTH, X.HEIGHT).select("video", "gop", "tiled")


def _fine_axis(name: str, low: str, size: str, least: int, whole: int) -> str:
    """The cuts of one axis, an interval a step: recursion over sorted spans with the cuts so far."""

    def crossed(at: str) -> str:
        return f"(len(list_filter(sp, lambda p: p.s < {at} and p.e > {at})) - case when sp[i].s < {at} and sp[i].e > {at} then 1 else 0 end > 0)"

    return f"""{name}_spans as (
      select video, frame // 30 as gop, list(struct_pack(s := {low}, e := {low} + {size}) order by {low}, {low} + {size}) as sp from box where label in ('A', 'R') group by all
    ), {name}_step as (
      select video, gop, sp, 1 as i, cast([] as integer[]) as cuts, cast(null as integer) as reached from {name}_spans
      union all
      select video, gop, sp, i + 1, case
          when high = base1 then cuts1
          when high - base1 >= {least} and {whole} - high >= {least} then case when not {crossed('high')} and (reached is null or high >= reached) then list_append(cuts1, high) else cuts1 end
          when base1 + {least} >= sp[i].e and (reached is null or base1 + {least} >= reached) and {whole} - base1 - {least} >= {least}
            and case when i < len(sp) then sp[i + 1].s - base1 - {least} >= {least} else base1 < sp[i].e end then list_append(cuts1, base1 + {least})
          else cuts1 end, high
      from (select *, cast(base1 + ceil((sp[i].e - base1) / 32.0) * 32 as integer) as high
        from (select *, coalesce(cuts1[-1], 0) as base1
          from (select *, case
              when not (low - base >= {least} and not {crossed('low')} and (reached is null or low >= reached)) then cuts
              when {whole} - low >= {least} then list_append(cuts, low)
              when {whole} - 2 * {least} >= base and not {crossed(f'({whole} - {least})')} then list_append(cuts, {whole} - {least})
              else cuts end as cuts1
            from (select *, cast(base + floor((sp[i].s - base) / 32.0) * 32 as integer) as low
              from (select *, coalesce(cuts[-1], 0) as base from {name}_step where i <= len(sp)))))
    )), {name}_sizes as (
      select video, gop, list_transform(range(1, len(cuts) + 2), lambda k: coalesce(cuts[k], {whole}) - coalesce(case when k > 1 then cuts[k - 1] end, 0)) as sizes from {name}_step where i = len(sp) + 1
    )"""


@query(
    f"""with recursive {X.DETECTIONS_SQL}, {_fine_axis('wide', 'x', 'w', 256, 1920)}, {_fine_axis('tall', 'y', 'h', 160, 1080)},
      every as (select 'v' || cast(v as varchar) as video, cast(g as integer) as gop from range(4) as vs(v), range(10) as gs(g)),
      sizes as (select video, gop, 'width' as axis, sizes from wide_sizes union all select video, gop, 'height', sizes from tall_sizes),
      axes as (select *, case axis when 'width' then 1920 else 1080 end as whole from every, (values ('width'), ('height')) as a(axis)),
      known as (select a.video, a.gop, a.axis, coalesce(sizes, [whole]) as sizes from axes a left join sizes s using (video, gop, axis))
    select video, gop, axis, cast(k - 1 as integer) as i, cast(sizes[k] as integer) as size from known, unnest(range(1, len(sizes) + 1)) as u(k)"""
)
def fine_layout_dims(spark, sf_dir):
    made = layouts.around_detections(_boxes(spark, sf_dir, None, ["A", "R"]), X.WIDTH, X.HEIGHT, X.GOP)
    known = layouts.filled(made, X.gops(spark), X.WIDTH, X.HEIGHT)
    axes = F.explode(F.array(F.struct(F.lit("width").alias("axis"), F.col("layout.widths").alias("s")), F.struct(F.lit("height").alias("axis"), F.col("layout.heights").alias("s"))))
    return known.select("video", "gop", axes.alias("a")).select("video", "gop", "a.axis", F.posexplode("a.s").alias("i", "size"))


@query(
    _det(""", m as (
      select video, frame, list_sort(list(distinct {'x1': x, 'y1': y, 'x2': x + w, 'y2': y + h})) as b, false as done from box group by video, frame
      union all
      select video, frame, nb, nb = b from (select video, frame, b, list_sort(list_distinct(list_transform(list_transform(b, lambda p: list_filter(b, lambda q: p.x1 < q.x2 and q.x1 < p.x2 and p.y1 < q.y2 and q.y1 < p.y2)),
        lambda own: {'x1': list_min(list_transform(own, lambda q: q.x1)), 'y1': list_min(list_transform(own, lambda q: q.y1)),
          'x2': list_max(list_transform(own, lambda q: q.x2)), 'y2': list_max(list_transform(own, lambda q: q.y2))}))) as nb from m where not done)
    ), r as (select video, frame, unnest(b) as u from m where done)
    select video, frame, u.x1 as x, u.y1 as y, u.x2 - u.x1 as width, u.y2 - u.y1 as height from r""").replace("with det", "with recursive det", 1)
)
def merged_rectangles(spark, sf_dir):
    return merging.merged(_boxes(spark, sf_dir, None, ["A", "N", "R"]))


# Regret

_REGRET = f"""with {X.DETECTIONS_SQL}, {X.UNIFORM_SQL}, {X.CANDIDATES_SQL}, {X.LOG_SQL}, one as (select [1920] as widths, [1080] as heights),
  wgrid as (select 0 as tile_no, 0 as tx, 0 as ty, 1920 as tw, 1080 as th),
  {X.cost_sql('own', 'cgrid', 'layout_id')}, {X.cost_sql('base', 'ugrid')}, {X.cost_sql('whole', 'wgrid')}, r as (
    select o.video, o.gop, o.layout_id, sum(1.608e-06 * (b.pixels - o.pixels) + 1.703e-01 * (b.tiles - o.tiles)) as regret, bool_or(o.pixels >= 0.8 * w.pixels) as disqualified
    from own o join base b using (video, gop, query_id) join whole w using (video, gop, query_id) group by all)"""


def _regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regret.by_gop_and_layout(X.detections(spark, sf_dir), X.query_log(spark), X.gop_layouts(spark, *_UNI), X.candidates(spark), X.WIDTH, X.HEIGHT, X.GOP)


@query(_REGRET + " select video, gop, layout_id, round(regret, 6) as regret, disqualified from r")
def regret_by_gop_layout(spark, sf_dir):
    return _regret(spark, sf_dir).withColumn("regret", F.round("regret", 6))


@query(
    _REGRET
    + """, n as (select *, row_number() over (partition by video, gop order by regret desc, layout_id) as n from r where not disqualified)
    select video, gop, layout_id, round(regret, 6) as regret from n where n = 1 and regret > 0 and regret > 0.1 * (3.206e-06 * 1920 * 1080 * 30 + 2.592)"""
)
def retile_decision(spark, sf_dir):
    return regret.decide(_regret(spark, sf_dir), X.WIDTH, X.HEIGHT, X.GOP, 0.1).withColumn("regret", F.round("regret", 6))


@query(
    _REGRET
    + """, n as (select *, row_number() over (partition by video, gop order by regret desc, layout_id) as n from r where not disqualified),
      c as (select video, gop from n where n = 1 and regret > 0 and regret > 0.1 * (3.206e-06 * 1920 * 1080 * 30 + 2.592))
    select distinct d.video, d.frame from det d join c on c.video = d.video and c.gop = d.frame // 30"""
)
def retile_gop_frames(spark, sf_dir):
    chosen = regret.decide(_regret(spark, sf_dir), X.WIDTH, X.HEIGHT, X.GOP, 0.1)
    frames = X.detections(spark, sf_dir).select("video", "frame").distinct().withColumn("gop", F.expr(f"cast(frame div {X.GOP} as int)"))
    return frames.join(chosen, ["video", "gop"], "left_semi").select("video", "frame")



@query(
    f"""with {X.DETECTIONS_SQL}, {X.UNIFORM_SQL}, {X.CANDIDATES_SQL}, {X.ORDER_LOG_SQL}, wgrid as (select 0 as tile_no, 0 as tx, 0 as ty, 1920 as tw, 1080 as th),
      {X.cost_sql('own', 'cgrid', 'layout_id')}, {X.cost_sql('base', 'ugrid')}, {X.cost_sql('whole', 'wgrid')}, n as (
        select t.query_id, t.video, t.gop, count(*) as n from (select distinct query_id, video, gop from whole) t join log l using (query_id)
        join asks a on a.video = l.video and a.label = l.label and a.first = l.first and a.last = l.last left join cleared c on c.video = t.video and c.gop = t.gop
        where c.iteration is null or a.iteration > c.iteration group by all
      ), r as (
        select o.video, o.gop, o.layout_id, cast(sum(n * (b.pixels - o.pixels)) as bigint) as pixels, cast(sum(n * (b.tiles - o.tiles)) as bigint) as tiles, bool_or(o.pixels >= 0.8 * w.pixels) as disqualified
        from own o join base b using (video, gop, query_id) join whole w using (video, gop, query_id) join n using (video, gop, query_id) group by all)
    select video, gop, layout_id, pixels, tiles, round(1.608e-06 * pixels + 1.703e-01 * tiles, 3) as regret, disqualified from r"""
)
def regret_of_order_log(spark, sf_dir):
    found = regret.by_shape(X.detections(spark, sf_dir), X.order_log(spark, sf_dir), X.gop_layouts(spark, *_UNI), X.candidates(spark), X.WIDTH, X.HEIGHT, X.GOP, X.order_cleared(spark, sf_dir))
    return found.withColumn("regret", F.round("regret", 3))


@query(
    f"""with {X.ORDER_LOG_SQL}, f as (select video, label, min(iteration) as since from asks group by all),
      s as (select f.video, f.label, string_agg(g.label, '_' order by g.label) as so_far from f join f g on g.video = f.video and (g.since, g.label) <= (f.since, f.label) group by f.video, f.label)
    select video, label as layout_id from s union select video, so_far from s"""
)
def regret_candidates_all(spark, sf_dir):
    return regret.candidates(X.order_log(spark, sf_dir)).select("video", "layout_id")


# The same over all rows of the tables: no rows are left out, and layouts grow with lineitem


@query(_det("select distinct 'w' as video, label, frame, x1, y1, x2, y2 from det"))
def legacy_wh_view_all(spark, sf_dir):
    return D.from_legacy(D.to_legacy(X.detections(spark, sf_dir)), "w")


@query(_det("select video, frame // 30 as gop, frame // 30 * 30 as first, max(frame) as last from det where label = 'A' group by video, frame // 30"))
def gop_read_ranges_all(spark, sf_dir):
    return _as_int(catalog.read_ranges(D.pick(X.detections(spark, sf_dir), None, "A"), X.GOP), "gop", "first", "last")


@query(_det("select distinct video, frame // 30 as gop, frame // 30 * 30 as first, frame // 30 * 30 + 29 as last from det where label = 'R'"))
def gop_read_whole_all(spark, sf_dir):
    return _as_int(catalog.read_ranges(D.pick(X.detections(spark, sf_dir), None, "R"), X.GOP, whole=True), "gop", "first", "last")


# Each line shows one, two or three frames of every three, which leaves gaps without leaving out rows
@query(
    """with f as (select distinct 'o' || cast(l_orderkey as varchar) as video, cast(3 * l_linenumber + k as integer) as frame from lineitem, range(3) as r(k) where k < case l_returnflag when 'R' then 3 when 'A' then 2 else 1 end),
      i as (select *, frame - row_number() over (partition by video order by frame) as island from f)
    select video, min(frame) as first, max(frame) as last from i group by video, island"""
)
def contiguous_runs_all(spark, sf_dir):
    shown = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    frames = F.explode(F.sequence(3 * F.col("l_linenumber"), 3 * F.col("l_linenumber") + shown - 1).cast("array<int>"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return catalog.runs(rows.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("video"), frames.alias("frame")))


@query(
    _hits("b.label = 'R'")
    + _SPAN
    + " select video, first_frame, version, cast(tile_no as integer) as tile_no, cast(f as integer) as frame, tw as width, th as height from dec, unnest(range(first, last + 1)) as u(f)"
)
def select_tiles_with_prefix_all(spark, sf_dir):
    return selecting.whole_tiles(_boxes(spark, sf_dir, None, "R"), X.layouts(spark), X.GOP, include_prefix=True)


@query(
    """with p as (select l_orderkey as k, l_linenumber as n, cast(16 + l_partkey % 220 as double) - 16 as y, cast(l_suppkey % 256 as double) - 128 as u, cast(l_orderkey % 256 as double) - 128 as v from lineitem),
      m as (select 255.0 / 219 as s, 0.2126::double as wr, 0.0722::double as wb)
    select k, n, cast(floor(least(greatest(s * y + s * 2 * (1 - wr) * v, 0), 255)) as integer) as r,
      cast(floor(least(greatest(s * y - s * 2 * wb * (1 - wb) / (1 - wb - wr) * u - s * 2 * wr * (1 - wr) / (1 - wb - wr) * v, 0), 255)) as integer) as g,
      cast(floor(least(greatest(s * y + s * 2 * (1 - wb) * u, 0), 255)) as integer) as b from p, m"""
)
def nv12_to_rgba_all(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y, u, v = (16 + F.col("l_partkey") % 220).cast("double"), (F.col("l_suppkey") % 256).cast("double"), (F.col("l_orderkey") % 256).cast("double")
    r, g, b = P.rgb(y, u, v)
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"with {X.ALL_LAYOUTS_SQL} select video, first_frame, version, cast(tile_no as integer) as tile_no, tw as width, th as height, 3.206e-06 * tw * th * 30 + 2.592 as seconds from grid")
def encode_cost_all(spark, sf_dir):
    tiles = layouts.exploded(X.all_layouts(spark, sf_dir))
    return tiles.select("video", "first_frame", "version", "tile_no", "width", "height", regret.encode_cost(F.col("width"), F.col("height"), X.GOP).alias("seconds"))


@query(f'with {X.ALL_LAYOUTS_SQL} select video, first_frame, version, tile_no, "row", col, tx as x, ty as y, tw as width, th as height from grid')
def tile_rects_all(spark, sf_dir):
    return layouts.exploded(X.all_layouts(spark, sf_dir)).drop("last_frame")


@query(
    f"""with {X.ALL_LAYOUTS_SQL} select video, first_frame, version, cast(list_sum(widths) as integer) as total_width, cast(list_sum(heights) as integer) as total_height,
      cast(ceil(list_sum(widths) / 32.0) * 32 as integer) as coded_width, cast(ceil(list_sum(heights) / 32.0) * 32 as integer) as coded_height,
      list_max(widths) as largest_width, list_max(heights) as largest_height, cast(len(widths) * len(heights) as integer) as n_tiles from lay"""
)
def layout_totals_all(spark, sf_dir):
    return layouts.totals(X.all_layouts(spark, sf_dir)).drop("last_frame")


@query(
    f"""with {X.ALL_LAYOUTS_SQL} select video, min(first_frame) as first_frame, max(last_frame) as last_frame, count(*) as n_ranges, max(version) as version,
      max(list_max(widths)) as largest_width, max(list_max(heights)) as largest_height from lay group by video"""
)
def catalog_extent_all(spark, sf_dir):
    return catalog.extent(X.all_layouts(spark, sf_dir))


@query(f"with {X.ALL_LAYOUTS_SQL} select video, max(version) + 1 as version from lay group by video")
def next_tile_version_all(spark, sf_dir):
    return catalog.next_version(X.all_layouts(spark, sf_dir))


@query(
    f"""with {X.ALL_LAYOUTS_SQL}, f as (select distinct video, first_frame + version as frame from lay), s as (
      select f.video, f.frame, l.first_frame, l.version, row_number() over (partition by f.video, f.frame order by l.version desc, l.first_frame desc) as n
      from f join lay l on l.video = f.video and f.frame between l.first_frame and l.last_frame)
    select video, frame, first_frame, version from s where n = 1"""
)
def layout_stab_latest_version_all(spark, sf_dir):
    known = X.all_layouts(spark, sf_dir).drop("layout").repartition("video")  # frames come from ranges: both are dealt at once
    frames = known.select("video", (F.col("first_frame") + F.col("version")).alias("frame"))
    return catalog.newest(frames, known, X.GOP, ("first_frame", "version"))


@query(
    f"""with {X.LONG_RANGES_SQL}, f as (
      select distinct video, cast(first_frame + (last_frame - first_frame) // 4 * k as integer) as frame from far, range(5) as r(k)
    ), s as (
      select f.video, f.frame, l.first_frame, l.last_frame, l.version, row_number() over (partition by f.video, f.frame order by l.version desc, l.first_frame desc, l.last_frame desc) as n
      from f join far l on l.video = f.video and f.frame between l.first_frame and l.last_frame)
    select video, frame, first_frame, last_frame, version from s where n = 1"""
)
def layout_stab_long_ranges(spark, sf_dir):
    known = X.long_ranges(spark, sf_dir).repartition("video")  # frames come from ranges: both are dealt at once
    steps = F.explode(F.sequence(F.lit(0), F.lit(4)))
    frames = known.withColumn("k", steps).select("video", F.expr("cast(first_frame + (last_frame - first_frame) div 4 * k as int)").alias("frame"))
    return catalog.newest(frames, known, X.GOP, ("first_frame", "last_frame", "version"))


@query(
    f"""with {X.ALL_LAYOUTS_SQL}, p as (select x, y from (values (0, 0), (959, 544), (960, 543), (1919, 1079), (1920, 0)) as v(x, y))
    select g.video, g.first_frame, g.version, p.x, p.y, cast(g.tile_no as integer) as tile_no from grid g, p where p.x >= tx and p.x < tx + tw and p.y >= ty and p.y < ty + th"""
)
def tile_for_point_all(spark, sf_dir):
    points = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0, 0), (959, 544), (960, 543), (1919, 1079), (1920, 0)])))
    known = X.all_layouts(spark, sf_dir).withColumn("layout", G.with_edges(F.col("layout")))
    asked = known.withColumn("p", points).select("video", "first_frame", "version", "layout", "p.*")
    return asked.withColumn("tile_no", G.tile_at(F.col("layout"), F.col("x"), F.col("y"))["tile_no"]).where("tile_no is not null").drop("layout")


@query(f"with {X.ALL_LAYOUTS_SQL} select video, first_frame, version, cast(tile_no as integer) as tile_no, cast(floor(8000000 * (cast(tw as bigint) * th) / (1920 * 1080)) as bigint) as bits_per_second from grid")
def tile_bitrate_share_all(spark, sf_dir):
    tiles = layouts.exploded(X.all_layouts(spark, sf_dir))
    share = F.floor(F.lit(8_000_000) * (F.col("width").cast("bigint") * F.col("height")) / F.lit(X.WIDTH * X.HEIGHT))
    return tiles.select("video", "first_frame", "version", "tile_no", share.cast("bigint").alias("bits_per_second"))


# A layout of many tiles

_FINE = ([96] * 20, [54] * 20)


@query(
    f"""with {X.DETECTIONS_SQL}, fine as (select {X._ints(_FINE[0])} as widths, {X._ints(_FINE[1])} as heights), {X._grid_sql("fgrid", "fine", "0 as one")}
    select b.video, cast(b.frame // 30 as integer) as gop, cast(g.tile_no as integer) as tile_no, max(b.frame) as last, max(g.tw) as width, max(g.th) as height
    from box b join fgrid g on {X.MEET} group by all"""
)
def tiles_touched_in_fine_grid(spark, sf_dir):
    boxes = _boxes(spark, sf_dir, None, ["A", "N", "R"])
    return cost.touched(boxes, X.gop_layouts(spark, *_FINE), X.GOP)


# Grids of every row, videos of every supplier


@query(
    """with n as (
      select l_orderkey as k, l_linenumber as n, 1 + l_linenumber as n_rows, 1 + l_suppkey % 7 as n_cols, 64 + 2 * (l_partkey % 900) as width, 48 + 2 * (l_suppkey % 500) as height from lineitem
    ), axis as (
      select k, n, 'width' as axis, n_cols as parts, width as shown from n union all select k, n, 'height', n_rows, height from n)
    select k, n, axis, cast(i as integer) as i,
      cast(least((i + 1) * (cast(ceil(shown / 32.0) as bigint) * 32) // parts, shown) - least(i * (cast(ceil(shown / 32.0) as bigint) * 32) // parts, shown) as integer) as size
    from axis, unnest(range(parts)) as r(i)"""
)
def uniform_layout_dims_all(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    width, height = (64 + 2 * (F.col("l_partkey") % 900)).cast("int"), (48 + 2 * (F.col("l_suppkey") % 500)).cast("int")
    made = rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), layouts.uniform((1 + F.col("l_linenumber")).cast("int"), (1 + F.col("l_suppkey") % 7).cast("int"), width, height).alias("layout"))
    axes = F.explode(F.array(F.struct(F.lit("width").alias("axis"), F.col("layout.widths").alias("s")), F.struct(F.lit("height").alias("axis"), F.col("layout.heights").alias("s"))))
    return made.select("k", "n", axes.alias("a")).select("k", "n", "a.axis", F.posexplode("a.s").alias("i", "size"))


@query(f"""with {X.SUPPLIER_DETECTIONS_SQL}, {X.SUPPLIER_LAYOUTS_SQL}, {X.STAB_SQL}
    select distinct g.video, g.first_frame, g.version, cast(g.tile_no as integer) as tile_no, b.frame from box b join stab s using (video, frame)
    join grid g on g.video = s.video and g.first_frame = s.first_frame and g.version = s.version and {X.MEET}""")
def tile_frames_by_supplier(spark, sf_dir):
    boxes = D.boxes(D.pick(X.supplier_detections(spark, sf_dir), None, ["A", "N", "R"]))
    return selecting.tile_frames(boxes, X.supplier_layouts(spark, sf_dir), X.GOP)


@query(
    X.SUPPLIER_DETECTIONS_SQL.replace("det as", "with det as", 1)
    + """, r as (select video, cast(frame // 30 as integer) as gop, cast(frame // 30 * 30 as integer) as first, max(frame) as last from det group by video, frame // 30)
    select r.video, r.gop, r.first, r.last, p.gop is null as discontinuity, r.gop = max(r.gop) over (partition by r.video) as end_of_stream
    from r left join r p on p.video = r.video and p.gop = r.gop - 1 and p.last + 1 = r.first"""
)
def gop_read_flags_by_supplier(spark, sf_dir):
    return _as_int(catalog.read_flags(catalog.read_ranges(X.supplier_detections(spark, sf_dir), X.GOP)), "gop", "first", "last")


@query(f"""with {X.SUPPLIER_DETECTIONS_SQL.replace("select concat(", "select l_orderkey * 8 + l_linenumber as box_id, concat(", 1).replace("select video, label, frame, x1 - x1", "select box_id, video, label, frame, x1 - x1", 1)}, {X.SUPPLIER_LAYOUTS_SQL}, {X.STAB_SQL}
    select g.video, g.first_frame, g.version, cast(g.tile_no as integer) as tile_no, b.frame, b.box_id from box b join stab s using (video, frame)
    join grid g on g.video = s.video and g.first_frame = s.first_frame and g.version = s.version and {X.MEET}""")
def tile_box_ids_by_supplier(spark, sf_dir):
    rows = X.supplier_detections(spark, sf_dir, (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box_id"))
    return selecting.tile_boxes(D.boxes(rows), X.supplier_layouts(spark, sf_dir), X.GOP, "box_id")


@query(f"""with {X.CROWDED_DETECTIONS_SQL.replace("select if(", "select l_orderkey * 8 + l_linenumber as box_id, if(", 1).replace("select video, label, frame, x1 - x1", "select box_id, video, label, frame, x1 - x1", 1)}, {X.SUPPLIER_LAYOUTS_SQL}, {X.STAB_SQL}
    select g.video, g.first_frame, g.version, cast(g.tile_no as integer) as tile_no, b.frame, b.box_id from box b join stab s using (video, frame)
    join grid g on g.video = s.video and g.first_frame = s.first_frame and g.version = s.version and {X.MEET}""")
def tile_box_ids_of_a_crowded_frame(spark, sf_dir):
    rows = X.crowded_detections(spark, sf_dir, (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box_id"))
    return selecting.tile_boxes(D.boxes(rows), X.supplier_layouts(spark, sf_dir), X.GOP, "box_id", split=True)


@query(f"""with {X.CROWDED_DETECTIONS_SQL}, log as (
      select row_number() over (order by v, l) as query_id, 's' || cast(v as varchar) as video, l as label, null as first, null as last from (select s_suppkey as v from supplier), (values ('A'), ('N'), ('R')) as ls(l)
    ), grid as (
      select 's' || cast(s_suppkey as varchar) as video, r * 2 + c as tile_no, c * 960 as tx, r * 544 as ty, 960 as tw, if(r = 0, 544, 536) as th from supplier, range(2) as rs(r), range(2) as cs(c)
    ), hit as (
      select b.video, b.frame // 30 as gop, b.label, g.tile_no, tw, th, max(b.frame) as last from box b join log q on b.video = q.video and b.label = q.label join grid g on g.video = b.video and {X.MEET} group by all)
    select video, label, cast(gop as integer) as gop, cast(sum(cast(tw as bigint) * th * (last - gop * 30 + 1)) as bigint) as pixels, cast(sum(last - gop * 30 + 1) as bigint) as tiles from hit group by video, label, gop""")
def cost_of_crowded_groups(spark, sf_dir):
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("video"))
    none = F.lit(None).cast("int")
    asked = suppliers.withColumn("label", F.explode(F.array(*map(F.lit, "ANR")))).select(F.concat_ws("/", "video", "label").alias("query_id"), "video", "label", none.alias("first"), none.alias("last"))
    grid = F.struct(F.array(*map(F.lit, _UNI[0])).alias("widths"), F.array(*map(F.lit, _UNI[1])).alias("heights"))
    grids = suppliers.select("video", F.explode(F.sequence(F.lit(0), F.lit(X.FRAMES // X.GOP - 1))).alias("gop"), grid.alias("layout"))
    found = cost.of_queries(X.crowded_detections(spark, sf_dir), asked, grids, X.GOP, split=True)
    return found.select("video", F.split_part("query_id", F.lit("/"), F.lit(2)).alias("label"), "gop", "pixels", "tiles")


# Two planes of 12 x 12 for each supplier, of sums over its lines
@query(
    """with c as (
      select l_suppkey as k, cast(l_partkey % 12 as integer) as x, cast(l_orderkey % 12 as integer) as y, cast(sum(l_quantity) as bigint) % 256 as a, cast(sum(l_quantity + l_linenumber) as bigint) % 256 as b from lineitem group by all
    ), p as (
      select s.k, s.x, s.y, cast(coalesce(a, 0) as double) as a, cast(coalesce(b, 0) as double) as b
      from (select k, x, y from (select distinct l_suppkey as k from lineitem), range(12) as xs(x), range(12) as ys(y)) s left join c on c.k = s.k and c.x = s.x and c.y = s.y
    ), w as (
      select k, u, v, avg(a) as ma, avg(b) as mb, avg(a * a) - avg(a) * avg(a) as va, avg(b * b) - avg(b) * avg(b) as vb, avg(a * b) - avg(a) * avg(b) as ab
      from p, range(5) as us(u), range(5) as vs(v) where x between u and u + 7 and y between v and v + 7 group by k, u, v)
    select k as supplier, round(avg((2 * ma * mb + 6.5025) * (2 * ab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))), 6) as similarity from w group by k"""
)
def plane_similarity_by_supplier(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = rows.groupBy(F.col("l_suppkey").alias("supplier"), (F.col("l_orderkey") % 12 * 12 + F.col("l_partkey") % 12).cast("int").alias("at")).agg(
        (F.sum("l_quantity").cast("bigint") % 256).alias("a"), (F.sum(F.col("l_quantity") + F.col("l_linenumber")).cast("bigint") % 256).alias("b")
    )
    known = cells.groupBy("supplier").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("a", "b")))).alias("cells"))  # 144 of them at most

    def plane(name: str):
        return F.transform(F.sequence(F.lit(0), F.lit(143)), lambda i: F.coalesce(F.try_element_at("cells", i)[name], F.lit(0)).cast("int"))

    return known.select("supplier", F.round(P.plane_ssim(plane("a"), plane("b"), F.lit(12)), 6).alias("similarity"))
