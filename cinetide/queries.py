"""The media operators as queries on the driver's tables, each with its SQL for DuckDB.

The tables hold no video: each query runs an operator on rows of the same shape
(a user's events as frames, parts as clips, suppliers as backends).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinetide.functions import pixels
from cinetide.functions import scalars as S
from cinetide.operators import control, folds, frames, tiles
from cinetide.plans import planner
from cinetide.session import removed, shared_folder, shuffles_dropped
from cinetide.sources import mp4, video
from cinetide.streaming import events, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- frames ----


@query("""
with d as (select label, vec_id, embedding as a, lag(embedding) over (partition by label order by vec_id) as b from embeddings)
select cast(label as bigint) as label, vec_id,
  round(coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(cast(a[i] as double) - cast(b[i] as double)))) / len(a), 255.0), 6) as diff from d""")
def mean_abs_diff(spark, sf):
    rows = frames.with_diff(read(spark, sf, "embeddings"), ["label"], "vec_id", "embedding")
    return rows.select(F.col("label").cast("long"), "vec_id", F.round("diff", 6).alias("diff"))


def _event_frames(spark, sf, duplicate=2.0, cut=40.0):
    """A user's events as frames: the difference is that of their values."""
    rows = read(spark, sf, "events").select("user_id", "event_id", "value")
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = rows.withColumn("diff", F.coalesce(F.round(F.abs(F.col("value") - before), 4), F.lit(frames.FIRST)))
    rows = frames.with_flags(rows, "diff", duplicate, cut)
    return frames.with_segments(frames.with_runs(rows, ["user_id"], "event_id"), ["user_id"], "event_id")


_EVENT_FRAMES = """
with a as (select user_id, event_id, value, coalesce(round(abs(value - lag(value) over w), 4), 255.0) as diff from events window w as (partition by user_id order by event_id)),
f as (select *, diff <> 255.0 and diff < 2.0 as is_dup, diff = 255.0 or diff > 40.0 as is_cut from a),
r as (select *, last_value(case when not is_dup then event_id end ignore nulls) over w as root, sum(case when is_dup then 0 else 1 end) over w as run,
  sum(case when is_cut then 1 else 0 end) over w as segment from f window w as (partition by user_id order by event_id rows unbounded preceding))
"""


@query(_EVENT_FRAMES + "select user_id, event_id, is_dup, root, cast(run as bigint) as run from r")
def dup_runs(spark, sf):
    return _event_frames(spark, sf).select("user_id", "event_id", "is_dup", "root", "run")


@query(_EVENT_FRAMES + "select user_id, segment, cast(count(*) as bigint) as frames, min(event_id) as first from (select user_id, cast(segment as bigint) as segment, event_id from r) group by 1, 2")
def scene_segments(spark, sf):
    rows = _event_frames(spark, sf).withColumn("segment", F.col("segment").cast("long"))
    return rows.groupBy("user_id", "segment").agg(F.count("*").alias("frames"), F.min("event_id").alias("first"))


@query(_EVENT_FRAMES + "select r.user_id, r.event_id, r.is_dup, r.root, o.value as result from r join events o on r.root = o.event_id")
def shared_results(spark, sf):
    rows = _event_frames(spark, sf)
    results = rows.where(~F.col("is_dup")).select("user_id", "event_id", F.col("value").alias("result"))
    out = frames.shared_back(results, rows.select("user_id", "event_id", "is_dup", "root"), ["user_id"], "event_id")
    return out.select("user_id", "event_id", "is_dup", "root", "result")


@query(
    _EVENT_FRAMES.replace("with a", "with recursive a")
    + """, n as (select user_id, event_id, segment, cast(floor(value * 10) as bigint) as v, row_number() over (partition by user_id, segment order by event_id) as i from r),
t as (select user_id, segment, event_id, i, v, v as filtered from n where i = 1
  union all select n.user_id, n.segment, n.event_id, n.i, n.v,
    case when abs(n.v - t.v) >= 24 then n.v else (n.v * (256 - (128 * (24 - abs(n.v - t.v))) // 24) + t.filtered * ((128 * (24 - abs(n.v - t.v))) // 24)) >> 8 end
  from t join n on n.user_id = t.user_id and n.segment = t.segment and n.i = t.i + 1)
select user_id, event_id, v as value, filtered from t"""
)
def temporal_filter(spark, sf):
    rows = _event_frames(spark, sf).select("user_id", "segment", "event_id", F.floor(F.col("value") * 10).cast("long").alias("value"))
    out = folds.folded(rows, ["user_id", "segment"], ["event_id"], ["value"], folds.iir(), "filtered", "bigint")
    return out.select("user_id", "event_id", "value", "filtered")


@query("""
select user_id, round(list_reduce(list(value order by event_id), lambda a, x: a * 0.7 + x * 0.3, 3000.0), 6) as latency, cast(count(*) as bigint) as n
from events where event_type <> 'error' group by user_id""")
def ema_latency(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", "value", (F.col("event_type") != "error").alias("ok"))
    out = folds.folded(rows, ["user_id"], ["event_id"], ["value", "ok"], folds.ema(), "latency", "double")
    return out.groupBy("user_id").agg(F.round(F.max_by("latency", "event_id"), 6).alias("latency"), F.count_if("ok").alias("n")).where("n > 0")


@query("""
with g as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id rows unbounded preceding) as good from events)
select user_id, event_id, cast(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, good order by event_id rows unbounded preceding) as bigint) as failures from g""")
def failure_runs(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", "event_type")
    return control.failure_runs(rows, ["user_id"], ["event_id"], F.col("event_type") == "error").select("user_id", "event_id", "failures")


@query("""
select l_orderkey, l_linenumber from (
  select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as n
  from (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag <> 'R')) where n = l_linenumber""")
def reorder_prefix(spark, sf):
    rows = read(spark, sf, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).distinct()
    return frames.reordered_prefix(rows, ["l_orderkey"], "l_linenumber", start=1)


@query("select p_partkey, cast(p_partkey % 3 as bigint) as device from part")
def round_robin(spark, sf):
    return control.round_robin(read(spark, sf, "part"), "p_partkey", 3).select("p_partkey", F.col("device").cast("long").alias("device"))


@query("""
with e as (select user_id, event_id, event_id % 3 = 0 as is_key, cast(epoch_us(ts) as bigint) as us from events),
s as (select user_id, event_id, is_key, us - min(us) over (partition by user_id) as pts from e),
d as (select user_id, max(pts) // 1000 as duration_ms from s group by 1),
p as (select user_id, share, cast(floor(duration_ms * 1000 * share) as bigint) as t from d, (values (0.15::double), (0.5::double), (0.85::double)) v(share)),
c as (select p.user_id, share, pts, event_id, row_number() over (partition by p.user_id, share order by abs(pts - t), pts, event_id) as n from p join s on s.user_id = p.user_id and is_key)
select user_id, share, event_id, pts as pts_us from c where n = 1""")
def sample_points(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 3 == 0).alias("is_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = rows.groupBy("user_id").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    clips = first.select(F.col("user_id").alias("video_id"), F.floor((F.col("last") - F.col("first")) / 1000).alias("duration_ms"))
    shown = rows.join(first, "user_id").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_idx"), (F.col("us") - F.col("first")).alias("pts_us"), "is_key")
    return frames.sample_points(shown, clips).select(F.col("video_id").alias("user_id"), "share", F.col("frame_idx").alias("event_id"), "pts_us")


# ---- colour and content ----

_RGB = "cast(p_partkey % 256 as int) as r, cast((p_partkey * 7) % 256 as int) as g, cast((p_size * 5) % 256 as int) as b"


def _rgb(spark, sf):
    return read(spark, sf, "part").selectExpr("p_partkey", "p_brand", "p_size", *(x.strip() for x in _RGB.split(", ")))


@query(f"""
select p_partkey, cast((2 * r + 5 * g + b) >> 3 as bigint) as fast, round((299 * r + 587 * g + 114 * b) / 1000.0, 6)::double as exact,
  cast((77 * r + 150 * g + 29 * b) >> 8 as bigint) as fixed, round(r * 0.299::double + g * 0.587::double + b * 0.114::double, 6) as unit,
  round(case when greatest(r, g, b) = 0 then 0.0 else (greatest(r, g, b) - least(r, g, b))::double / greatest(r, g, b) end, 6)::double as saturation,
  cast(((r >> 5) << 6) | ((g >> 5) << 3) | (b >> 5) as bigint) as bin from (select p_partkey, {_RGB} from part)""")
def luma_variants(spark, sf):
    c = ("r", "g", "b")
    return _rgb(spark, sf).select(
        "p_partkey", S.luma_fast(*c).cast("long").alias("fast"), F.round(S.luma_exact(*c), 6).alias("exact"), S.luma_256(*c).cast("long").alias("fixed"),
        F.round(S.luma_unit(*c), 6).alias("unit"), F.round(S.saturation(*c), 6).alias("saturation"), S.colour_bin(*c).cast("long").alias("bin"),
    )


@query("select a, (a & 4278255360) | ((a & 255) << 16) | ((a >> 16) & 255) as swapped from (select distinct (l_partkey * 65537 + l_suppkey) % 4294967296 as a from lineitem)")
def swizzled(spark, sf):
    rows = read(spark, sf, "lineitem").select(((F.col("l_partkey") * 65537 + F.col("l_suppkey")) % 4294967296).alias("a")).distinct()
    return rows.select("a", S.swizzle("a").alias("swapped"))


_HIST = f"select p_brand, cast(((r >> 5) << 6) | ((g >> 5) << 3) | (b >> 5) as bigint) as bin, count(*) as n from (select p_brand, {_RGB} from part) group by 1, 2"


@query(_HIST)
def colour_hist(spark, sf):
    return _rgb(spark, sf).groupBy("p_brand", S.colour_bin("r", "g", "b").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""
with h as ({_HIST}), c as (select p_brand, sum(n) over (partition by p_brand order by n desc, bin rows unbounded preceding) as cover,
  row_number() over (partition by p_brand order by n desc, bin) as rank, sum(n) over (partition by p_brand) as total from h)
select p_brand, min(rank) as bins, round(min(rank) / 512.0::double, 6) as diversity from c where cover * 100 >= total * 99 group by 1""")
def hist_diversity(spark, sf):
    by = Window.partitionBy("p_brand").orderBy(F.desc("n"), "bin")
    rows = colour_hist(spark, sf).withColumns(
        {
            "cover": F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(by),
            "total": F.sum("n").over(Window.partitionBy("p_brand")),
        }
    )
    out = rows.where(F.col("cover") * 100 >= F.col("total") * 99).groupBy("p_brand").agg(F.min("rank").cast("long").alias("bins"))
    return out.withColumn("diversity", F.round(F.col("bins") / F.lit(512.0), 6))


@query("""
select l_returnflag, round(coalesce(avg(case when x % 8 = 0 then e end) / (avg(case when x % 8 <> 0 then e end) + 0.5), 1.0), 6) as ratio,
  count(*) filter (e > 6) as some, count(*) filter (e > 40) as strong from (select l_returnflag, l_orderkey % 64 as x, l_quantity as e from lineitem) group by 1""")
def block_boundary(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_returnflag", (F.col("l_orderkey") % 64).alias("x"), F.col("l_quantity").alias("e"))
    on, off = F.avg(F.when(F.col("x") % 8 == 0, F.col("e"))), F.avg(F.when(F.col("x") % 8 != 0, F.col("e")))
    return rows.groupBy("l_returnflag").agg(
        F.round(F.coalesce(on / (off + 0.5), F.lit(1.0)), 6).alias("ratio"), F.count_if(F.col("e") > 6).alias("some"), F.count_if(F.col("e") > 40).alias("strong")
    )


_SCORES = """(p_partkey % 10) / 10.0{d} + 0.10013{d} as anime, (p_size % 7) / 7.0{d} + 0.0337{d} as blockiness, (p_size % 5) / 5.0{d} + 0.00131{d} as darkness, (p_partkey % 3) / 10.0{d} + 0.00017{d} as saturation"""


@query(f"""
with s as (select p_type, p_size % 10 as part_no, {_SCORES.format(d="::double")} from part),
m as (select p_type, part_no, avg(anime) as a, avg(blockiness) as b, avg(darkness) as d, avg(saturation) as s from s group by 1, 2)
select p_type, cast(part_no as bigint) as part_no, case when a > 0.6 then 'ANIME' when b > 0.55 then 'GENERAL_DENOISE' else 'NATURAL' end as recommended, d > 0.55 or s < 0.18 as color_fix from m""")
def content_class(spark, sf):
    """F10; scores are moved a little, so that no mean lies on a limit."""
    rows = read(spark, sf, "part").selectExpr("p_type", "cast(p_size % 10 as bigint) as part_no", *_SCORES.format(d="D").split(", "))
    return frames.classified(rows, rows, ("p_type", "part_no")).select("p_type", "part_no", "recommended", "color_fix")


# ---- geometry and plans ----


@query("""
with g as (select p_partkey, p_size * 20 as w, p_size * 12 as h from part),
x as (select *, unnest(range(0, w, 112)) as x0 from g), t as (select *, unnest(range(0, h, 112)) as y0 from x)
select p_partkey, cast(x0 as bigint) as x0, cast(y0 as bigint) as y0, cast(least(x0 + 112, w) as bigint) as x1, cast(least(y0 + 112, h) as bigint) as y1,
  cast(least(greatest(x0 - 8, 0), greatest(w - 128, 0)) as bigint) as origin_x, cast(least(greatest(y0 - 8, 0), greatest(h - 128, 0)) as bigint) as origin_y from t""")
def tile_grid(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 20).alias("width"), (F.col("p_size") * 12).alias("height"))
    cols = ("x0", "y0", "x1", "y1", "origin_x", "origin_y")
    return tiles.tile_grid(rows).select("p_partkey", *(F.col(c).cast("long").alias(c) for c in cols))


_CLIP = """select p_partkey, p_size * 32 as width, p_size * 18 as height, (p_partkey % 4) * 90 as rotation, 24.0::double + p_partkey % 37 as fps, p_partkey % 900000 + 1000 as duration_ms,
  (['ULTRA', 'HIGH', 'BALANCED', 'FAST'])[p_partkey % 4 + 1] as preset, (['AUTO', 'P480', 'P720', 'P1080', 'P1440', 'P2160'])[p_partkey % 6 + 1] as target,
  (['NATURAL', 'GENERAL', 'GENERAL_DENOISE', 'ANIME', 'ULTRA_PLUS'])[p_partkey % 5 + 1] as model, (['DEVICE', 'HYBRID', 'CLOUD'])[p_partkey % 3 + 1] as compute,
  p_partkey % 2 = 0 as gpu, p_partkey % 7 < 3 as cloud_up, p_partkey % 5 < 2 as high_end, p_partkey % 11 < 4 as heavy_ready from part"""


def _clips(spark, sf):
    pick = lambda n, *names: F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % n).cast("int"))
    key = F.col("p_partkey")
    return read(spark, sf, "part").select(
        key, (F.col("p_size") * 32).alias("width"), (F.col("p_size") * 18).alias("height"), (key % 4 * 90).alias("rotation"), (F.lit(24.0) + key % 37).alias("fps"),
        (key % 900000 + 1000).alias("duration_ms"), pick(4, *S.PRESETS).alias("preset"), pick(6, *S.TARGETS).alias("target"), pick(5, *S.MODELS).alias("model"),
        pick(3, *S.COMPUTES).alias("compute"), (key % 2 == 0).alias("gpu"), (key % 7 < 3).alias("cloud_up"), (key % 5 < 2).alias("high_end"), (key % 11 < 4).alias("heavy_ready"),
    )


_HEIGHT = "case target when 'P480' then 480 when 'P720' then 720 when 'P1080' then 1080 when 'P1440' then 1440 when 'P2160' then 2160 else 0 end"
_PASSES = "case when preset = 'ULTRA' and width * 16 <= 4096 and height * 16 <= 4096 then 2 else 1 end"


@query(f"""
with c as ({_CLIP}), t as (select *, {_HEIGHT} as tall, {_PASSES} as passes, rotation in (90, 270) as turned from c),
d as (select *, case when turned then height else width end as sw, case when turned then width else height end as sh, case when preset <> 'FAST' and passes = 2 then 16 else 4 end as scale from t),
s as (select *, case when sw >= sh then cast(floor(tall * (sw::double / sh) + 0.5) as int) else tall end as w, case when sw >= sh then tall else cast(floor(tall / (sw::double / sh) + 0.5) as int) end as h from d),
o as (select *, case when tall = 0 then width * scale when turned then h else w end // 2 * 2 as ow, case when tall = 0 then height * scale when turned then w else h end // 2 * 2 as oh from s)
select p_partkey, cast(passes as bigint) as passes,
  cast(case when greatest(ow, oh) > 4096 then cast(floor(ow * (4096.0::double / greatest(ow, oh)) + 0.5) as int) // 2 * 2 else ow end as bigint) as width,
  cast(case when greatest(ow, oh) > 4096 then cast(floor(oh * (4096.0::double / greatest(ow, oh)) + 0.5) as int) // 2 * 2 else oh end as bigint) as height from o""")
def output_geometry(spark, sf):
    size = S.output_size("width", "height", "rotation", "preset", "target")
    return _clips(spark, sf).select(
        "p_partkey", S.passes("preset", "width", "height").cast("long").alias("passes"), size["width"].cast("long").alias("width"), size["height"].cast("long").alias("height")
    )


@query(f"""
select p_partkey, cast(least(greatest(floor(width * 4 * height * 4 * fps * case when width * 4 * height * 4 >= 3840 * 2160 then 0.06::double when width * 4 * height * 4 >= 1920 * 1080 then 0.09::double else 0.12::double end), 2000000), 60000000) as bigint) as bitrate
from ({_CLIP})""")
def bitrate(spark, sf):
    return _clips(spark, sf).select("p_partkey", S.bitrate(F.col("width") * 4, F.col("height") * 4, "fps").alias("bitrate"))


def _cost_sql(preset: str, model: str, compute: str) -> str:
    tile = f"(case when {model} = 'ULTRA_PLUS' then 80 else 160 end)"
    cost = f"(case {model} when 'ANIME' then 0.25::double when 'ULTRA_PLUS' then 8.0::double else 1.0::double end)"
    per = f"(45.0::double * ({tile} * {tile}) / (128.0::double * 128.0::double) * {cost} * case when gpu then 1.0::double else 4.0::double end * case when high_end then 1.0::double else 1.6::double end)"
    count = lambda k: f"(ceil(width * {k} / ({tile} - 16)::double) * ceil(height * {k} / ({tile} - 16)::double))"
    second = f"case when {preset} = 'ULTRA' and width * 16 <= 4096 and height * 16 <= 4096 then {count(4)} else 0 end"
    frames_ = f"(duration_ms / 1000.0::double * fps * case when {preset} = 'BALANCED' then 0.75::double else 1.0::double end)"
    total = f"({frames_} * ({count(1)} + {second}) * {per} / 1000.0::double)"
    return (
        f"(case when {preset} = 'FAST' then greatest(duration_ms / 1000.0::double * 0.15::double, 2.0::double) when {compute} = 'HYBRID' and cloud_up then {total} * 0.6::double + 8 "
        f"when {compute} = 'CLOUD' and cloud_up then duration_ms / 1000.0::double * case when {model} = 'ULTRA_PLUS' then 3.0::double else 1.2::double end + 40 else {total} * 1.1::double + 5 end)"
    )


def _columns():
    names = ("width", "height", "fps", "duration_ms", "gpu", "high_end", "cloud_up")
    return {n: F.col(n) for n in names} | {"tile": F.lit(160)}


@query(f"select p_partkey, round({_cost_sql('preset', 'model', 'compute')}, 6) as seconds from ({_CLIP})")
def cost_model(spark, sf):
    seconds = planner.estimated_seconds(_columns(), F.col("preset"), F.col("model"), F.col("compute"))
    return _clips(spark, sf).select("p_partkey", F.round(seconds, 6).alias("seconds"))


def _target_sql(reach: str) -> str:
    return f"(case when {reach} <= 480 then 'P480' when {reach} <= 720 then 'P720' when {reach} <= 1080 then 'P1080' when {reach} <= 1440 then 'P1440' else 'P2160' end)"


@query(f"""
with c as (select *, least(width, height) as short, greatest(width, height) as long from ({_CLIP})),
k as (select *, case when cloud_up and duration_ms <= 720000 then 1
  when long * 16 <= 4096 and {_cost_sql("'ULTRA'", "'NATURAL'", "'DEVICE'")} <= 1800 then 2
  when heavy_ready and {_cost_sql("'HIGH'", "'ULTRA_PLUS'", "'DEVICE'")} <= 1800 then 3 else 4 end as k from c)
select p_partkey, case k when 1 then 'CLOUD' else 'DEVICE' end as compute, case k when 2 then 'ULTRA' else 'HIGH' end as preset,
  case when k = 1 and heavy_ready or k = 3 then 'ULTRA_PLUS' else 'NATURAL' end as model, {_target_sql("short * case k when 2 then 16 else 4 end")} as target from k""")
def plan_choice(spark, sf):
    plan = planner.plan(_columns(), F.lit("NATURAL"), F.col("heavy_ready"))
    return _clips(spark, sf).select("p_partkey", plan.alias("plan")).select("p_partkey", "plan.compute", "plan.preset", "plan.model", "plan.target")


@query(f"select p_partkey, {_target_sql('p_size * 60')} as target from part")
def target_pick(spark, sf):
    return read(spark, sf, "part").select("p_partkey", planner.target_for(F.col("p_size") * 60).alias("target"))


@query("""
with j as (select o_orderkey, o_custkey % 5000 - 500 as start_ms, o_orderkey % 9000 - 1000 as end_ms, 8000 as duration_ms, o_orderkey % 60 as fps from orders),
t as (select *, greatest(start_ms, 0) as s, case when end_ms > 0 and end_ms > greatest(start_ms, 0) then end_ms end as e from j)
select o_orderkey, s as start_ms, e as end_ms, cast(greatest(least(coalesce(e, duration_ms), duration_ms) - s, 0) as bigint) as length_ms,
  cast(greatest(floor(duration_ms / 1000.0::double * fps), 1) as bigint) as total_frames, case when end_ms >= duration_ms - 200 then 0 else end_ms end as snapped from t""")
def trim_range(spark, sf):
    rows = read(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 5000 - 500).alias("start_ms"), (F.col("o_orderkey") % 9000 - 1000).alias("end_ms"), F.lit(8000).alias("duration_ms"), (F.col("o_orderkey") % 60).alias("fps")
    )
    t = S.trim("start_ms", "end_ms", "duration_ms")
    return rows.select(
        "o_orderkey", t["start_ms"].alias("start_ms"), t["end_ms"].alias("end_ms"), t["duration_ms"].alias("length_ms"),
        S.total_frames("duration_ms", "fps").alias("total_frames"), S.snapped_end("end_ms", "duration_ms").alias("snapped"),
    )


@query("""
with d as (select s_suppkey, cast(s_suppkey * 97 % 10000 as bigint) as ram, s_suppkey % 12 + 1 as cores from supplier)
select s_suppkey, cast(case when ram >= 8000 then 256 when ram >= 6000 then 192 when ram >= 4000 then 160 else 128 end as bigint) as tile, cast(least(greatest(cores - 1, 2), 6) as bigint) as threads,
  ram >= 6000 and cores >= 8 as high_end from d""")
def device_plan(spark, sf):
    rows = read(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 97 % 10000).alias("ram"), (F.col("s_suppkey") % 12 + 1).alias("cores"))
    plan = S.device_plan("ram", "cores")
    return rows.select("s_suppkey", plan["tile"].cast("long").alias("tile"), plan["threads"].cast("long").alias("threads"), plan["high_end"].alias("high_end"))


@query("""
select l_orderkey, l_linenumber::bigint as l_linenumber, round(l_linenumber / greatest(l_quantity - l_tax, 0.001::double), 6) as fps,
  round((8 - l_linenumber) / (l_linenumber / greatest(l_quantity - l_tax, 0.001::double)), 4) as eta_s, round(least(l_linenumber / 7.0::double, 0.999::double), 6) as progress
from (select distinct l_orderkey, l_linenumber, l_quantity, l_tax from lineitem)""")
def job_progress(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity", "l_tax").distinct()
    p = S.progress("l_linenumber", F.lit(8), "l_quantity", "l_tax")
    share = S.progress("l_linenumber", F.lit(7), "l_quantity", "l_tax")["progress"]
    return rows.select("l_orderkey", "l_linenumber", F.round(p["fps"], 6).alias("fps"), F.round(p["eta_s"], 4).alias("eta_s"), F.round(share, 6).alias("progress"))


@query("""
with d as (select c_custkey, ['2', '4', '8', '3', 'x', ''][c_custkey % 6 + 1] as scale, ['0.25', '1.7', '-1', 'nan', 'abc', '0.5'][c_custkey % 6 + 1] as strength from customer)
select c_custkey, case when scale in ('2', '4', '8') then scale::bigint else 4 end as scale, case strength when '0.25' then 0.25::double when '1.7' then 1.0::double when '-1' then 0.0::double else 0.5::double end as strength,
  case when c_custkey % 3 = 0 then 'webp' when c_custkey % 3 = 1 then 'jpg' else 'png' end as extension,
  case when c_mktsegment = 'MACHINERY' then 'ULTRA' else 'BALANCED' end as preset from (select d.*, c_mktsegment from d join customer using (c_custkey))""")
def request_decoding(spark, sf):
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names)).cast("int"))
    rows = read(spark, sf, "customer").select(
        "c_custkey", pick("2", "4", "8", "3", "x", "").alias("scale"), pick("0.25", "1.7", "-1", "nan", "abc", "0.5").alias("natural"), pick("image/webp", "image/jpeg", "image/png").alias("mime"),
        F.regexp_replace("c_mktsegment", "MACHINERY", "ULTRA").alias("preset"),
    )
    return rows.select("c_custkey", S.known_scale("scale").cast("long").alias("scale"), S.natural("natural").alias("strength"), S.extension("mime").alias("extension"), S.enum("preset", "preset").alias("preset"))


# ---- control plane ----


@query("""
with k as (select doc_id, sha256(coalesce(text, '')) as key from documents), f as (select *, min(doc_id) over (partition by key) as first from k)
select doc_id, key, case when doc_id = first then 'MISS' else 'HIT' end as state from f""")
def cache_lookup(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", control.content_key(F.coalesce("text", F.lit(""))).alias("key"))
    return control.cache_state(rows, "key", "doc_id").select("doc_id", "key", "state")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def cache_misses(spark, sf):
    requests = read(spark, sf, "documents").select("doc_id", "lang")
    return control.hits_and_misses(requests, read(spark, sf, "labels").select("doc_id"), "doc_id")[1]


@query("""
with h as (select r_regionkey, case r_regionkey when 0 then ['general', 'anime'] when 1 then ['heavy', 'denoise'] when 2 then [] when 3 then ['natural', 'general'] else null end as have from region),
w as (select n_nationkey, n_regionkey, ['natural', 'general', 'anime', 'heavy'][n_nationkey % 4 + 1] as want from nation)
select n_nationkey::bigint as n_nationkey, want, case when have is null or len(have) = 0 or list_contains(have, want) then want when list_contains(have, 'general') then 'general' else have[1] end as model
from w join h on n_regionkey = r_regionkey""")
def model_resolve(spark, sf):
    known = {0: ("general", "anime"), 1: ("heavy", "denoise"), 2: (), 3: ("natural", "general")}
    have = F.lit(None).cast("array<string>")
    for key, names in known.items():
        have = F.when(F.col("r_regionkey") == key, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(have)
    regions = read(spark, sf, "region").select("r_regionkey", have.alias("have"))
    want = F.get(F.array(*map(F.lit, ("natural", "general", "anime", "heavy"))), F.col("n_nationkey") % 4)
    rows = read(spark, sf, "nation").select("n_nationkey", "n_regionkey", want.alias("want")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "want", control.resolved_model(F.col("want"), F.col("have")).alias("model"))


def _backends(spark, sf):
    key = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("long").alias("s_nationkey"), key.alias("pos"), F.col("s_name").alias("host"), (key % 4 != 0).alias("up"), F.when(key % 7 != 0, key % 10).alias("queue")
    )


_BACKENDS = "(select s_nationkey::bigint as s_nationkey, s_suppkey as pos, s_name as host, s_suppkey % 4 <> 0 as up, case when s_suppkey % 7 <> 0 then s_suppkey % 10 end as queue from supplier)"


@query(f"select s_nationkey, host, row_number() over (partition by s_nationkey order by coalesce(queue, 0) // 3, pos) as rank from {_BACKENDS} where up")
def backend_rank(spark, sf):
    return control.ranked(_backends(spark, sf), ["s_nationkey"]).select("s_nationkey", "host", F.col("rank").cast("long").alias("rank"))


@query(f"select s_nationkey, bool_or(up) as ok, min_by(host, coalesce(queue, 0) // 3 * 1000000000 + pos) filter (up) as primary from {_BACKENDS} group by 1")
def backend_health(spark, sf):
    return control.health(_backends(spark, sf), ["s_nationkey"])


@query("""
with a as (select l_orderkey, l_linenumber, l_returnflag = 'N' as ok, l_partkey, l_shipdate from lineitem)
select l_orderkey as request_id, min_by(l_partkey, l_linenumber) filter (ok) as result, cast(min(l_linenumber) filter (ok) as bigint) as rank,
  case when not bool_or(ok) then max_by('failed at ' || l_linenumber, l_linenumber) end as error
from (select l_orderkey, l_linenumber, bool_or(ok) as ok, min(l_partkey) as l_partkey from a group by 1, 2) group by 1""")
def failover(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").cast("long").alias("rank"))
    attempts = rows.agg(F.bool_or(F.col("l_returnflag") == "N").alias("ok"), F.min("l_partkey").alias("result")).withColumn("error", F.concat(F.lit("failed at "), F.col("rank")))
    return control.failover(attempts).select("request_id", "result", "rank", "error")


@query("""
with o as (select o_orderpriority, o_orderkey, o_custkey + 1 as mine, max(o_custkey + 1) over (partition by o_orderpriority order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) as best from orders)
select o_orderpriority, o_orderkey, best is null or mine >= best as accepted from o""")
def registration(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey", (F.col("o_custkey") + 1).alias("session_start"))
    return folds.newest_wins(rows, ["o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderpriority", "o_orderkey", "accepted")


@query("select o_orderkey, o_custkey from orders where o_custkey < 500")
def kick_filter(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("session_start"))
    return control.kicked(rows, 500).select("o_orderkey", "o_custkey")


_ACTIONS = "case event_type when 'view' then 'ENQUEUE' when 'click' then 'START' when 'purchase' then 'DONE' when 'error' then 'FAIL' else 'CANCEL' end"


def _queue(spark, sf):
    action = F.expr(_ACTIONS)
    rows = read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("job_id"), action.alias("action"))
    return control.queue_state(rows)


_QUEUE = f"select user_id as job_id, case max_by({_ACTIONS}, event_id) when 'ENQUEUE' then 'WAITING' when 'START' then 'RUNNING' when 'DONE' then 'DONE' when 'FAIL' then 'FAILED' else 'CANCELLED' end as status from events group by 1"


@query(_QUEUE)
def queue_state(spark, sf):
    return _queue(spark, sf)


_EDITS = f"case when event_id % 1501 = 0 then 'CANCEL_ALL' when event_id % 4 = 1 then 'REMOVE' else {_ACTIONS} end"


@query(f"""
with e as (select event_id as seq, user_id as job_id, {_EDITS} as action from events), a as (select max(seq) as all_at from e where action = 'CANCEL_ALL'),
o as (select * from e where action <> 'CANCEL_ALL'),
l as (select job_id, max_by(action, seq) as action, max(seq) as seq from o where action <> 'REMOVE' group by 1),
r as (select o.job_id, min(o.seq) as removed_at from o join l using (job_id) where o.action = 'REMOVE' and o.seq > l.seq group by 1),
s as (select job_id, seq, removed_at, all_at, case action when 'ENQUEUE' then 'WAITING' when 'START' then 'RUNNING' when 'DONE' then 'DONE' when 'FAIL' then 'FAILED' else 'CANCELLED' end as status from l left join r using (job_id), a)
select job_id, case when status in ('WAITING', 'RUNNING') and all_at > seq then 'CANCELLED' else status end as status from s
where not (status = 'WAITING' and removed_at is not null and (all_at is null or all_at <= seq or removed_at < all_at))""")
def queue_edited(spark, sf):
    """L2: a log in which waiting jobs are removed and, now and then, all are cancelled."""
    action = F.expr(_EDITS)
    rows = read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("job_id"), action.alias("action"))
    return control.queue_state(rows.withColumn("job_id", F.when(F.col("action") != "CANCEL_ALL", F.col("job_id"))))


@query(f"select status, count(*) as n from ({_QUEUE}) group by 1")
def queue_counts(spark, sf):
    return control.queue_counts(_queue(spark, sf))


@query("select o_orderkey, o_totalprice from (select * from orders order by o_orderdate desc, o_orderkey limit 30)")
def history_topk(spark, sf):
    return control.newest(read(spark, sf, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query("""
select 'order' as track, o_orderkey as key, cast(epoch_us(o_orderdate) as bigint) as pts_us from orders where o_orderdate <= (select least((select max(o_orderdate) from orders), (select max(l_shipdate) from lineitem)))
union all select 'line', l_orderkey, cast(epoch_us(l_shipdate) as bigint) from lineitem where l_shipdate <= (select least((select max(o_orderdate) from orders), (select max(l_shipdate) from lineitem)))""")
def packet_interleave(spark, sf):
    time = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("pts_us")
    one = read(spark, sf, "orders").select(F.lit(0).alias("video_id"), F.lit("order").alias("track"), F.col("o_orderkey").alias("key"), time("o_orderdate"))
    other = read(spark, sf, "lineitem").select(F.lit(0).alias("video_id"), F.lit("line").alias("track"), F.col("l_orderkey").alias("key"), time("l_shipdate"))
    return control.interleaved(one, other, shortest=True).select("track", "key", "pts_us")


@query("""
select 'order' as track, o_orderkey as key, cast(epoch_us(o_orderdate) as bigint) - 800000000000000 as pts_us from orders
where epoch_us(o_orderdate) between 800000000000000 and 900000000000000""")
def packet_range(spark, sf):
    rows = read(spark, sf, "orders").select(F.lit("order").alias("track"), F.col("o_orderkey").alias("key"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("pts_us"))
    return control.track_range(rows, 800_000_000_000_000, 900_000_000_000_000, "ord")


@query("select c_custkey, c_name from customer where c_nationkey < 10 union all select c_custkey, c_name from customer where c_acctbal > 0 and not c_nationkey < 10")
def append_dedup(spark, sf):
    rows = read(spark, sf, "customer")
    return control.added_sources(rows.where("c_nationkey < 10").select("c_custkey", "c_name"), rows.where("c_acctbal > 0").select("c_custkey", "c_name"), "c_custkey")


@query("""
with c as (select n_nationkey, 'https://a' || n_nationkey || '/|2|5|3, ,https://b|' || case when n_nationkey % 2 = 0 then '0|0' else 'x' end || ',c' as text from nation),
e as (select n_nationkey, unnest(list_filter(list_transform(string_split(text, ','), lambda s: trim(s)), lambda s: s <> '')) as entry, generate_subscripts(list_filter(list_transform(string_split(text, ','), lambda s: trim(s)), lambda s: s <> ''), 1) - 1 as pos from c)
select n_nationkey::bigint as n_nationkey, pos::bigint as pos, regexp_replace(string_split(entry, '|')[1], '/$', '') as host, coalesce(nullif(try_cast(string_split(entry, '|')[2] as bigint), 0), 0) as fn_image,
  coalesce(nullif(try_cast(string_split(entry, '|')[3] as bigint), 0), 3) as fn_video, case when string_split(entry, '|')[4] = '3' then 3 else 2 end::bigint as args from e""")
def backend_parse(spark, sf):
    tail = F.when(F.col("n_nationkey") % 2 == 0, "0|0").otherwise("x")
    rows = read(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("https://a"), "n_nationkey", F.lit("/|2|5|3, ,https://b|"), tail, F.lit(",c")).alias("text"))
    out = control.parsed_backends(rows, "text")
    return out.select("host", *(F.col(c).cast("long").alias(c) for c in ("n_nationkey", "pos", "fn_image", "fn_video", "args")))


@query("""
select event_id, case event_type when 'view' then 'queued' when 'click' then 'processing' when 'purchase' then 'done' else 'error' end as stage, cast(json_extract_string(props, '$.k') as double) / 100 as progress
from events where event_type <> 'signup'""")
def sse_parse(spark, sf):
    stage = F.expr("case event_type when 'view' then 'queued' when 'click' then 'processing' when 'purchase' then 'done' when 'error' then 'error' else 'unknown' end")
    data = F.to_json(F.struct(stage.alias("stage"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("progress")))
    rows = read(spark, sf, "events").select("event_id", F.concat(F.lit("event: message\ndata: "), data).alias("line"))
    return video.parsed_events(rows).select("event_id", "stage", "progress")


@query("""
with n as (select o_orderkey, case when o_orderkey % 10 = 0 then '.mp4' else 'clip.' || o_orderpriority || ' ' || repeat('x', (o_orderkey % 50)::int) || '.mp4' end as name, o_orderdate from orders),
b as (select *, left(regexp_replace(name, '\\.[^.]*$', ''), 40) as base from n)
select o_orderkey, case when trim(base) = '' then 'video' else base end || '_' || least(1280, o_orderkey % 2000) || 'p_AI_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.mp4' as name from b""")
def name_format(spark, sf):
    rows = read(spark, sf, "orders")
    key = F.col("o_orderkey")
    name = F.when(key % 10 == 0, ".mp4").otherwise(F.concat(F.lit("clip."), "o_orderpriority", F.lit(" "), F.repeat(F.lit("x"), (key % 50).cast("int")), F.lit(".mp4")))
    return rows.select("o_orderkey", S.output_name(name, F.lit(1280), key % 2000, "o_orderdate").alias("name"))


@query("""
select event_id, case when s >= 3600 then (s // 3600) || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') else (s // 60)::varchar end || ':' || lpad((s % 60)::varchar, 2, '0') as clock,
  case when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' when s >= 60 then (s // 60) || 'm ' || (s % 60) || 's' else s || 's' end as spoken
from (select event_id, cast(floor(value * 37) as bigint) as s from events)""")
def dur_format(spark, sf):
    rows = read(spark, sf, "events").select("event_id", F.floor(F.col("value") * 37).alias("s"))
    return rows.select("event_id", S.clock("s").alias("clock"), S.spoken("s").alias("spoken"))


@query("""
select c_custkey, case when c_custkey % 3 = 0 then 'NATURAL' else 'ANIME' end as model, 'BALANCED' as preset, case when c_custkey % 3 = 0 then 1.0::double else c_custkey % 10 / 10.0::double end as natural, true as gpu from customer""")
def settings_decode(spark, sf):
    good = F.concat(F.lit('{"model": "ANIME", "preset": "NONE", "natural": '), (F.col("c_custkey") % 10 / F.lit(10.0)).cast("string"), F.lit("}"))
    rows = read(spark, sf, "customer").select("c_custkey", S.settings(F.when(F.col("c_custkey") % 3 == 0, "not json").otherwise(good)).alias("s"))
    return rows.select("c_custkey", "s.model", "s.preset", "s.natural", "s.gpu")


_BENCH = "select l_suppkey as s_suppkey, avg(l_quantity) / max(9) as ms_per_tile from lineitem where l_linenumber in (2, 3) group by 1"


@query(f"select s_suppkey, round(ms_per_tile, 6) as ms from ({_BENCH})")
def tile_benchmark(spark, sf):
    """F16: mean of two timed runs after the warm-up, by tiles."""
    return _bench(spark, sf).select("s_suppkey", F.round("ms_per_tile", 6).alias("ms"))


def _bench(spark, sf):
    runs = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_linenumber") - 1).alias("run"), F.col("l_quantity").alias("ms"), F.lit(9).alias("tiles"))
    return planner.tile_milliseconds(runs, ["s_suppkey"])


@query(f"""
with b as (select s_suppkey, ms_per_tile from ({_BENCH}) where s_suppkey % 2 = 0)
select p_partkey, round(coalesce(ms_per_tile, 45.0::double * (160 * 160) / (128.0::double * 128.0::double) * case when p_partkey % 2 = 0 then 1.0::double else 4.0::double end * 1.6::double), 6) as ms
from part left join b on s_suppkey = p_partkey % 100 + 1""")
def measured_tiles(spark, sf):
    """The benchmark's time where there is one, else the guess."""
    rows = read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 100 + 1).alias("s_suppkey"), (F.col("p_partkey") % 2 == 0).alias("gpu"))
    rows = planner.with_measured(rows, _bench(spark, sf).where("s_suppkey % 2 = 0"), ["s_suppkey"])
    ms = planner.ms_per_tile(F.lit(160), F.lit("NATURAL"), F.col("gpu"), F.lit(False), F.col("measured"))
    return rows.select("p_partkey", F.round(ms, 6).alias("ms"))


# ---- more of the inventory ----


@query("select doc_id, octet_length(encode(text)) as size from documents where octet_length(encode(text)) between 100 and 8000000")
def valid_bodies(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    return control.valid_bodies(rows).select("doc_id", F.octet_length("body").cast("long").alias("size"))


@query("""
with k as (select doc_id, lang, sha256(text) || '-' || lang || '-' || (['0.50', '1.00', '0.25'])[doc_id % 3 + 1] as key from documents)
select key, min(doc_id) as doc_id, count(*) as requests from k group by 1""")
def cache_keys(spark, sf):
    """L13 with the resolved model and natural to two decimals, so that 0.5 and 0.50 are one key."""
    raw = F.get(F.array(F.lit("0.5"), F.lit("1"), F.lit("0.250")), (F.col("doc_id") % 3).cast("int"))
    natural = F.format_string("%.2f", S.natural(raw))
    rows = read(spark, sf, "documents").select("doc_id", control.content_key("text", F.col("lang"), natural).alias("key"))
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("requests"))


@query("""
with c as (select sha256(text) as key, min(doc_id) as doc_id from documents where doc_id % 2 = 0 group by 1), f as (select sha256(text) as key, min(doc_id) as doc_id from documents where doc_id % 2 = 1 group by 1)
select key, doc_id from c union all select key, doc_id from f where key not in (select key from c)""")
def cache_merge(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", control.content_key("text").alias("key"))
    part = lambda n: rows.where(F.col("doc_id") % 2 == n).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return control.merged_cache(part(0), part(1))


@query("""
select a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: cast(cast(a.embedding[i] * 0.5 + b.embedding[i] * 0.5 as float) as double))), 5) as total
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def weight_blend(spark, sf):
    """J11 on vectors as tensors: each with the next one."""
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").alias("values"))
    out = tiles.blended_weights(rows, rows.select((F.col("name") - 1).alias("name"), "values"))
    return out.select(F.col("name").alias("vec_id"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("select cast((max(p_size) - 2) // 2 as bigint) as num_conv from part")
def architecture(spark, sf):
    names = read(spark, sf, "part").select(F.concat(F.lit("body."), "p_size", F.lit(".weight")).alias("name"))
    return tiles.architecture(names).select(F.col("num_conv").cast("long").alias("num_conv"))


@query("""
with s as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, o_orderkey % 90000 as duration_ms from orders)
select o_custkey, o_orderkey, case when pos = 0 then 1000 else 0 end::bigint as start_ms, case when pos = 0 then 4000 else 0 end::bigint as end_ms from s""")
def job_expansion(spark, sf):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = read(spark, sf, "orders").select("o_custkey", "o_orderkey", place.alias("pos"), (F.col("o_orderkey") % 90000).alias("duration_ms"))
    return control.expanded_jobs(rows, (1000, 4000)).select("o_custkey", "o_orderkey", "start_ms", "end_ms")


@query("""
select c_custkey, case when c_custkey % 4 = 0 then 'ULTRA_PLUS' when c_custkey % 2 = 0 then case when c_custkey % 3 = 0 then 'ANIME' else 'GENERAL_DENOISE' end else 'NATURAL' end as model,
  case when c_custkey % 2 = 0 and c_custkey % 5 < 2 and c_custkey % 7 <> 0 then 'AUTO' when c_custkey % 7 = 0 then 'VIVID' else 'OFF' end as color from customer""")
def analysis_applied(spark, sf):
    key = F.col("c_custkey")
    rows = read(spark, sf, "customer").select(key.alias("video_id"), F.when(key % 4 == 0, "ULTRA_PLUS").otherwise("NATURAL").alias("model"), F.when(key % 7 == 0, "VIVID").otherwise("OFF").alias("color"))
    found = read(spark, sf, "customer").where(key % 2 == 0).select(key.alias("video_id"), F.when(key % 3 == 0, "ANIME").otherwise("GENERAL_DENOISE").alias("recommended"), (key % 5 < 2).alias("color_fix"))
    return control.applied_analysis(rows, found).withColumnRenamed("video_id", "c_custkey")


@query("select s_suppkey, case when s_suppkey % 3 = 0 then 'new ' || s_name else s_name end as s_name, case when s_suppkey % 6 = 0 then 0.0 else s_acctbal end::double as s_acctbal from supplier")
def source_upsert(spark, sf):
    rows = read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    updates = rows.where("s_suppkey % 3 = 0").select("s_suppkey", F.concat(F.lit("new "), "s_name").alias("s_name"), F.when(F.col("s_suppkey") % 6 == 0, 0.0).alias("s_acctbal"))
    return control.upserted(rows, updates, "s_suppkey")


@query("""
with r as (select p_partkey, case when p_partkey % 3 = 0 then p_size::double end as t, case when p_partkey % 5 = 0 then p_size * 4.0::double end as c, p_partkey % 900 as n, p_partkey % 4 * 1000 as ms from part),
f as (select *, coalesce(case when t > 1 then t end, case when c > 1 then c end, case when ms > 0 and n * 1000.0::double / nullif(ms, 0) > 1 then n * 1000.0::double / nullif(ms, 0) end, 30.0::double) as raw from r)
select p_partkey, round(case when raw > 120 then 30.0::double else raw end, 6) as fps, cast(case when n > 0 then n else floor(ms / 1000.0::double * case when raw > 120 then 30.0::double else raw end) end as bigint) as frame_count from f""")
def metadata_probe(spark, sf):
    key = F.col("p_partkey")
    rows = read(spark, sf, "part").select(
        key, F.when(key % 3 == 0, F.col("p_size").cast("double")).alias("track_fps"), F.when(key % 5 == 0, F.col("p_size") * F.lit(4.0)).alias("capture_fps"), (key % 900).alias("frames"), (key % 4 * 1000).alias("duration_ms")
    )
    return video.probed(rows).select("p_partkey", F.round("fps", 6).alias("fps"), "frame_count")


@query("""
with m as (select s_suppkey, s_name as host, s_suppkey % 50 as start, s_suppkey * 1000 % 60000 as age from supplier), l as (select s_name as host, s_suppkey % 50 as start from supplier where s_suppkey % 3 <> 0 and s_suppkey % 50 < 40)
select m.s_suppkey, case when (select max(start) from l) > m.start or age >= 42000 then 'EXIT' when m.host not in (select host from l) then 'REGISTER' else 'STAY' end as action from m""")
def session_liveness(spark, sf):
    key = F.col("s_suppkey")
    mine = read(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("host"), (key % 50).alias("session_start"), (key * 1000 % 60000).alias("age_s"))
    live = read(spark, sf, "supplier").where((key % 3 != 0) & (key % 50 < 40)).select(F.col("s_name").alias("host"), (key % 50).alias("session_start"))
    return control.liveness(mine, live).select("s_suppkey", "action")


@query(f"""
select p_partkey, case when model in ('NATURAL', 'GENERAL') and fps / 100 >= 0.35 then 'natural' when model = 'NATURAL' then 'general' when model = 'GENERAL' then 'general' when model = 'GENERAL_DENOISE' then 'denoise'
    when model = 'ANIME' then 'anime' else 'heavy' end as routed,
  cast(case when {_HEIGHT} = 0 then 4 when {_HEIGHT}::double / least(width, height) <= 2.2 then 2 else 4 end as bigint) as scale, case when height <= 360 then 'P1080' when height <= 540 then 'P2160' else 'AUTO' end as auto_target,
  cast(case when model = 'ULTRA_PLUS' then 80 else 160 end as bigint) as tile, round(case when preset = 'FAST' then 0.35::double + 0.6::double * (p_partkey % 10 / 10.0::double) else 0.6::double * (p_partkey % 10 / 10.0::double) end, 6) as sharpen,
  case when {_HEIGHT} = 0 then 'x4' else {_HEIGHT}::varchar || 'p' end || ' - ' || lower(preset) || ' - ' || lower(compute) as label from ({_CLIP})""")
def request_parameters(spark, sf):
    """C15, C24, C26, C30, C31, C36, J7."""
    share = F.col("p_partkey") % 10 / F.lit(10.0)
    return _clips(spark, sf).select(
        "p_partkey", control.routed_model(S.remote_name("model"), F.col("fps") / 100).alias("routed"), S.remote_scale("target", "width", "height").cast("long").alias("scale"),
        S.auto_target("height").alias("auto_target"), S.effective_tile(F.lit(160), "model").cast("long").alias("tile"), F.round(S.sharpen_amount("preset", share), 6).alias("sharpen"),
        S.plan_label("target", "preset", "compute").alias("label"),
    )


@query("""
select s_suppkey, case when s_name like '%1' then 'shared' else 'own' end as gpu, case when s_suppkey % 4 = 0 then 'Supplier' when s_suppkey % 4 = 1 then 'clip' || s_suppkey when s_suppkey % 4 = 2 then 'video' else s_name end as name,
  case s_nationkey % 3 when 0 then 'stop' when 1 then 'halt' else 'stop' end as text from supplier""")
def labels_and_names(spark, sf):
    """A17, C32, C33."""
    key = F.col("s_suppkey")
    name = F.when(key % 4 == 0, "Supplier").when(key % 4 == 3, F.col("s_name"))
    uri = F.when(key % 4 == 1, F.concat(F.lit("content://media/clip"), key)).otherwise("")
    lang = F.get(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), F.col("s_nationkey") % 3)
    rows = read(spark, sf, "supplier").withColumn("host", F.when(F.col("s_name").endswith("1"), "x.pool.net").otherwise("y.net"))
    return rows.select("s_suppkey", S.host_label("host", {"pool": "shared"}, "own").alias("gpu"), video.display_name(name, uri).alias("name"), S.localised(lang, {"en": "stop", "de": "halt"}, "en").alias("text"))


@query("""
with recursive e as (select user_id, event_id, cast(epoch_ms(ts) as bigint) as ms, row_number() over (partition by user_id order by ts, event_id) as i from events),
t as (select user_id, event_id, i, ms as last, true as passes from e where i = 1
  union all select e.user_id, e.event_id, e.i, case when e.ms - t.last >= 43200000 then e.ms else t.last end, e.ms - t.last >= 43200000 from t join e on e.user_id = t.user_id and e.i = t.i + 1)
select user_id, event_id, passes from t""")
def report_throttle(spark, sf):
    """At most one report in twelve hours."""
    rows = read(spark, sf, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return folds.folded(rows, ["user_id"], ["ms", "event_id"], ["ms"], folds.throttle(43_200_000), "passes", "boolean").select("user_id", "event_id", "passes")


@query("""
with recursive o as (select o_orderpriority, o_orderkey, o_custkey % 800 as mine, o_orderkey % 40 = 0 as force, o_custkey % 9 <> 0 as tunnel, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as i from orders),
t as (select o_orderpriority, o_orderkey, i, case when mine = 0 then 1 else mine end as state, true as accepted from o where i = 1
  union all select o.o_orderpriority, o.o_orderkey, o.i, case when not force and mine < state and tunnel then state when mine = 0 then 1 else mine end, not (not force and mine < state and tunnel)
  from t join o on o.o_orderpriority = t.o_orderpriority and o.i = t.i + 1)
select o_orderpriority, o_orderkey, accepted from t""")
def registration_forced(spark, sf):
    """L4 in full: forced and tunnel-less registrations may lower the state."""
    rows = read(spark, sf, "orders").select(
        "o_orderpriority", "o_orderdate", "o_orderkey", (F.col("o_custkey") % 800).alias("mine"), (F.col("o_orderkey") % 40 == 0).alias("force"), (F.col("o_custkey") % 9 != 0).alias("is_tunnel"), F.lit(1).alias("now")
    )
    out = folds.folded(rows, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], ["mine", "force", "is_tunnel", "now"], folds.arbitration(), "accepted", "boolean")
    return out.select("o_orderpriority", "o_orderkey", "accepted")


@query(f"""
with n as (select *, row_number() over (partition by width order by p_partkey) - 1 as pos from ({_CLIP})),
c as (select * exclude (duration_ms), case when pos = 0 then 61000 - 1500 else duration_ms end as duration_ms from n), s as (select {_cost_sql('preset', 'model', 'compute')} as seconds, width from c)
select width::bigint as width, cast(floor(round(sum(seconds), 3)) as bigint) as seconds from s group by 1""")
def selection_time(spark, sf):
    """the estimated time of each selection (clips of one width), of whose first clip a part is taken."""
    place = F.row_number().over(Window.partitionBy("width").orderBy("p_partkey")) - 1
    rows = _clips(spark, sf).withColumn("pos", place).withColumn("duration_ms", S.trimmed_ms("pos", "duration_ms", F.lit(1500), F.lit(61000)))
    seconds = planner.estimated_seconds(_columns(), F.col("preset"), F.col("model"), F.col("compute"))
    return planner.selection_seconds(rows.select(F.col("width").cast("long").alias("width"), seconds.alias("seconds")), ["width"])


@query("""
with e as (select user_id, event_id, event_id % 3 = 0 as is_key, cast(epoch_us(ts) as bigint) as us from events),
s as (select user_id, event_id, is_key, us - min(us) over (partition by user_id) as pts from e),
d as (select user_id, max(pts) // 1000 as ms, user_id % 7 * 100000 as start from s group by 1),
p as (select user_id, 'thumbnail' as name, least(ms, 2000) * 1000 as t from d union all select user_id, 'preview', least(start + least(ms, 3000), ms - 1) * 1000 from d),
c as (select p.user_id, name, pts, event_id, row_number() over (partition by p.user_id, name order by abs(pts - t), pts, event_id) as n from p join s on s.user_id = p.user_id and (is_key or name = 'preview'))
select user_id, name, event_id, pts as pts_us from c where n = 1""")
def still_frames(spark, sf):
    """A5: the frames of thumbnails (key frames) and of previews (any)."""
    rows = read(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 3 == 0).alias("is_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = rows.groupBy("user_id").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    clips = first.select(F.col("user_id").alias("video_id"), F.floor((F.col("last") - F.col("first")) / 1000).alias("duration_ms"), (F.col("user_id") % 7 * 100_000).alias("start_ms"))
    shown = rows.join(first, "user_id").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_idx"), (F.col("us") - F.col("first")).alias("pts_us"), "is_key")
    points = frames.still_points(clips)
    out = frames.closest(shown, points.where("name = 'thumbnail'")).union(frames.closest(shown, points.where("name = 'preview'"), keyed=False))
    return out.select(F.col("video_id").alias("user_id"), "name", F.col("frame_idx").alias("event_id"), "pts_us")


@query("""
select c_custkey, '{"model":"' || case when c_custkey % 3 = 0 then 'ANIME' else 'NATURAL' end || '","target":"AUTO","preset":"BALANCED","color":"OFF","compute":"DEVICE","natural":' || (c_custkey % 10 / 10.0::double)::varchar
  || ',"sharpen":0.3,"anti_flicker":true,"hevc":true,"gpu":true,"max_mode":true}' as json from customer""")
def settings_write(spark, sf):
    """B9."""
    model = F.when(F.col("c_custkey") % 3 == 0, '"ANIME"').otherwise('"none such"')
    text = F.concat(F.lit('{"model": '), model, F.lit(', "natural": '), (F.col("c_custkey") % 10 / F.lit(10.0)).cast("string"), F.lit("}"))
    return read(spark, sf, "customer").select("c_custkey", S.settings_json(S.settings(text)).alias("json"))


@query("""
with c as (select o_custkey, max(o_orderdate) as cleared from orders where o_orderkey % 9 = 0 group by 1)
select o_orderkey, o_custkey from orders left join c using (o_custkey) where (cleared is null or o_orderdate > cleared) and o_orderpriority <> '5-LOW'""")
def history_cleared(spark, sf):
    """Entries after a customer's last clear whose file (order priority) is still there."""
    rows = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    left = control.after_clear(rows, rows.where("o_orderkey % 9 = 0"), ["o_custkey"], "o_orderdate")
    return control.without_stale(left, rows.where("o_orderpriority <> '5-LOW'").select("o_orderpriority"), "o_orderpriority").select("o_orderkey", "o_custkey")


@query("""
with h as (select s_nationkey as n, list(s_name order by s_suppkey) as hosts, list(s_acctbal > 0 order by s_suppkey) as up from supplier group by 1),
z as (select n, unnest(hosts) as host, unnest(up) as up, generate_subscripts(hosts, 1) - 1 as pos from h)
select n, pos, host, row_number() over (partition by n order by pos // 3, pos) as rank from z where up""")
def backends_with_probes(spark, sf):
    """Lists of backends and of their probes by place, then the ranking."""
    lists = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name", (F.col("s_acctbal") > 0).alias("up")))).alias("a"))
    rows = control.zipped(lists.select("n", F.col("a.s_name").alias("host"), F.col("a.up").alias("up")), "host", "up")
    out = control.ranked(rows.withColumn("queue", F.col("pos")), ["n"])
    return out.select("n", F.col("pos").cast("long").alias("pos"), "host", F.col("rank").cast("long").alias("rank"))


@query("""
with p as (select c_custkey, c_name from (select * from customer where c_acctbal > 0 order by c_acctbal desc, c_custkey limit 20)), s as (select c_custkey, c_name from customer where c_nationkey < 3)
select * from (select * from s union all select * from p where c_custkey not in (select c_custkey from s)) where c_custkey % 5 <> 0""")
def picked_sources(spark, sf):
    """Twenty picked at most; those whose probe failed are out."""
    rows = read(spark, sf, "customer")
    own, picked = (rows.where(c).select("c_custkey", "c_name", "c_acctbal") for c in ("c_nationkey < 3", "c_acctbal > 0"))
    return control.picked_sources(own, picked, [F.desc("c_acctbal"), F.col("c_custkey")], rows.where("c_custkey % 5 = 0"), "c_custkey").select("c_custkey", "c_name")


@query("""
with m as (select c_custkey, case when c_custkey % 4 = 0 then 'ANIME' else 'GENERAL' end as model, c_custkey % 2 = 0 as gpu, case when c_custkey % 3 = 0 then 'ULTRA_PLUS' end as pick, case when c_custkey % 5 = 0 then false end as device,
  case when c_custkey % 7 < 3 then 'ANIME' when c_custkey % 7 = 3 then 'ULTRA_PLUS' end as gone from customer),
n as (select *, coalesce(pick, model) as chosen from m), r as (select *, case when chosen = gone then 'NATURAL' else chosen end as now from n)
select c_custkey, now as model, coalesce(device, gpu) as gpu, pick is null as auto_model, now <> model or coalesce(device, gpu) <> gpu as preview_stale from r""")
def settings_edits(spark, sf):
    """L17."""
    key = F.col("c_custkey")
    rows = read(spark, sf, "customer").select("c_custkey", F.when(key % 4 == 0, "ANIME").otherwise("GENERAL").alias("model"), (key % 2 == 0).alias("gpu"), F.lit(True).alias("auto_model"))
    gone = F.when(key % 7 < 3, "ANIME").when(key % 7 == 3, "ULTRA_PLUS")
    edits = rows.select("c_custkey", F.when(key % 3 == 0, "ULTRA_PLUS").alias("model"), F.when(key % 5 == 0, F.lit(False)).alias("gpu"), gone.alias("deleted"))
    return control.edited_settings(rows, edits, "c_custkey")


@query("""
with d as (select distinct l_orderkey from lineitem where l_returnflag = 'R' and l_linenumber <= 2),
j as (select o_orderkey, (['DEVICE', 'HYBRID', 'CLOUD'])[o_orderkey % 3 + 1] as compute, case when o_orderkey % 5 = 0 then 'FAST' else 'HIGH' end as preset from orders)
select o_orderkey, case when compute <> 'CLOUD' then compute when preset <> 'FAST' and l_orderkey is not null then 'CLOUD' else 'HYBRID' end as runs from j left join d on l_orderkey = o_orderkey""")
def cloud_fallback(spark, sf):
    """L8."""
    compute = F.get(F.array(F.lit("DEVICE"), F.lit("HYBRID"), F.lit("CLOUD")), (F.col("o_orderkey") % 3).cast("int"))
    jobs = read(spark, sf, "orders").select("o_orderkey", compute.alias("compute"), F.when(F.col("o_orderkey") % 5 == 0, "FAST").otherwise("HIGH").alias("preset"))
    attempts = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") == "R").alias("ok"))
    return control.with_fallback(jobs, attempts, "o_orderkey").select("o_orderkey", "runs")


@query("""
select user_id, max_by(case event_type when 'view' then 'START' when 'click' then 'PAUSE' when 'purchase' then 'RESUME' when 'error' then 'PAUSE' else 'ENQUEUE' end, event_id) filter (event_type in ('view', 'click', 'purchase', 'error')) = 'PAUSE' as paused
from events where event_type in ('view', 'click', 'purchase', 'error') group by 1""")
def queue_paused(spark, sf):
    """L2, L20."""
    action = F.expr("case event_type when 'view' then 'START' when 'click' then 'PAUSE' when 'purchase' then 'RESUME' when 'error' then 'PAUSE' else 'ENQUEUE' end")
    return control.paused(read(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), action.alias("action")), ["user_id"])


@query(f"select job_id, status from ({_QUEUE}) where status in ('WAITING', 'RUNNING')")
def queue_live(spark, sf):
    """What stays when finished jobs are cleared."""
    return control.finished_cleared(_queue(spark, sf))


@query(f"select min(job_id) as job_id, 'WAITING' as status from ({_QUEUE}) where status = 'WAITING' having count(*) > 0")
def queue_next(spark, sf):
    """H4."""
    return control.next_job(_queue(spark, sf))


_SKIPS = _EVENT_FRAMES + """, k as (select *, (['ULTRA', 'HIGH', 'BALANCED'])[user_id % 3 + 1] = 'BALANCED' and is_dup and lag(event_id) over (partition by user_id order by event_id) is not null as skipped from r) """


@query(_SKIPS + "select user_id, count(*) as processed, count_if(skipped)::bigint as skipped, count_if(not skipped)::bigint as inferred from k group by 1")
def frame_counters(spark, sf):
    """D9, F13."""
    rows = _event_frames(spark, sf).withColumn("preset", F.get(F.array(F.lit("ULTRA"), F.lit("HIGH"), F.lit("BALANCED")), (F.col("user_id") % 3).cast("int")))
    return frames.counters(frames.with_skips(rows, ["user_id"], "event_id"), ["user_id"])


@query("select s_name as name, s_suppkey % 3 = 0 or (s_suppkey % 3 = 1 and s_acctbal * 1000 > 1000000) as there from supplier")
def models_available(spark, sf):
    """The map of what is there, taken apart again."""
    key = F.col("s_suppkey")
    models = read(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.when(key % 3 != 0, "https://models").alias("download_url"))
    files = read(spark, sf, "supplier").where(key % 3 == 1).select(F.col("s_name").alias("name"), (F.col("s_acctbal") * 1000).alias("size_bytes"))
    return control.availability(models, files).select(F.explode("available").alias("name", "there"))


@query("""
select l_orderkey, l_linenumber::bigint as l_linenumber, case l_returnflag when 'N' then 0 else 1 end as out_index from lineitem where l_returnflag in ('N', 'A') and l_orderkey % 4 <> 0""")
def track_map(spark, sf):
    """Two tracks of most videos are taken over."""
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_returnflag").alias("track"))
    tracks = rows.where("video_id % 4 <> 0 and track in ('N', 'A')").select("video_id", "track").distinct().withColumn("out_index", F.when(F.col("track") == "N", 0).otherwise(1))
    return control.mapped_tracks(rows, tracks).select(F.col("video_id").alias("l_orderkey"), "l_linenumber", "out_index")


# ---- frames for real ----

WIDE, HIGH = 32, 24
#: A clip per brand, a frame per part; pixels follow from the values v and w of the part, or of the one before it for every second frame.
_FRAMES_OF = """
n as (select p_brand as video_id, p_size, cast(floor(p_retailprice) as bigint) % 64 as w, row_number() over (partition by p_brand order by p_partkey) - 1 as frame_idx from part),
f as (select video_id, frame_idx, case when frame_idx % 2 = 1 then lag(p_size) over b else p_size end as v, case when frame_idx % 2 = 1 then lag(w) over b else w end as w from n window b as (partition by video_id order by frame_idx))"""


def _pixel_sql(x: str, y: str) -> tuple[str, str, str]:
    r = f"((({x}) * 3 + ({y}) * 2 + v * 5) % 256)"
    return r, f"((({x}) * w + ({y}) * 7 + v) % 256)", f"((255 - {r} + ({x}) * ({y})) % 256)"


def part_clips(spark: SparkSession, sf: str, names: list[str] | None = None) -> DataFrame:
    """Frames of WIDE x HIGH pixels whose samples are made from the values of parts; of the clips that are named, or of all."""
    from cinetide.schemas import FRAMES

    by = Window.partitionBy("video_id").orderBy("p_partkey")
    price = F.floor("p_retailprice") % 64
    parts = read(spark, sf, "part")
    rows = (parts if names is None else parts.where(F.col("p_brand").isin(names))).select(F.col("p_brand").alias("video_id"), "p_partkey", F.col("p_size").cast("long").alias("v"), price.cast("long").alias("w"))
    rows = rows.withColumn("frame_idx", (F.row_number().over(by) - 1).cast("long"))
    pair = lambda c: F.when(F.col("frame_idx") % 2 == 1, F.lag(c).over(by)).otherwise(F.col(c)).alias(c)
    rows = frames.dealt(rows.select("video_id", "frame_idx", pair("v"), pair("w")), "video_id", "frame_idx")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        y, x = np.mgrid[0:HIGH, 0:WIDE]
        for batch in frames.slices(batches):
            v, w = (batch.column(c).to_numpy()[:, None, None] for c in ("v", "w"))
            r = (x * 3 + y * 2 + v * 5) % 256
            px = np.stack([r, (x * w + y * 7 + v) % 256, (255 - r + x * y) % 256], axis=-1).astype(np.uint8)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("video_id"), batch.column("frame_idx"), pa.array(batch.column("frame_idx").to_numpy() * 33_333), pa.array([WIDE] * n, pa.int32()),
                    pa.array([HIGH] * n, pa.int32()), pa.array([p.tobytes() for p in px], pa.binary()),
                ],
                ["video_id", "frame_idx", "pts_us", "width", "height", "px"],
            )

    return rows.mapInArrow(run, FRAMES)


_R, _G, _B = _pixel_sql("x", "cast(floor(i * 0.75) as bigint)")


@query(f"""
with {_FRAMES_OF}, cells as (select video_id, frame_idx, x, i, cast((2 * {_R} + 5 * {_G} + {_B}) >> 3 as double) as luma from f, range(32) as a(x), range(32) as c(i)),
steps as (select video_id, frame_idx, abs(luma - lag(luma) over (partition by video_id, x, i order by frame_idx)) as step from cells),
d as (select video_id, frame_idx, coalesce(avg(step), 255.0) as diff from steps group by 1, 2),
g as (select *, diff <> 255.0 and diff < 0.05 as is_dup, diff = 255.0 or diff > 40.0 as is_cut from d)
select video_id, frame_idx, round(diff, 4) as diff, is_dup, is_cut, last_value(case when not is_dup then frame_idx end ignore nulls) over w as root, cast(sum(case when is_cut then 1 else 0 end) over w as bigint) as segment
from g window w as (partition by video_id order by frame_idx rows unbounded preceding)""")
def frame_analysis(spark, sf):
    """F1, F2, D7, D8, G1-G3 on pixels."""
    return frames.analysed(part_clips(spark, sf)).select("video_id", "frame_idx", F.round("diff", 4).alias("diff"), "is_dup", "is_cut", "root", F.col("segment").cast("long").alias("segment"))


def _luma_sql(x: str, y: str) -> str:
    r, g, b = _pixel_sql(x, y)
    return f"(299 * {r} + 587 * {g} + 114 * {b}) / 1000.0::double"


_UNIT = "greatest(least({}, 1.0::double), 0.0::double)"
_R, _G, _B = _pixel_sql("x", "y")
_CONTENT_SQL = f"""
{_FRAMES_OF}, px as (select video_id, frame_idx, x, y, v, w, {_R} as r, {_G} as g, {_B} as b, {_luma_sql("x", "y")} as luma from f, range({WIDE}) as a(x), range({HIGH}) as c(y)),
plain as (select video_id, frame_idx, 1 - {_UNIT.format("avg(luma) / 255")} as darkness,
  avg(case when greatest(r, g, b) = 0 then 0.0::double else (greatest(r, g, b) - least(r, g, b))::double / greatest(r, g, b) end) as saturation from px group by 1, 2),
bins as (select video_id, frame_idx, ((r >> 5) << 6) | ((g >> 5) << 3) | (b >> 5) as bin, count(*) as n from px group by 1, 2, 3),
cover as (select video_id, frame_idx, sum(n) over o as cover, row_number() over o as k from bins window o as (partition by video_id, frame_idx order by n desc, bin rows unbounded preceding)),
spread as (select video_id, frame_idx, min(k) / 512.0::double as diversity from cover where cover >= 0.99 * {WIDE * HIGH} group by 1, 2),
steps as (select video_id, frame_idx, x, y, abs({_luma_sql("x + 1", "y")} - {_luma_sql("x - 1", "y")}) as gx, abs({_luma_sql("x", "y + 1")} - {_luma_sql("x", "y - 1")}) as gy
  from px where x between 1 and {WIDE - 2} and y between 1 and {HIGH - 2}),
sums as (select video_id, frame_idx, count(*) as n, count(*) filter (gx + gy > 6) as soft, count(*) filter (gx + gy > 60) as strong, avg(gx + gy) as mean,
  (sum(case when x % 8 = 0 then gx else 0 end) + sum(case when y % 8 = 0 then gy else 0 end)) / (count(*) filter (x % 8 = 0) + count(*) filter (y % 8 = 0)) as edge,
  (sum(case when x % 8 <> 0 then gx else 0 end) + sum(case when y % 8 <> 0 then gy else 0 end)) / (count(*) filter (x % 8 <> 0) + count(*) filter (y % 8 <> 0)) as inside from steps group by 1, 2),
scores as (select video_id, frame_idx, darkness, saturation,
  0.4::double * {_UNIT.format("1 - 4 * diversity")} + 0.3::double * {_UNIT.format("1 - 6 * soft::double / n")} + 0.3::double * {_UNIT.format("case when soft = 0 then 0 else 3 * strong::double / soft end")} as anime,
  greatest({_UNIT.format("(edge / (inside + 0.5) - 1.05::double) * 2.5::double")}, 0.7::double * {_UNIT.format("(mean - 14) / 20")}) as blockiness
  from plain join spread using (video_id, frame_idx) join sums using (video_id, frame_idx))"""


@query(f"with {_CONTENT_SQL} select video_id, frame_idx, round(anime, 6) as anime, round(blockiness, 6) as blockiness, round(darkness, 6) as darkness, round(saturation, 6) as saturation from scores")
def frame_scores(spark, sf):
    """F3-F9 of each frame's pixels: the kernel itself."""
    return frames.content_scores(part_clips(spark, sf)).select("video_id", "frame_idx", *(F.round(c, 6).alias(c) for c in ("anime", "blockiness", "darkness", "saturation")))


@query(f"""
with {_CONTENT_SQL}, m as (select video_id, avg(anime) as anime, avg(blockiness) as blockiness, avg(darkness) as darkness, avg(saturation) as saturation from scores group by 1)
select video_id, case when anime > 0.6 then 'ANIME' when blockiness > 0.55 then 'GENERAL_DENOISE' else 'NATURAL' end as recommended, darkness > 0.55 or saturation < 0.18 as color_fix,
  round(anime, 6) as anime, round(blockiness, 6) as blockiness, round(darkness, 6) as darkness, round(saturation, 6) as saturation from m""")
def frame_content(spark, sf):
    """F3-F10 on pixels."""
    scores = frames.content_scores(part_clips(spark, sf))
    return frames.classified(scores, scores).select("video_id", "recommended", "color_fix", *(F.round(c, 6).alias(c) for c in ("anime", "blockiness", "darkness", "saturation")))


# ---- kernels, by digests of what they make of whole frames ----

_WEIGHT = "(1 + (x * 7 + y * 13 + c * 29) % 101)"
_GRID = f"range({WIDE}) as a(x), range({HIGH}) as b(y)"


def _luma_256_sql(x: str, y: str) -> str:
    r, g, b = _pixel_sql(x, y)
    return f"((77 * {r} + 150 * {g} + 29 * {b}) >> 8)"


def _channel_sql(x: str, y: str) -> str:
    r, g, b = _pixel_sql(x, y)
    return f"(case c when 0 then {r} when 1 then {g} else {b} end)"


_STEP = f"(abs({_luma_256_sql('x + 1', 'y')} - {_luma_256_sql('x - 1', 'y')}) + abs({_luma_256_sql('x', 'y + 1')} - {_luma_256_sql('x', 'y - 1')})) * 255 // 60"


@query(f"""
with {_FRAMES_OF}, raw as (select video_id, frame_idx, x, y, case when x between 1 and {WIDE - 2} and y between 1 and {HIGH - 2} then {_STEP} else 0 end as raw from f, {_GRID}),
wide as (select *, sum(raw) over (partition by video_id, frame_idx, y order by x rows between 1 preceding and 1 following) as wide from raw),
box as (select *, sum(wide) over (partition by video_id, frame_idx, x order by y rows between 1 preceding and 1 following) as box, 0 as c from wide)
select video_id, frame_idx, cast(sum(case when x between 1 and {WIDE - 2} and y between 1 and {HIGH - 2} then least(box // 9, 255) else 0 end * {_WEIGHT}) as bigint) as digest from box group by 1, 2""")
def pixel_edges(spark, sf):
    """K1."""
    return frames.digests(part_clips(spark, sf), pixels.edge_mask)


@query(f"""
with {_FRAMES_OF}, p as (select video_id, frame_idx, x, y, {_luma_256_sql("x", "y")} as p from f, {_GRID}),
across as (select video_id, frame_idx, x, y, (sum(p) over (o rows between 8 preceding and 8 following) + greatest(8 - x, 0) * first_value(p) over (o rows unbounded preceding)
  + greatest(x - {WIDE - 9}, 0) * last_value(p) over (o rows between unbounded preceding and unbounded following)) // 17 as p from p window o as (partition by video_id, frame_idx, y order by x)),
down as (select video_id, frame_idx, x, y, 0 as c, (sum(p) over (o rows between 8 preceding and 8 following) + greatest(8 - y, 0) * first_value(p) over (o rows unbounded preceding)
  + greatest(y - {HIGH - 9}, 0) * last_value(p) over (o rows between unbounded preceding and unbounded following)) // 17 as p from across window o as (partition by video_id, frame_idx, x order by y))
select video_id, frame_idx, cast(sum(p * {_WEIGHT}) as bigint) as digest from down group by 1, 2""")
def pixel_blur(spark, sf):
    """K2 at scale 4."""
    return frames.digests(part_clips(spark, sf), lambda rgb: pixels.box_blur(pixels.luma_256(rgb), 4))


_UP = [_channel_sql(x, y) for y in ("y0", "y0 + 1") for x in ("x0", "x0 + 1")]


@query(f"""
with {_FRAMES_OF}, spots as (select *, greatest(x * 128 - 128, 0) as ax, greatest(y * 128 - 128, 0) as ay from f, range({2 * WIDE}) as a(x), range({2 * HIGH}) as b(y), range(3) as d(c)),
i as (select *, least(ax >> 8, {WIDE - 2}) as x0, ax & 255 as wx, least(ay >> 8, {HIGH - 2}) as y0, ay & 255 as wy from spots)
select video_id, frame_idx, cast(sum(((({_UP[0]} * (256 - wx) + {_UP[1]} * wx) * (256 - wy) + ({_UP[2]} * (256 - wx) + {_UP[3]} * wx) * wy) >> 14) * {_WEIGHT}) as bigint) as digest from i group by 1, 2""")
def pixel_upsampled(spark, sf):
    """C12 at scale 2."""
    return frames.digests(part_clips(spark, sf), lambda rgb: pixels.upsample_x4(rgb, 2))


@query(f"""
with {_FRAMES_OF}, p as (select video_id, frame_idx, x, y, c, 1192 * greatest({_pixel_sql("x", "y")[0]} - 16, 0) as base, {_pixel_sql("(x // 2 * 2)", "(y // 2 * 2)")[1]} - 128 as cb, {_pixel_sql("(x // 2 * 2)", "(y // 2 * 2)")[2]} - 128 as cr
  from f, {_GRID}, range(3) as d(c))
select video_id, frame_idx, cast(sum(least(greatest(case c when 0 then base + 1634 * cr when 1 then base - 833 * cr - 400 * cb else base + 2066 * cb end >> 10, 0), 255) * {_WEIGHT}) as bigint) as digest from p group by 1, 2""")
def pixel_yuv(spark, sf):
    """C1, with the frame's channels as planes."""
    return frames.digests(part_clips(spark, sf), lambda rgb: pixels.yuv420_to_rgb(rgb[..., 0], rgb[::2, ::2, 1], rgb[::2, ::2, 2]))


_RS, _GS, _BS = _pixel_sql("x", "y")
_U = f"128 + (-37.797::double * {_RS} - 74.203::double * {_GS} + 112.0::double * {_BS}) / 255"
_V = f"128 + (112.0::double * {_RS} - 93.786::double * {_GS} - 18.214::double * {_BS}) / 255"
_BYTE = "least(greatest(round_even({}, 0), 0), 255)"


@query(f"""
with {_FRAMES_OF}, p as (select video_id, frame_idx, x, y, 16 + (65.481::double * {_RS} + 128.553::double * {_GS} + 24.966::double * {_BS}) / 255 as luma, {_U} as u, {_V} as v from f, {_GRID}),
h as (select video_id, frame_idx, x // 2 as x, y // 2 as y, avg(u) as u, avg(v) as v from p group by all),
b as (select video_id, frame_idx, y * {WIDE} + x as x, {_BYTE.format("luma")} as s from p union all select video_id, frame_idx, {WIDE * HIGH} + y * {WIDE // 2} + x, {_BYTE.format("u")} from h
  union all select video_id, frame_idx, {WIDE * HIGH + WIDE * HIGH // 4} + y * {WIDE // 2} + x, {_BYTE.format("v")} from h)
select video_id, frame_idx, cast(sum(s * (1 + x * 7 % 101)) as bigint) as digest from b group by 1, 2""")
def pixel_i420(spark, sf):
    """The bytes of a raw frame."""
    import numpy as np

    return frames.digests(part_clips(spark, sf), lambda rgb: np.frombuffer(pixels.rgb_to_i420(rgb), np.uint8)[None, :, None])


_RX = [_channel_sql(x, y) for y in ("y0", "y1") for x in ("x0", "x1")]


@query(f"""
with {_FRAMES_OF}, spots as (select *, least(greatest((x + 0.5::double) * {WIDE} / 20 - 0.5::double, 0), {WIDE - 1}) as ax, least(greatest((y + 0.5::double) * {HIGH} / 15 - 0.5::double, 0), {HIGH - 1}) as ay
  from f, range(20) as a(x), range(15) as b(y), range(3) as d(c)),
i as (select *, cast(floor(ax) as bigint) as x0, least(cast(floor(ax) as bigint) + 1, {WIDE - 1}) as x1, cast(floor(ay) as bigint) as y0, least(cast(floor(ay) as bigint) + 1, {HIGH - 1}) as y1 from spots),
s as (select *, ({_RX[0]} * (1 - (ay - y0)) + {_RX[2]} * (ay - y0)) * (1 - (ax - x0)) + ({_RX[1]} * (1 - (ay - y0)) + {_RX[3]} * (ay - y0)) * (ax - x0) as s from i)
select video_id, frame_idx, cast(sum(least(greatest(floor(s + 0.5::double), 0), 255) * {_WEIGHT}) as bigint) as digest from s group by 1, 2""")
def pixel_resized(spark, sf):
    """K7 to 20 x 15."""
    return frames.digests(part_clips(spark, sf), lambda rgb: pixels.bilinear(rgb, 20, 15))


@query(f"""
with {_FRAMES_OF}, p as (select video_id, frame_idx, x * 4 + dx as x, y * 4 + dy as y, c, {_channel_sql("x", "y")} as s from f, {_GRID}, range(3) as d(c), range(4) as g(dx), range(4) as h(dy))
select video_id, frame_idx, cast(sum(s * {_WEIGHT}) as bigint) as digest from p group by 1, 2""")
def tiles_stitched(spark, sf):
    """Tiles of 24 taken out, enlarged by repetition, and put together again."""
    repeat = lambda planes: planes.repeat(tiles.SCALE, axis=2).repeat(tiles.SCALE, axis=3)
    return frames.digests(tiles.inferred(part_clips(spark, sf), repeat, tile=24))


_C = [f"(({c} / 255.0::double - 0.5::double) * 1.22::double + 0.5::double)" for c in (_RS, _GS, _BS)]
_CURVE = "({c} * 0.65::double + {t} * {t} * (3 - 2 * {t}) * 0.35::double)"


@query(f"""
with {_FRAMES_OF}, p as (select video_id, frame_idx, x, y, c, {_C[0]} as r, {_C[1]} as g, {_C[2]} as b from f, {_GRID}, range(3) as d(c)),
t as (select *, least(greatest(r, 0.0::double), 1.0::double) as tr, least(greatest(g, 0.0::double), 1.0::double) as tg, least(greatest(b, 0.0::double), 1.0::double) as tb from p),
k as (select video_id, frame_idx, x, y, c, {_CURVE.format(c="r", t="tr")} as r, {_CURVE.format(c="g", t="tg")} as g, {_CURVE.format(c="b", t="tb")} as b from t),
m as (select *, 0.299::double * r + 0.587::double * g + 0.114::double * b as luma from k)
select video_id, frame_idx, cast(sum(floor(least(greatest(luma * (1 - 1.35::double) + case c when 0 then r when 1 then g else b end * 1.35::double, 0.0::double), 1.0::double) * 255 + 0.5::double) * {_WEIGHT}) as bigint) as digest
from m group by 1, 2""")
def pixel_graded(spark, sf):
    """C13, K6 without sharpening."""
    return frames.digests(tiles.rendered(part_clips(spark, sf), "VIVID", 0.0))


def _sharpened_sql(amount: float) -> str:
    """Each sample against the mean of its 3 x 3 neighbourhood; edges repeat."""
    near = [_pixel_sql(f"least(greatest(x + {dx}, 0), {WIDE - 1})", f"least(greatest(y + {dy}, 0), {HIGH - 1})") for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    means = [" + ".join(n[c] for n in near) for c in range(3)]
    own = _pixel_sql("x", "y")
    high = ", ".join(f"{own[c]} / 255.0::double as {n}, ({own[c]} * 9 - ({means[c]})) / 2295.0::double as h{n}" for c, n in enumerate("rgb"))
    step = lambda lo, hi: f"(least(greatest((size - {lo}::double) / {hi - lo:.2f}::double, 0.0::double), 1.0::double))"
    curve = lambda t: f"({t} * {t} * (3 - 2 * {t}))"
    return f"""
with {_FRAMES_OF}, p as (select video_id, frame_idx, x, y, {high} from f, {_GRID}),
s as (select *, sqrt(hr * hr + hg * hg + hb * hb) as size from p),
w as (select *, 0.4::double + 0.6::double * {curve(step(0.0, 0.08))} * (1 - {curve(step(0.25, 0.6))}) as weight from s),
o as (select video_id, frame_idx, x, y, c, case c when 0 then r when 1 then g else b end + case c when 0 then hr when 1 then hg else hb end * {amount}::double * weight as v from w, range(3) as d(c))
select video_id, frame_idx, cast(sum(floor(least(greatest(v, 0.0::double), 1.0::double) * 255 + 0.5::double) * {_WEIGHT}) as bigint) as digest from o group by 1, 2"""


@query(_sharpened_sql(0.6))
def pixel_sharpened(spark, sf):
    """C14, K6: adaptive sharpening without a grade."""
    return frames.digests(tiles.rendered(part_clips(spark, sf), "OFF", 0.6))


_R, _G, _B = _pixel_sql("x", "cast(floor(i * 0.75) as bigint)")
_ALPHA = "case when abs(q.r - t.r) + abs(q.g - t.g) + abs(q.b - t.b) >= 24 then 0 else 128 * (24 - abs(q.r - t.r) - abs(q.g - t.g) - abs(q.b - t.b)) // 24 end"
_BLEND = "case when q.segment <> t.segment then q.{c} else (q.{c} * (256 - " + _ALPHA + ") + t.{o} * " + _ALPHA + ") >> 8 end as {o}"


@query(f"""
with recursive {_FRAMES_OF}, cells as (select video_id, frame_idx, x, i, cast((2 * {_R} + 5 * {_G} + {_B}) >> 3 as double) as luma from f, range(32) as a(x), range(32) as c(i)),
steps as (select video_id, frame_idx, abs(luma - lag(luma) over (partition by video_id, x, i order by frame_idx)) as step from cells),
d as (select video_id, frame_idx, coalesce(avg(step), 255.0) as diff from steps group by 1, 2),
g as (select video_id, frame_idx, sum(case when diff = 255.0 or diff > 40.0 then 1 else 0 end) over (partition by video_id order by frame_idx rows unbounded preceding) as segment from d),
q as (select video_id, frame_idx, segment, x, y, {_RS} as r, {_GS} as g, {_BS} as b from f join g using (video_id, frame_idx), {_GRID}),
t as (select video_id, frame_idx, segment, x, y, r, g, b, r as o0, g as o1, b as o2 from q where frame_idx = 0
  union all select q.video_id, q.frame_idx, q.segment, q.x, q.y, q.r, q.g, q.b, {_BLEND.format(c="r", o="o0")}, {_BLEND.format(c="g", o="o1")}, {_BLEND.format(c="b", o="o2")}
  from t join q on q.video_id = t.video_id and q.frame_idx = t.frame_idx + 1 and q.x = t.x and q.y = t.y)
select video_id, frame_idx, cast(sum(o0 * (1 + (x * 7 + y * 13) % 101) + o1 * (1 + (x * 7 + y * 13 + 29) % 101) + o2 * (1 + (x * 7 + y * 13 + 58) % 101)) as bigint) as digest from t group by 1, 2""")
def pixel_stabilised(spark, sf):
    """G4, K5 on pixels: each frame's blend with what the one before became, within its scene."""
    clips = part_clips(spark, sf)
    return frames.digests(tiles.stabilised(clips.withColumn("source", F.col("px")), frames.analysed(clips)))


@query()
def upscale_smoke(spark, sf):
    """J1-J5, K1-K3, E1, G4 on pixels: digests of the finished frames."""
    clips = part_clips(spark, sf)
    out = tiles.processed(clips, frames.analysed(clips), tile=48)
    return out.select("video_id", "frame_idx", "width", "height", F.sha2("px", 256).alias("sha256"))


#: Bytes of results that upscale_blocks has in blocks on disk at a time, or those of one clip.
BLOCK_BYTES = 1 << 30


def clip_batches(spark: SparkSession, sf: str, most_bytes: int) -> Iterator[list[str]]:
    """Names of clips in batches whose results, if no frame is a duplicate, have so many bytes, or of one clip each."""
    held, size = [], 0
    for name, n in read(spark, sf, "part").where("p_brand is not null").groupBy("p_brand").count().orderBy("p_brand").toLocalIterator():
        own = n * WIDE * HIGH * 3 * tiles.SCALE**2
        if held and size + own > most_bytes:
            yield held
            held, size = [], 0
        held.append(name)
        size += own
    if held:
        yield held


@query("select p_brand as video_id, count(*) as frames, count(*) as same from part group by 1")
def upscale_blocks(spark, sf):
    """The upscaling path with inference in blocks gives the bits of the single stream.

    Flags are found for all clips at once, as a clip's are one task's.  Then clips come in batches, and a batch's blocks and
    shuffles are removed before the next one, so the disk that results take is a batch's and not the table's.
    """
    folder, found = shared_folder(spark, "blocks"), shared_folder(spark, "compared")
    schema = "video_id string, frames bigint, same bigint"
    spark.createDataFrame([], schema).write.parquet(found)
    try:
        with shuffles_dropped(spark):
            frames.analysed(part_clips(spark, sf)).select("video_id", "frame_idx", "is_dup", "segment").write.parquet(f"{folder}/flags")
            flags = spark.read.parquet(f"{folder}/flags")
            for names in clip_batches(spark, sf, BLOCK_BYTES):
                clips, own = part_clips(spark, sf, names), flags.where(F.col("video_id").isin(names))
                ways = [tiles.processed(clips, own, tile=48, folder=to).select("video_id", "frame_idx", F.sha2("px", 256).alias("sha256")) for to in (None, f"{folder}/results")]
                both = ways[0].join(ways[1].withColumnRenamed("sha256", "other").hint("merge"), ["video_id", "frame_idx"])
                both.groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if(F.col("sha256") == F.col("other")).alias("same")).write.mode("append").parquet(found)
                removed(f"{folder}/results")
    finally:
        removed(folder)
    return spark.read.schema(schema).parquet(found)


# ---- networks and motion ----

#: net_compact's corner of each frame, and the weights of a compact network of two features, by a rule in whole numbers, so that results are exact.
CORNER_X, CORNER_Y = 8, 6
_WEIGHT_OF = "((o * 7 + i * 5 + r * 3 + q * 11) % 3 - 1)"


def _net_weights(spark, sf):
    """The tensors of the network as a table, for each region's name (the first one is used)."""
    sizes = [("body.0.weight", 2, 3), ("body.2.weight", 48, 2)]
    layers = spark.createDataFrame(sizes, "name string, outs int, ins int").join(read(spark, sf, "region").agg(F.min("r_regionkey").alias("base")))
    at = lambda n: F.sequence(F.lit(0), n - 1)
    grid = layers.select("*", F.explode(at(F.col("outs"))).alias("o")).select("*", F.explode(at(F.col("ins"))).alias("i")).select("*", F.explode(at(F.lit(3))).alias("r")).select("*", F.explode(at(F.lit(3))).alias("q"))
    value = F.struct("o", "i", "r", "q", ((F.col("o") * 7 + F.col("i") * 5 + F.col("r") * 3 + F.col("q") * 11) % 3 - 1).cast("float").alias("v"))
    convs = grid.groupBy("name", "outs", "ins").agg(F.sort_array(F.collect_list(value)).alias("all")).select("name", F.array("outs", "ins", F.lit(3), F.lit(3)).alias("shape"), F.transform("all", lambda e: e["v"]).alias("values"))
    biases = layers.select(F.regexp_replace("name", "weight", "bias").alias("name"), F.array("outs").alias("shape"), F.transform(at(F.col("outs")), lambda k: (k % 5 - 2).cast("float")).alias("values"))
    slopes = layers.where("name like 'body.0%'").select(F.lit("body.1.weight").alias("name"), F.array("outs").alias("shape"), F.transform(at(F.col("outs")), lambda k: (k + 2).cast("float")).alias("values"))
    return convs.union(biases).union(slopes)


def _inside(x: str, y: str, value: str, wide: int, high: int) -> str:
    return f"(case when {x} between 0 and {wide - 1} and {y} between 0 and {high - 1} then {value} else 0 end)"


def _hidden_sql(o: int, wide: int = CORNER_X, high: int = CORNER_Y) -> str:
    terms = []
    for r in range(3):
        for q in range(3):
            for i, channel in enumerate(_pixel_sql(f"x + {q - 1}", f"y + {r - 1}")):
                if weight := (o * 7 + i * 5 + r * 3 + q * 11) % 3 - 1:
                    terms.append(f"{weight:+d} * {_inside(f'x + {q - 1}', f'y + {r - 1}', channel, wide, high)}")
    return f"({o % 5 - 2} {' '.join(terms)})"


_CHANNEL = "(case o // 16 when 0 then {} when 1 then {} else {} end)".format(*_pixel_sql("x", "y"))
_NET_SQL = f"""
with {_FRAMES_OF}, h as (select video_id, frame_idx, x, y, v, w, {_hidden_sql(0)} as h0, {_hidden_sql(1)} as h1 from f, range({CORNER_X}) as a(x), range({CORNER_Y}) as b(y)),
p as (select video_id, frame_idx, x, y, v, w, case when h0 > 0 then h0 else 2 * h0 end as h0, case when h1 > 0 then h1 else 3 * h1 end as h1 from h),
taps as (select o, i, r, q, {_WEIGHT_OF} as k from range(48) as a(o), range(2) as b(i), range(3) as c(r), range(3) as d(q)),
lists as (select o, list(k order by r, q, i) as ks from taps group by o),
near as (select m.video_id, m.frame_idx, m.x, m.y, m.v, m.w, flatten(list([coalesce(n.h0, 0), coalesce(n.h1, 0)] order by r, q)) as hs
  from p m cross join range(3) as c(r) cross join range(3) as d(q) left join p n on n.video_id = m.video_id and n.frame_idx = m.frame_idx and n.x = m.x + q - 1 and n.y = m.y + r - 1 group by all),
outs as (select video_id, frame_idx, 4 * x + o % 4 as big_x, 4 * y + (o // 4) % 4 as big_y, o // 16 as c, cast(list_inner_product(hs, ks) as bigint) + o % 5 - 2 + {_CHANNEL} as value from near, lists)
select video_id, frame_idx, cast(sum(value * (1 + (big_x * 7 + big_y * 13 + c * 29) % 101)) as bigint) as digest from outs group by 1, 2"""


#: The same network on whole frames; neighbours are the rows before and after.
_WHOLE_NET_SQL = f"""
with {_FRAMES_OF}, h as (select video_id, frame_idx, x, y, v, w, {_hidden_sql(0, WIDE, HIGH)} as h0, {_hidden_sql(1, WIDE, HIGH)} as h1 from f, {_GRID}),
p as (select video_id, frame_idx, x, y, v, w, case when h0 > 0 then h0 else 2 * h0 end as h0, case when h1 > 0 then h1 else 3 * h1 end as h1 from h),
across as (select *, [coalesce(lag(h0) over o, 0), coalesce(lag(h1) over o, 0), h0, h1, coalesce(lead(h0) over o, 0), coalesce(lead(h1) over o, 0)] as hs from p window o as (partition by video_id, frame_idx, y order by x)),
near as (select video_id, frame_idx, x, y, v, w, coalesce(lag(hs) over o, [0, 0, 0, 0, 0, 0]) || hs || coalesce(lead(hs) over o, [0, 0, 0, 0, 0, 0]) as hs from across window o as (partition by video_id, frame_idx, x order by y)),
taps as (select o, i, r, q, {_WEIGHT_OF} as k from range(48) as a(o), range(2) as b(i), range(3) as c(r), range(3) as d(q)),
lists as (select o, list(k order by r, q, i) as ks from taps group by o),
outs as (select video_id, frame_idx, 4 * x + o % 4 as big_x, 4 * y + (o // 4) % 4 as big_y, o // 16 as c, cast(list_inner_product(hs, ks) as bigint) + o % 5 - 2 + {_CHANNEL} as value from near, lists)
select video_id, frame_idx, cast(sum(value * (1 + (big_x * 7 + big_y * 13 + c * 29) % 101)) as bigint) as digest from outs group by 1, 2"""


def _through(kernel, wide: int = WIDE, high: int = HIGH):
    import numpy as np

    def run(rgb):
        planes = rgb[:high, :wide].transpose(2, 0, 1)[None].astype(np.float32)
        return np.rint(kernel(planes)[0]).astype(np.int64).transpose(1, 2, 0)

    return run


@query(_NET_SQL)
def net_compact(spark, sf):
    """A compact network whose weights are a table, on a corner of each frame."""
    return frames.digests(part_clips(spark, sf), _through(tiles.net_kernel(_net_weights(spark, sf)), CORNER_X, CORNER_Y))


@query(_WHOLE_NET_SQL)
def net_as_onnx(spark, sf):
    """The same network on whole frames, written as an ONNX file and run by the runtime."""
    return frames.digests(part_clips(spark, sf), _through(tiles.onnx_kernel(tiles.add_model(_net_weights(spark, sf), f"net{uuid.uuid4().hex}", shared_folder(spark, "models")))))


@query("""
with n as (select p_brand as video_id, p_partkey, p_size, row_number() over (partition by p_brand order by p_partkey) - 1 as frame_idx from part)
select video_id, frame_idx, case when frame_idx % 2 = 1 then p_size % 5 - 2 end as dx, case when frame_idx % 2 = 1 then p_size % 7 - 3 end as dy from n""")
def motion_found(spark, sf):
    """Every second frame is the one before it, moved by whole pixels that its part tells; motion() finds them."""
    moved = frames.motion(moved_clips(spark, sf)).where("dx is not null or frame_idx = 0")
    found = lambda c: F.when(F.col("frame_idx") % 2 == 1, F.round(c).cast("long")).alias(c)
    return moved.select("video_id", "frame_idx", found("dx"), found("dy"))


def moved_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of frames with a pattern of waves from a part's price; the second one is moved."""
    from cinetide.schemas import FRAMES

    by = Window.partitionBy("video_id").orderBy("p_partkey")
    rows = read(spark, sf, "part").select(F.col("p_brand").alias("video_id"), "p_partkey", F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    rows = rows.withColumn("frame_idx", (F.row_number().over(by) - 1).cast("long"))
    odd = F.col("frame_idx") % 2 == 1
    rows = rows.select("video_id", "frame_idx", F.when(odd, F.lag("price").over(by)).otherwise(F.col("price")).alias("price"), F.when(odd, F.col("size") % 5 - 2).otherwise(0).alias("dx"), F.when(odd, F.col("size") % 7 - 3).otherwise(0).alias("dy"))
    rows = frames.dealt(rows, "video_id", "frame_idx")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        y, x = np.mgrid[0:HIGH, 0:WIDE]
        for batch in frames.slices(batches):
            price, dx, dy = (batch.column(c).to_numpy()[:, None, None] for c in ("price", "dx", "dy"))
            u, v = x - dx, y - dy
            wave = np.sin(u * (0.35 + price % 7 / 50) + price) + np.sin(v * (0.4 + price % 11 / 80) - price) + np.sin((u + 2 * v) * 0.21 + price % 3)
            px = np.repeat(np.clip(np.rint(127.5 + wave * 40), 0, 255).astype(np.uint8)[..., None], 3, axis=-1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame_idx"), pa.array(batch.column("frame_idx").to_numpy() * 33_333), pa.array([WIDE] * n, pa.int32()), pa.array([HIGH] * n, pa.int32()), pa.array([p.tobytes() for p in px], pa.binary())], ["video_id", "frame_idx", "pts_us", "width", "height", "px"])

    return rows.mapInArrow(run, FRAMES)


# ---- files of packets ----

#: A supplier's lines as the packets of a clip: two tracks, key frames, video decoded in another order than shown.
_PACKETS = """
select 'clip' || l_suppkey as video_id, case when l_returnflag = 'N' then 'video/avc1' else 'audio/mp4a' end as track,
  (row_number() over (partition by l_suppkey, l_returnflag = 'N' order by l_orderkey, l_linenumber) - 1) * 40000 + case when l_returnflag = 'N' then 0 else 20000 end as dts_us,
  case when l_returnflag = 'N' then (l_linenumber % 3) * 40000 else 0 end as later, l_returnflag <> 'N' or l_linenumber = 1 as is_key,
  l_orderkey || ':' || l_linenumber || repeat('x', cast(l_linenumber * 9 as int)) as body from lineitem"""
_SHOWN = f"select video_id, track, dts_us + later as pts_us, dts_us, is_key, body from ({_PACKETS})"


def _clip_packets(spark, sf):
    rows = read(spark, sf, "lineitem")
    is_video = F.col("l_returnflag") == "N"
    place = F.row_number().over(Window.partitionBy("l_suppkey", is_video).orderBy("l_orderkey", "l_linenumber")) - 1
    rows = rows.select(
        F.concat(F.lit("clip"), "l_suppkey").alias("video_id"), F.when(is_video, "video/avc1").otherwise("audio/mp4a").alias("track"),
        (place * 40_000 + F.when(is_video, 0).otherwise(20_000)).cast("long").alias("dts_us"), F.when(is_video, (F.col("l_linenumber") % 3) * 40_000).otherwise(0).alias("later"),
        (~is_video | (F.col("l_linenumber") == 1)).alias("is_key"), F.concat("l_orderkey", F.lit(":"), "l_linenumber", F.repeat(F.lit("x"), (F.col("l_linenumber") * 9).cast("int"))).alias("data"),
    )
    return rows.withColumn("pts_us", (F.col("dts_us") + F.col("later")).cast("long")).withColumn("data", F.col("data").cast("binary")).drop("later")


def _clip_tracks(packets):
    tracks = packets.select("video_id", "track").distinct()
    is_video = F.col("track").startswith("video")
    size = F.pmod(F.substring("video_id", 5, 9).cast("int"), F.lit(50))
    return tracks.withColumns({"number": F.when(is_video, 1).otherwise(2), "width": F.when(is_video, 160 + size), "height": F.when(is_video, 90 + size), "rotation": F.lit(90), "channels": F.lit(1), "sample_rate": F.lit(44_100)})


def _clip_folder(spark, sf):
    """The folder of the clips' files."""
    packets, path = _clip_packets(spark, sf), shared_folder(spark, "clips")
    mp4.write_packets(packets, _clip_tracks(packets), path)
    return path


def _listed(packets):
    return packets.select("video_id", "track", "pts_us", "dts_us", "is_key", F.md5("data").alias("digest"))


@query(f"select video_id, track, pts_us, dts_us, is_key, md5(body) as digest from ({_SHOWN})")
def mp4_packets(spark, sf):
    return _listed(mp4.read_packets(spark, _clip_folder(spark, sf)))


@query(f"select video_id, track, pts_us - 2000000 as pts_us, dts_us, is_key, md5(body) as digest from ({_SHOWN}) where track = 'audio/mp4a' and pts_us between 2000000 and 9000000")
def mp4_audio_range(spark, sf):
    packets = mp4.read_packets(spark, _clip_folder(spark, sf)).where("track = 'audio/mp4a'")
    return _listed(control.track_range(packets, 2_000_000, 9_000_000, "audio/"))


@query(f"""
with p as ({_SHOWN}), b as (select video_id, coalesce(max(pts_us) filter (track = 'video/avc1' and is_key and pts_us <= 3000000), 0) as base from p group by video_id)
select video_id, track, pts_us - base as pts_us, dts_us - base as dts_us, is_key, md5(body) as digest from p join b using (video_id) where pts_us between base and 8000000""")
def mp4_remuxed(spark, sf):
    source = _clip_folder(spark, sf)
    target = shared_folder(spark, "remuxed")
    mp4.write_packets(mp4.remuxed(mp4.read_packets(spark, source), 3_000_000, 8_000_000), mp4.read_tracks(spark, source).drop("duration_us"), target)
    return _listed(mp4.read_packets(spark, target))


@query(f"""
with p as ({_SHOWN}), t as (select video_id, track, count(*) as n, max(dts_us) - min(dts_us) + case when count(*) > 1 then 40000 else 1 end as us from p group by all),
v as (select video_id, n, us from t where track = 'video/avc1'), l as (select video_id, max(us) as us, bool_or(track = 'audio/mp4a') as has_audio from t group by video_id)
select video_id, cast(160 + cast(video_id[5:] as int) % 50 as int) as width, cast(90 + cast(video_id[5:] as int) % 50 as int) as height, 90 as rotation, cast(floor(l.us / 1000) as bigint) as duration_ms, 'video/avc1' as mime, has_audio,
  cast(case when n * 1e6 / v.us > 120 then 30 when n * 1e6 / v.us > 1 then round(n * 1e6 / v.us, 6) when n * 1e3 / floor(l.us / 1000) > 1 then round(n * 1e3 / floor(l.us / 1000), 6) else 30 end as double) as fps, n as frame_count
from l join v using (video_id)""")
def mp4_probed(spark, sf):
    return mp4.probed_files(mp4.read_tracks(spark, _clip_folder(spark, sf))).withColumn("fps", F.round("fps", 6))


@query(f"""
with p as ({_SHOWN}), e as (select video_id, max(dts_us) + 40000 as us from p where track = 'video/avc1' group by video_id having count(*) > 1),
a as (select video_id, unnest([0, 1, 2]) as point, unnest([cast(floor(us * 0.15::double) as bigint), cast(floor(us * 0.5::double) as bigint), cast(floor(us * 0.85::double) as bigint)]) as at_us from e),
k as (select video_id, point, at_us, pts_us, row_number() over (partition by video_id, point order by abs(pts_us - at_us), pts_us) as place from a join p using (video_id) where track = 'video/avc1' and is_key)
select video_id, point::int as point, at_us, pts_us from k where place = 1""")
def mp4_key_samples(spark, sf):
    path = _clip_folder(spark, sf)
    several = mp4.read_tracks(spark, path).where("samples > 1")
    return mp4.key_samples(mp4.read_packets(spark, path, payload="false"), several).select("video_id", "point", "at_us", "pts_us")


@query("""
with h as (select 'file' || o_orderkey as uri, 'clip ' || o_orderkey as name, case when o_orderkey % 3 > 0 then o_orderstatus end as res, o_custkey as el, o_orderkey * 7 as size, cast(epoch_ms(o_orderdate) as bigint) as ts, o_orderpriority as preset, 'general' as model from orders),
n as (select * from h order by ts desc, uri limit 30)
select uri, name, res, el, size, ts, preset, model, cast(row_number() over (order by ts desc, uri) - 1 as int) as place from n""")
def history_stored(spark, sf):
    """The stored text read again: fields, order and nulls."""
    rows = read(spark, sf, "orders").select(
        F.concat(F.lit("file"), "o_orderkey").alias("uri"), F.concat(F.lit("clip "), "o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("res"),
        F.col("o_custkey").alias("elapsed_s"), (F.col("o_orderkey") * 7).alias("size_bytes"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"), F.col("o_orderpriority").alias("preset"), F.lit("general").alias("model"),
    )
    back = control.history_rows(F.col("json"), control.STORED_TYPES)
    return control.history_json(rows).select(F.posexplode(back).alias("place", "entry")).select("entry.*", "place")


# ---- streams ----


def _drained(df, name):
    """What a stream gives until its source is used up, as a table."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    running = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def _as_stream(rows, name, files=3):
    """Rows written to a folder in a few files, read again one file a batch."""
    path = shared_folder(rows.sparkSession, name)
    rows.repartition(files).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("""
select event_id::varchar as id, case event_type when 'view' then 'queued' when 'click' then 'processing' when 'purchase' then 'done' else 'error' end as stage, round(value / 7, 4) as progress
from events where event_id % 5 <> 0""")
def events_followed(spark, sf):
    """Progress events published as a stream, followed as another; every fifth has a stage that nobody knows."""
    stage = F.when(F.col("event_id") % 5 == 0, "lost").when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "done").otherwise("error")
    rows = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.to_json(F.struct(stage.alias("stage"), F.round(F.col("value") / 7, 4).alias("progress"))).alias("data"))
    path = shared_folder(spark, "published")
    events.publish(_as_stream(rows, "progress"), f"{path}/log", f"{path}/state").awaitTermination()
    return _drained(events.progress(events.follow(spark, f"{path}/log")), "followed").select("id", "stage", "progress")


#: A session lasts 26 hours; each service registers with its first event of a day.
_LIMIT_MS = 26 * 3_600_000
_REGISTRATIONS = f"""
select 'service' || user_id % 40 as service, (epoch_us(ts) // 1000) as at_ms, event_id as seq, case when event_id % 6 = 0 then 0 else (epoch_us(ts) // 1000) - (event_id % 9) * 20000000 end as mine,
  event_id % 13 = 0 as force, event_id % 7 > 0 as is_tunnel from events
qualify row_number() over (partition by user_id % 40, ts::date order by ts, event_id) = 1"""


@query(f"""
with recursive e as (select *, row_number() over (partition by service order by at_ms, seq) as n from ({_REGISTRATIONS})),
r as (select service, 0::bigint as n, null::bigint as cur, null::bigint as since, null::bigint as seq, null::bigint as at_ms, null::boolean as accepted, null::bigint as ended from e group by 1
  union all select service, n, case when accepted then case when mine = 0 then at_ms else mine end else cur end, case when accepted then at_ms else since end, seq, at_ms, accepted, ended from (
    select e.*, r.since + {_LIMIT_MS} <= e.at_ms as over, case when r.since + {_LIMIT_MS} <= e.at_ms then r.since + {_LIMIT_MS} end as ended, case when over then null else r.cur end as cur, case when over then null else r.since end as since,
      not (coalesce(case when over then null else r.cur end, 0) > 0 and not e.force and e.is_tunnel and e.mine < r.cur) as accepted
    from r join e on e.service = r.service and e.n = r.n + 1)),
last as (select service, max_by(since, n) as since from r group by 1)
select service, at_ms, seq, case when accepted then 'ACCEPTED' else 'REJECTED' end as event from r where n > 0
union all select service, ended, -1, 'EXPIRED' from r where ended is not null
union all select service, since + {_LIMIT_MS}, -1, 'EXPIRED' from last where since is not null""")
def sessions_decided(spark, sf):
    """Registrations as a stream, decided in order of time by timers, and the ends of sessions."""
    at = F.col("ts").cast("timestamp")
    start = F.when(F.col("event_id") % 6 == 0, F.lit(None).cast("bigint")).otherwise(F.unix_millis(at) - (F.col("event_id") % 9) * 20_000_000)
    day = read(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("of"), F.to_date("ts").alias("day")).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    rows = day.select("of", "first.*").select(
        F.concat(F.lit("service"), F.col("of").cast("string")).alias("service"), at.alias("at"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("host"),
        start.alias("session_start"), (F.col("event_id") % 13 == 0).alias("force"), (F.col("event_id") % 7 > 0).alias("is_tunnel"),
    )
    span = rows.agg((F.unix_seconds(F.max("at")) - F.unix_seconds(F.min("at")) + 60).alias("s")).first()["s"] or 60
    path = shared_folder(spark, "registrations")
    rows.repartition(3).write.parquet(path)
    for k in (1, 2):  # what comes years later brings the watermark past all else
        late = rows.agg(F.max("at").alias("at")).select(F.lit("end").alias("service"), (F.col("at") + F.make_interval(F.lit(10 * k))).alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit("end").alias("host"), F.lit(0).cast("bigint").alias("session_start"), F.lit(True).alias("force"), F.lit(True).alias("is_tunnel"))
        late.coalesce(1).write.mode("append").parquet(path)
    sessions.with_timers(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _drained(sessions.live(stream, f"{span} seconds", _LIMIT_MS), "decided").where("service <> 'end'").select("service", "at_ms", "seq", "event")
