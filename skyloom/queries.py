"""Queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom import schema, shared
from skyloom.functions import pixels, timefmt
from skyloom.operators import container, fold, keogram, manifest, norm, stats, timeaxis, video, zones
from skyloom.plans import pipelines
from skyloom.sources import camera, raw, sinks
from skyloom.streaming import keograms, ordered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FRAMES = """frames as (select vec_id as frame_idx, cast(1704067200 as double) + vec_id * cast(7.5 as double) as ut,
    [cast(floor((cast(x as double) + 1) * 1000) as integer) for x in embedding] as px from embeddings)"""
SLICES = """slices as (select frame_idx, ut, pos, px[1 + 8 * pos + 4] as ns, px[1 + 32 + pos] as ew from (select *, unnest(range(8)) as pos from frames))"""
TICKS = """ticks as (select event_type as rec_id, row_number() over (partition by event_type order by ts, event_id) - 1 as frame_idx, epoch_us(ts) / 1e6 as ut,
    cast(floor("value" * 100) as integer) as bright from events)"""
RANGES = "ranges as (select rec_id, count(*) as n, min_by(ut, frame_idx) as start, max_by(ut, frame_idx) as stop from ticks group by rec_id)"
DT = "dts as (select rec_id, median(d) as dt from (select rec_id, ut - lag(ut) over (partition by rec_id order by frame_idx) as d from ticks) where d is not null group by rec_id)"
#: The nearest frame for ``sought`` (rec_id, t and others) among ``source``.
NEAREST = """axis as (select rec_id, ut, min(frame_idx) as first_idx, max(frame_idx) as last_idx from source group by all),
    near as (select k.*, case when l.ut is null then coalesce(r.first_idx, 0) when r.ut is null then l.last_idx when abs(l.ut - k.t) <= abs(r.ut - k.t) then l.last_idx else r.first_idx end as idx
    from sought k asof left join axis l on k.rec_id = l.rec_id and k.t > l.ut asof left join axis r on k.rec_id = r.rec_id and k.t <= r.ut)"""
BOUNDS = """bounds as (select rec_id, row_number() over (partition by rec_id order by part, b) - 1 as seq, b as t from (
    select rec_id, 0 as part, start as b from ranges where floor(start % 3600) <> 0
    union all select rec_id, 1, b from (select rec_id, stop, unnest([f + i * 3600 for i in range(0, cast(greatest(0, ceil((stop - f) / 3600)) as bigint) + 1)]) as b
        from (select rec_id, stop, case when floor(start % 3600) = 0 then start else floor(start / 3600) * 3600 + 3600 end as f from ranges)) where b < stop
    union all select rec_id, 2, stop from ranges))"""
SEGMENTS = """sought as (select rec_id, seq, t from bounds),
    """ + NEAREST + """, segments as (select * from (select rec_id, seq as seg, idx as s, lead(idx) over (partition by rec_id order by seq) as e from near) where e is not null)"""
FRAME_SOURCE = """ticks as (select 'sky' as rec_id, frame_idx, ut from frames), """ + RANGES + """, """ + BOUNDS + """, source as (select * from ticks), """ + SEGMENTS
TICK_SOURCE = TICKS + ", " + RANGES + ", " + BOUNDS + ", source as (select * from ticks), " + SEGMENTS


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


# -- hour keograms ---------------------------------------------------------------

HOURLY = "with {f}, {s} select 'sky' as rec_id, floor(ut / 3600) * 3600 as hour, cast(floor((ut - floor(ut / 3600) * 3600) / 60) as bigint) as bin, pos, round(sum({a}) / count({a}), 6) as mean from slices group by all"


@query(HOURLY.format(f=FRAMES, s=SLICES, a="ew"))
def keogram_hourly_ew(spark, sf_dir):
    return rounded(keogram.by_hour(schema.frames(spark, sf_dir), "ew"), "mean")


@query(HOURLY.format(f=FRAMES, s=SLICES, a="ns"))
def keogram_hourly_ns(spark, sf_dir):
    return rounded(keogram.by_hour(schema.frames(spark, sf_dir), "ns"), "mean")


@query(f"""with {FRAMES}, {SLICES}, means as (select floor(ut / 3600) * 3600 as hour, cast(floor((ut - floor(ut / 3600) * 3600) / 60) as bigint) as bin, pos, round(sum(ew) / count(ew), 6) as mean from slices group by all)
    select 'sky' as rec_id, hour, bin, pos, mean from (select hour, bin, unnest(range(8)) as pos from (select hour, unnest(range(60)) as bin from (select distinct hour from means))) left join means using (hour, bin, pos)""")
def keogram_gapfill(spark, sf_dir):
    return rounded(keogram.gap_fill(keogram.by_hour(schema.frames(spark, sf_dir), "ew"), 60, 8), "mean")


BY_SEGMENT = f"""with {FRAMES}, {SLICES}, {FRAME_SOURCE}, hours as (select s.*, floor(t.ut / 3600) * 3600 as hour from segments s join ranges r using (rec_id) join ticks t on t.frame_idx = least(s.s + {{ahead}}, r.n - 1))
    select 'sky' as rec_id, seg, cast(floor((ut - hour) / 60) as bigint) as bin, pos, round(sum(ns) / count(ns), 6) as mean from slices f join hours h on f.frame_idx >= h.s and f.frame_idx < h.e where ut >= hour and ut < hour + 3600 group by all"""


def _by_segment(ahead: int):
    def found(spark, sf_dir):
        frames = schema.frames(spark, sf_dir)
        slim = frames.select("rec_id", "frame_idx", "ut")
        return rounded(keogram.by_segment(frames, timeaxis.clock_hours(slim, timeaxis.hour_segments(slim), ahead), "ns"), "mean")

    return found


query(BY_SEGMENT.format(ahead=10), "keogram_segments")(_by_segment(10))
query(BY_SEGMENT.format(ahead=500), "keogram_segments_lookahead_500")(_by_segment(500))


# -- histograms and limits ---------------------------------------------------------

HISTOGRAM = "hist as (select v, count(*) as n from (select unnest(px) as v from frames) where v > 0 group by v)"


@query(f"with {FRAMES}, {HISTOGRAM} select 'sky' as rec_id, v, n from hist")
def pixel_histogram(spark, sf_dir):
    return norm.pixel_histogram(schema.frames(spark, sf_dir))


@query(f"with {FRAMES}, {HISTOGRAM} select 'sky' as rec_id, v, n, cast(sum(n) over (order by v) as bigint) as cum from hist")
def pixel_cdf(spark, sf_dir):
    return norm.cumulative(norm.pixel_histogram(schema.frames(spark, sf_dir)))


SAMPLE = """span as (select count(*) as total, cast(trunc((max_by(ut, frame_idx) - min_by(ut, frame_idx)) / 60) as bigint) as m from frames),
    sample as (select k, case when k = m - 1 and m > 1 then total - 1 else cast(floor(k * ((total - 1) / greatest(m - 1, 1))) as bigint) end as frame_idx from (select unnest(range(m)) as k, m, total from span))"""
LIMITS = f"""with {FRAMES}, {SAMPLE}, hist as (select v, count(*) as n from (select unnest(px) as v from frames join sample using (frame_idx)) where v > 0 group by v),
    cdf as (select v, sum(n) over (order by v) as cum, sum(n) over () as total from hist)
    select 'sky' as rec_id, {{low}} as vmin, cast(min(v) filter (where cum >= total * 99.9 / 100) as double) as vmax, '{{kind}}' as kind from cdf"""
LOW = "cast(min(v) filter (where cum >= total * 0.1 / 100) as double)"


@query(LIMITS.format(low=f"greatest({LOW}, 1e-6)", kind="log"))
def norm_log(spark, sf_dir):
    return norm.norm(schema.frames(spark, sf_dir), 60.0, 0.1, 99.9)


@query(LIMITS.format(low=LOW, kind="linear"))
def norm_linear(spark, sf_dir):
    return norm.norm(schema.frames(spark, sf_dir), 60.0, 0.1, 99.9, linear=True)


@query(f"with {FRAMES}, {SAMPLE} select 'sky' as rec_id, k, frame_idx from sample")
def sample_linspace(spark, sf_dir):
    ranges = timeaxis.time_range(schema.frames(spark, sf_dir)).withColumn("s", F.lit(0).cast("long")).withColumn("e", F.col("n") - 1)
    return norm.sample_index(ranges, 60.0)


@query(f"""with {FRAMES}, ends as (select min(v) as lo, max(v) as hi from (select unnest(px) as v from frames) where v > 0)
    select 'sky' as rec_id, frame_idx, [least(255, greatest(0, cast(floor(256 * (v - lo) / (hi - lo)) as integer))) for v in px] as gray from frames, ends""")
def frame_to_gray(spark, sf_dir):
    frames = schema.frames(spark, sf_dir)
    ends = norm.pixel_histogram(frames).groupBy("rec_id").agg(F.min("v").cast("double").alias("vmin"), F.max("v").cast("double").alias("vmax"))
    return video.gray_frames(frames, ends, "linear")


@query(f"""with {FRAMES}, {FRAME_SOURCE}, hist as (select seg, v, count(*) as n from (select seg, unnest(px) as v from frames f join segments on f.frame_idx between s and e) where v > 0 group by all),
    cdf as (select seg, v, sum(n) over (partition by seg order by v) as cum, sum(n) over (partition by seg) as total from hist)
    select 'sky' as rec_id, seg, greatest(cast(min(v) filter (where cum >= total * 1.0 / 100) as double), 1e-6) as vmin, cast(min(v) filter (where cum >= total * 99.0 / 100) as double) as vmax, 'log' as kind from cdf group by seg""")
def norm_by_hour(spark, sf_dir):
    """The limits of every hour, from one tree of histograms."""
    frames = schema.frames(spark, sf_dir)
    hours = timeaxis.hour_segments(frames.select("rec_id", "frame_idx", "ut"))
    found = norm.range_histograms(norm.histogram_tree(frames, 16), frames, hours.select("rec_id", F.col("seg").alias("name"), "s", "e"))
    return norm.limits(found, keys=("rec_id", "name")).withColumnRenamed("name", "seg")


# -- time axis ------------------------------------------------------------------


NEAREST_FRAME = f"""with {TICKS}, source as (select * from ticks), sought as (select rec_id, frame_idx as asked, ut + (frame_idx % 7) * 60.5 - 100 as t from ticks), {NEAREST}
    select rec_id, round(t, 6) as key, asked, idx from near"""


@query(NEAREST_FRAME)
def nearest_frame(spark, sf_dir):
    return rounded(timeaxis.nearest(schema.ticks(spark, sf_dir).select("rec_id", "frame_idx", "ut"), _keys(spark, sf_dir)), "key")


@query(NEAREST_FRAME.replace("asked, idx from near", "asked, idx, round(ut, 6) as at from near join ticks using (rec_id) where ticks.frame_idx = idx"))
def nearest_frame_all(spark, sf_dir):
    """The same with the time of what was found."""
    return rounded(timeaxis.nearest(schema.ticks(spark, sf_dir).select("rec_id", "frame_idx", "ut"), _keys(spark, sf_dir), with_time=True), "key", "at")


def _keys(spark, sf_dir):
    return schema.ticks(spark, sf_dir).select("rec_id", F.col("frame_idx").alias("asked"), (F.col("ut") + (F.col("frame_idx") % 7) * F.lit(60.5) - 100).alias("key"))


def _zones(spark, sf_dir):
    """Ticks as stored recordings, in row groups of about a hundred."""
    place = shared.folder(spark)
    sinks.write_recording(schema.ticks(spark, sf_dir), place, slices=False, group_bytes=1024)
    return zones.stored(spark, place)


@query(NEAREST_FRAME)
def nearest_stored(spark, sf_dir):
    """The same through the recordings' row groups."""
    return rounded(zones.nearest(_zones(spark, sf_dir), _keys(spark, sf_dir)).found, "key")


@query(f"""with {TICKS}, source as (select * from ticks), pairs as (select event_type as rec_id, user_id, min(epoch_us(ts)) / 1e6 + 0.7 as a, max(epoch_us(ts)) / 1e6 + 0.2 as b from events group by all),
    sought as (select rec_id, user_id, 'start' as which, floor(a) as t from pairs union all select rec_id, user_id, 'stop', floor(b) from pairs), {NEAREST}
    select rec_id, user_id, max(idx) filter (where which = 'start') as s, max(idx) filter (where which = 'stop') as e from near group by all""")
def range_lookup(spark, sf_dir):
    ut = schema.epoch("ts")
    events = schema.read(spark, sf_dir, "events").select(F.col("event_type").alias("rec_id"), "user_id", ut.alias("ut"))
    pairs = events.groupBy("rec_id", "user_id").agg((F.min("ut") + 0.7).alias("a"), (F.max("ut") + 0.2).alias("b"))
    keys = pairs.select("rec_id", "user_id", F.inline(F.array(F.struct(F.lit("start").alias("which"), F.col("a").alias("key")), F.struct(F.lit("stop").alias("which"), F.col("b").alias("key")))))
    found = timeaxis.nearest(schema.ticks(spark, sf_dir).select("rec_id", "frame_idx", "ut"), keys, whole_seconds=True)
    at = lambda w: F.max(F.when(F.col("which") == w, F.col("idx")))
    return found.groupBy("rec_id", "user_id").agg(at("start").alias("s"), at("stop").alias("e"))


def _dt(spark, sf_dir):
    return timeaxis.native_dt(schema.ticks(spark, sf_dir))


@query(f"with {TICKS}, {DT} select rec_id, round(dt, 6) as dt from dts")
def native_dt(spark, sf_dir):
    return rounded(_dt(spark, sf_dir), "dt")


@query(f"with {TICKS}, {DT} select rec_id, round(15 / (dt * 5), 9) as fps, round(0.5 * dt * 5, 6) as speed from dts")
def solve_fps(spark, sf_dir):
    dt = F.col("dt")
    return _dt(spark, sf_dir).select("rec_id", F.round(timeaxis.fps(dt, F.lit(5), F.lit(15.0)), 9).alias("fps"), F.round(F.lit(0.5) * dt * 5, 6).alias("speed"))


@query(f"with {TICKS}, {DT} select rec_id, greatest(1, cast(round_even(15000 / (0.5 * dt), 0) as bigint)) as bin_size from dts")
def solve_bin_size(spark, sf_dir):
    return _dt(spark, sf_dir).select("rec_id", timeaxis.bin_size(F.col("dt"), F.lit(0.5), F.lit(15000.0)).alias("bin_size"))


@query(f"with {TICKS}, {DT}, s as (select rec_id, greatest(1, cast(round_even((1 / 0.0001) / dt, 0) as bigint)) as stride from dts) select rec_id, stride, cast(0.0001 * 15000 as double) as fps, 5 <= stride as valid from s")
def stride_plan(spark, sf_dir):
    return _dt(spark, sf_dir).select("rec_id", timeaxis.stride(F.col("dt"), F.lit(0.0001)).alias("stride")).select("rec_id", "stride", F.lit(0.0001 * 15000).alias("fps"), (F.col("stride") >= 5).alias("valid"))


@query(f"""with {TICKS}, {RANGES}, w as (select rec_id, n, greatest(1, cast(trunc((stop - start) / 7200) as bigint)) as wished from ranges), p as (select rec_id, n, greatest(1, n // wished) as per from w)
    select rec_id, cast(ceil(n / per) as bigint) as n_bins, cast(per as bigint) as frames_per_bin from p""")
def keogram_bin_plan(spark, sf_dir):
    return timeaxis.count_bins(timeaxis.time_range(schema.ticks(spark, sf_dir)), 7200.0)


# -- segments --------------------------------------------------------------------


@query(f"with {TICKS}, {RANGES}, {BOUNDS} select rec_id, seq, round(t, 6) as boundary from bounds")
def hour_boundaries(spark, sf_dir):
    return rounded(timeaxis.hour_boundaries(timeaxis.time_range(schema.ticks(spark, sf_dir))), "boundary")


@query(f"with {TICK_SOURCE} select rec_id, seg, s, e from segments")
def hour_segments(spark, sf_dir):
    return timeaxis.hour_segments(schema.ticks(spark, sf_dir).select("rec_id", "frame_idx", "ut")).select("rec_id", "seg", "s", "e")


@query(f"with {TICK_SOURCE} select rec_id, seg, s, e from segments")
def hour_segments_stored(spark, sf_dir):
    """Segments whose boundaries are looked up in the row groups they fall into."""
    held = shared.written(_zones(spark, sf_dir))
    keys = timeaxis.hour_boundaries(zones.time_range(held)).withColumnRenamed("boundary", "key")
    return timeaxis.segments_of(zones.nearest(held, keys, with_time=True).found).select("rec_id", "seg", "s", "e")


@query(f"with {TICK_SOURCE} select s.rec_id, seg, s, e, floor(ut / 3600) * 3600 as hour from segments s join ranges using (rec_id) join ticks t on t.rec_id = s.rec_id and t.frame_idx = least(s.s + 10, n - 1)")
def segment_clock_hour(spark, sf_dir):
    ticks = schema.ticks(spark, sf_dir).select("rec_id", "frame_idx", "ut")
    return timeaxis.clock_hours(ticks, timeaxis.hour_segments(ticks), 10).select("rec_id", "seg", "s", "e", "hour")


# -- videos ----------------------------------------------------------------------

BINS = f"with {FRAMES}, {FRAME_SOURCE}, binned as (select seg, (frame_idx - s) // 5 as bin, f.frame_idx, f.ut, px from frames f join segments on f.frame_idx between s and e)"
STRIDED = f"with {FRAMES}, {FRAME_SOURCE}, binned as (select seg, (frame_idx - s) // 12 as bin, f.frame_idx, f.ut, px from frames f join segments on f.frame_idx >= s and f.frame_idx < e where (frame_idx - s) % 12 < 5)"
PIXELS = " select 'sky' as rec_id, seg, bin, pos, round(avg(v), 6) as px_mean from (select seg, bin, unnest(px) as v, unnest(range(64)) as pos from binned) group by all"


def _binned(spark, sf_dir, stride=None):
    frames = schema.frames(spark, sf_dir)
    return video.bins(frames, timeaxis.hour_segments(frames.select("rec_id", "frame_idx", "ut")), 5, stride, closed=stride is None)


@query(BINS + PIXELS)
def video_bins(spark, sf_dir):
    return rounded(video.pixel_means(_binned(spark, sf_dir)), "px_mean")


@query(STRIDED + PIXELS)
def video_bins_strided(spark, sf_dir):
    return rounded(video.pixel_means(_binned(spark, sf_dir, 12)), "px_mean")


@query(BINS + " select 'sky' as rec_id, seg, bin, count(*) as n_frames, round(avg(ut), 6) as t_mean, strftime(make_timestamp(cast(floor(avg(ut)) * 1000000 as bigint)), '%Y-%m-%d %H:%M:%S UTC') as label from binned group by seg, bin")
def video_labels(spark, sf_dir):
    return rounded(video.times(_binned(spark, sf_dir)), "t_mean")


# -- count keograms -----------------------------------------------------------------


@query(f"""with {FRAMES}, {SLICES}, r as (select count(*) as n, max_by(ut, frame_idx) - min_by(ut, frame_idx) as span from frames), p as (select greatest(1, n // greatest(1, cast(trunc(span / 100) as bigint))) as per from r)
    select 'sky' as rec_id, frame_idx // per as bin, pos, round(sum(ns) / count(ns), 6) as mean from slices, p group by all""")
def keogram_count(spark, sf_dir):
    return rounded(pipelines.whole_keogram(schema.frames(spark, sf_dir), "ns", 100.0).keograms, "mean")


@query(f"""with {FRAMES}, {SLICES}, r as (select cast(ceil(count(*) / 20) as bigint) - 1 as blocks from frames)
    select 'sky' as rec_id, frame_idx // 20 as bin, pos, round(sum(ew) / count(ew), 6) as mean from slices, r where frame_idx % 20 < 8 and frame_idx // 20 < blocks group by all""")
def keogram_rough(spark, sf_dir):
    return rounded(keogram.rough(schema.frames(spark, sf_dir), "ew", 20, spark.range(1).select(F.lit("sky").alias("rec_id"), F.lit(8).alias("frames_per_bin"))), "mean")


# -- statistics -------------------------------------------------------------------

STATS = "stats as (select frame_idx, list_max(px) as px_max, cast(list_sum(px) as bigint) as px_sum, len(px) as n_px, list_sum(px) / len(px) as px_mean from frames)"


@query(f"with {FRAMES}, {STATS} select 'sky' as rec_id, frame_idx, px_max, px_sum, n_px, round(px_mean, 6) as px_mean from stats")
def frame_stats(spark, sf_dir):
    return rounded(stats.frame_stats(schema.frames(spark, sf_dir)), "px_mean")


@query(f"""with {FRAMES}, {STATS}, d as (select *, abs(px_mean - lag(px_mean) over (order by frame_idx)) as step from stats)
    select 'sky' as rec_id, count(*) as frame_count, cast(greatest(max(px_max), 0) as double) as max_brightness, round(sum(px_sum) / sum(n_px), 6) as mean_brightness, round(stddev_pop(px_mean), 6) as brightness_std, round(avg(step), 6) as motion from d""")
def recording_stats(spark, sf_dir):
    return rounded(stats.recording_stats(stats.frame_stats(schema.frames(spark, sf_dir))), "mean_brightness", "brightness_std", "motion")


@query(f"with {TICKS}, {RANGES} select rec_id, n, round(start, 6) as start, round(stop, 6) as stop from ranges")
def recording_time_range(spark, sf_dir):
    return rounded(timeaxis.time_range(schema.ticks(spark, sf_dir)), "start", "stop")


@query(f"with {TICKS}, {RANGES} select rec_id, strftime(make_timestamp(cast(floor(ut) * 1000000 as bigint)), '%Y-%m-%d') as date from ticks join ranges using (rec_id) where frame_idx = n // 2")
def mid_date(spark, sf_dir):
    return stats.mid_date(schema.ticks(spark, sf_dir))


# -- strings, names, ticks ---------------------------------------------------------


@query(f"""with {TICKS}, t as (select rec_id, frame_idx, ut, make_timestamp(cast(floor(ut) * 1000000 as bigint)) as ts from ticks)
    select rec_id, frame_idx, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') as label, strftime(ts, '%Y%m%d') as day, strftime(ts, '%H-%M-%S') as clock, floor(ut / 3600) * 3600 as hour, round((ut % 86400) / 3600, 6) as day_hours from t""")
def time_strings(spark, sf_dir):
    ut = F.col("ut")
    return schema.ticks(spark, sf_dir).select("rec_id", "frame_idx", timefmt.label(ut).alias("label"), timefmt.utc(ut, "yyyyMMdd").alias("day"), timefmt.utc(ut, "HH-mm-ss").alias("clock"), timefmt.hour_of(ut).alias("hour"), F.round(timefmt.hours_of_day(ut), 6).alias("day_hours"))


@query(f"""with {TICK_SOURCE}, e as (select s.*, a.ut as ua, b.ut as ub from segments s join ticks a on a.rec_id = s.rec_id and a.frame_idx = s join ticks b on b.rec_id = s.rec_id and b.frame_idx = e)
    select rec_id, seg, rec_id || '_CamSer42_' || strftime(make_timestamp(cast(floor(ua) * 1000000 as bigint)), '%H-%M-%S') || '_' || strftime(make_timestamp(cast(floor(ub) * 1000000 as bigint)), '%H-%M-%S') || '.mp4' as video,
    'CamSer42_' || strftime(make_timestamp(cast(floor(ua) * 1000000 as bigint)), '%Y%m%d') || '_' || seg || '.png' as image, rec_id || '_CamSer42.png' as keogram from e""")
def output_names(spark, sf_dir):
    ticks = schema.ticks(spark, sf_dir).select("rec_id", "frame_idx", "ut")
    found = timeaxis.hour_segments(ticks)
    path = F.concat(F.lit("/data/HDF/x/"), F.col("rec_id"), F.lit("_CamSer42.h5"))
    return found.select("rec_id", "seg", sinks.video_name(timefmt.stem(path), F.col("us"), F.col("ue")).alias("video"), sinks.hourly_name(path, F.col("us"), F.col("seg"), ".png").alias("image"), F.regexp_extract(timefmt.with_suffix(path, ".png"), r"[^/]+$", 0).alias("keogram"))


@query(f"""with {TICKS}, {RANGES}, ends as (select rec_id, (start % 86400) / 3600 as a, (stop % 86400) / 3600 as b from ranges),
    steps as (select rec_id, a, b, [x for x in [ceil(a / (1 / 6)) * (1 / 6) + i * (1 / 6) for i in range(0, 200)] if x < b - 1e-12] as s from ends),
    kept as (select rec_id, a, b, [x for x, i in s if not ((i = 1 and abs(x - a) < 1 / 30) or (i = len(s) and abs(b - x) < 1 / 30))] as s from steps),
    every as (select rec_id, list_concat(list_concat([a], s), [b]) as t from kept)
    select rec_id, seq, round(tick, 6) as tick, printf('%02d:%02d', cast(floor(tick) as bigint) % 24, cast(least(round_even((tick - floor(tick)) * 60, 0), 59) as bigint)) as label from (select rec_id, unnest(range(len(t))) as seq, unnest(t) as tick from every)""")
def axis_ticks(spark, sf_dir):
    ends = timeaxis.time_range(schema.ticks(spark, sf_dir)).select("rec_id", timefmt.hours_of_day(F.col("start")).alias("a"), timefmt.hours_of_day(F.col("stop")).alias("b"))
    return rounded(keogram.axis_ticks(ends), "tick")


# -- manifests and logs -------------------------------------------------------------

SHEET = """sheet as (select event_id as line, case when event_id % 11 = 0 then 'n/a' when event_id % 5 = 0 then ' ' || strftime(ts, '%Y-%m-%d') || ' ' else strftime(ts, '%Y-%m-%d') end as date,
    case when event_id % 7 = 0 then '' when event_id % 13 = 0 then 'noon' else strftime(ts, '%H:%M:%S') end as start_time, case when event_id % 3 = 0 then user_id || '.0' else ' ' || user_id end as cam_ser, event_id % 4 = 0 as processed from events),
    lines as (select line, processed, try_cast(case when trim(date) ~ '^\\d{4}-\\d\\d-\\d\\d$' then trim(date) end as date) as day, case when start_time ~ '^\\d\\d:\\d\\d:\\d\\d$' then cast(start_time[1:2] as integer) * 3600 + cast(start_time[4:5] as integer) * 60 + cast(start_time[7:8] as integer) end as start_sec,
    regexp_replace(trim(cam_ser), '\\.0$', '') as cam, start_time from sheet),
    coerced as (select line, processed, case when day is null then 'bad date' when start_sec is null and start_time <> '' then 'bad time' else '' end as error, day, start_sec, cam from lines)"""
SHEET = SHEET.replace("\\\\", "\\")
FILES = """files as (select '/data/HDF/' || strftime(ts, '%Y-%m-%d') || '/' || user_id || '/CamSer' || user_id || '_' || event_id || case when event_id % 10 = 1 then '.png' else '.h5' end as path, cast(ts as date) as day, cast(user_id as varchar) as cam from events where event_id % 6 <> 0),
    folders as (select day, cam, count(*) as n_files, min(path) as one from files where path like '%.h5' group by all)"""
LOCATED = f"""{SHEET}, {FILES}, located as (select c.line, c.processed, c.day, c.start_sec, c.cam, case when n_files = 1 then one end as path,
    case when error <> '' then error when n_files is null then 'no file' when n_files > 1 then 'several files' else '' end as error from coerced c left join folders f on c.day = f.day and c.cam = f.cam)"""


#: A line's columns in results.
LINES = ["line", "processed", "error", "cast(day as string) as day", "start_sec", "cam"]


def _coerced(spark, sf_dir):
    return manifest.coerce(schema.manifest(spark, sf_dir))


@query(f"with {SHEET} select line, processed, error, cast(day as varchar) as day, start_sec, cam, round(epoch(cast(day as timestamp)) + start_sec, 3) as start from coerced")
def coerce_manifest(spark, sf_dir):
    return _coerced(spark, sf_dir).withColumn("start", F.round(manifest.start_of(F.col("day"), F.col("start_sec")), 3)).selectExpr(*LINES, "start")


@query(f"with {SHEET} select line, processed, error, cast(day as varchar) as day, start_sec, cam from coerced where not processed")
def pending_work(spark, sf_dir):
    return manifest.pending(_coerced(spark, sf_dir)).selectExpr(*LINES)


@query(f"with {LOCATED} select line, processed, cast(day as varchar) as day, start_sec, cam, path, error from located")
def manifest_join(spark, sf_dir):
    return manifest.locate(_coerced(spark, sf_dir), schema.listing(spark, sf_dir)).selectExpr(*LINES, "path")


@query(f"with {LOCATED} select error, count(*) as lines, count(distinct cam) as cameras, count(path) as found from located where not processed group by error")
def batch_status(spark, sf_dir):
    located = manifest.locate(manifest.pending(_coerced(spark, sf_dir)), schema.listing(spark, sf_dir))
    return located.groupBy("error").agg(F.count("*").alias("lines"), F.countDistinct("cam").alias("cameras"), F.count("path").alias("found"))


@query(f"""with {FILES}, done as (select distinct regexp_extract(path, '([^/]*)\\.png$', 1) as stem from files where path like '%.png') select path, regexp_extract(path, '([^/]*)\\.h5$', 1) as stem from files where path like '%.h5'
    and regexp_extract(path, '([^/]*)\\.h5$', 1) not in (select stem from done)""")
def undone_files(spark, sf_dir):
    files = schema.listing(spark, sf_dir)
    return manifest.undone(files.where(F.col("path").endswith(".h5")), files).select("path", "stem")


@query("""with l as (select cast(user_id as varchar) as path, event_id, event_type = 'click' as said, event_id % 3 = 0 as marked, ts from events),
    f as (select path, min_by(event_id, event_id) filter (where said) as first_id from l group by path)
    select f.path, case when not marked then strftime(ts, '%Y-%m-%d %H:%M:%S.%f') end as start, case when first_id is null then 'no start line' when marked then 'no time' end as problem from f left join l on l.event_id = f.first_id""")
def log_start_time(spark, sf_dir):
    return camera.log_start(schema.log_lines(spark, sf_dir)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# -- raw frames and streams ---------------------------------------------------------


@query(f"with {FRAMES} select printf('%08d', frame_idx) as rec_id, 0 as frame_idx, cast(5.0 as double) as ut, px from frames")
def raw_frames_decode(spark, sf_dir):
    frames = schema.frames(spark, sf_dir)
    files = frames.select(F.concat(F.lit("/raw/"), F.lpad(F.col("frame_idx").cast("string"), 8, "0"), F.lit(".DMCdata")).alias("path"), F.concat(pixels.as_unsigned_16(F.col("px")), F.unhex(F.lit("00000000"))).alias("content"))
    camera_of = {"header_bytes": 4, "horiz_pixels": 8, "vert_pixels": 8, "kinetic_sec": 1.0, "start_utc": 6.0}
    given = schema.CAMERA_DEFAULTS | camera_of
    params = files.select("path", "content", *[F.lit(given[f.name]).cast(f.dataType).alias(f.name) for f in schema.CAMERA])
    return camera.raw_frames(params).select("rec_id", "frame_idx", "ut", "px")


@query(f"with {FRAMES}, {SLICES} select 'sky' as rec_id, floor(ut / 60) * 60 as start, pos, round(sum(ew) / count(ew), 6) as mean from slices group by all")
def stream_keogram(spark, sf_dir):
    place = shared.folder(spark)
    stream = keograms.frame_stream(spark, f"{sf_dir}/embeddings.parque[t]", schema.read(spark, sf_dir, "embeddings").schema, schema.as_frames)
    return rounded(keograms.run_to_end(keograms.means(stream, "ew"), f"{place}/out", f"{place}/state"), "mean")


RAW = f"""with {FRAMES}, raw as (select 'x_CamSer' || printf('%06d', frame_idx // 10) as rec_id, frame_idx % 10 as frame_idx, frame_idx + 70000 as raw_idx, 1365663601 + (frame_idx + 70000 - 1) * cast(0.5 as double) as ut, px from frames)"""


def _raw(spark, sf_dir):
    files, xml, nmea = schema.raw_files(spark, sf_dir)
    return camera.raw_frames(camera.with_params(files, camera.xml_params(xml), camera.nmea_start(nmea), {"kinetic_sec": 9.0, "rot_ccw": 90}, {"flip_lr": True}))


@query(RAW + " select rec_id, frame_idx, raw_idx, ut, 16 as height, 4 as width, [px[1 + (3 - p % 4) * 16 + 15 - p // 4] for p in range(64)] as px from raw")
def raw_to_frames(spark, sf_dir):
    """Raw files with metadata and position texts: numbers from headers, camera binning, a quarter turn and a flip."""
    return _raw(spark, sf_dir)


@query(RAW + " select rec_id, min(raw_idx) as first_raw, max(raw_idx) as last_raw, count(*) as n from raw group by rec_id")
def raw_index_range(spark, sf_dir):
    return camera.raw_ranges(_raw(spark, sf_dir))


STORED = f"""with {FRAMES}, raw as (select 'x_CamSer' || printf('%06d', frame_idx // 100) as rec_id, frame_idx % 100 as frame_idx, frame_idx + 70000 + 3 * (frame_idx // 50) as raw_idx, px from frames)"""
STORED_ROWS = " select rec_id, frame_idx, raw_idx, 1365663601 + (raw_idx - 1) * cast(0.5 as double) as ut, 4 as height, 16 as width, px from raw"


def _stored(spark, sf_dir, **options):
    """Raw files of a hundred frames in folders, read by ranges of 4,096 bytes."""
    place = shared.folder(spark)
    files, xml, nmea = schema.raw_files(spark, sf_dir, 100, 3)
    texts = xml.unionByName(nmea).select("path", F.encode("value", "utf-8").alias("content"))
    raw.write_files(files.unionByName(texts), place).write.format("noop").mode("overwrite").save()
    return raw.frames(spark, place, split_bytes=4096, **options).drop("path")


@query(STORED + STORED_ROWS)
def raw_by_ranges(spark, sf_dir):
    return _stored(spark, sf_dir)


@query(STORED + STORED_ROWS + " where raw_idx between 70120 and 70260")
def raw_slice(spark, sf_dir):
    """Frames between two raw numbers, found by their headers."""
    return _stored(spark, sf_dir, first_raw=70120, last_raw=70260)


@query(STORED + " select rec_id, run, min(raw_idx) as first_raw, max(raw_idx) as last_raw, count(*) as n from (select rec_id, raw_idx, dense_rank() over (partition by rec_id order by raw_idx - frame_idx) - 1 as run from raw) group by all")
def raw_runs(spark, sf_dir):
    return timeaxis.runs(_stored(spark, sf_dir, pixels=False))


@query(STORED + ", steps as (select rec_id, raw_idx, lead(raw_idx) over (partition by rec_id order by raw_idx) - raw_idx - 1 as missing from raw) select rec_id, raw_idx as after_raw, missing from steps where missing > 0")
def raw_dropped(spark, sf_dir):
    return timeaxis.dropped(timeaxis.runs(_stored(spark, sf_dir, pixels=False)))


@query(f"with {FRAMES}, {SLICES} select 'sky' as rec_id, frame_idx // 20 as bin, pos, round(sum(ns) / count(ns), 6) as mean from slices group by all")
def stream_count_keogram(spark, sf_dir):
    place = shared.folder(spark)
    stream = keograms.frame_stream(spark, f"{sf_dir}/embeddings.parque[t]", schema.read(spark, sf_dir, "embeddings").schema, schema.as_frames)
    return rounded(keograms.run_to_end(keograms.count_means(stream, "ns", 20), f"{place}/out", f"{place}/state"), "mean")


@query(f"with {FRAMES}, {SLICES} select 'sky' as rec_id, frame_idx // 20 as bin, pos, round(sum(ns) / count(ns), 6) as mean from slices group by all")
def stream_arrival_bins(spark, sf_dir):
    """The same bins by how many frames came before, whatever their numbers and order of arrival."""
    stream = keograms.frame_stream(spark, f"{sf_dir}/embeddings.parque[t]", schema.read(spark, sf_dir, "embeddings").schema, schema.as_frames)
    ended = schema.frames(spark, sf_dir).select("rec_id").distinct()
    return rounded(ordered.run(stream, shared.folder(spark), "ns", 20, "1 hour", ended), "mean")


# -- whole jobs ----------------------------------------------------------------------


@query(f"with {FRAMES}, {STATS}, d as (select abs(px_mean - lag(px_mean) over (order by frame_idx)) as step from stats) select 'sky' as rec_id, count(*) as n, round(avg(step), 6) as motion from d")
def fold_motion(spark, sf_dir):
    """An aggregate that a user adds, folded by blocks of frames."""
    return rounded(fold.apply(schema.frames(spark, sf_dir), fold.Motion(), ["px"], 64), "motion")


@query(f"""with {FRAMES}, {HISTOGRAM}, ends as (select min(v) as lo, max(v) as hi from hist)
    select 'sky' as rec_id, frame_idx, list_aggregate([printf('%02X', b) || printf('%02X', b) || printf('%02X', b) for b in [cast(trunc(cast(g as double) / 255 * 255) as integer) for g in [least(255, greatest(0, cast(floor(256 * ((ln(v) - ln(lo)) / (ln(hi) - ln(lo)))) as integer))) for v in px]]], 'string_agg', '') as rgb from frames, ends""")
def frame_to_rgb_log(spark, sf_dir):
    frames = schema.frames(spark, sf_dir)
    ends = norm.pixel_histogram(frames).groupBy("rec_id").agg(F.min("v").cast("double").alias("vmin"), F.max("v").cast("double").alias("vmax"))
    return video.rgb_frames(video.gray_frames(frames, ends, "log")).withColumn("rgb", F.hex("rgb"))


@query(BINS + """, ends as (select min(v) as lo, max(v) as hi from (select unnest(px) as v from frames)),
    means as (select seg, bin, list(m order by pos) as px from (select seg, bin, pos, avg(v) as m from (select seg, bin, unnest(px) as v, unnest(range(64)) as pos from binned) group by all) group by all),
    shown as (select seg, bin, list_aggregate([printf('%02X', cast(trunc(cast(g as double) / 255 * 255) as integer)) for g in [least(255, greatest(0, cast(floor(256 * (v - lo) / (hi - lo)) as integer))) for v in px]], 'string_agg', '') as red from means, ends)
    select 'sky' as rec_id, seg, bin, count(*) as n_frames, any_value(red) as red from binned join shown using (seg, bin) group by all""")
def video_rgb(spark, sf_dir):
    """The first of a video's three equal colours."""
    frames = schema.frames(spark, sf_dir)
    ends = norm.pixel_histogram(frames).groupBy("rec_id").agg(F.min("v").cast("double").alias("vmin"), F.max("v").cast("double").alias("vmax"))
    shown = video.rgb_video(_binned(spark, sf_dir), ends, "linear").withColumn("red", F.regexp_replace(F.hex("rgb"), "(..)....", "$1"))
    return shown.select("rec_id", "seg", "bin", "n_frames", "red")

@query(BINS + """, ends as (select min(v) as lo, max(v) as hi from (select unnest(px) as v from frames)),
    means as (select seg, bin, list(m order by pos) as px from (select seg, bin, pos, avg(v) as m from (select seg, bin, unnest(px) as v, unnest(range(64)) as pos from binned) group by all) group by all),
    shown as (select seg, bin, list_aggregate([printf('%02X', cast(trunc(cast(g as double) / 255 * 255) as integer)) for g in [least(255, greatest(0, cast(floor(256 * (v - lo) / (hi - lo)) as integer))) for v in px]], 'string_agg', '') as red from means, ends)
    select 'sky' as rec_id, seg, bin, any_value(red) as red from binned join shown using (seg, bin) group by all""")
def video_container(spark, sf_dir):
    """The same frames, coded in chunks of seven and decoded."""
    frames = schema.frames(spark, sf_dir)
    ends = norm.pixel_histogram(frames).groupBy("rec_id").agg(F.min("v").cast("double").alias("vmin"), F.max("v").cast("double").alias("vmax"))
    shown = container.unpack(container.pack(video.rgb_video(_binned(spark, sf_dir), ends, "linear"), 7))
    return shown.select("rec_id", "seg", "bin", F.regexp_replace(F.hex("rgb"), "(..)....", "$1").alias("red"))


#: Sampled frames between the nearest ones to two whole seconds.
BETWEEN = f"""with {FRAMES}, ticks as (select 'sky' as rec_id, frame_idx, ut from frames), source as (select * from ticks), bounds as (select {{start}} as a, {{stop}} as b from ticks),
    sought as (select 'sky' as rec_id, 'a' as which, floor(a) as t from bounds union all select 'sky', 'b', floor(b) from bounds), {NEAREST},
    span as (select max(idx) filter (where which = 'a') as s, max(idx) filter (where which = 'b') as e from near), times as (select s, e, (select ut from ticks where frame_idx = e) - (select ut from ticks where frame_idx = s) as took from span),
    counted as (select s, e, cast(trunc(took / 60) as bigint) as m from times),
    sample as (select case when k = m - 1 and m > 1 then e else cast(floor(k * ((e - s) / greatest(m - 1, 1)) + s) as bigint) end as frame_idx from (select unnest(range(m)) as k, m, s, e from counted)),
    hist as (select v, count(*) as n from (select unnest(px) as v from frames join sample using (frame_idx)) where v > 0 group by v), cdf as (select v, sum(n) over (order by v) as cum, sum(n) over () as total from hist)
    select 'sky' as rec_id, greatest(cast(min(v) filter (where cum >= total * 1.0 / 100) as double), 1e-6) as vmin, cast(min(v) filter (where cum >= total * 99.0 / 100) as double) as vmax, 'log' as kind from cdf"""


@query(BETWEEN.format(start="min_by(ut, frame_idx)", stop="max_by(ut, frame_idx)"))
def norm_whole_seconds(spark, sf_dir):
    return norm.norm_between(schema.frames(spark, sf_dir), 60.0)


@query(BETWEEN.format(start="max(1704067200 + 400.9)", stop="max(1704067200 + 3000.2)"))
def norm_between(spark, sf_dir):
    bounds = spark.range(1).select(F.lit("sky").alias("rec_id"), F.lit(1704067600.9).alias("start"), F.lit(1704070200.2).alias("stop"))
    return norm.norm_between(schema.frames(spark, sf_dir), 60.0, bounds)


@query(BINS + " select 'sky' as rec_id, seg, bin, count(*) as n_frames, round(avg(ut), 6) as t_mean, cast(0.4 as double) as fps from binned group by seg, bin")
def videos_job(spark, sf_dir):
    found = pipelines.videos(schema.frames(spark, sf_dir), bin_size=5, speed=15.0)
    return rounded(found.times.join(found.plan, "rec_id").select("rec_id", "seg", "bin", "n_frames", "t_mean", "fps"), "t_mean", "fps")


def _hourly(spark, sf_dir):
    return pipelines.hourly(schema.frames(spark, sf_dir), output_hz=0.01, bin_seconds=60.0, lookahead=10)


STRIDE = "greatest(1, cast(round_even((1 / 0.01) / dt, 0) as bigint))"


@query(f"""with {FRAMES}, d as (select median(x) as dt from (select ut - lag(ut) over (order by frame_idx) as x from frames) where x is not null)
    select 'sky' as rec_id, dt, cast(15 as double) as speed, round(cast(0.01 * 15 as double), 6) as fps, cast(5 as bigint) as bin_size, {STRIDE} as stride, case when 5 > {STRIDE} then 'a bin must not be larger than the stride' end as problem from d""")
def hourly_plan(spark, sf_dir):
    return rounded(_hourly(spark, sf_dir).plan, "dt", "speed", "fps")


@query(STRIDED.replace("12", "13") + " select 'sky' as rec_id, seg, bin, count(*) as n_frames, round(avg(ut), 6) as t_mean from binned group by seg, bin")
def hourly_times(spark, sf_dir):
    return rounded(_hourly(spark, sf_dir).times.drop("label"), "t_mean")


@query(STRIDED.replace("12", "13") + PIXELS)
def hourly_pixels(spark, sf_dir):
    return rounded(_hourly(spark, sf_dir).pixels, "px_mean")


@query(f"""with {FRAMES}, {SLICES}, {FRAME_SOURCE}, hours as (select s.*, floor(t.ut / 3600) * 3600 as hour from segments s join ranges r using (rec_id) join ticks t on t.frame_idx = least(s.s + 10, r.n - 1)),
    held as (select seg, cast(floor((ut - hour) / 60) as bigint) as bin, pos, ns, ew from slices f join hours h on f.frame_idx >= h.s and f.frame_idx < h.e where ut >= hour and ut < hour + 3600),
    both_axes as (select seg, bin, 'ns' as axis, pos, ns as v from held union all select seg, bin, 'ew', pos, ew from held)
    select 'sky' as rec_id, seg, bin, axis, pos, round(sum(v) / count(v), 6) as mean from both_axes group by all""")
def hourly_keograms(spark, sf_dir):
    return rounded(_hourly(spark, sf_dir).keograms, "mean")


@query(f"""with {FRAMES}, {SLICES}, r as (select count(*) as n, max_by(ut, frame_idx) - min_by(ut, frame_idx) as span from frames), p as (select cast(ceil(n / 20) as bigint) - 1 as blocks, greatest(1, n // greatest(1, cast(trunc(span / 60) as bigint))) as per from r)
    select 'sky' as rec_id, frame_idx // 20 as bin, pos, round(sum(ew) / count(ew), 6) as mean from slices, p where frame_idx % 20 < per and frame_idx // 20 < blocks group by all""")
def rough_job(spark, sf_dir):
    return rounded(pipelines.rough_keogram(schema.frames(spark, sf_dir), "ew", 60.0, 20).keograms, "mean")
