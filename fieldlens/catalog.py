"""The registered queries and their SQL oracles.

Each query applies library operators to a view of the test tables (``sources.fixtures``); its oracle says the same in DuckDB SQL over the same view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as g
from .operators import evaluation, folds, identity, joins, metrics, signals, tracking, windows
from .plans import events, jobs
from .sources import files
from .sources.fixtures import oracle, view
from .streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of (view, tables) under its name, with its oracle where there is one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: view(spark, sf_dir, name), lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = oracle(list(views), sql) if views else sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


def r(c: Column | str, n: int = 4) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


BAND = "case when v < 2 then 'walk' when v < 4 then 'jog' when v < 5.5e0 then 'run' when v < 7 then 'high' when v < 10 then 'sprint' else 'artefact' end"
STEP = "sqrt((x_m - lag(x_m) over w) * (x_m - lag(x_m) over w) + (y_m - lag(y_m) over w) * (y_m - lag(y_m) over w))"
STEPS = f", steps as (select * from (select *, {STEP} as step from trk window w as (partition by track_id order by frame)) where step is not null)"


def with_steps(body: str) -> str:
    return STEPS.lstrip() + "\n" + body


# ---- movement


@query(with_steps(f"select role, band, round(sum(step), 2) + 0e0 as metres, count(*) as n_steps from (select *, {BAND} as band from (select *, step * 25 as v from steps)) group by role, band"), "trk")
def speed_bands_by_role(v, t):
    return metrics.speed_bands(v("trk")).select("role", "band", r("metres", 2).alias("metres"), "n_steps")


@query(f"select track_id, count(*) as n_frames, round((max(frame) - min(frame) + 1) / 25e0, 4) as seconds, round(sum(step), 4) + 0e0 as metres from (select *, {STEP} as step from trk window w as (partition by track_id order by frame)) group by track_id having count(*) >= 2", "trk")
def track_distance(v, t):
    return metrics.track_distance(v("trk")).select("track_id", "n_frames", r("seconds").alias("seconds"), r("metres").alias("metres"))


MA = "(sum({c}) over (partition by track_id order by frame rows between 2 preceding and 2 following) + (2 - count(*) over (partition by track_id order by frame rows between 2 preceding and 1 preceding)) * first({c}) over (partition by track_id order by frame rows between unbounded preceding and unbounded following) + (2 - count(*) over (partition by track_id order by frame rows between 1 following and 2 following)) * last({c}) over (partition by track_id order by frame rows between unbounded preceding and unbounded following)) / 5e0"


@query(f", s as (select track_id, frame, {MA.format(c='x_m')} as x_m, {MA.format(c='y_m')} as y_m from trk) select track_id, round(sum(step), 4) + 0e0 as metres from (select track_id, {STEP} as step from s window w as (partition by track_id order by frame)) group by track_id having count(*) >= 2", "trk")
def track_distance_smoothed(v, t):
    return metrics.track_distance(v("trk"), smooth=2).select("track_id", r("metres").alias("metres"))


@query(with_steps("select role, round(sum(step), 2) as metres, round(sum(case when step * 25 <= 10 then step else 0 end), 2) as legal_metres, round(max(case when step * 25 <= 10 then step * 25 end), 4) as max_speed from steps group by role"), "trk")
def team_distance(v, t):
    return metrics.team_distance(v("trk")).select("role", r("metres", 2).alias("metres"), r("legal_metres", 2).alias("legal_metres"), r("max_speed").alias("max_speed"))


POINTS = ", points as (select role as who, x_m, y_m from trk union all select 'ball', pitch_x_m, pitch_y_m from ball where pitch_x_m is not null)"


def points(v) -> DataFrame:
    """SO1, SO2: players and ball as one set of points."""
    return v("trk").select(F.col("role").alias("who"), "x_m", "y_m").unionByName(v("ball").where("pitch_x_m is not null").select(F.lit("ball").alias("who"), F.col("pitch_x_m").alias("x_m"), F.col("pitch_y_m").alias("y_m")))


@query(POINTS + " select who, part, count(*) as n, round(100e0 * count(*) / sum(count(*)) over (partition by who), 4) as pct from (select who, cast(least(floor((greatest(least(x_m, 52.5e0), -52.5e0) + 52.5e0) * 3 / 105e0), 2) as bigint) as part from points) group by who, part", "trk", "ball")
def territory_pct(v, t):
    return metrics.territory(points(v), ["who"]).select("who", "part", "n", r("pct").alias("pct"))


@query(POINTS + " select who, bin_x, bin_y, count(*) as n from (select who, cast(least(floor((x_m + 52.5e0) * 36 / 105e0), 35) as bigint) as bin_x, cast(least(floor((y_m + 34e0) * 20 / 68e0), 19) as bigint) as bin_y from points where x_m between -52.5e0 and 52.5e0 and y_m between -34e0 and 34e0) group by who, bin_x, bin_y", "trk", "ball")
def heatmap_bins(v, t):
    return metrics.heatmap(points(v), ["who"])


@query("select role, track_id, round(avg(x_m), 4) + 0e0 as x_mean, round(avg(y_m), 4) + 0e0 as y_mean, count(*) as n_frames from trk group by role, track_id having count(*) >= 10", "trk")
def formation_positions(v, t):
    return metrics.formation(v("trk"), 10).select("role", "track_id", r("x_mean").alias("x_mean"), r("y_mean").alias("y_mean"), "n_frames")


@query(", c as (select role, frame, x, y, count(*) over w as n, avg(x) over w as cx, avg(y) over w as cy from boxes window w as (partition by role, frame)), f as (select role, frame, avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) as d from c where n >= 3 group by role, frame) select role, round(avg(d), 4) as spread, count(*) as n_frames from f group by role", "boxes")
def team_spread(v, t):
    return metrics.team_spread(v("boxes"), ["frame"], ["role"], "x", "y").select("role", r("spread").alias("spread"), "n_frames")


@query(", m as (select frame, median(x) as mx, median(y) as my, count(*) as n from boxes group by frame having count(*) >= 3) select b.frame, m.n, round(avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))), 4) as spread from boxes b join m on b.frame = m.frame group by b.frame, m.n", "boxes")
def player_spread_median(v, t):
    return metrics.median_spread(v("boxes"), ["frame"], "x", "y").select("frame", "n", r("spread").alias("spread"))


@query(", d as (select frame, x, y, count(*) over w as n, sqrt((x - avg(x) over w) * (x - avg(x) over w) + (y - avg(y) over w) * (y - avg(y) over w)) as d from boxes window w as (partition by frame)), q as (select *, quantile_cont(d, 0.85) over (partition by frame) as cut from d), k as (select *, count(case when d <= cut then 1 end) over (partition by frame) as kept from q) select frame, round(avg(x), 4) as cx, round(avg(y), 4) as cy, count(*) as n from k where n < 7 or d <= cut or kept < 3 group by frame", "boxes")
def player_centroid_trimmed(v, t):
    return metrics.trimmed_centroid(v("boxes"), ["frame"], "x", "y").select("frame", r("cx").alias("cx"), r("cy").alias("cy"), "n")


@query(", pt as (select distinct frame, role, x, y from boxes), ed as (select p.frame, p.role, p.x as px, p.y as py, q.x as qx, q.y as qy from pt p join pt q on q.frame = p.frame and q.role = p.role and (q.x <> p.x or q.y <> p.y)), tr as (select ed.*, (qx - px) * (o.y - py) - (qy - py) * (o.x - px) as side, (o.x - px) * (qx - px) + (o.y - py) * (qy - py) as along, (qx - px) * (qx - px) + (qy - py) * (qy - py) as len from ed join pt o on o.frame = ed.frame and o.role = ed.role), rim as (select frame, role, px, py, qx, qy from tr group by frame, role, px, py, qx, qy having min(side) >= 0 and not bool_or(side = 0 and (along < 0 or along > len))) select frame, role, round(sum(px * qy - qx * py) / 2, 4) as area from rim group by frame, role having sum(px * qy - qx * py) > 0", "boxes")
def team_hull_area(v, t):
    return tracking.hull_areas(v("boxes"), ["frame", "role"], "x", "y").select("frame", "role", r("area").alias("area"))


H = (0.09, 0.004, -55.0, -0.003, 0.11, -40.0, 0.00002, 0.0001, 1.0)
HX = "(0.09e0 * x + 0.004e0 * y - 55e0) / (0.00002e0 * x + 0.0001e0 * y + 1e0)"
HY = "(-0.003e0 * x + 0.11e0 * y - 40e0) / (0.00002e0 * x + 0.0001e0 * y + 1e0)"


@query(f"select frame, det_id, round({HX}, 4) + 0e0 as px, round({HY}, 4) + 0e0 as py from boxes", "boxes")
def homography_project(v, t):
    px, py = g.project("x", "y", H)
    return v("boxes").select("frame", "det_id", r(px).alias("px"), r(py).alias("py"))


@query(f"select track_id, round(avg(case when abs({HX}) <= 54e0 and abs({HY}) <= 35.5e0 then 1e0 else 0e0 end), 4) as fraction from boxes group by track_id", "boxes")
def inbounds_fraction(v, t):
    px, py = g.project("x", "y", H)
    return v("boxes").groupBy("track_id").agg(r(F.avg(((F.abs(px) <= 54.0) & (F.abs(py) <= 35.5)).cast("double"))).alias("fraction"))


@query("select frame, det_id, round(sqrt(pow(greatest(x - b_x, 0e0, b_x - (x + w)), 2) + pow(greatest(y - b_y, 0e0, b_y - (y + h)), 2)), 4) as d, coalesce(b_x between x + w * 0.2e0 and x + w - w * 0.2e0 and b_y between y and y + h * 0.18e0, false) as head from boxes join ball_px using (frame)", "boxes", "ball_px")
def ball_box_distance(v, t):
    b = v("boxes").join(v("ball_px"), "frame")
    return b.select("frame", "det_id", r(g.box_distance("b_x", "b_y", *g.to_corners("x", "y", "w", "h"))).alias("d"), g.in_head_zone("b_x", "b_y", "x", "y", "w", "h").alias("head"))


# ---- nearness to the ball


NEAREST = ", n as (select *, row_number() over (partition by frame order by d, track_id, det_id) as rk from touch where status <> 'lost')"


def touching(v) -> DataFrame:
    return v("touch").where("status <> 'lost'")


@query(NEAREST + " select frame, track_id, role, round(d, 4) as d from n where rk = 1 and d < 170e0", "touch")
def nearest_player_px(v, t):
    return joins.nearest(touching(v), ["frame"], "d", ["track_id", "det_id"], 170.0, strict=True).select("frame", "track_id", "role", r("d").alias("d"))


@query(" select frame, count(case when d <= 220 and role = 'TeamA' then 1 end) as near_TeamA, count(case when d <= 220 and role = 'TeamB' then 1 end) as near_TeamB from touch group by frame", "touch")
def near_counts(v, t):
    return joins.counts_within(v("touch"), ["frame"], "d", 220.0, "role", ["TeamA", "TeamB"])


TIMELINE = NEAREST + ", tl as (select p.frame, cast(case when n.role = 'TeamA' then 1 when n.role = 'TeamB' then 2 else 0 end as bigint) as possession from ball_px p left join (select * from n where rk = 1 and d <= 250e0) n on p.frame = n.frame)"


def timeline(v) -> DataFrame:
    near = joins.nearest(touching(v), ["frame"], "d", ["track_id", "det_id"], 250.0)
    return signals.possession_timeline(v("ball_px"), near, ["frame"])


@query(TIMELINE + " select * from tl", "touch", "ball_px")
def possession_timeline(v, t):
    return timeline(v)


@query(TIMELINE + " select round(100e0 * count(case when possession = 1 then 1 end) / greatest(1, count(case when possession <> 0 then 1 end)), 4) as team_a_pct, round(100e0 * count(case when possession = 2 then 1 end) / greatest(1, count(case when possession <> 0 then 1 end)), 4) as team_b_pct, count(case when possession <> 0 then 1 end) as n_counted, count(*) as n_total from tl", "touch", "ball_px")
def possession_share(v, t):
    return metrics.possession_share(timeline(v)).select(r("team_a_pct").alias("team_a_pct"), r("team_b_pct").alias("team_b_pct"), "n_counted", "n_total")


@query("select seq, i, cast(case when a + b = 0 then 0 when a >= b then 1 else 2 end as bigint) as possession from (select seq, i, count(case when possession = 1 then 1 end) over w as a, count(case when possession = 2 then 1 end) over w as b from features window w as (partition by seq order by i rows between 7 preceding and 7 following))", "features")
def possession_majority(v, t):
    return v("features").select("seq", "i", big(windows.majority(F.col("possession"), windows.ordered(["seq"], "i"), 7)).alias("possession"))


@query("select seq, i from (select seq, i, possession, last_value(nullif(possession, 0) ignore nulls) over (partition by seq order by i rows between unbounded preceding and 1 preceding) as was from features) where possession <> 0 and possession <> was", "features")
def possession_flips(v, t):
    return v("features").withColumn("f", windows.flips(F.col("possession"), windows.ordered(["seq"], "i"))).where("f").select("seq", "i")


@query("select frame, track_id, det_id from touch where status <> 'lost' and d <= 2.5e0 * h", "touch")
def involvement_radius(v, t):
    return touching(v).where(F.col("d") <= 2.5 * F.col("h")).select("frame", "track_id", "det_id")


@query(NEAREST + " select frame, track_id, det_id from n where rk = 1 and d <= 2.5e0 * h", "touch")
def involvement_nearest(v, t):
    return joins.nearest(touching(v), ["frame"], "d", ["track_id", "det_id"], 2.5 * F.col("h")).select("frame", "track_id", "det_id")


@query(NEAREST + ", s as (select *, lead(d) over (partition by frame order by d, track_id, det_id) as d2 from n) select frame, track_id, det_id from s where rk = 1 and d <= 300e0 and (d2 is null or d2 >= 1.6e0 * d)", "touch")
def involvement_gap(v, t):
    return joins.involved(touching(v), ["frame"], "d", ["track_id", "det_id"], "gap", 300.0).select("frame", "track_id", "det_id")


@query(", c as (select cls, track_id, count(*) as n from (select b.role as cls, b.track_id from touch b where status <> 'lost' and d <= 300e0) group by cls, track_id), k as (select *, row_number() over (partition by cls order by n desc, track_id) as rk from c) select cls as role, round(sum(case when rk <= 3 then n else 0 end) / cast(sum(n) as double), 4) as top_share, count(*) as n_tracks from k group by cls", "touch")
def top3_share(v, t):
    counts = joins.involved(touching(v), ["frame"], "d", ["track_id", "det_id"], "radius", 300.0).groupBy("role", "track_id").agg(F.count(F.lit(1)).alias("n"))
    return metrics.top_share(counts, ["role"]).select("role", r("top_share").alias("top_share"), "n_tracks")


# ---- runs and stretches


RUNS = ", o as (select distinct track_id, hour_frame as f from trk), m as (select *, case when f - lag(f) over (partition by track_id order by f) <= 5 then 0 else 1 end as nw from o), g as (select *, sum(nw) over (partition by track_id order by f) as run from m), runs as (select track_id, min(f) as s, max(f) as e, count(*) as n_rows from g group by track_id, run)"


@query(RUNS + " select track_id, s as start, e as \"end\", n_rows from runs where e - s + 1 >= 2", "trk")
def involvement_ranges(v, t):
    return metrics.presence(v("trk"), min_len=2)


@query(RUNS + " select track_id, s as start, e as \"end\" from (select *, row_number() over (partition by track_id order by e - s desc, s) as rk from runs) where rk = 1", "trk")
def longest_stretch(v, t):
    return metrics.longest_presence(v("trk"))


@query(RUNS + " select track_id, s, cast(case when e - s + 1 > 10 then floor((s + e) / 2) - 5 else s end as bigint) as start, cast(case when e - s + 1 > 10 then floor((s + e) / 2) + 4 else e end as bigint) as \"end\" from runs", "trk")
def presence_cap(v, t):
    a, b = metrics.capped(F.col("start"), F.col("end"), 10)
    return metrics.presence(v("trk")).select("track_id", F.col("start").alias("s"), big(a).alias("start"), big(b).alias("end"))


@query(RUNS + " select track_id, s, greatest(1, s - 50) as start, least(700, e + 25) as \"end\" from runs", "trk")
def clip_padding(v, t):
    a, b = metrics.padded(F.col("start"), F.col("end"), F.lit(700))
    return metrics.presence(v("trk")).select("track_id", F.col("start").alias("s"), big(a).alias("start"), big(b).alias("end"))


COVER = RUNS + ", have as (select track_id, count(*) as n from runs where e - s + 1 >= 10 group by track_id), tracks as (select seq, track_id, count(*) as n_frames from trk group by seq, track_id having count(*) >= 5)"


def covered(v) -> tuple[DataFrame, DataFrame]:
    return v("trk").groupBy("seq", "track_id").agg(F.count(F.lit(1)).alias("n_frames")), metrics.presence(v("trk"), min_len=10)


@query(COVER + " select seq, count(*) as n_tracks, count(case when n > 0 then 1 end) as via_involvement, count(case when coalesce(n, 0) = 0 then 1 end) as via_presence, min(coalesce(n, 0)) as least, cast(floor(median(coalesce(n, 0))) as bigint) as median, max(coalesce(n, 0)) as most from tracks left join have using (track_id) group by seq", "trk")
def inclusivity_rollup(v, t):
    return metrics.inclusivity(*covered(v), substantial=5)


@query(COVER + " select seq, track_id, n_frames from tracks where track_id not in (select track_id from have)", "trk")
def missed_tracks(v, t):
    return metrics.missed(*covered(v), substantial=5)


@query(RUNS + " select n_clips, n_tracks, s as seconds_each, round(n_clips * s / 3600, 4) as hours from (select count(*) as n_clips, count(distinct track_id) as n_tracks from runs), (values (5e0), (10e0), (20e0)) v(s)", "trk")
def tagging_volume(v, t):
    return metrics.tagging_volume(metrics.presence(v("trk"))).select("n_clips", "n_tracks", "seconds_each", r("hours").alias("hours"))


# ---- the ball series


BALL_W = "window w as (partition by seq order by frame)"
FILL = ", f as (select *, last_value(pitch_x_m ignore nulls) over (partition by seq order by frame rows between unbounded preceding and current row) as v0, last_value(case when pitch_x_m is not null then frame end ignore nulls) over (partition by seq order by frame rows between unbounded preceding and current row) as i0, first_value(pitch_x_m ignore nulls) over (partition by seq order by frame rows between current row and unbounded following) as v1, first_value(case when pitch_x_m is not null then frame end ignore nulls) over (partition by seq order by frame rows between current row and unbounded following) as i1 from ball), x as (select seq, frame, status, coalesce(pitch_x_m, v0 + (v1 - v0) * (frame - i0) / nullif(i1 - i0, 0), v0, v1, 0e0) as x from f)"


def filled(v) -> DataFrame:
    return v("ball").withColumn("x", windows.interpolate(F.col("pitch_x_m"), F.col("frame"), ["seq"], "frame"))


@query(FILL + " select seq, frame, round(x, 4) + 0e0 as x from x", "ball")
def gap_interpolate(v, t):
    return filled(v).select("seq", "frame", r("x").alias("x"))


@query(FILL + ", s as (select seq, frame, count(*) over (partition by seq order by frame rows between 3 preceding and 1 preceding) as b, count(*) over (partition by seq order by frame rows between 1 following and 3 following) as a, sum(x) over (partition by seq order by frame rows between 3 preceding and 3 following) as s, first(x) over (partition by seq order by frame rows between unbounded preceding and unbounded following) as x0, last(x) over (partition by seq order by frame rows between unbounded preceding and unbounded following) as x1 from x) select seq, frame, round((s + (3 - b) * x0 + (3 - a) * x1) / 7, 4) + 0e0 as x from s", "ball")
def smooth_edge_ma(v, t):
    return filled(v).select("seq", "frame", r(windows.edge_moving_average(F.col("x"), windows.ordered(["seq"], "frame"), 3)).alias("x"))


@query(FILL + f", g as (select *, lead(x) over w as n, lag(x) over w as p from x {BALL_W}) select seq, frame, round(case when status = 'lost' then 0e0 else abs(coalesce((n - p) / 2, n - x, x - p, 0e0)) * 25 end, 4) + 0e0 as speed from g", "ball")
def gradient_speed(v, t):
    speed = F.abs(windows.gradient(F.col("x"), windows.ordered(["seq"], "frame"))) * 25.0
    return filled(v).select("seq", "frame", r(F.when(F.col("status") == "lost", 0.0).otherwise(speed)).alias("speed"))


ISLAND = ", m as (select seq, frame, case when frame - lag(frame) over (partition by seq order by frame) <= {b} then 0 else 1 end as nw from ball where {c}), g as (select *, sum(nw) over (partition by seq order by frame) as run from m)"


@query(ISLAND.format(b=3, c="status <> 'lost'") + " select seq, min(frame) as start, max(frame) as \"end\", count(*) as n_rows from g group by seq, run having max(frame) - min(frame) + 1 >= 4", "ball")
def island_runs(v, t):
    return windows.islands(v("ball").where("status <> 'lost'"), ["seq"], "frame", 3, 4)


@query(ISLAND.format(b=1, c="status = 'lost'") + " select seq, n as gap, count(*) as n_gaps from (select seq, run, count(*) as n from g group by seq, run) group by seq, n", "ball")
def missing_gap_stats(v, t):
    return windows.islands(v("ball").where("status = 'lost'"), ["seq"], "frame", 1).groupBy("seq", F.col("n_rows").alias("gap")).agg(F.count(F.lit(1)).alias("n_gaps"))


@query(ISLAND.format(b=1, c="status = 'predicted'") + " select seq, max(n) as longest_streak from (select seq, run, count(*) as n from g group by seq, run) group by seq", "ball")
def longest_predict_streak(v, t):
    return windows.longest_streak(v("ball"), ["seq"], "frame", F.col("status") == "predicted")


GUARD = ", b as (select seq, row_number() over (partition by seq order by frame) as rn, frame, pitch_x_m as x, pitch_y_m as y from ball where pitch_x_m is not null), rec as (select seq, rn, frame, x, y, frame as lf, x as lx, y as ly, false as teleport from b where rn = 1 union all select b.seq, b.rn, b.frame, b.x, b.y, case when far then lf else b.frame end, case when far then lx else b.x end, case when far then ly else b.y end, far from (select b.*, rec.lf, rec.lx, rec.ly, sqrt((b.x - lx) * (b.x - lx) + (b.y - ly) * (b.y - ly)) / greatest(1, b.frame - lf) > 1.6e0 as far from rec join b on b.seq = rec.seq and b.rn = rec.rn + 1) b)"


@query(GUARD + " select seq, frame from rec where teleport", "ball")
def teleport_guard(v, t):
    return folds.teleport_guard(v("ball"), ["seq"], "frame", "pitch_x_m", "pitch_y_m", 1.6).where("teleport").select("seq", "frame")


@query(f", c as (select seq, frame, case when x is null then 480e0 else greatest(320e0, least(x, 640e0)) end as cx from ball), d as (select *, cx - lag(cx) over w as v from c {BALL_W}), e as (select *, v - lag(v) over w as a from d {BALL_W}), f as (select *, a - lag(a) over w as j from e {BALL_W}) select seq, round(avg(abs(a)), 4) as accel, round(avg(abs(j)), 4) as jerk, round(avg(case when cx in (320e0, 640e0) then 1e0 else 0e0 end), 4) as clamped from f group by seq", "ball")
def crop_jerk(v, t):
    w = windows.ordered(["seq"], "frame")
    c = v("ball").withColumn("cx", F.coalesce(g.clamp_centre("x", 640.0, 960.0), F.lit(480.0)))
    c = c.withColumn("v", F.col("cx") - F.lag("cx").over(w)).withColumn("a", F.col("v") - F.lag("v").over(w)).withColumn("j", F.col("a") - F.lag("a").over(w))
    return c.groupBy("seq").agg(r(F.avg(F.abs("a"))).alias("accel"), r(F.avg(F.abs("j"))).alias("jerk"), r(F.avg(F.col("cx").isin(320.0, 640.0).cast("double"))).alias("clamped"))


@query("select seq, round(100e0 * avg(case when abs(x - 480e0) <= 192e0 then 1e0 else 0e0 end), 4) as safe_pct, count(*) as n from ball where x is not null group by seq", "ball")
def safe_zone_pct(v, t):
    return v("ball").where("x is not null").groupBy("seq").agg(r(100.0 * F.avg((F.abs(F.col("x") - 480.0) <= 192.0).cast("double"))).alias("safe_pct"), F.count(F.lit(1)).alias("n"))


@query(", g as (select seq, frame, x + (k % 5 - 2) * 3e0 as gx, y + (k % 3 - 1) * 4e0 as gy from ball) select status, count(*) as n, round(sqrt(avg((x - gx) * (x - gx) + (y - gy) * (y - gy))), 4) as rmse, round(avg(case when sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) <= 5 then 1e0 else 0e0 end), 4) as within from ball join g using (seq, frame) where x is not null group by status", "ball")
def ball_rmse_by_status(v, t):
    b = v("ball")
    truth = b.select("seq", "frame", (F.col("x") + (F.col("k") % 5 - 2) * 3.0).alias("x"), (F.col("y") + (F.col("k") % 3 - 1) * 4.0).alias("y"))
    return evaluation.rmse_by_status(b, truth, ["seq", "frame"], 5.0).select("status", "n", r("rmse").alias("rmse"), r("within").alias("within"))


# ---- football events


EV_BEST = ", m as (select *, case when i - lag(i) over (partition by seq order by i) <= {b} then 0 else 1 end as nw from features where {c}), g as (select *, sum(nw) over (partition by seq order by i) as run from m)"
SHOT = EV_BEST.format(b=7, c="detected and speed > 9 and ((h_pos > 0.3e0 and d_pos < 42) or (h_neg > 0.3e0 and d_neg < 42))") + ", shots as (select seq, 'shot' as type, min(i) as start, max(i) as \"end\", arg_max(i, speed * 1e9 - i) as peak, round(least(greatest(0.45e0 + 0.5e0 * (max(speed) - 9) / 16e0 + 0.2e0 * (arg_max(greatest(h_pos, h_neg), speed * 1e9 - i) - 0.3e0), 0.2e0), 0.98e0), 2) as confidence from g group by seq, run having max(i) - min(i) + 1 >= 2)"


def event(df: DataFrame, *more: str) -> DataFrame:
    return df.select("seq", "type", "start", "end", "peak", "confidence", *more)


@query(SHOT + " select * from shots", "features")
def detect_shots(v, t):
    return event(events.shots(v("features")))


LOST = ", e as (select *, last_value(case when detected then i end ignore nulls) over (partition by seq order by i rows between unbounded preceding and 1 preceding) as pre, first_value(case when detected then i end ignore nulls) over (partition by seq order by i rows between 1 following and unbounded following) as post from features), lm as (select *, case when i - lag(i) over (partition by seq order by i) <= 3 then 0 else 1 end as nw from e where not detected), lg as (select *, sum(nw) over (partition by seq order by i) as run from lm), lost as (select seq, min(i) as s, max(i) as e, arg_min_null(pre, i) as pre, arg_max_null(post, i) as post from lg group by seq, run having max(i) - min(i) + 1 >= {n})"
FLIGHT = LOST.format(n=3) + ", fl as (select l.seq, l.pre, l.post, a.d_pos - b.d_pos as cp, a.d_neg - b.d_neg as cn, b.d_pos as bp, b.d_neg as bn from lost l join features a on a.seq = l.seq and a.i = l.pre join features b on b.seq = l.seq and b.i = l.post), flights as (select seq, 'shot' as type, pre as start, post as \"end\", pre as peak, round(least(greatest(0.55e0 + 0.35e0 * near / 40e0, 0.4e0), 0.95e0), 2) as confidence, round(arrive, 1) as arrive from (select *, case when cp >= 0.2e0 and bp <= 40 then cp when cn >= 0.2e0 and bn <= 40 then cn end as near, case when cp >= 0.2e0 and bp <= 40 then bp when cn >= 0.2e0 and bn <= 40 then bn end as arrive from fl) where near is not null)"
LOOSE = events.Football(lost_frames=3, approach=0.2, near_goal=40.0, flight_goal=30.0, run_frames=4, run_metres=1.0, halt_frames=6, halt_speed=4.0)


@query(FLIGHT + " select * from flights", "features")
def detect_shot_flights(v, t):
    return event(events.shot_flights(v("features"), LOOSE), "arrive")


@query(EV_BEST.format(b=7, c="speed > 7") + ", run as (select seq, min(i) as s, max(i) as e, arg_max(i, speed * 1e9 - i) as peak, abs(arg_max(px, i) - arg_min(px, i)) as dx from g group by seq, run having max(i) - min(i) + 1 >= 4) select r.seq, 'fast_transition' as type, r.s as start, r.e as \"end\", r.peak, round(least(greatest(0.4e0 + 0.4e0 * (dx / 50e0) + 0.2e0 * (avg(f.speed) / 15e0), 0.2e0), 0.95e0), 2) as confidence from run r join features f on f.seq = r.seq and f.i between r.s and r.e where dx >= 1 group by r.seq, r.s, r.e, r.peak, dx", "features")
def detect_transitions(v, t):
    return event(events.transitions(v("features"), LOOSE))


GOALS = SHOT + FLIGHT + ", all_shots as (select seq, start, \"end\" as e, peak, confidence from shots union all select seq, start, \"end\", peak, confidence from flights), al as (select s.seq, s.start, s.e, s.peak, s.confidence, bool_or(f.in_goal_zone) as zone, (avg(case when f.detected then 0e0 else 1e0 end) > 0.5 or avg(case when f.possession = 0 then 1e0 else 0e0 end) > 0.5) as dead from (select distinct * from all_shots) s join features f on f.seq = s.seq and f.i >= s.e and f.i < s.e + 60 group by all), n as (select seq, max(i) + 1 as n from features group by seq), goals as (select seq, 'likely_goal_candidate' as type, start, least(n - 1, least(n, e + 60)) as \"end\", peak, round(least(greatest(0.25e0 + 0.15e0 * zone::int + 0.1e0 * dead::int + 0.2e0 * confidence, 0.15e0), 0.6e0), 2) as confidence from al join n using (seq) where zone or dead union all select seq, 'likely_goal_candidate', start, \"end\", peak, round(least(0.6e0, confidence), 2) from flights where arrive <= 30)"


@query(GOALS + " select * from goals", "features")
def detect_likely_goals(v, t):
    f = v("features")
    flights = events.shot_flights(f, LOOSE)
    return event(events.likely_goals(f, events.shots(f, LOOSE).unionByName(flights.drop("arrive")), flights, LOOSE))


def emitted_sql(cond: str, cols: str, name: str) -> str:
    return f", cand as (select *, row_number() over (partition by seq order by i) as rn from ({cols}) where {cond}), em as (select seq, rn, i, i as last, true as keep from cand where rn = 1 union all select c.seq, c.rn, c.i, case when c.i - em.last >= 15 then c.i else em.last end, c.i - em.last >= 15 from em join cand c on c.seq = em.seq and c.rn = em.rn + 1), {name} as (select cand.* from cand join em using (seq, rn) where em.keep)"


TACKLE = emitted_sql("flip and a >= 1 and b >= 1", "select *, max(near_a) over w as a, max(near_b) over w as b, min(i) over w as lo, max(i) over w as hi from features window w as (partition by seq order by i rows between 10 preceding and 10 following)", "tk") + ", tackles as (select seq, 'tackle_proxy' as type, lo as start, hi as \"end\", i as peak, round(least(greatest(0.3e0 + 0.1e0 * least(a, b), 0.25e0), 0.7e0), 2) as confidence from tk)"


@query(TACKLE + " select * from tackles", "features")
def detect_tackles(v, t):
    return event(events.tackles(v("features")))


@query(emitted_sql("flip and least(d_left, d_right) >= 5", "select * from features", "st") + " select seq, 'steal_proxy' as type, greatest(0, i - 10) as start, least(n - 1, i + 10) as \"end\", i as peak, 0.4e0 as confidence from st join (select seq, max(i) + 1 as n from features group by seq) using (seq)", "features")
def detect_steals(v, t):
    return event(events.steals(v("features")))


@query(EV_BEST.format(b=7, c="speed < 4 or not detected") + ", run as (select seq, min(i) as s, max(i) as e from g group by seq, run having max(i) - min(i) + 1 >= 6), md as (select seq, median(spread) as md from features group by seq) select r.seq, 'stoppage_review' as type, r.s as start, r.e as \"end\", r.s + cast(floor((r.e - r.s) / 2) as bigint) as peak, round(least(greatest(0.25e0 + 0.1e0 * (r.e - r.s) / 50e0, 0.2e0), 0.55e0), 2) as confidence from run r join features f on f.seq = r.seq and f.i between r.s and r.e join md on md.seq = r.seq group by r.seq, r.s, r.e, md.md having avg(f.spread) < md.md or avg(case when f.possession = 0 then 1e0 else 0e0 end) > 0.6", "features")
def detect_stoppages(v, t):
    return event(events.stoppages(v("features"), LOOSE))


MOMENT = ", o as (select *, case when peak - lag(peak) over w <= {gap} then 0 else 1 end as nw, row_number() over w as pos from ev window w as (partition by seq order by peak, type, start, \"end\")), cl as (select *, sum(nw) over (partition by seq order by pos) as c from o), pm as (select seq, c, min(start) as s, max(\"end\") as e, arg_max(peak, worth * 1e9 - pos) as peak, max(confidence) as confidence, max(worth) as interest, string_agg(distinct type, ',' order by type) as types, count(*) as n_events from cl group by seq, c), pw as (select pm.*, n, greatest(0, least(s, peak - 100)) as s1, least(n - 1, e + 50) as e1 from pm join (select seq, max(i) + 1 as n from features group by seq) using (seq)), mo as (select seq, case when e1 - s1 > {most} then greatest(0, peak - {half}) else s1 end as start, case when e1 - s1 > {most} then least(n - 1, peak + {half}) else e1 end as \"end\", peak, confidence, types, n_events, interest from pw)"


def sizes(f: DataFrame) -> DataFrame:
    return f.groupBy("seq").agg((F.max("i") + 1).alias("n"))


@query(SHOT + TACKLE + ", ev as (select *, confidence as worth from shots union all select *, confidence from tackles)" + MOMENT.format(gap=40, most=300, half=150) + " select seq, start, \"end\", peak, confidence, types, n_events from mo", "features")
def merge_moments(v, t):
    f = v("features")
    return events.moments(events.shots(f).unionByName(events.tackles(f)), sizes(f))


@query(SHOT + ", lab as (select seq, i from features where flip) select l.seq, l.i, coalesce(bool_or(l.i between s.start and s.\"end\"), false) as covered from lab l left join shots s on s.seq = l.seq group by l.seq, l.i", "features")
def label_coverage(v, t):
    f = v("features")
    return joins.contained(f.where("flip").select("seq", "i"), events.shots(f), "i", "start", "end", ["seq"])


@query(", lab as (select seq, i as pos from features where flip), p as (select lab.seq, pos, max(speed) as top from lab join features f on f.seq = lab.seq and abs(f.i - pos) <= 38 group by lab.seq, pos) select p.seq, p.pos as \"at\", round(top, 6) as peak_speed, round(avg(case when f.speed < top then 1e0 else 0e0 end), 4) as slower from p join features f on f.seq = p.seq group by p.seq, p.pos, top", "features")
def label_plausibility(v, t):
    f = v("features")
    return events.label_plausibility(f, f.where("flip").select("seq", F.col("i").alias("at"))).select("seq", "at", r("peak_speed", 6).alias("peak_speed"), r("slower").alias("slower"))


# ---- basketball events


def hoop_sql(hoop: str) -> str:
    d, h, x = f"d_{hoop}", f"hd_{hoop}", hoop[0]
    return (
        f", {x}1 as (select l.seq, l.pre, l.post, a.{d} as dp, least(min(f.{d}), b.{d}) as reach from lost l join features a on a.seq = l.seq and a.i = l.pre join features b on b.seq = l.seq and b.i = l.post join features f on f.seq = l.seq and f.i between l.s and l.e group by l.seq, l.pre, l.post, a.{d}, b.{d})"
        f", {x}2 as (select *, case when i - lag(i) over (partition by seq order by i) <= 7 then 0 else 1 end as nw from features where detected and {h} > 0.3e0 and {d} < 5.8e0 and speed > 3), {x}3 as (select *, sum(nw) over (partition by seq order by i) as run from {x}2)"
        f", {x}s as (select seq, 'shot_attempt' as type, pre as start, post as \"end\", pre as peak, round(least(greatest(0.5e0 + 0.4e0 * (dp - reach) / 8e0, 0.35e0), 0.95e0), 2) as confidence, '{hoop}' as hoop from {x}1 where dp - reach >= 0.3e0 and reach <= 3.3e0 union all select seq, 'shot_attempt', min(i), max(i), min(i), round(least(greatest(0.4e0 + 0.3e0 * (arg_min({d}, i) - arg_max({d}, i)) / 6e0, 0.3e0), 0.85e0), 2), '{hoop}' from {x}3 group by seq, run having max(i) - min(i) + 1 >= 3)"
    )


HOOPS = events.Basketball(lost_frames=3, approach=0.3)


@query(LOST.format(n=3) + hoop_sql("left").replace("< 5.8e0", "< 2.1e0") + hoop_sql("right").replace("< 5.8e0", "< 2.1e0") + " select * from ls union all select * from rs", "features")
def bb_shots(v, t):
    return event(events.hoop_shots(v("features"), HOOPS), "hoop")


@query(EV_BEST.format(b=7, c="speed > 2") + ", run as (select seq, min(i) as s, max(i) as e, arg_max(i, speed * 1e9 - i) as peak, abs(arg_max(px, i) / 4e0 - arg_min(px, i) / 4e0) as dx from g group by seq, run having max(i) - min(i) + 1 >= 2) select r.seq, 'fast_break' as type, r.s as start, r.e as \"end\", r.peak, round(least(greatest(0.45e0 + 0.35e0 * dx / 20e0, 0.3e0), 0.9e0), 2) as confidence from run r join features f on f.seq = r.seq and f.i between r.s and r.e where dx >= 0.1e0 group by r.seq, r.s, r.e, r.peak, dx having abs(avg(f.stream)) > 2", "features")
def bb_fast_breaks(v, t):
    on_court = v("features").withColumn("px", F.col("px") / 4.0)  # the view's places are of a pitch
    return event(events.fast_breaks(on_court, events.Basketball(break_speed=2.0, break_frames=2, break_metres=0.1)))


def near_sql(hoop: str, cond: str, least: int, ahead: int, aggs: str) -> str:
    d, x = f"d_{hoop}", hoop[0]
    return (
        f", {x}2 as (select *, case when i - lag(i) over (partition by seq order by i) <= 5 then 0 else 1 end as nw from features where {cond}), {x}3 as (select *, sum(nw) over (partition by seq order by i) as run from {x}2), {x}4 as (select seq, min(i) as s, max(i) as e, arg_min(i, {d} * 1e9 + i) as rim, arg_max({d}, i) as d0, arg_min(possession, i) as p0 from {x}3 group by seq, run having max(i) - min(i) + 1 >= {least})"
        f", {x}5 as (select r.seq, r.s, r.e, r.rim, r.d0, r.p0, {aggs} from {x}4 r join features f on f.seq = r.seq and f.i >= r.e and f.i < r.e + {ahead} group by r.seq, r.s, r.e, r.rim, r.d0, r.p0)"
    )


def blocks_sql(hoop: str) -> str:
    return near_sql(hoop, f"detected and d_{hoop} < 2.8e0 and hd_{hoop} > 0.2e0", 2, 15, f"bool_or(f.hd_{hoop} < -0.4e0) as away, arg_max(f.d_{hoop}, f.i) as d1")


@query(blocks_sql("left") + blocks_sql("right") + ", n as (select seq, max(i) + 1 as n from features group by seq) select l5.seq, 'block_proxy' as type, s as start, least(n - 1, e + 15) as \"end\", s as peak, 0.45e0 as confidence, 'left' as hoop from l5 join n using (seq) where away and d1 - d0 > 1.5e0 union all select r5.seq, 'block_proxy', s, least(n - 1, e + 15), s, 0.45e0, 'right' from r5 join n using (seq) where away and d1 - d0 > 1.5e0", "features")
def bb_blocks(v, t):
    return event(events.blocks(v("features")), "hoop")


def made_sql(hoop: str) -> str:
    x = hoop[0]
    return near_sql(hoop, f"d_{hoop} < 1.8e0", 1, 50, f"bool_or(f.hd_{hoop} < -0.2e0) as away, bool_or(f.flip) as fl, arg_max(f.possession, f.i) as p1") + (
        f", {x}6 as (select *, fl or (p1 <> 0 and p0 <> 0 and p1 <> p0) as turned from {x}5), {x}7 as (select *, coalesce(first_shot, rim) as anchor from (select h.*, n, arg_min(sh.peak, sh.start) filter (where h.rim between sh.start and sh.\"end\" + 5) as first_shot from {x}6 h join nn on nn.seq = h.seq left join sh on sh.seq = h.seq where away or turned group by all))"
        f", {x}8 as (select seq, 'likely_made_basket' as type, least(anchor, s) as start, least(n - 1, least(n, e + 50)) as \"end\", anchor as peak, round(least(greatest(0.4e0 + 0.2e0 * away::int + 0.2e0 * turned::int, 0.3e0), 0.7e0), 2) as confidence, '{hoop}' as hoop from {x}7)"
    )


SH = ", sh as (select seq, 'shot_attempt' as type, i as start, i + 3 as \"end\", i as peak, 0.5e0 as confidence from features where flip and detected), nn as (select seq, max(i) + 1 as n from features group by seq)"


def sample_shots(f: DataFrame) -> DataFrame:
    return f.where("flip and detected").select("seq", F.lit("shot_attempt").alias("type"), F.col("i").alias("start"), (F.col("i") + 3).alias("end"), F.col("i").alias("peak"), F.lit(0.5).alias("confidence"))


@query(SH + made_sql("left") + made_sql("right") + " select * from l8 union all select * from r8", "features")
def bb_made_baskets(v, t):
    f = v("features")
    return event(events.made_baskets(f, sample_shots(f)), "hoop")


@query(SH + made_sql("left") + made_sql("right") + ", ev as (select seq, type, start, \"end\", peak, confidence, round(1e0 + 0.25e0 * confidence, 6) as worth from (select * from l8 union all select * from r8) union all select *, round(0.5e0 + 0.25e0 * confidence, 6) from sh)" + MOMENT.format(gap=20, most=275, half=137) + " select seq, start, \"end\", peak, confidence, types, n_events, round(interest, 3) as interest, row_number() over (partition by seq order by round(interest, 3) desc, peak) as rank from mo", "features")
def bb_ranked_moments(v, t):
    f = v("features")
    found = sample_shots(f)
    return events.moments(found.unionByName(events.made_baskets(f, found).drop("hoop")), sizes(f), events.INTEREST, gap=20, longest=275)


# ---- matching and evaluation


IOU = "greatest(0e0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0e0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
PAIRS = f", p as (select a.frame, a.cls, a.det_id, b.det_id as g_det_id, a.conf, {IOU} / (a.w * a.h + b.w * b.h - {IOU}) as iou from boxes a join gt b on a.frame = b.frame and a.cls = b.cls)"


@query(PAIRS + " select frame, cls, det_id, g_det_id, round(iou, 4) as iou from (select *, row_number() over (partition by frame, cls, det_id order by iou desc, g_det_id) as rk from p where iou >= 0.5) where rk = 1", "boxes", "gt")
def iou_best_match(v, t):
    return evaluation.best_overlaps(v("boxes"), v("gt"), ["frame", "cls"]).select("frame", "cls", "det_id", "g_det_id", r("iou").alias("iou"))


@query(PAIRS + " select cls, count(*) as n, round(avg(iou), 4) as mean_iou from p where iou > 0 group by cls", "boxes", "gt")
def iou_pairs(v, t):
    a, b = v("boxes"), v("gt").select("frame", "cls", *[F.col(c).alias(f"g_{c}") for c in ("x", "y", "w", "h")])
    p = a.join(b, ["frame", "cls"]).withColumn("iou", g.iou(("x", "y", "w", "h"), ("g_x", "g_y", "g_w", "g_h"))).where("iou > 0")
    return p.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), r(F.avg("iou")).alias("mean_iou"))


@query(", pr as (select b.frame, b.cls, b.det_id, q.det_id as g_det_id, b.conf, greatest(0e0, least(b.x + b.w, q.x + q.w) - greatest(b.x, q.x)) * greatest(0e0, least(b.y + b.h, q.y + q.h) - greatest(b.y, q.y)) as meet, b.w * b.h + q.w * q.h as two from boxes b join gt q on q.frame = b.frame and q.cls = b.cls), iv as (select *, meet / (two - meet) as iou from pr where meet / (two - meet) >= 0.5e0), od as (select *, row_number() over (partition by frame, cls order by conf desc, det_id, iou desc, g_det_id) as rn from iv), gm as (select frame, cls, rn, det_id, g_det_id, iou, true as ok, [det_id] as l, [g_det_id] as rr from od where rn = 1 union all select o.frame, o.cls, o.rn, o.det_id, o.g_det_id, o.iou, not (list_contains(l, o.det_id) or list_contains(rr, o.g_det_id)), case when list_contains(l, o.det_id) or list_contains(rr, o.g_det_id) then l else list_append(l, o.det_id) end, case when list_contains(l, o.det_id) or list_contains(rr, o.g_det_id) then rr else list_append(rr, o.g_det_id) end from gm join od o on o.frame = gm.frame and o.cls = gm.cls and o.rn = gm.rn + 1) select frame, cls, det_id, g_det_id, round(iou, 4) as iou from gm where ok", "boxes", "gt")
def greedy_detection_match(v, t):
    b = v("gt").select("frame", "cls", *[F.col(c).alias(f"g_{c}") for c in ("det_id", "x", "y", "w", "h")])
    p = v("boxes").join(b, ["frame", "cls"]).withColumn("iou", g.iou(("x", "y", "w", "h"), ("g_x", "g_y", "g_w", "g_h"))).where("iou >= 0.5")
    return joins.greedy_matches(p, ["frame", "cls"], "iou", "det_id", "g_det_id", first="conf").select("frame", "cls", "det_id", "g_det_id", r("iou").alias("iou"))


@query("select cls, count(case when conf >= 0.25 and y_true = 1 then 1 end) as tp, count(case when conf >= 0.25 and y_true = 0 then 1 end) as fp, count(case when conf < 0.25 and y_true = 1 then 1 end) as fn, round(count(case when conf >= 0.25 and y_true = 1 then 1 end) / nullif(count(case when conf >= 0.25 then 1 end), 0), 4) as \"precision\", round(count(case when conf >= 0.25 and y_true = 1 then 1 end) / nullif(count(case when y_true = 1 then 1 end), 0), 4) as recall from scored group by cls", "scored")
def precision_recall_at_conf(v, t):
    return evaluation.precision_recall(v("scored"), "conf", "y_true", 0.25, ["cls"]).select("cls", "tp", "fp", "fn", r("precision").alias("precision"), r("recall").alias("recall"))


@query(", c as (select cls, sum(y_true) over (partition by cls order by conf desc, doc_id) as tp, row_number() over (partition by cls order by conf desc, doc_id) as n, sum(y_true) over (partition by cls) as total from scored), pr as (select cls, tp / n as p, tp / total as r from c where total > 0), ts as (select unnest(range(11)) / 10 as t) select cls, round(sum(coalesce(best, 0)) / 11, 4) as ap from (select k.cls, ts.t, max(case when pr.r >= ts.t then pr.p end) as best from (select distinct cls from pr) k cross join ts join pr on pr.cls = k.cls group by k.cls, ts.t) group by cls", "scored")
def average_precision_11pt(v, t):
    return evaluation.average_precision(v("scored"), "conf", "y_true", "cls", "doc_id").select("cls", r("ap").alias("ap"))


@query(", gr as (select t / 100e0 as threshold from range(1, 96) x(t)), s as (select threshold, count(case when y_true = 1 and conf < threshold then 1 end) / nullif(count(case when y_true = 1 then 1 end), 0) as fr, count(case when y_true = 0 and conf < threshold then 1 end) / nullif(count(case when y_true = 0 then 1 end), 0) as tr from scored cross join gr group by threshold) select round(threshold, 2) as threshold, round(fr, 4) as false_reject, round(tr, 4) as true_reject from s where fr <= 0.05 order by threshold desc limit 1", "scored")
def threshold_tuning(v, t):
    return evaluation.tune_threshold(v("scored"), "conf", "y_true").select(r("threshold", 2).alias("threshold"), r("false_reject").alias("false_reject"), r("true_reject").alias("true_reject"))


@query("select round(avg(case when lang = 'en' then keep end), 4) as recall, round(avg(case when keep = 1 then (lang = 'en')::int end), 4) as \"precision\", round(avg(case when lang = 'de' then 1 - keep end), 4) as reject_de, round(avg(case when lang = 'fr' then 1 - keep end), 4) as reject_fr from (select cls as lang, (conf >= 0.3)::int as keep from scored)", "scored")
def filter_quality(v, t):
    out = evaluation.filter_quality(v("scored"), F.col("conf") >= 0.3, "cls", "en", ["de", "fr"])
    return out.select(*[r(c).alias(c) for c in out.columns])


# ---- identity


VOTES = ", c as (select track_id, crop_idx % 3 as cl, count(*) as n from crops group by 1, 2), b as (select *, row_number() over (partition by track_id order by n desc, cl) as rk, sum(n) over (partition by track_id) as total from c), d as (select track_id, avg(abs(embedding[1])) as mean_dist from crops group by track_id), v as (select b.track_id, cl as majority_cluster, cast(total as bigint) as n_dets, n / total as purity, mean_dist from b join d using (track_id) where rk = 1)"


def votes(v) -> DataFrame:
    rows = v("crops").withColumn("cl", F.col("crop_idx") % 3).withColumn("dist", F.abs(F.col("embedding")[0]))
    return identity.majority_vote(rows, "track_id", "cl", "dist")


@query(VOTES + " select track_id, majority_cluster, n_dets, round(purity, 4) as purity from v", "crops")
def majority_vote_roles(v, t):
    return votes(v).select("track_id", "majority_cluster", "n_dets", r("purity").alias("purity"))


@query(VOTES + " select majority_cluster, count(*) as n, round(avg(purity), 4) as purity from v group by majority_cluster", "crops")
def vote_purity(v, t):
    return votes(v).groupBy("majority_cluster").agg(F.count(F.lit(1)).alias("n"), r(F.avg("purity")).alias("purity"))


@query(VOTES + ", q as (select quantile_cont(mean_dist, 0.8) as cut from v) select track_id, case when mean_dist > cut then 'Referee' when majority_cluster = 0 then 'TeamA' else 'TeamB' end as role from v, q", "crops")
def outlier_roles(v, t):
    return identity.outlier_roles(votes(v), 0.8).select("track_id", "role")


@query("select crop_idx from crops where 1 / (1 + exp(-(list_sum(list_transform(embedding, lambda x: x::double * 0.8e0)) + 0.1e0))) >= 0.5", "crops")
def appearance_filter(v, t):
    return v("crops").where(evaluation.appearance_score("embedding", [0.8] * 64, 0.1) >= 0.5).select("crop_idx")


@query("select count(*) as n, round(greatest(avg(((crop_idx % 2 = 0) = (hand = 'A'))::int), 1 - avg(((crop_idx % 2 = 0) = (hand = 'A'))::int)), 4) as accuracy from crops where hand in ('A', 'B')", "crops")
def team_accuracy_aligned(v, t):
    return identity.aligned_accuracy(v("crops").withColumn("cl", F.col("crop_idx") % 2), "cl", "hand").select("n", r("accuracy").alias("accuracy"))


ASOF = "with v as (select event_id, epoch_us(ts) as us from events where event_type = 'view'), p as (select event_id as sid, epoch_us(ts) as sus, user_id % 7 as tag from events where event_type = 'purchase') select event_id, tag, sid, dt from (select event_id, tag, sid, abs(us - sus) as dt, row_number() over (partition by event_id, tag order by abs(us - sus), sid) as rk from v join p on sus between us - 600000000 and us + 600000000) where rk = 1"


def sensor_pair(t) -> tuple[DataFrame, DataFrame]:
    e = t("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.where("event_type = 'view'").select("event_id", "us"), e.where("event_type = 'purchase'").select(F.col("event_id").alias("sid"), F.col("us").alias("sus"), (F.col("user_id") % 7).alias("tag"))


@query(ASOF)
def asof_tolerance(v, t):
    return joins.asof_within(*sensor_pair(t), "event_id", "us", "sid", "sus", 600_000_000, ["tag"]).select("event_id", "tag", "sid", "dt")


@query(ASOF.replace("select event_id, tag, sid, dt from (select event_id, tag, sid, abs(us - sus) as dt, row_number() over (partition by event_id, tag order by abs(us - sus), sid) as rk", "select event_id, sid, dt from (select event_id, sid, dt, rk, row_number() over (partition by sid order by dt, event_id) as rk2 from (select event_id, sid, abs(us - sus) as dt, row_number() over (partition by event_id order by abs(us - sus), sid) as rk").replace(") where rk = 1", ") where rk = 1) where rk2 = 1"))
def mutual_nn(v, t):
    picked = joins.asof_within(*sensor_pair(t), "event_id", "us", "sid", "sus", 600_000_000)
    return joins.mutual_nearest(picked, [], "event_id", "sid", "dt").select("event_id", "sid", "dt")


ENDS = ", tr as (select concat('SEQ-', cast(track_id % 3 as varchar)) as seq, track_id, frame, det_id, x / 10e0 as x, y / 10e0 as y, row_number() over (partition by track_id order by frame, det_id) as up, row_number() over (partition by track_id order by frame desc, det_id desc) as dn, count(*) over (partition by track_id) as n from boxes)"


def short_tracks(v) -> DataFrame:
    """Gapless track pieces of up to 12 rows over the positions, with frames on a common clock."""
    p = v("trk")
    return p.select("seq", (F.col("track_id") * 100 + F.floor((F.col("frame") - 1) / 4)).alias("track_id"), ((F.col("track_id") * 7) % 50 + F.col("frame") * 2).alias("frame"), F.col("x_m"), F.col("y_m"))


SHORT = ", s as (select seq, track_id * 100 + cast(floor((frame - 1) / 4) as bigint) as track_id, (track_id * 7) % 50 + frame * 2 as frame, x_m, y_m from trk), n as (select *, row_number() over (partition by track_id order by frame) as up, row_number() over (partition by track_id order by frame desc) as dn, count(*) over (partition by track_id) as n from s), ends as (select seq, track_id, min(frame) as f0, max(frame) as f1, count(*) as n_frames, max(case when up = 1 then x_m end) as x0, max(case when up = 1 then y_m end) as y0, max(case when dn = 1 then x_m end) as x1, max(case when dn = 1 then y_m end) as y1, coalesce((max(case when up = least(4, n) then x_m end) - max(case when up = 1 then x_m end)) / nullif((max(least(4, n)) - 1) * 0.4e0, 0), 0) as vx0, coalesce((max(case when up = least(4, n) then y_m end) - max(case when up = 1 then y_m end)) / nullif((max(least(4, n)) - 1) * 0.4e0, 0), 0) as vy0, coalesce((max(case when dn = 1 then x_m end) - max(case when dn = least(4, n) then x_m end)) / nullif((max(least(4, n)) - 1) * 0.4e0, 0), 0) as vx1, coalesce((max(case when dn = 1 then y_m end) - max(case when dn = least(4, n) then y_m end)) / nullif((max(least(4, n)) - 1) * 0.4e0, 0), 0) as vy1 from n group by seq, track_id)"
LINKS = SHORT + ", pr as (select a.seq, a.track_id as a, b.track_id as b, b.f0 - a.f1 as df, sqrt(pow(a.x1 + a.vx1 * (b.f0 - a.f1) * 0.4e0 - b.x0, 2) + pow(a.y1 + a.vy1 * (b.f0 - a.f1) * 0.4e0 - b.y0, 2)) as d, sqrt(pow(a.x1 - b.x0, 2) + pow(a.y1 - b.y0, 2)) / ((b.f0 - a.f1) * 0.4e0) as implied, case when sqrt(a.vx1 * a.vx1 + a.vy1 * a.vy1) > 1 and sqrt(b.vx0 * b.vx0 + b.vy0 * b.vy0) > 1 then (a.vx1 * b.vx0 + a.vy1 * b.vy0) / (sqrt(a.vx1 * a.vx1 + a.vy1 * a.vy1) * sqrt(b.vx0 * b.vx0 + b.vy0 * b.vy0)) end as c from ends a join ends b on a.seq = b.seq and b.f0 - a.f1 between 1 and 8 and a.track_id <> b.track_id), cand as (select seq, a, b, df, d, d + 0.3e0 * df as score from pr where d <= 12 and implied <= 30 and coalesce(c >= -0.2e0, true))"


RELINK = identity.Relink(gap=8, metres=12.0, dt=0.4, top_speed=30.0)


def short_ends(v) -> DataFrame:
    return identity.endpoints(short_tracks(v), dt=RELINK.dt)


@query(LINKS + " select seq, a, b, df, round(d, 4) as d, round(score, 4) as score from cand", "trk")
def relink_candidates(v, t):
    found = identity.relink_candidates(short_ends(v), RELINK.gap, RELINK.metres, RELINK.dt, RELINK.top_speed)
    return found.select("seq", "a", "b", "df", r("d").alias("d"), r("score").alias("score"))


@query(LINKS + ", od as (select *, row_number() over (partition by seq order by score, a, b) as rn from cand), gm as (select seq, rn, a, b, true as ok, [a] as l, [b] as rr from od where rn = 1 union all select o.seq, o.rn, o.a, o.b, not (list_contains(l, o.a) or list_contains(rr, o.b)), case when list_contains(l, o.a) or list_contains(rr, o.b) then l else list_append(l, o.a) end, case when list_contains(l, o.a) or list_contains(rr, o.b) then rr else list_append(rr, o.b) end from gm join od o on o.seq = gm.seq and o.rn = gm.rn + 1), ln as materialized (select b as id, a as parent from gm where ok), up as (select id, parent as root from ln union all select up.id, ln.parent from up join ln on ln.id = up.root) select id, root from up where root not in (select id from ln)", "trk")
def relink_chain(v, t):
    links = identity.relink_greedily(short_ends(v), RELINK)
    return folds.resolve_chains(links.select(F.col("b").alias("id"), F.col("a").alias("parent")))


@query(", f as (select seq, track_id, cast(floor((min(frame) - 1) / 2e0) as bigint) as minute from trk group by seq, track_id), c as (select seq, minute, count(*) as n from f group by seq, minute), sp as (select seq, unnest(range(0, cast(floor((max(frame) - 1) / 2e0) as bigint) + 1)) as minute from trk group by seq) select sp.seq, sp.minute, coalesce(n, 0) as new_ids, cast(sum(coalesce(n, 0)) over (partition by sp.seq order by sp.minute) as bigint) as total_ids from sp left join c on c.seq = sp.seq and c.minute = sp.minute", "trk")
def id_accumulation(v, t):
    return metrics.id_accumulation(v("trk"), fps=1 / 30)


@query(", p as (select seq, track_id, max(frame) - min(frame) + 1 as life, count(*) as n from trk group by seq, track_id) select seq, count(*) as n_tracks, count(case when n >= 8 then 1 end) as n_substantial, round(quantile_cont(life, 0.5), 4) as life_p50, round(quantile_cont(life, 0.9), 4) as life_p90, max(life) as life_max from p group by seq", "trk")
def track_lifetimes(v, t):
    return metrics.lifetimes(v("trk"), 8).select("seq", "n_tracks", "n_substantial", r("life_p50").alias("life_p50"), r("life_p90").alias("life_p90"), "life_max")


@query(", m as (select pk % 50 as gt_id, track_id, frame, det_id from boxes), s as (select *, case when track_id <> lag(track_id) over (partition by gt_id order by frame, det_id) then 1 else 0 end as sw from m), c as (select gt_id, track_id, count(*) as n from m group by gt_id, track_id) select s.gt_id, count(*) as n, count(distinct track_id) as n_tracks, cast(sum(sw) as bigint) as switches, round(max(mx) / cast(count(*) as double), 4) as purity from s join (select gt_id, max(n) as mx from c group by gt_id) x using (gt_id) group by s.gt_id", "boxes")
def id_switch_purity(v, t):
    m = v("boxes").select((F.col("pk") % 50).alias("gt_id"), "track_id", (F.col("frame") * 1000 + F.col("det_id")).alias("frame"))
    return identity.identity_switches(m).select("gt_id", "n", "n_tracks", "switches", r("purity").alias("purity"))


@query(", s as (select track_id, frame, x_m, y_m, count(*) over (partition by track_id) as life, lag(x_m, 2) over w as px, lag(y_m, 2) over w as py, lag(frame, 2) over w as pf from trk window w as (partition by track_id order by frame)), d as (select sqrt((x_m - px) * (x_m - px) + (y_m - py) * (y_m - py)) / ((frame - pf) / 25e0) as v from s where life >= 5), b as (select case when v < 300 then 'slow' when v < 600 then 'mid' else 'fast' end as band from d where v <= 900) select band, count(*) as n, round(100e0 * count(*) / sum(count(*)) over (), 4) as pct from b group by band", "trk")
def speed_band_time_share(v, t):
    out = metrics.band_time_share(v("trk"), k=2, min_life=5, guard=900.0, bands=((300.0, 600.0), ("slow", "mid", "fast")))
    return out.select("band", "n", r("pct").alias("pct"))


# ---- grids, jobs, data sets


@query("select job_id, sport from jobs where state = 'queued' order by created_at, job_id limit 5", "jobs")
def job_queue_head(v, t):
    return jobs.queue_head(v("jobs"), 5).select("job_id", "sport")


@query("select sport, count(*) as n_jobs, count(case when state = 'ready' then 1 end) as n_ready, round(sum(duration_sec) / 3600, 4) as hours from jobs group by sport", "jobs")
def dashboard_stats(v, t):
    return jobs.dashboard(v("jobs")).select("sport", "n_jobs", "n_ready", r("hours").alias("hours"))


@query("select job_id, case when duration_sec > 1200 then 'coach_analytics' else deliverables end as granted from jobs", "jobs")
def deliverable_rules(v, t):
    return v("jobs").select("job_id", F.array_join(jobs.deliverables(F.col("duration_sec"), F.col("deliverables")), ",").alias("granted"))


@query("select case state when 'queued' then 'waiting' when 'ready' then 'ready' else 'failed' end as cloud, count(*) as n from jobs group by 1", "jobs")
def cloud_state_map(v, t):
    return v("jobs").groupBy(jobs.cloud_state(F.col("state")).alias("cloud")).agg(F.count(F.lit(1)).alias("n"))


@query("select job_id, 'duration' as broken from jobs where duration_sec / 3000 not between 0.2 and 1", "jobs")
def job_constraint_violations(v, t):
    return jobs.violations(v("jobs"), 0.2, 1.0).select("job_id", "broken")


@query("select job_id, step, cast(round(100e0 * row_number() over (partition by job_id order by no) / count(*) over (partition by job_id)) as bigint) as pct from jobs join (values ('decode', 1, null), ('track', 2, null), ('coach', 3, 'coach_analytics'), ('clips', 4, 'event_highlights'), ('reels', 5, 'player_highlights')) s(step, no, needs) on needs is null or contains(',' || deliverables || ',', ',' || needs || ',')", "jobs")
def job_progress(v, t):
    j = v("jobs")
    steps = j.sparkSession.createDataFrame([("decode", 1, None), ("track", 2, None), ("coach", 3, "coach_analytics"), ("clips", 4, "event_highlights"), ("reels", 5, "player_highlights")], "step string, no int, needs string")
    return jobs.progress(jobs.resolve_steps(j, steps)).select("job_id", "step", "pct")


@query("select l_orderkey as frame, pk, dense_rank() over (order by first, pk) as new_id from (select l_orderkey, l_partkey as pk, min(l_orderkey) over (partition by l_partkey) as first from lineitem)")
def mot_reindex(v, t):
    li = t("lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("pk"))
    return files.reindexed(li, "pk", "frame", "new_id").select("frame", "pk", "new_id")


@query("select frame, det_id, round((x + w / 2) / 1280, 4) as cx, round((y + h / 2) / 720, 4) as cy, round(w / 1280, 4) as w, round(h / 720, 4) as h from boxes where frame % 5 = 1 and w > 0 and h > 0", "boxes")
def yolo_normalise(v, t):
    cx, cy, w, h = g.to_centre("x", "y", "w", "h", 1280.0, 720.0)
    return v("boxes").where("(frame - 1) % 5 = 0 and w > 0 and h > 0").select("frame", "det_id", r(cx).alias("cx"), r(cy).alias("cy"), r(w).alias("w"), r(h).alias("h"))


@query("select code, count(*) as n from (select case when lower(p_type) = 'promo' then 0 when lower(p_type) in ('small', 'large') then 1 end as code from part) where code is not null group by code")
def class_remap(v, t):
    name = F.regexp_replace(F.regexp_replace("p_type", "PROMO", "Match Ball"), "SMALL|LARGE", "Goalkeeper 1")
    return t("part").select(files.class_code(name).alias("code")).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---- sequential, learned and streaming operators: checked by tests


def ball_detections(v) -> DataFrame:
    return v("ball").where("status <> 'lost'").select("seq", "frame", "x", "y", F.coalesce("picked_conf", F.lit(0.2)).alias("conf"))


@query(None)
def kalman_track(v, t):
    return tracking.kalman_track(ball_detections(v), ["seq"])


@query(None)
def hungarian_identity(v, t):
    p = v("boxes").join(v("gt").select("frame", F.col("track_id").alias("gt_id"), F.col("x").alias("gx"), F.col("y").alias("gy")), "frame")
    p = p.withColumn("d", g.distance("x", "y", "gx", "gy")).where("d <= 60")
    return joins.optimal_matches(p, ["frame"], "d", "det_id", "gt_id", 60.0)


from . import catalog_extra, catalog_more  # noqa: E402, F401  (register more queries)
