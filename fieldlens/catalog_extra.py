"""More registered queries: projection, signals, diagnosis, reports, the job store and streams, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import BALL_W, H, HX, HY, ORACLES, SHOT, big, query, r, short_tracks, touching
from .functions import geometry as g
from .operators import diagnosis, evaluation, folds, homography, joins, metrics, projection, ranking, signals, windows
from .plans import events, jobs
from .sources import files
from .sources.shared import checkpoint, folder
from .streaming import live

LASTV = "last_value({e} ignore nulls) over (partition by {p} order by frame rows between unbounded preceding and {to})"


# ---- projection


def ball_matrices(v) -> DataFrame:
    h = F.array(0.09 + F.col("b_x") / 1e6, *[F.lit(float(x)) for x in H[1:]])
    return v("ball_px").where("status = 'detected'").select("frame", h.alias("h"))


OWN_HX = HX.replace("0.09e0 * x", "(0.09e0 + p.b_x / 1e6) * x", 1)


@query(f"select b.frame, det_id, round({OWN_HX}, 4) + 0e0 as px, round({HY}, 4) + 0e0 as py from boxes b join ball_px p on p.frame = b.frame where p.status = 'detected'", "boxes", "ball_px")
def track_projection(v, t):
    return projection.on_pitch(v("boxes"), ball_matrices(v)).select("frame", "det_id", r("px").alias("px"), r("py").alias("py"))


@query("select track_id, count(*) as n_points, 9e-2 as h0, 0e0 as holdout from boxes group by track_id having count(distinct (x, y)) >= 8", "boxes")
def homography_fit(v, t):
    px, py = g.project("x", "y", H)
    marked = v("boxes").select("track_id", "x", "y", px.alias("u"), py.alias("v"))
    enough = marked.groupBy("track_id").agg(F.count_distinct("x", "y").alias("n")).where("n >= 8")
    fits = homography.fit_homographies(marked.join(enough, "track_id", "left_semi"), ["track_id"])
    return fits.select("track_id", F.col("n_points").cast("bigint").alias("n_points"), r(F.col("h")[0]).alias("h0"), r("holdout").alias("holdout"))


@query(None)
def appearance_probe(v, t):
    crops = v("crops")
    weights, bias = evaluation.train_probe(crops.select("embedding", (F.col("hand") == "ref").cast("int").alias("ref")), "embedding", "ref")
    return crops.select("crop_idx", r(evaluation.appearance_score("embedding", weights, bias)).alias("score"))


@query("select seq, unnest(range(1, max(frame) + 1)) as frame, 9e-2 as scale from ball group by seq", "ball")
def static_projection(v, t):
    still = v("ball").groupBy("seq").agg(F.max("frame").alias("n")).withColumn("h", F.array(*[F.lit(float(x)) for x in H]))
    return projection.every_frame(still, "n").select("seq", "frame", F.col("h")[0].alias("scale"))


NEAR_BOX = "sqrt(pow(greatest(b.x - p.b_x, 0e0, p.b_x - (b.x + b.w)), 2) + pow(greatest(b.y - p.b_y, 0e0, p.b_y - (b.y + b.h)), 2))"


@query(f", n as (select p.frame, min({NEAR_BOX}) as d from ball_px p join boxes b on b.frame = p.frame group by p.frame) select p.frame, coalesce(d <= 60, true) as near from ball_px p left join n on n.frame = p.frame", "boxes", "ball_px")
def ball_near_player(v, t):
    return projection.near_player(v("ball_px"), v("boxes"), ["frame"], "b_x", "b_y", 60.0).select("frame", "near")


@query("select frame, det_id from boxes where y >= 1e-1 * 1280", "boxes")
def boxes_below_top(v, t):
    return projection.below_top(v("boxes"), "y", 1280.0).select("frame", "det_id")


@query("select seq, frame from ball where abs(pitch_x_m) <= 45 and abs(pitch_y_m) <= 30", "ball")
def ball_in_pitch(v, t):
    return projection.ball_on_pitch(v("ball"), half=(40.0, 25.0)).select("seq", "frame")


@query("select track_id, frame from (select *, count(*) over (partition by track_id) as n from trk where abs(x_m) <= 42 and abs(y_m) <= 27) where n >= 2", "trk")
def tracks_in_bounds(v, t):
    return projection.tracks_on_pitch(v("trk"), half=(40.0, 25.0)).select("track_id", "frame")


@query("select track_id, round(avg(case when abs(x_m) <= 41.5e0 and abs(y_m) <= 26.5e0 then 1e0 else 0e0 end), 4) as on_pitch from trk group by track_id", "trk")
def on_court_by_track(v, t):
    return projection.share_on_pitch(v("trk"), ["track_id"], half=(40.0, 25.0)).select("track_id", r("on_pitch").alias("on_pitch"))


@query("select frame, name, round(b_x / 10 * wx + b_x, 4) + 0e0 as u, round(b_y / 10 * wy + b_y, 4) + 0e0 as v from ball_px, (values ('left', -12.75e0, 1e0), ('right', 12.75e0, 1e0)) t(name, wx, wy) where b_x / 10 * wx + b_x between 0 and 1280 and b_y / 10 * wy + b_y between 0 and 720", "ball_px")
def hoops_in_picture(v, t):
    zero = F.lit(0.0)
    m = v("ball_px").select("frame", F.array(F.col("b_x") / 10, zero, "b_x", zero, F.col("b_y") / 10, "b_y", zero, zero, F.lit(1.0)).alias("h"))
    return projection.places_in_picture(m, [("left", -12.75, 1.0), ("right", 12.75, 1.0)], 1280.0, 720.0).select("frame", "name", r("u").alias("u"), r("v").alias("v"))


@query(f", s as (select *, y - lag(y) over w as vy from ball {BALL_W}) select seq, frame, coalesce(x is not null and (y < 3e-1 * 720 or coalesce(abs(vy) > 40, false)), false) as shot from s", "ball")
def shot_flags(v, t):
    b = v("ball").withColumn("vy", F.col("y") - F.lag("y").over(windows.ordered(["seq"], "frame")))
    return b.select("seq", "frame", projection.in_flight(F.col("x"), F.col("y"), F.col("vy"), 720.0, 0.3, 40.0).alias("shot"))


WAS = ", a as (select *, {x} as wx, {y} as wy from ball)".format(**{c: LASTV.format(e=f"pitch_{c}_m", p="seq", to="1 preceding") for c in "xy"})
AERIAL = WAS + ", ae as (select *, coalesce(sqrt((pitch_x_m - wx) * (pitch_x_m - wx) + (pitch_y_m - wy) * (pitch_y_m - wy)) * 25 > 12, false) as aerial from a)"


@query(AERIAL + " select seq, frame, aerial from ae", "ball")
def aerial_suspects(v, t):
    return projection.aerial_suspects(v("ball"), ["seq"], "frame", "pitch_x_m", "pitch_y_m", top=12.0).select("seq", "frame", "aerial")


@query("select track_id, frame from (select *, dense_rank() over (partition by seq order by frame) as k from trk) where (k - 1) % 5 = 0", "trk")
def frame_stride(v, t):
    return projection.every_nth_frame(v("trk"), ["seq"], "frame", 5).select("track_id", "frame")


@query("select track_id, frame from (select *, row_number() over (partition by track_id order by frame) - 1 as k, greatest(1, cast(floor(count(*) over (partition by track_id) / 4) as bigint)) as s from trk) where k % s = 0 and k / s < 4", "trk")
def spread_sample(v, t):
    return projection.spread_sample(v("trk"), ["track_id"], ["frame"], 4).select("track_id", "frame")


@query("select crop_idx, hand from crops order by md5(concat('42:', cast(crop_idx as varchar))), crop_idx limit 20", "crops")
def seeded_sample(v, t):
    return projection.seeded_sample(v("crops"), "crop_idx", 20).select("crop_idx", "hand")


@query("select job_id, case when state = 'ready' then sport when state = 'queued' then 'auto-register (retired)' else sport end as method, case state when 'ready' then 'landmark recon' when 'queued' then 'align resid' else 'calib' end as label, case state when 'ready' then printf('%.1f m', duration_sec / 997 + 0.0123e0) when 'queued' then printf('%.0f px', duration_sec / 7 + 0.0123e0) else 'n/a' end as value from jobs", "jobs")
def calibration_readout(v, t):
    j = v("jobs")
    marks, fit = F.when(F.col("state") == "ready", F.col("duration_sec") / 997 + 0.0123), F.when(F.col("state") == "queued", F.col("duration_sec") / 7 + 0.0123)
    return j.select("job_id", *projection.calibration_quality(marks, fit, F.col("sport")))


@query(SHOT + " select seq, start, concat('shot+fast transition  c=', printf('%.2f', confidence), '  [', printf('%.1f', start / 25e0), '-', printf('%.1f', \"end\" / 25e0), 's]') as tag from shots", "features")
def moment_tags(v, t):
    s = events.shots(v("features"))
    return s.select("seq", "start", projection.tag_text(F.array(F.col("type"), F.lit("fast_transition")), F.col("confidence"), F.col("start") / 25.0, F.col("end") / 25.0).alias("tag"))


@query("select job_id, no, label, wx, wy from jobs, (values (0, 'r_basket', 12.425e0, 0e0), (1, 'center', 0e0, 0e0), (2, 'nowhere', null, null), (3, 'l_baseline_near', -14e0, 7.5e0)) t(no, label, wx, wy)", "jobs")
def landmark_places(v, t):
    j = v("jobs").select("job_id", F.array(*map(F.lit, ("r_basket", "center", "nowhere", "l_baseline_near"))).alias("labels"))
    places = projection.court_landmarks(j.sparkSession, 28.0, 15.0, 4.9, 5.8, 1.575, 6.75)
    return projection.world_points(j, places, ["job_id"]).select("job_id", "no", "label", r("wx").alias("wx"), r("wy").alias("wy"))


TOUCH_H = (HX + "|" + HY).replace(" * x", " * cx").replace(" * y", " * cy").split("|")


@query(f", m as (select frame, cast(det_id as varchar) as label, h > 150 as pruned, sqrt(pow({TOUCH_H[0]} - b_x / 20, 2) + pow({TOUCH_H[1]} - b_y / 20, 2)) as d from touch) select frame, coalesce(string_agg(label, ',' order by label) filter (where pruned), '') as pruned, round(avg(d) filter (where not pruned), 4) as error_m, count(case when not pruned then 1 end) as n_marks from m group by frame", "touch")
def landmark_errors(v, t):
    h = F.array(*[F.lit(float(x)) for x in H])
    m = v("touch").select("frame", F.col("det_id").cast("string").alias("label"), F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("b_x") / 20).alias("wx"), (F.col("b_y") / 20).alias("wy"), (F.col("h") > 150).alias("pruned"), h.alias("h"))
    e = projection.landmark_errors(m, ["frame"])
    return e.select("frame", F.array_join("pruned", ",").alias("pruned"), r("error_m").alias("error_m"), F.coalesce("n_marks", F.lit(0)).alias("n_marks"))


# ---- signals


@query(", s as (select *, case when frame - lag(frame) over w = 1 then (x_m - lag(x_m) over w) * 25 end as v from trk window w as (partition by seq, track_id order by frame)) select seq, frame, round(avg(v), 6) + 0e0 as stream from s group by seq, frame", "trk")
def player_stream(v, t):
    return signals.stream(v("trk"), ["seq"], "x_m").select("seq", "frame", r("stream", 6).alias("stream"))


@query(", c as (select *, avg(x_m) over w as mx, avg(y_m) over w as my, count(*) over w as n from trk window w as (partition by seq, frame)), j as (select c.*, sqrt(pow(c.x_m - b.x_m, 2) + pow(c.y_m - b.y_m, 2)) / 0.04e0 as v from c left join trk b on b.seq = c.seq and b.track_id = c.track_id and b.frame = c.frame - 1) select seq, frame, count(*) as n, round(median(v), 3) as speed, round(case when count(*) >= 3 then avg(sqrt(pow(x_m - mx, 2) + pow(y_m - my, 2))) else 0e0 end, 4) as spread from j group by seq, frame", "trk")
def frame_signals(v, t):
    return signals.frame_signals(v("trk"), ["seq"], "x_m", "y_m").select("seq", "frame", "n", r("speed", 3).alias("speed"), r("spread").alias("spread"))


@query("select role, count(*) as n from trk where role in ('TeamA', 'TeamB') group by role", "trk")
def team_rows(v, t):
    p = v("trk")
    return signals.with_roles(p.drop("role"), p.select("track_id", "role").distinct()).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


NEAREST_M = ", pr as (select b.seq, b.frame, p.track_id, p.role, sqrt(pow(b.pitch_x_m - p.x_m, 2) + pow(b.pitch_y_m - p.y_m, 2)) as d from ball b join trk p on p.seq = b.seq and p.frame = b.frame where b.pitch_x_m is not null{c}), nm as (select *, row_number() over (partition by seq, frame order by d, track_id) as rk from pr)"


@query(NEAREST_M.format(c=" and abs(p.x_m) <= 50 and abs(p.y_m) <= 30") + " select seq, frame, track_id, role, round(d, 4) as d from nm where rk = 1 and d <= 15", "ball", "trk")
def court_possession(v, t):
    b = v("ball").where("pitch_x_m is not null").select("seq", "frame", F.col("pitch_x_m").alias("bx"), F.col("pitch_y_m").alias("by"))
    p = v("trk").select("seq", "frame", "track_id", "role", F.col("x_m").alias("px"), F.col("y_m").alias("py"))
    return signals.court_possession(b, p, ["seq", "frame"], (50.0, 30.0), 15.0).select("seq", "frame", "track_id", "role", r("d").alias("d"))


@query(f", s as (select *, pitch_x_m - lag(pitch_x_m) over w as vx, pitch_y_m - lag(pitch_y_m) over w as vy from ball {BALL_W}), q as (select seq, frame, sqrt((52.5e0 - pitch_x_m) * (52.5e0 - pitch_x_m) + pitch_y_m * pitch_y_m) as d, sqrt(vx * vx + vy * vy) as v, vx * (52.5e0 - pitch_x_m) + vy * (0e0 - pitch_y_m) as p from s) select seq, frame, round(d, 4) as d, round(case when d > 1e-6 and v > 1e-6 then p / (d * v) else 0e0 end, 4) + 0e0 as heading from q", "ball")
def goal_geometry(v, t):
    w = windows.ordered(["seq"], "frame")
    d, h = signals.goal_geometry(F.col("pitch_x_m"), F.col("pitch_y_m"), F.col("pitch_x_m") - F.lag("pitch_x_m").over(w), F.col("pitch_y_m") - F.lag("pitch_y_m").over(w), (52.5, 0.0))
    return v("ball").select("seq", "frame", r(d).alias("d"), r(h).alias("heading"))


@query(", b as (select cls, frame, arg_max(x, conf * 1e9 - x - y / 1e5) as x, arg_max(y, conf * 1e9 - x - y / 1e5) as y from boxes group by cls, frame), j as (select *, frame - lag(frame) over w as gap, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as jump from b window w as (partition by cls order by frame)) select cls, count(*) as n, round(quantile_cont(jump, 0.5), 3) as p50, round(quantile_cont(jump, 0.9), 3) as p90 from j where gap = 1 group by cls", "boxes")
def detection_jumps(v, t):
    j = windows.jumps(v("boxes"), ["cls"], "frame", "conf", "x", "y")
    return windows.percentiles(j, ["cls"], "jump", {"p50": 0.5, "p90": 0.9}).select("cls", "n", r("p50", 3).alias("p50"), r("p90", 3).alias("p90"))


@query(f", d as (select seq, frame, x - lag(x) over w as v, x - 2 * lag(x) over w + lag(x, 2) over w as a, x - 3 * lag(x) over w + 3 * lag(x, 2) over w - lag(x, 3) over w as j from ball {BALL_W}) select seq, round(avg(abs(v)), 3) as velocity, round(avg(abs(a)), 3) as acceleration, round(avg(abs(j)), 3) as jerk from d group by seq", "ball")
def path_differences(v, t):
    w = windows.ordered(["seq"], "frame")
    d = v("ball").select("seq", *[windows.differences(F.col("x"), w, n).alias(c) for n, c in ((1, "velocity"), (2, "acceleration"), (3, "jerk"))])
    return d.groupBy("seq").agg(*[r(F.avg(F.abs(c)), 3).alias(c) for c in ("velocity", "acceleration", "jerk")])


@query(AERIAL + NEAREST_M.format(c="") + ", z as (select ae.seq, case when status = 'lost' then 'no_ball_track' when pitch_x_m is null then 'no_pitch' when aerial then 'aerial' when nm.d is null then 'no_players' when nm.d > 5 then 'ball_too_far' else 'counted' end as reason from ae left join nm on nm.seq = ae.seq and nm.frame = ae.frame and nm.rk = 1) select seq, reason, count(*) as n from z group by seq, reason", "ball", "trk")
def possession_exclusions(v, t):
    b = projection.aerial_suspects(v("ball"), ["seq"], "frame", "pitch_x_m", "pitch_y_m", top=12.0)
    p = b.where("pitch_x_m is not null").join(v("trk"), ["seq", "frame"]).withColumn("d", g.distance("pitch_x_m", "pitch_y_m", "x_m", "y_m"))
    return metrics.possession_exclusions(b.join(p.groupBy("seq", "frame").agg(F.min("d").alias("d")), ["seq", "frame"], "left"), ["seq"])


@query(", m as (select seq, i, possession as p, case when possession = lag(possession) over (partition by seq order by i) then 0 else 1 end as nw from features), s as (select *, sum(nw) over (partition by seq order by i) as run from m) select seq, case p when 1 then 'TeamA' when 2 then 'TeamB' else 'none' end as colour, min(i) as start, max(i) as \"end\" from s group by seq, run, p", "features")
def possession_strip(v, t):
    return metrics.possession_strip(v("features").withColumnRenamed("i", "frame"))


# ---- diagnosis


def broken_tracks(v) -> DataFrame:
    return short_tracks(v).select("seq", "track_id", "frame", ((F.col("x_m") + 52.5) * 10).alias("cx"), ((F.col("y_m") + 34.0) * 10).alias("cy"), F.lit(40.0).alias("h"))


BROKEN = ", s as (select seq, track_id * 100 + cast(floor((frame - 1) / 4) as bigint) as track_id, (track_id * 7) % 50 + frame * 2 as frame, (x_m + 52.5e0) * 10 as cx, (y_m + 34e0) * 10 as cy from trk), n as (select *, row_number() over (partition by seq, track_id order by frame) as up, row_number() over (partition by seq, track_id order by frame desc) as dn, count(*) over (partition by seq, track_id) as n, coalesce(cx - lag(cx) over (partition by seq, track_id order by frame), 0e0) as vx, coalesce(cy - lag(cy) over (partition by seq, track_id order by frame), 0e0) as vy from s), e as (select * from n where dn = 1), su as (select e.seq, e.track_id, b.frame - e.frame as gap, b.track_id as successor, row_number() over (partition by e.seq, e.track_id order by b.frame - e.frame, b.track_id) as rk from e join n b on b.seq = e.seq and b.up = 1 and b.frame - e.frame between 1 and 30 and sqrt(pow(e.cx + e.vx * (b.frame - e.frame) - b.cx, 2) + pow(e.cy + e.vy * (b.frame - e.frame) - b.cy, 2)) < 200), oc as (select distinct e.seq, e.track_id from e join s on s.seq = e.seq and s.frame = e.frame and s.track_id <> e.track_id and sqrt(pow(e.cx - s.cx, 2) + pow(e.cy - s.cy, 2)) < 55), ca as (select e.seq, e.track_id, case when n < 4 then 'BLIP' when cx < 30 or cx > 1020 or cy < 30 or cy > 650 or cy + 20 > 650 then 'EDGE' when su.gap is null then 'GENUINE_END' when oc.track_id is not null then 'OCCLUSION' when su.gap <= 3 then 'FLICKER' else 'FAST_MOTION' end as cause from e left join su on su.seq = e.seq and su.track_id = e.track_id and su.rk = 1 left join oc on oc.seq = e.seq and oc.track_id = e.track_id)"
BREAKS = diagnosis.Breaks(min_life=4, edge=30.0, width=1050.0, height=680.0, link=200.0)


@query(BROKEN + " select cause, count(*) as n, round(100e0 * count(*) / sum(count(*)) over (), 4) as pct from ca group by cause", "trk")
def break_causes(v, t):
    return diagnosis.cause_shares(diagnosis.break_causes(broken_tracks(v), c=BREAKS)).select("cause", "n", r("pct").alias("pct"))


@query(BROKEN + " select seq, track_id, gap, successor from su where rk = 1", "trk")
def successor_search(v, t):
    b = broken_tracks(v)
    first = b.withColumn("up", F.row_number().over(Window.partitionBy("seq", "track_id").orderBy("frame"))).where("up = 1")
    return diagnosis.successors(diagnosis.track_ends(b, ["seq"]), first, ["seq"], 30, 200.0)


@query(", m as (select cls, pk % 50 as gt_id, track_id from boxes), c as (select cls, track_id, gt_id, count(*) as n from m group by all), k as (select *, row_number() over (partition by cls, track_id order by n desc, gt_id) as rk from c) select cls, count(distinct track_id) as n_tracks, count(case when rk = 2 then 1 end) as merged, count(case when rk = 2 and n >= 3 then 1 end) as merged_strict from k group by cls", "boxes")
def over_merged(v, t):
    return diagnosis.over_merged(v("boxes").select("cls", (F.col("pk") % 50).alias("gt_id"), "track_id"), ["cls"])


@query(None)
def idf1(v, t):
    m = v("boxes").select("cls", (F.col("pk") % 50).alias("gt_id"), "track_id")
    return diagnosis.identity_f1(m, v("boxes").groupBy("cls").agg(F.count(F.lit(1)).alias("n")), ["cls"])


@query(", p as (select px.frame, b.det_id, b.w, b.h, row_number() over (partition by px.frame order by sqrt((px.b_x - b.x) * (px.b_x - b.x) + (px.b_y - b.y) * (px.b_y - b.y)), det_id) as rk, sqrt((px.b_x - b.x) * (px.b_x - b.x) + (px.b_y - b.y) * (px.b_y - b.y)) as d from ball_px px join boxes b on b.frame = px.frame) select px.frame, coalesce(p.det_id, -1) as det_id, coalesce(round(p.w * p.h, 2), -1) as area from ball_px px left join p on p.frame = px.frame and rk = 1 and d <= 200", "ball_px", "boxes")
def detection_sizes(v, t):
    d = v("boxes").select("frame", "det_id", "x", "y", "w", "h")
    p = v("ball_px").select("frame", F.col("b_x").alias("bx"), F.col("b_y").alias("by"))
    return diagnosis.detection_size(p, d, ["frame"], 200.0).select("frame", F.coalesce("det_id", F.lit(-1)).alias("det_id"), F.coalesce(r("area", 2), F.lit(-1.0)).alias("area"))


def state_sql(src: str, p: str, gap: int) -> str:
    given = "case when status in ('detected', 'predicted') then {e} end"
    was = {c: LASTV.format(e=given.format(e=c), p=p, to="1 preceding") for c in ("frame", "x", "y")}
    seen = LASTV.format(e="case when status = 'detected' then rn end", p=p, to="1 preceding")
    return f", sn as (select *, row_number() over (partition by {p} order by frame) as rn from {src}), sw as (select *, {was['frame']} as wf, {was['x']} as wx, {was['y']} as wy, rn - 1 - coalesce({seen}, 0) as missed from sn), st as (select *, case when status = 'detected' then sqrt((x - wx) * (x - wx) + (y - wy) * (y - wy)) / greatest(1, frame - wf) end as jump, status = 'detected' and missed > {gap} and wf is not null as post_reset from sw)"


@query(state_sql("ball", "seq", 2) + " select seq, frame, round(jump, 4) as jump, missed, post_reset from st", "ball")
def provided_state(v, t):
    return diagnosis.provided_state(v("ball"), ["seq"], max_gap=2).select("seq", "frame", r("jump").alias("jump"), big("missed").alias("missed"), "post_reset")


HEAD_SQL = "b_x between cx - 12 and cx + 12 and b_y between cy - h / 2e0 and cy - h / 2e0 + 0.18e0 * h"
FRAMES_SQL = f", z as (select frame, bool_or(d <= 60) as near, bool_or({HEAD_SQL}) as head from touch group by frame), bf as (select p.frame, p.frame // 4096 as part, p.status, case when p.status <> 'lost' then p.b_x end as x, case when p.status <> 'lost' then p.b_y end as y, z.near, z.head from ball_px p left join z on z.frame = p.frame)"


def ball_frames(v) -> DataFrame:
    """The ball frame by frame, in stretches of 4096 numbers, with whether a player is near and whether it is on a head (null without players)."""
    top = F.col("cy") - F.col("h") / 2
    head = F.col("b_x").between(F.col("cx") - 12, F.col("cx") + 12) & F.col("b_y").between(top, top + 0.18 * F.col("h"))
    z = v("touch").groupBy("frame").agg(F.bool_or(F.col("d") <= 60).alias("near"), F.bool_or(head).alias("head"))
    kept = F.col("status") != "lost"
    p = v("ball_px").select("frame", F.floor(F.col("frame") / 4096).alias("part"), "status", F.when(kept, F.col("b_x")).alias("x"), F.when(kept, F.col("b_y")).alias("y"))
    return p.join(z, "frame", "left")


@query(FRAMES_SQL + state_sql("bf", "part", 1) + ", fp as (select status, status = 'detected' and not coalesce(near, false) as a, status = 'detected' and coalesce(head, false) as b, status = 'detected' and post_reset and coalesce(jump > 80, false) as c from st) select status, count(*) as n, count(case when a then 1 end) as fp_noplayer, count(case when b then 1 end) as fp_head, count(case when c then 1 end) as fp_teleport, count(case when a or b or c then 1 end) as fp_any from fp group by status", "touch", "ball_px")
def ball_fp_diagnosis(v, t):
    s = diagnosis.false_positives(diagnosis.provided_state(ball_frames(v), ["part"], max_gap=1), "near", "head")
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in ("fp_noplayer", "fp_head", "fp_teleport", "fp_any")])


@query(FRAMES_SQL + ", l as (select part, status = 'detected' as on_ball, not near as a, head as b from bf) select part, round(avg(case when on_ball and (coalesce(a, false) or coalesce(b, false)) then 1e0 else 0e0 end), 4) as latch_rate, count(case when on_ball and (coalesce(a, false) or coalesce(b, false)) then 1 end) as latched, count(case when on_ball and a then 1 end) as fp_noplayer, count(case when on_ball and b then 1 end) as fp_head, count(case when on_ball then 1 end) as ball_frames from l group by part", "touch", "ball_px")
def fp_latch_rate(v, t):
    f = ball_frames(v).withColumn("source", F.when(F.col("status") == "detected", "ball").otherwise("centroid")).withColumn("noplayer", ~F.col("near"))
    return diagnosis.latch_rate(f, "source", "noplayer", "head", ["part"]).withColumn("latch_rate", r("latch_rate"))


CAMERA = f", cm as (select *, least(greatest(coalesce(lag(x, 2) over w, 480e0), 160e0), 800e0) as cx, least(greatest(coalesce(lag(y, 2) over w, 360e0), 120e0), 600e0) as cy, coalesce(picked_conf < 0.45e0, false) as fp_any from ball {BALL_W})"


@query(CAMERA + ", wy as (select seq, case when abs(x - cx) <= 96 and abs(y - cy) <= 72 then 'i' when fp_any then 'f' when cx <= 160.5e0 or cx >= 799.5e0 or cy <= 120.5e0 or cy >= 599.5e0 then 'c' else 'l' end as why from cm where status = 'detected') select seq, count(case when why = 'i' then 1 end) as inside, count(case when why = 'f' then 1 end) as miss_fp, count(case when why = 'c' then 1 end) as miss_clamp, count(case when why = 'l' then 1 end) as miss_lag, count(*) as total, round(count(case when why = 'i' then 1 end) / cast(count(*) as double), 4) as safe_rate from wy group by seq", "ball")
def safe_zone_misses(v, t):
    w = windows.ordered(["seq"], "frame")
    held = {c: g.clamp(F.coalesce(F.lag(c, 2).over(w), F.lit(m)), lo, hi) for c, m, lo, hi in (("x", 480.0, 160.0, 800.0), ("y", 360.0, 120.0, 600.0))}
    f = v("ball").withColumns({"cx": held["x"], "cy": held["y"], "fp_any": F.coalesce(F.col("picked_conf") < 0.45, F.lit(False))})
    return diagnosis.safe_zone_misses(f, ["seq"], (320.0, 240.0), (960.0, 720.0)).withColumn("safe_rate", r("safe_rate"))


FOLLOW = ", bd as (select b.seq, b.frame, p.track_id, row_number() over (partition by b.seq, b.frame order by sqrt((b.pitch_x_m - p.x_m) * (b.pitch_x_m - p.x_m) + (b.pitch_y_m - p.y_m) * (b.pitch_y_m - p.y_m)), p.track_id) as rk from ball b join trk p on p.seq = b.seq and p.frame = b.frame where status = 'detected' and pitch_x_m is not null and sqrt((b.pitch_x_m - p.x_m) * (b.pitch_x_m - p.x_m) + (b.pitch_y_m - p.y_m) * (b.pitch_y_m - p.y_m)) <= 20), b1 as (select b.*, bd.track_id as bound, row_number() over (partition by b.seq order by b.frame) as rn from ball b left join bd on bd.seq = b.seq and bd.frame = b.frame and rk = 1), b2 as (select *, {h} as holder, rn - {s} as since from b1), ct as (select seq, frame, avg(x_m) as mx from trk group by seq, frame), b3 as (select b2.*, p.x_m as hx, mx, case when status = 'detected' and pitch_x_m is not null then 'ball' when status = 'predicted' and pitch_x_m is not null and since <= 1 then 'pred' when p.x_m is not null and since <= 50 then 'holder' else 'centroid' end as source from b2 left join trk p on p.seq = b2.seq and p.frame = b2.frame and p.track_id = b2.holder left join ct on ct.seq = b2.seq and ct.frame = b2.frame)".format(h=LASTV.format(e="bound", p="seq", to="current row"), s=LASTV.format(e="case when status = 'detected' and pitch_x_m is not null then rn end", p="seq", to="current row"))


@query(FOLLOW + " select seq, frame, source, round(case when source in ('ball', 'pred') then pitch_x_m when source = 'holder' then hx else mx end, 4) + 0e0 as target, coalesce(holder, -1) as holder from b3", "ball", "trk")
def handoff_target(v, t):
    p = v("trk").select("seq", "frame", "track_id", F.col("x_m").alias("px"), F.col("y_m").alias("py"))
    b = v("ball").select("seq", "frame", "status", F.col("pitch_x_m").alias("x"), F.col("pitch_y_m").alias("y"))
    c = p.groupBy("seq", "frame").agg(F.avg("px").alias("mx"), F.avg("py").alias("my"))
    return diagnosis.camera_target(b, p, c, ["seq"], short=1, bind=20.0).select("seq", "frame", "source", r("tx").alias("target"), "holder")


@query(FRAMES_SQL + ", dm as (select frame, min(d) as d from touch group by frame), pl as (select case when coalesce(head, false) then 'head' when coalesce(d > 150, true) then 'junk' when d <= 60 and status = 'detected' then 'ball' end as label from bf left join dm on dm.frame = bf.frame where status <> 'lost') select label, count(*) as n from pl where label is not null group by label", "touch", "ball_px")
def pseudo_labels(v, t):
    d = v("touch").groupBy("frame").agg(F.min("d").alias("d"))
    rows = ball_frames(v).where("status <> 'lost'").join(d, "frame", "left")
    label = diagnosis.pseudo_label(F.coalesce("head", F.lit(False)), F.col("d"), F.when(F.col("status") == "detected", 1.0).otherwise(0.0))
    return rows.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- orders and reports


@query("select * from (select seq, track_id, count(*) as n, row_number() over (partition by seq order by count(*) desc, track_id) as rank from trk group by seq, track_id) where rank <= 4", "trk")
def most_tracked(v, t):
    return ranking.most_tracked(v("trk"))


@query(SHOT + " select seq, start, \"end\", confidence from shots order by confidence desc, seq, start limit 8", "features")
def best_moments(v, t):
    return ranking.best_moments(events.shots(v("features"))).select("seq", "start", "end", "confidence")


PIECES = ", o as (select distinct seq, track_id, hour_frame as f from trk), m as (select *, case when f - lag(f) over (partition by seq, track_id order by f) <= 5 then 0 else 1 end as nw from o), gg as (select *, sum(nw) over (partition by seq, track_id order by f) as run from m), pc as (select seq, track_id, min(f) as start, max(f) as \"end\", cast(count(*) as double) as strength from gg group by seq, track_id, run)"


def pieces(v) -> DataFrame:
    p = windows.islands(v("trk").select("seq", "track_id", "hour_frame").distinct(), ["seq", "track_id"], "hour_frame", 5)
    return p.withColumn("strength", F.col("n_rows").cast("double"))


@query(PIECES + ", k as (select *, row_number() over (partition by seq, track_id order by strength desc, start) as place, count(*) over (partition by seq, track_id) as n_moments from pc) select seq, track_id, start, place, n_moments, dense_rank() over (partition by seq order by n_moments desc, track_id) as track_place from k", "trk")
def moments_of_tracks(v, t):
    return ranking.moments_of_tracks(pieces(v)).select("seq", "track_id", "start", "place", "n_moments", "track_place")


@query(PIECES + " select seq, track_id, start, row_number() over (partition by seq, track_id order by case when strength >= 2 then 0 else 1 end, strength desc, start) as no from pc", "trk")
def reel_order(v, t):
    clips = pieces(v).withColumn("kind", F.when(F.col("strength") >= 2, "involvement").otherwise("presence"))
    return ranking.reel_order(clips, ["seq", "track_id"], "kind").select("seq", "track_id", "start", "no")


@query(PIECES + ", n as (select seq, track_id, count(*) as n_clips from pc group by seq, track_id) select seq, track_id, n_clips from (select *, row_number() over (partition by seq order by n_clips desc, track_id) as rk from n) where rk = 1", "trk")
def largest_reel(v, t):
    return ranking.largest_reel(pieces(v).groupBy("seq", "track_id").agg(F.count(F.lit(1)).alias("n_clips")))


@query(", per as (select frame, count(case when cls = 'F' then 1 end) as b, count(case when cls <> 'F' then 1 end) as p from boxes group by frame), fr as (select px.frame, px.status as grp, coalesce(b, 0) as b, coalesce(p, 0) as p from ball_px px left join per on per.frame = px.frame), cf as (select px.status as grp, avg(conf) as m, quantile_cont(conf, 0.1) as p10, quantile_cont(conf, 0.5) as p50, quantile_cont(conf, 0.9) as p90 from boxes bx join ball_px px on px.frame = bx.frame where cls = 'F' group by px.status) select fr.grp, count(*) as n_frames, round(100e0 * avg(case when b > 0 then 1e0 else 0e0 end), 4) as ball_pct, round(100e0 * avg(case when b > 1 then 1e0 else 0e0 end), 4) as multi_pct, round(avg(p), 4) as players_per_frame, round(max(m), 4) as conf_mean, round(max(p10), 4) as conf_p10, round(max(p50), 4) as conf_p50, round(max(p90), 4) as conf_p90 from fr left join cf on cf.grp = fr.grp group by fr.grp", "boxes", "ball_px")
def detector_report(v, t):
    f = v("ball_px").select("frame", F.col("status").alias("grp"))
    d = v("boxes").select("frame", F.when(F.col("cls") == "F", "ball").otherwise("player").alias("cls"), "conf").join(f, "frame")
    out = ranking.detector_report(d, f, ["grp"])
    return out.select("grp", "n_frames", *[r(c).alias(c) for c in out.columns if c not in ("grp", "n_frames")])


@query("select quality as cls, count(*) as n from labels group by quality")
def class_counts(v, t):
    return ranking.class_counts(t("labels").withColumnRenamed("quality", "cls"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def without_labels(v, t):
    return ranking.without_labels(t("documents").select("doc_id"), t("labels"), "doc_id")


@query(", c as (select track_id, cls, count(*) as n from boxes group by track_id, cls), s as (select track_id, string_agg(concat(cls, ':', n), ',' order by cls) as votes from c group by track_id) select s.track_id, votes, round(median(b.x), 4) as median_dist from s join boxes b on b.track_id = s.track_id group by s.track_id, votes", "boxes")
def vote_map(v, t):
    return ranking.vote_map(v("boxes"), "track_id", "cls", "x").select("track_id", "votes", r("median_dist").alias("median_dist"))


@query("select seq, round(avg(n), 4) as per_frame, count(*) as n_frames from (select seq, frame, count(*) as n from trk group by seq, frame) group by seq", "trk")
def detections_per_frame(v, t):
    return ranking.detections_per_frame(v("trk")).select("seq", r("per_frame").alias("per_frame"), "n_frames")


def involvement_reports(v) -> DataFrame:
    b = v("ball").where("pitch_x_m is not null").select("seq", "frame", F.col("pitch_x_m").alias("bx"), F.col("pitch_y_m").alias("by"))
    pairs = b.join(v("trk"), ["seq", "frame"]).withColumn("d", g.distance("bx", "by", "x_m", "y_m"))
    known = v("trk").groupBy("seq", "track_id").agg(F.count(F.lit(1)).alias("n_frames")).where("n_frames >= 5")
    out = None
    for mode in ("radius", "nearest"):
        one = ranking.discrimination(joins.involved(pairs, ["seq", "frame"], "d", ["track_id"], mode, 20.0), known, ["seq"]).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


INVOLVED = NEAREST_M.format(c="") + ", iv as (select 'radius' as mode, * from nm where d <= 20 union all select 'nearest', * from nm where rk = 1 and d <= 20), ti as (select mode, seq, track_id, count(*) as n from iv group by mode, seq, track_id), tr as (select *, row_number() over (partition by mode, seq order by n desc, track_id) as k from ti), ts as (select mode, seq, count(*) as n_involved, sum(case when k <= 3 then n else 0 end) / sum(n) as top3_share from tr group by mode, seq), tf as (select mode, seq, count(*) / cast(count(distinct frame) as double) as ppf from iv group by mode, seq), kn as (select seq, count(*) as n_substantial from (select seq, track_id from trk group by seq, track_id having count(*) >= 5) group by seq), rp as (select md.mode, kn.seq, n_substantial, coalesce(n_involved, 0) as n_involved, coalesce(top3_share, 0) as top3_share, coalesce(ppf, 0) as players_per_frame, coalesce(n_involved, 0) / cast(greatest(1, n_substantial) as double) as involved_fraction from kn cross join (values ('radius'), ('nearest')) md(mode) left join ts on ts.seq = kn.seq and ts.mode = md.mode left join tf on tf.seq = kn.seq and tf.mode = md.mode)"


@query(INVOLVED + " select mode, seq, n_substantial, n_involved, round(top3_share, 4) as top3_share, round(players_per_frame, 4) as players_per_frame, round(involved_fraction, 4) as involved_fraction from rp", "ball", "trk")
def involvement_discrimination(v, t):
    return involvement_reports(v).select("mode", "seq", "n_substantial", "n_involved", *[r(c).alias(c) for c in ("top3_share", "players_per_frame", "involved_fraction")])


@query(INVOLVED + " select mode, round(avg(involved_fraction), 4) as mean_involved_fraction, round(avg(players_per_frame), 4) as mean_players_per_frame, round(avg(top3_share), 4) as mean_top3_share, cast(sum(n_substantial) as bigint) as total_substantial, cast(sum(n_involved) as bigint) as total_involved from rp group by mode", "ball", "trk")
def involvement_comparison(v, t):
    c = ranking.compare_definitions(involvement_reports(v))
    return c.select("mode", *[r(x).alias(x) for x in c.columns if x.startswith("mean")], "total_substantial", "total_involved")


@query("select sport, cast(sum(case when state = 'ready' then 1 else 0 end) as bigint) as ready, count(*) as jobs, round(100e0 * sum(case when state = 'ready' then 1 else 0 end) / greatest(1, count(*)), 4) as pct from jobs group by rollup (sport)", "jobs")
def jobs_with_total(v, t):
    j = v("jobs").select("sport", (F.col("state") == "ready").cast("bigint").alias("ready"), F.lit(1).cast("bigint").alias("jobs"))
    return ranking.with_total(j, "sport", "ready", "jobs").select("sport", "ready", "jobs", r("pct").alias("pct"))


@query(f", s as (select *, case when status <> 'lost' and lag(frame) over w = frame - 1 and lag(status) over w <> 'lost' then sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) end as step from ball {BALL_W}) select seq, round(avg(case when status = 'detected' then 1e0 else 0e0 end), 4) as raw_rate, round(avg(case when status <> 'lost' then 1e0 else 0e0 end), 4) as provided_rate, round(avg(case when status <> 'lost' then case when x between 0 and 900 and y between 0 and 640 then 1e0 else 0e0 end end), 4) as in_frame_rate, round(coalesce(avg(case when step > 5 then 1e0 when step <= 5 then 0e0 end), 0), 4) as teleport_fraction, round(avg(case when status <> 'lost' then 1e0 else 0e0 end) - avg(case when status = 'detected' then 1e0 else 0e0 end), 4) as lift from s group by seq", "ball")
def ball_coverage(v, t):
    p = ranking.plausibility(v("ball"), ["seq"], 900.0, 640.0, 5.0)
    return p.select("seq", *[r(c).alias(c) for c in p.columns if c != "seq"])


@query(", ".join(["select what, name, count(*) as n, count(case when looks then 1 end) as n_candidates from (select 'extension' as what, regexp_extract(url, '(\\.[^./]+)$', 1) as name", "regexp_matches(lower(url), 'ball|annot|traj|label') as looks from pages union all select 'folder'", "split_part(url, '/', 1)", "regexp_matches(lower(url), 'ball|annot|traj|label') from pages) group by what", "name"]))
def file_counts(v, t):
    return ranking.file_counts(t("pages"), "url")


@query("select doc_id, cast((length(s) - length(replace(s, 'the', ''))) / 3 as bigint) as n_the, cast((length(s) - length(replace(s, 'ball', ''))) / 4 as bigint) as n_ball, length(replace(s, 'ball', '')) < length(s) as present from (select doc_id, lower(coalesce(text, '')) as s from documents)")
def keyword_counts(v, t):
    return ranking.keyword_counts(t("documents"), "doc_id", "text", ["the", "ball"], ["ball"])


@query("select seq, frame from ball where status = 'detected' intersect select seq, frame from trk", "ball", "trk")
def covered_frames(v, t):
    return ranking.covered_frames(v("ball").where("status = 'detected'"), v("trk"), ["seq", "frame"])


@query(", m as (select det_id as cluster, avg(conf) as mean from boxes group by det_id) select cluster, round(mean, 6) as mean, case when row_number() over (order by mean desc, cluster) = 1 then 'TeamA' else 'TeamB' end as team from m", "boxes")
def team_of_cluster(v, t):
    return ranking.team_of_cluster(v("boxes").withColumnRenamed("det_id", "cluster"), "cluster", "conf").withColumn("mean", r("mean", 6))


@query(", q as (select role, quantile_cont(x, 0.1) as xl, quantile_cont(x, 0.9) as xh, quantile_cont(y, 0.1) as yl, quantile_cont(y, 0.9) as yh from boxes group by role) select b.role, round(avg(x) filter (where x between xl and xh and y between yl and yh), 4) as x, round(avg(y) filter (where x between xl and xh and y between yl and yh), 4) as y, count(case when x between xl and xh and y between yl and yh then 1 end) as n_inside from boxes b join q on q.role = b.role group by b.role", "boxes")
def trimmed_colour(v, t):
    return ranking.trimmed_mean(v("boxes"), ["role"], ["x", "y"]).select("role", r("x").alias("x"), r("y").alias("y"), "n_inside")


@query("select y_true, count(*) as n, round(avg(case when case when conf >= 0.25e0 then 1 else 0 end = y_true then 1e0 else 0e0 end), 4) as recall, round(avg(case when toxic = 1 then 1e0 else 0e0 end), 4) as excluded from scored group by y_true", "scored")
def recall_per_class(v, t):
    s = v("scored").withColumn("named", F.when(F.col("conf") >= 0.25, 1).otherwise(0))
    return ranking.per_class(s, "named", "y_true", F.col("toxic") == 1).select("y_true", "n", r("recall").alias("recall"), r("excluded").alias("excluded"))


@query(", e as (select min(conf) as lo, max(conf) as hi from scored), c as (select lo + (hi - lo) * k / 79 as threshold from e, (select unnest(range(80)) as k)), g as (select threshold, avg(case when y_true = 1 then case when conf >= threshold then 1e0 else 0e0 end end) as recall, avg(case when y_true <> 1 then case when conf < threshold then 1e0 else 0e0 end end) as reject from c, scored group by threshold) select round(threshold, 4) as threshold, round(recall, 4) as recall, round(reject, 4) as reject from g order by (recall + reject) / 2 desc, threshold limit 1", "scored")
def best_cut(v, t):
    return ranking.best_cut(v("scored"), "conf", "y_true").select(r("threshold").alias("threshold"), r("recall").alias("recall"), r("reject").alias("reject"))


@query(f"select round(avg(ap), 3) as map, count(*) as n_classes from ({ORACLES['average_precision_11pt']})")
def mean_average_precision(v, t):
    ap = evaluation.average_precision(v("scored"), "conf", "y_true", "cls", "doc_id").select("cls", r("ap").alias("ap"))
    return ranking.mean_average_precision(ap).select(r("map", 3).alias("map"), "n_classes")


@query("select part, count(*) as n from (select case when seq in ('SEQ-1', 'SEQ-3') then 'val' else 'train' end as part from trk) group by part", "trk")
def train_val_split(v, t):
    return v("trk").select(files.train_or_val(F.col("seq"), ["SEQ-1", "SEQ-3"]).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("select frame, det_id, round((x + w / 2) / 1280, 4) as cx, round(h / 720, 4) as h from (select *, dense_rank() over (partition by frame // 4096 order by frame) as k from boxes) where (k - 1) % 5 = 0 and w > 0 and h > 0", "boxes")
def yolo_stride(v, t):
    b = v("boxes").withColumn("seq", F.floor(F.col("frame") / 4096))
    return files.to_yolo(b, 1280.0, 720.0, 5).select("frame", "det_id", r("cx").alias("cx"), r("h").alias("h"))


# ---- job store


@query("select job_id, row_number() over (order by created_at desc, job_id) as place from jobs", "jobs")
def jobs_newest_first(v, t):
    return jobs.newest_first(v("jobs")).select("job_id", "place")


@query("select job_id, case when duration_sec > 3000 then 'failed' else state end as state, sport from jobs", "jobs")
def jobs_updated(v, t):
    j = v("jobs")
    return jobs.updated(j, j.where("duration_sec > 3000").select("job_id", F.lit("failed").alias("state"), F.lit("other").alias("sport"))).select("job_id", "state", "sport")


WAITING = ", wt as (select *, case when deliverables like '%,%' then 'quota_waiting' when state = 'ready' then 'submitted' when state = 'queued' then 'uploading' else 'expired' end as st from jobs)"


def requests(v) -> DataFrame:
    return v("jobs").withColumn("state", F.when(F.col("deliverables").like("%,%"), "quota_waiting").when(F.col("state") == "ready", "submitted").when(F.col("state") == "queued", "uploading").otherwise("expired"))


@query(WAITING + " select job_id, 'approved' as state from wt where st = 'quota_waiting' order by created_at, job_id limit 1", "jobs")
def job_promoted(v, t):
    return jobs.promoted(requests(v), 10, 5).select("job_id", "state")


@query(WAITING + ", d as (select *, case when sport = 'football' then 'approve' else 'reject' end as action from wt), a as (select *, case when action = 'approve' then st in ('submitted', 'quota_waiting') else st in ('submitted', 'approved', 'quota_waiting', 'uploading', 'uploaded') end as allowed from d) select job_id, allowed, case when allowed then case action when 'approve' then 'approved' else 'rejected' end else st end as next_state from a", "jobs")
def jobs_decided(v, t):
    q = requests(v)
    return jobs.decided(q, q.select("job_id", F.when(F.col("sport") == "football", "approve").otherwise("reject").alias("action"))).select("job_id", "allowed", "next_state")


@query("select job_id, user_id from jobs where user_id = (select min(user_id) from jobs)", "jobs")
def jobs_visible(v, t):
    j = v("jobs")
    return jobs.visible(j, j.agg(F.min("user_id")).first()[0], j.where("false").select("user_id")).select("job_id", "user_id")


STAGE_OF = "case state when 'ready' then 'ball' when 'queued' then 'decoding' else 'upside_down' end"
MESSAGES = "case {s} when 'ball' then 'Something went wrong while tracking the ball. Please try again.' when 'decoding' then 'We couldn''t read the video. Please try uploading it again.' else 'Something went wrong while processing this match. Please try again.' end"


@query(f"select job_id, {STAGE_OF} as stage, concat(job_id, '/logs/', {STAGE_OF}, '.log') as path, sport as value, {MESSAGES.format(s=STAGE_OF)} as message from jobs", "jobs")
def failure_log(v, t):
    stage = F.when(F.col("state") == "ready", "ball").when(F.col("state") == "queued", "decoding").otherwise("upside_down")
    return jobs.failure_log(v("jobs").select("job_id", stage.alias("stage"), F.col("sport").alias("detail"), F.col("created_at").alias("at")))


@query("select job_id, case when state = 'failed' then 'broke' when sport = 'football' then 'note' else 'usual' end as detail from jobs", "jobs")
def job_details(v, t):
    football = F.col("sport") == "football"
    state = F.when(F.col("state") == "failed", "failed").otherwise("rejected")
    return v("jobs").select("job_id", jobs.detail_of(state, F.when(football, "note").otherwise(""), F.lit("usual"), F.lit(""), F.lit("broke")).alias("detail"))


@query("select page_id, regexp_extract(url, '([^/\\\\]*)$', 1) as clip_id from pages")
def clip_ids(v, t):
    return jobs.clip_ids(t("pages").select("page_id", F.lit(None).cast("string").alias("clip_id"), F.col("url").alias("clip"))).select("page_id", "clip_id")


@query("select safe, count(*) as n from (select path not like '/%' and path not like '%../%' as safe from (select unnest([url, concat('/', url), concat('a/../', url), concat('a..b/', lower(url))]) as path from pages)) group by safe".replace("'%../%'", "'%/../%'"))
def safe_paths(v, t):
    path = F.explode(F.array("url", F.concat(F.lit("/"), "url"), F.concat(F.lit("a/../"), "url"), F.concat(F.lit("a..b/"), F.lower("url")))).alias("path")
    return t("pages").select(path).select(jobs.safe_path(F.col("path")).alias("safe")).groupBy("safe").agg(F.count(F.lit(1)).alias("n"))


@query("select job_id, state = 'ready' as enqueue, case state when 'failed' then 'failed' else 'processing' end as state, case when state = 'queued' and sport = 'football' then 'analytics only' when state = 'ready' and sport = 'football' then 'analytics only' else sport end as state_detail from jobs", "jobs")
def jobs_mirrored(v, t):
    j = v("jobs")
    local = j.select("job_id", F.when(F.col("state") == "ready", "calibrated").otherwise(F.col("state")).alias("state"), F.col("sport").alias("detail"))
    note = F.when(F.col("sport") == "football", "analytics only").otherwise("waiting")
    cloud = j.select("job_id", F.col("job_id").alias("local_job_id"), F.lit("processing").alias("state"), note.alias("state_detail"))
    return jobs.mirrored(cloud, local).select("job_id", "enqueue", "state", "state_detail")


def listed_files(v) -> DataFrame:
    place = F.when(F.col("state") == "ready", F.concat(F.lit("outputs/events/"), "sport", F.lit("/clips/a.mp4"))).when(F.col("state") == "queued", F.lit("outputs/player_highlights/x/reels/b.mp4")).otherwise("logs/c.mp4")
    return v("jobs").select("job_id", F.explode(F.array(place, F.lit("outputs/coach/report.pdf"))).alias("path"))


LISTED = ", ls as (select job_id, unnest([case state when 'ready' then concat('outputs/events/', sport, '/clips/a.mp4') when 'queued' then 'outputs/player_highlights/x/reels/b.mp4' else 'logs/c.mp4' end, 'outputs/coach/report.pdf']) as path from jobs), ot as (select job_id, substr(path, 9) as path from ls where path like 'outputs/%')"


@query(LISTED + " select job_id, path, row_number() over (partition by job_id order by path) as no from ot", "jobs")
def job_outputs(v, t):
    return jobs.outputs(listed_files(v)).select("job_id", "path", "no")


@query(LISTED + " select job_id, count(case when path like '%.mp4' then 1 end) as n_highlights from ot group by job_id", "jobs")
def highlight_counts(v, t):
    return jobs.outputs(listed_files(v)).groupBy("job_id").agg(F.count_if(jobs.highlight(F.col("path"))).alias("n_highlights"))


@query("select job_id, 'expired' as state, 'These results have expired.' as state_detail from jobs where state = 'ready' and created_at <= timestamp '1996-01-01'", "jobs")
def jobs_expired(v, t):
    return jobs.expired(v("jobs").withColumn("expires_at", F.col("created_at")), F.lit("1996-01-01").cast("timestamp_ntz")).select("job_id", "state", "state_detail")


@query(", u as (select job_id, cast(floor(duration_sec * 100) as bigint) as total, cast(floor(duration_sec * 30) as bigint) as done from jobs), s as (select *, unnest(range(done, total, 65536)) as start from u where done < total) select job_id, start, least(start + 65536, total) - 1 as \"end\", concat('bytes ', start, '-', least(start + 65536, total) - 1, '/', total) as header from s", "jobs")
def upload_chunks(v, t):
    u = v("jobs").select("job_id", big(F.floor(F.col("duration_sec") * 100)).alias("total"), big(F.floor(F.col("duration_sec") * 30)).alias("done"))
    return jobs.chunk_ranges(u, 65536).select("job_id", "start", "end", "header")


# ---- streams: read as streams, written to the shared folder, read back


def stream_of(t_dir: str, name: str, spark) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{t_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def streamed(sql: str | None = None):
    """Registers a function of (stream of events, spark) whose stream is run until it has taken all there is."""

    def add(f):
        def run(spark, sf_dir: str) -> DataFrame:
            out, made = f"{folder(spark)}/stream-{uuid.uuid4().hex}", f(stream_of(sf_dir, "events", spark))
            live.run_available(made, f"{out}/data", f"{out}/state")
            return spark.read.schema(made.schema).parquet(f"{out}/data")

        from .catalog import QUERIES

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@streamed("with f as (select user_id, date_trunc('minute', min(ts)) as start from events group by user_id) select start, count(*) as new_ids from f where start + interval 1 minute <= (select max(ts) - interval 1 hour from events) group by start")
def stream_new_ids(stream):
    return live.new_ids(stream).withColumn("start", F.col("start").cast("timestamp_ntz"))


@streamed("select distinct user_id as job_id, event_type as state from events")
def stream_dedupe(stream):
    return live.news(stream.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), "ts"), "400 days").select("job_id", "state")


@streamed()
def stream_kalman(stream):
    d = stream.select(F.concat(F.lit("SEQ-"), (F.col("user_id") % 5).cast("string")).alias("seq"), (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600) - 2840112).cast("bigint").alias("frame"), F.col("value").cast("double").alias("x"), (F.col("value") / 2).alias("y"), F.lit(0.5).alias("conf"))
    return live.track_ball(d)
