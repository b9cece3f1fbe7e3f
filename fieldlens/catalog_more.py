"""Queries of tracker quality, association, anchors, built features, camera paths, clusters and streams with timers, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import BALL_W, FILL, GUARD, big, filled, query, r, touching
from .catalog_extra import LASTV, streamed
from .operators import anchors, association, clusters, diagnosis, evaluation, identity, metrics, sequential, signals, tracker_metrics
from .plans import events
from .sources.shared import checkpoint
from .streaming import live, queue
from .streaming.association import associate_stream

# ---- SQL for series: windows over the rows of a sequence


def interp_sql(c: str, o: str = "frame", p: str = "seq") -> str:
    back, ahead = (f"over (partition by {p} order by {o} rows between {x})" for x in ("unbounded preceding and current row", "current row and unbounded following"))
    at = f"case when {c} is not null then {o} end"
    lv, lo, fv, fo = f"last_value({c} ignore nulls) {back}", f"last_value({at} ignore nulls) {back}", f"first_value({c} ignore nulls) {ahead}", f"first_value({at} ignore nulls) {ahead}"
    return f"coalesce({c}, {lv} + ({fv} - {lv}) * ({o} - {lo}) / nullif({fo} - {lo}, 0), {lv}, {fv}, 0e0)"


def mean_sql(c: str, k: int, o: str = "frame", p: str = "seq") -> str:
    w = f"over (partition by {p} order by {o} rows between "
    whole = w + "unbounded preceding and unbounded following)"
    return f"(sum({c}) {w}{k} preceding and {k} following) + ({k} - count(*) {w}{k} preceding and 1 preceding)) * first_value({c}) {whole} + ({k} - count(*) {w}1 following and {k} following)) * last_value({c}) {whole}) / {2 * k + 1}e0"


def slope_sql(c: str, o: str = "frame", p: str = "seq") -> str:
    w = f"over (partition by {p} order by {o})"
    return f"coalesce((lead({c}) {w} - lag({c}) {w}) / 2, lead({c}) {w} - {c}, {c} - lag({c}) {w}, 0e0)"


# ---- tracker quality


def boxed(v, name: str, who: str) -> DataFrame:
    return v(name).select(F.floor(F.col("frame") / 4096).alias("seq"), "frame", F.col("track_id").alias(who), "x", "y", "w", "h")


@query(None)
def tracker_hota(v, t):
    """ML16: every overlap of every sequence; held against brute force by tests."""
    rows = tracker_metrics.hota(boxed(v, "gt", "gt_id"), boxed(v, "boxes", "track_id"), ["seq"])
    return rows.select("seq", "alpha", "tp", "fn", "fp", *[r(c, 6).alias(c) for c in ("det_a", "ass_a", "loc_a", "hota")])


@query(None)
def tracker_hota_combined(v, t):
    rows = tracker_metrics.combined_hota(tracker_metrics.hota(boxed(v, "gt", "gt_id"), boxed(v, "boxes", "track_id"), ["seq"]))
    return rows.select("alpha", "tp", "fn", "fp", *[r(c, 6).alias(c) for c in ("det_a", "ass_a", "loc_a", "hota")])


OVERLAP = ", pr as (select b.frame // 4096 as seq, b.frame, g.track_id as gt_id, b.track_id, greatest(0e0, least(b.x + b.w, g.x + g.w) - greatest(b.x, g.x)) * greatest(0e0, least(b.y + b.h, g.y + g.h) - greatest(b.y, g.y)) as meet, b.w * b.h + g.w * g.h as two from boxes b join gt g on g.frame = b.frame), ov as (select *, meet / (two - meet) as iou from pr where meet > 0)"


@query(OVERLAP + ", sh as (select *, iou / (sum(iou) over (partition by seq, frame, gt_id) + sum(iou) over (partition by seq, frame, track_id) - iou) as share from ov), m as (select seq, gt_id, track_id, sum(share) as met from sh group by seq, gt_id, track_id), ng as (select frame // 4096 as seq, track_id as gt_id, count(*) as ng from gt group by 1, 2), nt as (select frame // 4096 as seq, track_id, count(*) as nt from boxes group by 1, 2) select seq, gt_id, track_id, round(met / (ng + nt - met), 6) as aligned from m join ng using (seq, gt_id) join nt using (seq, track_id)", "boxes", "gt")
def identity_alignment(v, t):
    truth, tracks = boxed(v, "gt", "gt_id"), boxed(v, "boxes", "track_id")
    return tracker_metrics.alignment(tracker_metrics.overlapping(truth, tracks, ["seq"]), truth, tracks, ["seq"]).select("seq", "gt_id", "track_id", r("aligned", 6).alias("aligned"))


@query(None)
def tracker_report(v, t):
    rows = tracker_metrics.tracker_report(boxed(v, "gt", "gt_id"), boxed(v, "boxes", "track_id"), ["seq"])
    return rows.select("seq", *[r(c, 6).alias(c) for c in ("hota", "det_a", "ass_a", "loc_a", "mota", "idf1")], "switches")


def detections(v) -> DataFrame:
    return v("dets").where("found").select("seq", "frame", "x", "y", "w", "h", "conf")


@query(None)
def associate_tracks(v, t):
    """ML18: detections to tracks; stream and batch are held against each other by tests."""
    return association.associate(detections(v), ["seq"]).select("seq", "frame", "track_id", *[r(c).alias(c) for c in ("x", "y", "w", "h", "conf")])


@query(None)
def association_report(v, t):
    """ML18 scored by ML16: the tracks that come of the detections against the objects that were there."""
    truth = v("dets").select("seq", "frame", F.col("object").alias("gt_id"), "x", "y", "w", "h")
    tracks = checkpoint(association.associate(detections(v), ["seq"]))
    return tracker_metrics.tracker_report(truth, tracks, ["seq"]).select("seq", *[r(c, 6).alias(c) for c in ("hota", "det_a", "ass_a", "loc_a", "mota", "idf1")], "switches")


# ---- anchors

STILL = anchors.Anchors(speed=3.0, players=6, spread=20.0, circle=10.0, in_circle=2, in_half=3, bridge=1, frames=4)
SIGNALS = ", fr as (select seq, frame, lag(frame) over (partition by seq order by frame) as was from (select distinct seq, frame from squads)), sg0 as (select s.seq, s.frame, s.x_m, s.y_m, case when s.frame - was <= 2 then sqrt(pow(s.x_m - b.x_m, 2) + pow(s.y_m - b.y_m, 2)) / (0.04e0 * (s.frame - was)) end as v, avg(s.x_m) over (partition by s.seq, s.frame) as mx, avg(s.y_m) over (partition by s.seq, s.frame) as my from squads s join fr on fr.seq = s.seq and fr.frame = s.frame left join squads b on b.seq = s.seq and b.frame = fr.was and b.track_id = s.track_id), sg as (select seq, frame, count(*) as n, median(v) as speed, case when count(*) >= 3 then avg(sqrt(pow(x_m - mx, 2) + pow(y_m - my, 2))) else 0 end as spread, count(case when sqrt(x_m * x_m + y_m * y_m) <= 10 then 1 end) as in_circle, count(case when x_m < 0 then 1 end) as l, count(case when x_m >= 0 then 1 end) as rr from sg0 group by seq, frame)"


def anchor_sql(rule: str) -> str:
    return SIGNALS + f", k as (select *, case when frame - lag(frame) over (partition by seq order by frame) <= 1 then 0 else 1 end as nw from sg where speed <= 3 and n >= 6 and {rule}), rn as (select *, sum(nw) over (partition by seq order by frame) as run from k) select seq, min(frame) as start, max(frame) as \"end\", count(*) as n_rows, min(struct_pack(s := speed, f := frame)).f as frame, round(min(speed), 4) as speed from rn group by seq, run having count(*) >= 4"


def found_anchors(v, rule) -> DataFrame:
    return anchors.anchors(anchors.signals(v("squads"), ["seq"], STILL), ["seq"], rule(STILL), STILL)


@query(anchor_sql("in_circle <= 2 and l >= 3 and rr >= 3"), "squads")
def kickoff_anchors(v, t):
    return found_anchors(v, anchors.kickoff_like).select("seq", "start", "end", "n_rows", "frame", r("speed").alias("speed"))


@query(anchor_sql("spread >= 20"), "squads")
def settled_anchors(v, t):
    return found_anchors(v, anchors.settled_like).select("seq", "start", "end", "n_rows", "frame", r("speed").alias("speed"))


def anchor_pairs(v) -> tuple[DataFrame, DataFrame]:
    """Formations whose players have new identities every 300 frames, as tracks that broke, and the pairs between their anchors."""
    tracks = v("squads").withColumn("track_id", F.col("track_id") + 100 * F.floor(F.col("frame") / 300))
    return tracks, checkpoint(anchors.aligned_pairs(checkpoint(found_anchors(v, anchors.settled_like)), tracks, ["seq"]))


@query(None)
def anchor_alignment(v, t):
    """FD10: pairs of players of anchors that follow each other."""
    return anchor_pairs(v)[1]


@query(None)
def anchored_identities(v, t):
    """FD10: the identities that those pairs join."""
    tracks, pairs = anchor_pairs(v)
    return anchors.carried(pairs, tracks, ["seq"])


# ---- features that detectors look at


def motion_sql(x: str, y: str, cap: str) -> str:
    guard = GUARD.replace("pitch_x_m as x, pitch_y_m as y", f"{x} as x, {y} as y").replace("where pitch_x_m is not null", f"where {x} is not null and {y} is not null").replace("> 1.6e0", f"> {cap}")
    return (
        f"{guard}, cl as (select o.seq, o.frame, o.status, o.{x} is not null and o.{y} is not null as known, case when not coalesce(teleport, false) then o.{x} end as gx, case when not coalesce(teleport, false) then o.{y} end as gy from ball o left join rec on rec.seq = o.seq and rec.frame = o.frame)"
        f", pf as (select seq, frame, status, known, {interp_sql('gx')} as px, {interp_sql('gy')} as py from cl), vf as (select *, ({slope_sql('px')}) * 25 as vx0, ({slope_sql('py')}) * 25 as vy0 from pf), mo as (select seq, frame, frame - 1 as i, status = 'detected' as detected, known, px, py, case when known then vx0 else 0 end as vx, case when known then vy0 else 0 end as vy, case when known then {mean_sql('sqrt(vx0 * vx0 + vy0 * vy0)', 2)} else 0 end as speed from vf)"
    )


def way_sql(gx: str) -> tuple[str, str]:
    d, s = f"sqrt(({gx} - px) * ({gx} - px) + py * py)", "sqrt(vx * vx + vy * vy)"
    return d, f"case when {d} > 1e-6 and {s} > 1e-6 then (vx * ({gx} - px) - vy * py) / ({d} * {s}) else 0e0 end"


def held_sql(src: str, x: str, y: str, tx: str, ty: str, radius: str, near: str) -> str:
    """``hd``: possession, flips and near counts by the places ``x, y`` of ``src``."""
    return (
        f", hp as (select s.seq, s.frame, t.track_id, t.role, sqrt(pow(s.{x} - t.{tx}, 2) + pow(s.{y} - t.{ty}, 2)) as d from {src} s join trk t on t.seq = s.seq and t.frame = s.frame where s.{x} is not null and s.{y} is not null), hn as (select * from (select *, row_number() over (partition by seq, frame order by d, track_id) as rk from hp where role in ('TeamA', 'TeamB')) where rk = 1 and d < {radius}), hc as (select seq, frame, count(case when d <= {near} and role = 'TeamA' then 1 end) as near_a, count(case when d <= {near} and role = 'TeamB' then 1 end) as near_b from hp group by seq, frame)"
        f", hj as (select s.seq, s.frame, case hn.role when 'TeamA' then 1 when 'TeamB' then 2 else 0 end as code, coalesce(near_a, 0) as near_a, coalesce(near_b, 0) as near_b from {src} s left join hn on hn.seq = s.seq and hn.frame = s.frame left join hc on hc.seq = s.seq and hc.frame = s.frame), hm as (select *, count(case when code = 1 then 1 end) over w as a, count(case when code = 2 then 1 end) over w as b from hj window w as (partition by seq order by frame rows between 7 preceding and 7 following)), hv as (select *, case when a + b = 0 then 0 when a >= b then 1 else 2 end as possession from hm), hd as (select seq, frame, near_a, near_b, possession, coalesce(possession <> 0 and possession <> last_value(nullif(possession, 0) ignore nulls) over (partition by seq order by frame rows between unbounded preceding and 1 preceding), false) as flip from hv)"
    )


DP, HP = way_sql("52.5e0")
DN, HN = way_sql("-52.5e0")
FOOTBALL = (
    motion_sql("pitch_x_m", "pitch_y_m", "1.6e0") + held_sql("ball", "pitch_x_m", "pitch_y_m", "x_m", "y_m", "15e0", "20e0")
    + ", md as (select seq, frame, median(x_m) as mx, median(y_m) as my from trk group by seq, frame having count(*) >= 3), sp as (select t.seq, t.frame, avg(sqrt(pow(x_m - mx, 2) + pow(y_m - my, 2))) as spread from trk t join md on md.seq = t.seq and md.frame = t.frame group by t.seq, t.frame)"
    + f", ff as (select mo.seq, mo.frame, i, detected, px, py, speed, {DP} as d_pos, {DN} as d_neg, {HP} as h_pos, {HN} as h_neg, abs(px) > 40.5e0 and abs(py) < 9 as in_goal_zone, possession, flip, near_a, near_b, sp.spread as s0 from mo join hd on hd.seq = mo.seq and hd.frame = mo.frame left join sp on sp.seq = mo.seq and sp.frame = mo.frame), fi as (select *, {interp_sql('s0')} as s1 from ff), built as (select *, {mean_sql('s1', 12)} as spread from fi)"
)


def football_frames(v) -> DataFrame:
    return signals.football_features(v("ball"), v("trk"), radius=15.0, near=20.0, at=("pitch_x_m", "pitch_y_m"), player_at=("x_m", "y_m"))


def rounded(names: str) -> str:
    return ", ".join(f"round({n}, 4) + 0e0 as {n}" for n in names.split())


@query(FOOTBALL + f" select seq, i, detected, {rounded('px py speed d_pos d_neg h_pos h_neg spread')}, in_goal_zone, cast(possession as bigint) as possession, flip, near_a, near_b from built", "ball", "trk")
def built_features(v, t):
    numbers = [r(c).alias(c) for c in "px py speed d_pos d_neg h_pos h_neg spread".split()]
    return football_frames(v).select("seq", "i", "detected", *numbers, "in_goal_zone", big("possession").alias("possession"), "flip", "near_a", "near_b")


RUNS_AT = ", {n}k as (select *, case when i - lag(i) over (partition by seq order by i) <= {b} then 0 else 1 end as nw from built where {c}), {n}g as (select *, sum(nw) over (partition by seq order by i) as run from {n}k)"
QUICK = events.Football(run_frames=4, run_metres=1.0, run_speed=2.0)


@query(FOOTBALL + RUNS_AT.format(n="t", b=QUICK.bridge + 1, c="speed > 2") + ", tr as (select seq, min(i) as s, max(i) as e, arg_max(i, struct_pack(v := speed, o := -i)) as peak, abs(arg_max(px, i) - arg_min(px, i)) as dx from tg group by seq, run having max(i) - min(i) + 1 >= 4) select tr.seq, 'fast_transition' as type, s as start, e as \"end\", peak, round(least(greatest(0.4e0 + 0.4e0 * (dx / 50e0) + 0.2e0 * (avg(f.speed) / 15e0), 0.2e0), 0.95e0), 2) as confidence from tr join built f on f.seq = tr.seq and f.i between s and e where dx >= 1 group by tr.seq, s, e, peak, dx", "ball", "trk")
def transitions_of_built_features(v, t):
    """EV3 on EV15: from tracks and ball to events."""
    return events.transitions(checkpoint(football_frames(v)), QUICK)


@query(None)
def events_of_built_features(v, t):
    return events.football_events(checkpoint(football_frames(v)), events.Football(run_frames=4, run_metres=1.0, lost_frames=3, approach=0.2))


def court(v) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ball and players on a court about a quarter of the pitch, and the hoops in the picture: the left one not in one of the sequences."""
    ball = v("ball").select("seq", "frame", "status", (F.col("pitch_x_m") * 0.271828182).alias("cx"), (F.col("pitch_y_m") * 0.271828182).alias("cy"))
    tracks = v("trk").select("seq", "frame", "track_id", "role", (F.col("x_m") * 0.271828182).alias("cx"), (F.col("y_m") * 0.271828182).alias("cy"))
    hoops = v("ball").select("seq").distinct().withColumn("name", F.explode(F.when(F.col("seq") == "SEQ-0", F.array(F.lit("right"))).otherwise(F.array(F.lit("left"), F.lit("right")))))
    return ball, tracks, hoops


(DR, HR), (DL, HL) = way_sql("12.75e0"), way_sql("-12.75e0")
BASKETBALL = (
    ", pitch as (select * from ball), wide as (select * from trk)"
    + motion_sql("cx", "cy", "1e0").replace("from ball", "from cball") + ", kn as (select seq, frame, case when known then px end as kx, case when known then py end as ky from mo)"
    + held_sql("kn", "kx", "ky", "cx", "cy", "3e0", "4e0").replace("join trk t", "join ctrk t")
    + f", st0 as (select seq, frame, case when frame - lag(frame) over w = 1 then (cx - lag(cx) over w) * 25 end as v from ctrk window w as (partition by seq, track_id order by frame)), st as (select seq, frame, avg(v) as s from st0 group by seq, frame), bb as (select mo.seq, mo.frame, i, detected, px, py, speed, case when mo.seq <> 'SEQ-0' then {DL} end as d_left, case when mo.seq <> 'SEQ-0' then {HL} end as hd_left, {DR} as d_right, {HR} as hd_right, possession, flip, near_a, near_b, st.s as s0 from mo join hd on hd.seq = mo.seq and hd.frame = mo.frame left join st on st.seq = mo.seq and st.frame = mo.frame), bi as (select *, {interp_sql('s0')} as s1 from bb), built as (select *, {mean_sql('s1', 2)} as stream from bi)"
)
BASKETBALL = ", cball as (select seq, frame, status, pitch_x_m * 0.271828182e0 as cx, pitch_y_m * 0.271828182e0 as cy from ball), ctrk as (select seq, frame, track_id, role, x_m * 0.271828182e0 as cx, y_m * 0.271828182e0 as cy from trk)" + BASKETBALL.replace(", pitch as (select * from ball), wide as (select * from trk)", "")


@query(BASKETBALL + f" select seq, i, detected, {rounded('px py speed d_left hd_left d_right hd_right stream')}, cast(possession as bigint) as possession, flip, near_a, near_b from built", "ball", "trk")
def built_court_features(v, t):
    numbers = [r(c).alias(c) for c in "px py speed d_left hd_left d_right hd_right stream".split()]
    return signals.basketball_features(*_court_args(v)).select("seq", "i", "detected", *numbers, big("possession").alias("possession"), "flip", "near_a", "near_b")


def _court_args(v) -> tuple:
    ball, tracks, hoops = court(v)
    return ball, tracks, ("seq",), hoops


COURT = events.Basketball(rim=2.5, approach=0.3, lost_frames=3, break_speed=1.0, break_frames=3, break_metres=0.2)


@query(BASKETBALL + ", fl as (select seq, i from built where flip and least(coalesce(d_left, d_right), d_right) >= 5), fo as (select seq, i, row_number() over (partition by seq order by i) as rn from fl), em as (select seq, i, rn, i as kept, true as ok from fo where rn = 1 union all select f.seq, f.i, f.rn, case when f.i - em.kept < 15 then em.kept else f.i end, f.i - em.kept >= 15 from em join fo f on f.seq = em.seq and f.rn = em.rn + 1), nn as (select seq, max(i) as last from built group by seq) select em.seq, 'steal_proxy' as type, greatest(0, i - 10) as start, least(last, i + 10) as \"end\", i as peak, 0.4e0 as confidence from em join nn on nn.seq = em.seq where ok", "ball", "trk")
def steals_of_built_features(v, t):
    """EV13 on EV15: from tracks and ball on the court to events."""
    return events.steals(checkpoint(signals.basketball_features(*_court_args(v))), COURT)


@query(None)
def events_of_court_features(v, t):
    return events.basketball_events(checkpoint(signals.basketball_features(*_court_args(v))), COURT)


# ---- camera paths

WAVE = sequential.LowPass(1.2, 25.0)
SERIES = ", sr as materialized (select seq, frame, {x} as x, {y} as y from ball)".format(x=interp_sql("x"), y=interp_sql("y"))


def wave_sql(src: str, out: str, values: str, way: int) -> str:
    """A pass of the filter over ``src`` (seq, at, values), from the first place or from the last."""
    (b0, b1, b2), (a1, a2) = ([f"({x!r}::double)" for x in c] for c in (WAVE.b, WAVE.a))
    vs = values.split()
    first = ", ".join(f"{v} as {v}, {b1} * {v} - {a1} * {v} + {v} * ({b2} - {a2}) as {v}1, {b2} * {v} - {a2} * {v} as {v}2" for v in vs)
    nxt = ", ".join(f"{b0} * n.{v} + p.{v}1, {b1} * n.{v} - {a1} * ({b0} * n.{v} + p.{v}1) + p.{v}2, {b2} * n.{v} - {a2} * ({b0} * n.{v} + p.{v}1)" for v in vs)
    start = "pos = 0" if way > 0 else "pos = top"
    return f", {out} as (select seq, pos, top, {first} from {src} where {start} union all select n.seq, n.pos, n.top, {nxt} from {out} p join {src} n on n.seq = p.seq and n.pos = p.pos + ({way}))"


SMOOTH = (
    SERIES + ", pd as (select seq, count(*) as n, least(9, count(*) - 1) as pad from sr group by seq), ex as materialized (select sr.seq, frame - 1 + pad as pos, n + 2 * pad - 1 as top, x, y from sr join pd using (seq)"
    + " union all select a.seq, pad - j, n + 2 * pad - 1, 2 * a.x - b.x, 2 * a.y - b.y from pd join (select unnest(range(1, 10)) as j) on j <= pad join sr a on a.seq = pd.seq and a.frame = 1 join sr b on b.seq = pd.seq and b.frame = 1 + j"
    + " union all select a.seq, pad + n - 1 + j, n + 2 * pad - 1, 2 * a.x - b.x, 2 * a.y - b.y from pd join (select unnest(range(1, 10)) as j) on j <= pad join sr a on a.seq = pd.seq and a.frame = n join sr b on b.seq = pd.seq and b.frame = n - j)"
    + wave_sql("ex", "fw", "x y", 1) + ", fm as materialized (select seq, pos, top, x, y from fw)" + wave_sql("fm", "bw", "x y", -1)
    + ", sm as materialized (select bw.seq, pos - pad + 1 as frame, x, y from bw join pd using (seq) where pos between pad and pad + n - 1)"
)
LIMITS = (9.0, 0.6, 0.4, 3.0)


def limited_sql(src: str, out: str, values: str, limits: tuple) -> str:
    vmax, accel, decel, zone = (f"{x}::double" for x in limits)
    vs = values.split()
    first = ", ".join(f"{v} as {v}, 0e0 as v{v}" for v in vs)
    want = ", ".join(f"sign(n.{v} - p.{v}) * least({vmax}, sqrt(2 * {decel} * greatest(0, abs(n.{v} - p.{v}) - {zone}))) as w{v}, p.{v} as p{v}, p.v{v} as s{v}" for v in vs)
    speed = ", ".join(f"p{v}, s{v} + greatest(-(case when abs(w{v}) > abs(s{v}) then {accel} else {decel} end), least(case when abs(w{v}) > abs(s{v}) then {accel} else {decel} end, w{v} - s{v})) as t{v}" for v in vs)
    return f", {out} as (select seq, frame, {first} from {src} where frame = 1 union all select seq, frame, {', '.join(f'p{v} + t{v}, t{v}' for v in vs)} from (select seq, frame, {speed} from (select n.seq, n.frame, {want} from {out} p join {src} n on n.seq = p.seq and n.frame = p.frame + 1)))"


CROP, PICTURE = (640.0, 480.0), (960.0, 720.0)


@query(FILL + ", xs as materialized (select seq, frame, x from x)" + limited_sql("xs", "rl", "x", (0.6, 0.05, 0.08, 0.5)) + " select seq, frame, round(x, 4) + 0e0 as x from rl", "ball")
def rate_limited_path(v, t):
    return sequential.rate_limited(filled(v).select("seq", "frame", "x"), ["seq"], "frame", ["x"], 0.6, 0.05, 0.08, 0.5).select("seq", "frame", r("x").alias("x"))


@query(SMOOTH + f" select seq, frame, {rounded('x y')} from sm", "ball")
def butterworth_path(v, t):
    series = v("ball").select("seq", "frame", *[sequential.interpolate(F.col(c), F.col("frame"), ["seq"], "frame").alias(c) for c in "xy"])
    return sequential.zero_phase(series, ["seq"], "frame", ["x", "y"], 1.2, 25.0).select("seq", "frame", r("x").alias("x"), r("y").alias("y"))


PATH = SMOOTH + limited_sql("sm", "rl", "x y", LIMITS) + ", path as materialized (select seq, frame, greatest(320e0, least(640e0, x)) as x, greatest(240e0, least(480e0, y)) as y from rl)"


def path(v) -> DataFrame:
    return sequential.camera_path(v("ball"), ["seq"], "frame", CROP, PICTURE, limits=LIMITS)


@query(PATH + f" select seq, frame, {rounded('x y')} from path", "ball")
def camera_path(v, t):
    """WN24 and FD5: gaps, low pass, limits and clamp as one operator."""
    return path(v).select("seq", "frame", r("x").alias("x"), r("y").alias("y"))


@query(
    PATH + ", d3 as (select *, x - 2 * lag(x) over w + lag(x, 2) over w as ax, y - 2 * lag(y) over w + lag(y, 2) over w as ay, x - 3 * lag(x) over w + 3 * lag(x, 2) over w - lag(x, 3) over w as jx, y - 3 * lag(y) over w + 3 * lag(y, 2) over w - lag(y, 3) over w as jy from path window w as (partition by seq order by frame)), mv as (select seq, avg(sqrt(ax * ax + ay * ay)) as mean_accel, avg(sqrt(jx * jx + jy * jy)) as mean_jerk, avg(case when x <= 320.5e0 or x >= 639.5e0 or y <= 240.5e0 or y >= 479.5e0 then 1e0 else 0e0 end) as clamped from d3 group by seq)"
    ", bs as (select b.seq, avg(case when abs(b.x - p.x) <= 224e0 and abs(b.y - p.y) <= 168e0 then 1e0 else 0e0 end) as ball_safe, count(*) as n_detected from ball b join path p on p.seq = b.seq and p.frame = b.frame where b.status = 'detected' and b.x is not null group by b.seq)"
    ", pl as (select t.seq, t.frame, avg(case when abs(x_m * 9 + 480 - p.x) <= 320 and abs(y_m * 9 + 360 - p.y) <= 240 then 1e0 else 0e0 end) as part from trk t join path p on p.seq = t.seq and p.frame = t.frame group by t.seq, t.frame), ac as (select seq, avg(part) as action_in_frame from pl group by seq)"
    ", tc as (select b.seq, avg(case when abs(b.x + 40 - p.x) <= 320 and abs(b.y - p.y) <= 240 then 1e0 else 0e0 end) as truth_in_crop from ball b join path p on p.seq = b.seq and p.frame = b.frame where b.x is not null and b.frame % 3 = 0 group by b.seq)"
    f" select seq, {rounded('mean_accel mean_jerk clamped ball_safe action_in_frame truth_in_crop')}, n_detected from mv left join bs using (seq) left join ac using (seq) left join tc using (seq)", "ball", "trk",
)
def camera_quality(v, t):
    """ML15: how well that path shows ball and play."""
    ball = v("ball").select("seq", "frame", "status", "x", "y")
    players = v("trk").select("seq", "frame", (F.col("x_m") * 9 + 480).alias("x"), (F.col("y_m") * 9 + 360).alias("y"))
    truth = ball.where("frame % 3 = 0").withColumn("x", F.col("x") + 40)
    rows = sequential.camera_quality(checkpoint(path(v)), ["seq"], CROP, PICTURE, ball, players, truth)
    return rows.select("seq", *[r(c).alias(c) for c in "mean_accel mean_jerk clamped ball_safe action_in_frame truth_in_crop".split()], "n_detected")


AIR = f", aw as (select *, row_number() over w as rn, y < 260e0 as air from ball {BALL_W}), sk as (select *, rn - coalesce(last_value(case when status = 'detected' then rn end ignore nulls) over (partition by seq order by frame rows between unbounded preceding and current row), 0) as streak from aw), wt as (select seq, frame, x, case when status = 'detected' then case when coalesce(air, false) then 0.25e0 else 1e0 end when status = 'predicted' then case when coalesce(air, false) then least(0.8e0 * exp(-(streak - 1) / 6e0), 0.25e0 * 0.7e0) else 0.8e0 * exp(-(streak - 1) / 6e0) end else 0e0 end as w from sk)"


def weight(v) -> DataFrame:
    aerial = F.coalesce(F.col("y") < 260.0, F.lit(False))
    return v("ball").withColumn("w", sequential.ball_weight(F.col("status"), aerial, ["seq"], "frame"))


@query(AIR + " select seq, frame, round(w, 4) as w from wt", "ball")
def ball_weight(v, t):
    return weight(v).select("seq", "frame", r("w").alias("w"))


@query(AIR + " select seq, frame, round(case when w > 0 and x is not null then w * x + (1 - w) * 480e0 else 480e0 end, 4) as centre from wt", "ball")
def blended_centre(v, t):
    return weight(v).select("seq", "frame", r(diagnosis.blended(F.col("x"), F.lit(480.0), F.col("w"))).alias("centre"))


# ---- clusters, anchors and labels


def clips(v) -> DataFrame:
    """The crops as clips of a colour each: the first two components stand for chroma."""
    c = v("crops")
    return c.select((F.col("crop_idx") % 10).alias("clip"), "crop_idx", "track_id", "embedding", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("chroma"))


@query(None)
def kmeans_teams(v, t):
    """ML1: two clusters in each clip, whose labels a track's vote takes; inertia is held against brute force by tests."""
    labels = clusters.kmeans_by_group(clips(v), ["clip"], "crop_idx", "chroma")
    return labels.select("clip", "crop_idx", "cluster", r("dist").alias("dist"))


@query(None)
def cluster_votes(v, t):
    labels = clusters.kmeans_by_group(clips(v), ["clip"], "crop_idx", "chroma").join(clips(v).select("crop_idx", "track_id"), "crop_idx")
    return identity.majority_vote(labels.withColumn("track_id", F.col("clip") * 1000 + F.col("track_id")), "track_id", "cluster", "dist").select("track_id", "majority_cluster", "n_dets", r("purity").alias("purity"), r("mean_dist").alias("mean_dist"))


@query(", e as (select crop_idx, unnest(range(1, 65)) as i, unnest(embedding)::double as x from crops where embedding is not null), m as (select i, avg(x) as m from e group by i), c as (select crop_idx, i, x - m as x from e join m using (i)) select cast(a.i - 1 as integer) as i, cast(b.i - 1 as integer) as j, round(sum(a.x * b.x), 3) + 0e0 as value from c a join c b on a.crop_idx = b.crop_idx and a.i <= b.i group by a.i, b.i", "crops")
def gram_matrix(v, t):
    return clusters.gram(v("crops"), "embedding").select("i", "j", r("value", 3).alias("value"))


@query(None)
def pca_embed(v, t):
    """ML3: coordinates along the directions of greatest variance; held against a singular value decomposition by tests."""
    c = v("crops")
    centre, directions, _ = clusters.principal(c, "embedding", 50)
    return c.select("crop_idx", F.transform(clusters.projected("embedding", centre, directions), lambda x: F.round(x, 4) + F.lit(0.0)).alias("low"))


SURE = ", e as (select crop_idx, hand, unnest(range(1, 65)) as i, unnest(embedding)::double as x from crops), m as (select i, avg(x) as m from e where hand = 'ref' and crop_idx % 3 = 0 group by i), an as (select i, m / (sqrt(sum(m * m) over ()) + 1e-8) as a from m)"


@query(SURE + " select crop_idx, round(sum(x * a), 4) + 0e0 as similarity from e join an using (i) group by crop_idx", "crops")
def anchor_cosine(v, t):
    """ML10: the anchor is the mean of the sure positives."""
    c = v("crops")
    anchor = clusters.sure_anchor(c, "embedding", (F.col("hand") == "ref") & (F.col("crop_idx") % 3 == 0))
    return c.select("crop_idx", r(clusters.to_anchor("embedding", anchor)).alias("similarity"))


CENTRES = ", an as (select max(case when crop_idx = 0 then embedding end) as a, max(case when crop_idx = 1 then embedding end) as b from crops)"


@query(CENTRES + ", s as (select crop_idx, list_sum(list_transform(list_zip(embedding, a), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))) as da, list_sum(list_transform(list_zip(embedding, b), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))) as db from crops, an) select crop_idx, cast(case when db < da then 1 else 0 end as bigint) as cluster, round(sqrt(least(da, db)), 4) as d from s", "crops")
def nearest_centroid(v, t):
    c = v("crops")
    centres = [list(x.embedding) for x in c.where("crop_idx in (0, 1)").orderBy("crop_idx").select("embedding").collect()]  # two rows
    cluster, d = identity.nearest_centre("embedding", centres)
    return c.select("crop_idx", cluster.alias("cluster"), r(d).alias("d"))


ROLES = ", mf as (select crop_idx as idx, 'SEQ-' || (crop_idx % 3) as seq, track_id from crops), rl as (select distinct 'SEQ-' || (crop_idx % 3) as seq, track_id, case when track_id = 24 then null when track_id % 5 = 4 then 'Excluded' when track_id % 5 = 3 then 'Referee' when track_id % 2 = 0 then 'TeamA' else 'TeamB' end as role from crops where crop_idx % 3 <> 2), lb as (select crop_idx as idx, hand from crops where crop_idx % 4 <> 1), jn as (select hand, role from lb join mf using (idx) join rl using (seq, track_id)), tp as (select * from jn where hand in ('A', 'B') and role in ('TeamA', 'TeamB')), ac as (select avg(case when (hand = 'A') = (role = 'TeamA') then 1e0 else 0e0 end) as one, count(*) as n from tp)"


@query(ROLES + " select (select count(*) from lb) as n_labelled, (select count(*) from jn) as n_matched, n as n_scored, round(one, 4) as accuracy_direct, round(1 - one, 4) as accuracy_swapped, round(greatest(one, 1 - one), 4) as accuracy, (select round(avg(case when (role = 'TeamA') = (one >= 1 - one) then 1e0 else 0e0 end), 4) from tp where hand = 'A') as accuracy_a, (select round(avg(case when (role = 'TeamB') = (one >= 1 - one) then 1e0 else 0e0 end), 4) from tp where hand = 'B') as accuracy_b, (select round(avg(case when role in ('Referee', 'Excluded') then 1e0 else 0e0 end), 4) from jn where hand in ('A', 'B')) as team_excluded, (select round(avg(case when role in ('Referee', 'Excluded') then 1e0 else 0e0 end), 4) from jn where hand in ('ref', 'bench')) as others_excluded from ac", "crops")
def label_validation(v, t):
    """JN23: hand labels against the roles of the tracks that the labelled crops come from."""
    c = v("crops")
    seq = F.concat(F.lit("SEQ-"), (F.col("crop_idx") % 3).cast("string")).alias("seq")
    k = F.col("track_id")
    role = F.when(k == 24, None).when(k % 5 == 4, "Excluded").when(k % 5 == 3, "Referee").when(k % 2 == 0, "TeamA").otherwise("TeamB").alias("role")
    out = evaluation.label_validation(c.where("crop_idx % 4 <> 1").select(F.col("crop_idx").alias("idx"), "hand"), c.select(F.col("crop_idx").alias("idx"), seq, "track_id"), c.where("crop_idx % 3 <> 2").select(seq, "track_id", role).distinct())
    shares = [c for c in out.columns if not c.startswith("n_")]
    return out.select(*[c if c not in shares else r(c).alias(c) for c in out.columns])


@query(", v as (select track_id % 7 as k, track_id, avg(case when abs(px) <= 30 and abs(py) <= 20 then 1e0 else 0e0 end) as court, avg(abs(px)) as mean_dist, mode(track_id % 2) as majority_cluster from (select track_id, x_m as px, y_m as py from trk) group by track_id), q as (select quantile_cont(mean_dist, 0.8) as cut from v) select track_id, case when court < 0.3e0 then 'Excluded' when mean_dist > cut then 'Referee' when majority_cluster = 0 then 'TeamA' else 'TeamB' end as role from v, q", "trk")
def roles_on_court(v, t):
    """AG15: tracks that are mostly off the court are excluded before anything else."""
    on = ((F.abs("x_m") <= 30) & (F.abs("y_m") <= 20)).cast("double")
    per = v("trk").groupBy("track_id").agg(F.avg(on).alias("court"), F.avg(F.abs("x_m")).alias("mean_dist"), F.first(F.col("track_id") % 2).alias("majority_cluster"))
    return identity.outlier_roles(per, 0.8, "court", 0.3).select("track_id", "role")


@query(", n as (select seq, i, speed, detected from features) select seq, count(*) as n, count(case when detected then 1 end) as n_detected, round(avg(case when detected then 1e0 else 0e0 end), 4) as detected_share, count(case when speed > 11 then 1 end) as fast, round(quantile_cont(speed, 0.5), 4) as p50, round(quantile_cont(speed, 0.9), 4) as p90, round(quantile_cont(speed, 0.99), 4) as p99 from n group by seq", "features")
def ball_plausibility(v, t):
    out = metrics.plausibility(v("features"), ["seq"], 11.0)
    return out.select("seq", "n", "n_detected", r("detected_share").alias("detected_share"), "fast", *[r(c).alias(c) for c in ("p50", "p90", "p99")])


GRID = {"conf": [0.05, 0.25, 0.6], "long": [0, 400], "within": [0.5, 0.9]}
SWEEP = " select tag, count(*) as n, round(avg(case when y_true = 1 then 1e0 else 0e0 end), 4) as precision from g join scored on scored.conf >= c and scored.conf <= w and scored.doc_id >= l group by tag"


@query(", g as (select 'conf' || c || '_long' || l || '_within' || w as tag, c::double as c, l::int as l, w::double as w from (values ('0.05'), ('0.25'), ('0.6')) x(c), (values ('0'), ('400')) y(l), (values ('0.5'), ('0.9')) z(w))" + SWEEP, "scored")
def sweep_grid_full(v, t):
    return swept(v, "full")


@query(", g as (select 'conf' || c || '_long' || l || '_within' || w as tag, c::double as c, l::int as l, w::double as w from (values ('0.05', '0', '0.5'), ('0.25', '0', '0.5'), ('0.6', '0', '0.5'), ('0.05', '400', '0.5'), ('0.05', '0', '0.9')) x(c, l, w))" + SWEEP, "scored")
def sweep_grid_oat(v, t):
    return swept(v, "oat")


def swept(v, mode: str) -> DataFrame:
    """ML17, PRJ23: what each setting of a grid keeps of the scored rows, by the setting's tag."""
    rows = v("scored")
    settings = [({k: str(x) for k, x in c.items()},) for c in evaluation.expand_grid(GRID, mode)]
    grid = rows.sparkSession.createDataFrame(settings, "config map<string,string>").withColumn("tag", evaluation.config_tag(F.col("config")))
    each = F.broadcast(grid.select("tag", *[F.col("config")[k].cast("double").alias(k) for k in GRID]))  # a row for each setting
    kept = rows.join(each, (rows["conf"] >= each["conf"]) & (rows["conf"] <= each["within"]) & (rows["doc_id"] >= each["long"]))
    return kept.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("y_true") == 1).cast("double")), 4).alias("precision"))


# ---- streams


@streamed("with w as (select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2) select start, event_type, n from w where start + interval 1 hour <= (select max(ts) - interval 1 hour from events)")
def stream_window_counts(stream):
    return live.counts_by_window(stream).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@streamed('with a as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as was from events), b as (select *, sum(case when was is null or ts > was + interval 6 hour then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as s from a), c as (select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as n from b group by user_id, s) select * from c where "end" <= (select max(ts) - interval 1 hour from events)')
def stream_sessions(stream):
    return live.sessions(stream).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@streamed()
def stream_association(stream):
    """ML18 as a stream: an event is a box, a user group a sequence, ten minutes a frame."""
    frame = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600) - 2840112).cast("bigint")
    return associate_stream(stream.select(F.concat(F.lit("SEQ-"), (F.col("user_id") % 5).cast("string")).alias("seq"), frame.alias("frame"), F.col("value").cast("double").alias("x"), (F.col("value") / 2).alias("y"), F.lit(60.0).alias("w"), F.lit(120.0).alias("h"), F.lit(0.5).alias("conf")))


def desk_jobs(rows: DataFrame) -> DataFrame:
    """An event as a job: purchases have results that expire two days later, sign-ups wait."""
    state = F.when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "signup", "quota_waiting").otherwise("submitted")
    created = F.col("ts").cast("timestamp")
    return rows.select(F.concat(F.lit("pool-"), (F.col("user_id") % 20).cast("string")).alias("pool"), F.col("event_id").alias("job_id"), state.alias("state"), created.alias("created_at"), F.when(state == "ready", created + F.expr("interval 2 days")).alias("expires_at"))


QUEUE = """
with recursive j as (select 'pool-' || (user_id % 20) as pool, event_id as job_id, event_type, date_trunc('millisecond', ts) as ts from events where event_type in ('purchase', 'signup')),
x as (select pool, job_id, ts + interval 2 day as "at", row_number() over (partition by pool order by ts, job_id) as k from j where event_type = 'purchase'),
w as (select pool, job_id, ts, row_number() over (partition by pool order by ts, job_id) as k from j where event_type = 'signup'),
had as (select x.pool, x.job_id, x."at", x.k, (select count(*) from w where w.pool = x.pool and w.ts <= x."at") as waiting from x),
q as (select pool, job_id, "at", k, cast(least(1, waiting) as bigint) as taken from had where k = 1 union all select h.pool, h.job_id, h."at", h.k, least(h.waiting, q.taken + 1) from q join had h on h.pool = q.pool and h.k = q.k + 1),
s as (select *, taken > coalesce(lag(taken) over (partition by pool order by k), 0) as takes from q),
u as (select date_trunc('millisecond', max(ts)) - interval 1 hour as until from events)
select pool, job_id, 'expired' as state, "at" from s, u where "at" <= until
union all select s.pool, w.job_id, 'approved', s."at" from s join w on w.pool = s.pool and w.k = s.taken, u where takes and s."at" <= until
"""


@streamed(QUEUE)
def stream_queue(stream):
    """ST7: expiry and promotion on timers."""
    return queue.queue_stream(desk_jobs(stream)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(QUEUE)
def queue_decisions(v, t):
    """ST7 in batch, as far as the stream's watermark gets."""
    events_ = t("events")
    until = events_.agg((F.date_trunc("millisecond", F.max(F.col("ts").cast("timestamp"))) - F.expr("interval 1 hour")).alias("until")).first().until
    return queue.queue_batch(desk_jobs(events_), F.lit(until)).withColumn("at", F.col("at").cast("timestamp_ntz"))
