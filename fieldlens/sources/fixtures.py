"""Deterministic views that give the test tables the shapes this library works on.

The texts run on Spark and on DuckDB; ``{K}`` is the payload number of an event in the engine's own words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {"trk": ["events"], "ball": ["events"], "boxes": ["lineitem"], "ball_px": ["orders"], "scored": ["documents", "labels"], "crops": ["embeddings"], "jobs": ["orders"], "gt": ["lineitem"], "features": ["events"], "touch": ["lineitem", "orders"], "dets": ["events"], "squads": ["events"]}
NEEDS = {"gt": ["boxes"], "features": ["ball"], "touch": ["boxes", "ball_px"], "dets": ["ball"], "squads": ["ball"]}
SPARK_K = "cast(get_json_object(props, '$.k') as int)"
DUCK_K = "cast(json_extract_string(props, '$.k') as integer)"

VIEWS = {
    "trk": """
select concat('SEQ-', cast(user_id % 5 as varchar(2))) as seq,
       user_id as track_id,
       case when user_id % 11 = 10 then 'NonOutfield' when user_id % 2 = 0 then 'TeamA' else 'TeamB' end as role,
       cast(row_number() over (partition by user_id order by event_id) as bigint) as frame,
       cast((extract(day from ts) - 1) * 24 + extract(hour from ts) as bigint) as hour_frame,
       cast({K} as double) * 1.05e0 - 51.975e0 as x_m,
       least(value, 340e0) / 5e0 - 34e0 as y_m,
       event_id
from events
""",
    "ball": """
select seq, frame, status,
       case when status = 'lost' then null else px end as pitch_x_m,
       case when status = 'lost' then null else py end as pitch_y_m,
       case when status = 'lost' then null else px * 9e0 + 480e0 end as x,
       case when status = 'lost' then null else py * 9e0 + 360e0 end as y,
       case when status = 'detected' then 0.35e0 + cast(k as double) / 200e0 end as picked_conf, k
from (select seq, frame, status, k,
             (case when k = 99 then -1e0 else 1e0 end) * (abs(((wx % 2100) + 2100) % 2100 - 1050) / 10e0 - 52.5e0) as px,
             abs(((wy % 1360) + 1360) % 1360 - 680) / 10e0 - 34e0 as py
      from (select seq, frame, status, k,
                   cast(sum(k % 11 - 5) over (partition by seq order by frame) as bigint) as wx,
                   cast(sum(k % 7 - 3) over (partition by seq order by frame) as bigint) as wy
            from (select concat('SEQ-', cast(user_id % 5 as varchar(2))) as seq,
                         cast(row_number() over (partition by user_id % 5 order by event_id) as bigint) as frame,
                         case event_type when 'error' then 'lost' when 'signup' then 'predicted' else 'detected' end as status,
                         {K} as k
                  from events) a) b) c
""",
    "boxes": """
select frame, cast(row_number() over (partition by frame order by ln, pk, track_id, price, qty, sd) as bigint) as det_id,
       track_id, role, cls, cast((pk * 7) % 1280 as double) as x, cast(ln * 80 + pk % 50 as double) as y,
       20e0 + qty as w, 60e0 + 2e0 * qty as h, conf, has_gt, pk
from (select l_orderkey as frame, l_linenumber as ln, l_partkey as pk, l_suppkey as track_id, l_extendedprice as price, l_quantity as qty, l_shipdate as sd,
             case when l_suppkey % 11 = 10 then 'NonOutfield' when l_suppkey % 2 = 0 then 'TeamA' else 'TeamB' end as role,
             l_linestatus as cls, 1e0 - 5e0 * abs(l_discount) as conf, l_returnflag <> 'R' as has_gt
      from lineitem) d
""",
    "ball_px": """
select o_orderkey as frame, cast((o_custkey * 13) % 1280 as double) as b_x, cast((o_custkey * 7) % 720 as double) as b_y,
       case o_orderstatus when 'F' then 'detected' when 'O' then 'predicted' else 'lost' end as status
from orders
""",
    "scored": """
select d.doc_id, d.lang as cls, least(1e0, cast(d.n_chars as double) / 5000e0) as conf, l.quality as y_true, l.toxic
from documents d join labels l on d.doc_id = l.doc_id
""",
    "crops": """
select vec_id as crop_idx, cast(vec_id % 25 as bigint) as track_id, embedding,
       case when label >= 8 then 'ref' when label % 2 = 0 then 'A' else 'B' end as hand
from embeddings
""",
    "jobs": """
select o_orderkey as job_id, o_custkey as user_id, case when o_orderkey % 2 = 0 then 'football' else 'basketball' end as sport,
       case o_orderstatus when 'F' then 'ready' when 'O' then 'queued' else 'failed' end as state,
       o_orderdate as created_at, o_totalprice / 100e0 as duration_sec,
       case substr(o_orderpriority, 1, 1) when '1' then 'coach_analytics' when '2' then 'event_highlights' when '3' then 'player_highlights'
            when '4' then 'coach_analytics,event_highlights' else 'coach_analytics,event_highlights,player_highlights' end as deliverables
from orders
""",
    "gt": """
select frame, det_id, track_id, cls, x + (pk % 7 - 3) * 3e0 as x, y, w, h from boxes where has_gt
""",
    "features": """
select seq, i, status = 'detected' as detected, px, py, speed, d_pos, d_neg, h_pos, h_neg,
       abs(py) <= 12e0 and (d_pos <= 9e0 or d_neg <= 9e0) as in_goal_zone, k % 3 as possession,
       coalesce(k % 3 <> 0 and prev_poss <> 0 and prev_poss <> k % 3, false) as flip, k % 4 as near_a, k % 5 % 3 as near_b, 8e0 + k % 17 as spread,
       d_right, d_left, hd_right, hd_left, (k % 13 - 6) / 1e0 as stream
from (select *, case when status <> 'lost' and ds > 1e-9 then (52.5e0 - px) * dx / (ds * greatest(d_pos, 1e-6)) + (0e0 - py) * dy / (ds * greatest(d_pos, 1e-6)) else 0e0 end as h_pos,
             case when status <> 'lost' and ds > 1e-9 then (-52.5e0 - px) * dx / (ds * greatest(d_neg, 1e-6)) + (0e0 - py) * dy / (ds * greatest(d_neg, 1e-6)) else 0e0 end as h_neg,
             case when ds > 1e-9 then ((12.75e0 - cx) * dx - cy * dy) / (ds * greatest(d_right, 1e-6)) else 0e0 end as hd_right,
             case when ds > 1e-9 then ((-12.75e0 - cx) * dx - cy * dy) / (ds * greatest(d_left, 1e-6)) else 0e0 end as hd_left,
             case when status = 'lost' then 0e0 else round(ds * 25e0, 6) end as speed
      from (select *, sqrt((52.5e0 - px) * (52.5e0 - px) + py * py) as d_pos, sqrt((52.5e0 + px) * (52.5e0 + px) + py * py) as d_neg,
                   sqrt((12.75e0 - cx) * (12.75e0 - cx) + cy * cy) as d_right, sqrt((12.75e0 + cx) * (12.75e0 + cx) + cy * cy) as d_left, sqrt(dx * dx + dy * dy) as ds
            from (select *, px / 4e0 as cx, py / 4e0 as cy, coalesce(px - lag(px) over (partition by seq order by i), 0e0) as dx, coalesce(py - lag(py) over (partition by seq order by i), 0e0) as dy,
                         lag(k % 3) over (partition by seq order by i) as prev_poss
                  from (select seq, frame - 1 as i, case when k % 10 < 4 then 'lost' else status end as status, k,
                               coalesce(pitch_x_m, k * 1e0 - 50e0) as px, coalesce(pitch_y_m, k * 6e-1 - 30e0) as py from ball) a) b) c) d
""",
    "dets": """
select seq, frame, j as object, x + j * 170e0 - 255e0 as x, y + (j % 2) * 90e0 as y, 60e0 + j * 2e0 as w, 120e0 as h,
       case when (k + 3 * j) % 5 = 0 then 0.15e0 else 0.4e0 + cast(k as double) / 250e0 end as conf, (k + 7 * j) % 9 <> 0 as found
from ball join (select 0 as j union all select 1 as j union all select 2 as j union all select 3 as j) o on o.j >= 0
where status <> 'lost'
""",
    "squads": """
select seq, frame, j as track_id, case when j % 2 = 0 then 'TeamA' else 'TeamB' end as role,
       j * 9e0 - 31.5e0 + cast(floor(frame / 40e0) as bigint) % 7 * j / 10e0 + cast(k % 5 as double) / 50e0 as x_m,
       (j * 5 % 7) * 8e0 - 24e0 + cast(floor(frame / 40e0) as bigint) % 5 / 4e0 + cast(k % 3 as double) / 50e0 as y_m
from (select seq, cast(frame as int) as frame, k from ball) b
join (select 0 as j union all select 1 as j union all select 2 as j union all select 3 as j union all select 4 as j union all select 5 as j union all select 6 as j union all select 7 as j) o on (frame + j) % 23 <> 0
""",
    "touch": """
select b.frame, b.det_id, b.track_id, b.role, b.x + b.w / 2e0 as cx, b.y + b.h / 2e0 as cy, b.h, p.b_x, p.b_y, p.status,
       sqrt((b.x + b.w / 2e0 - p.b_x) * (b.x + b.w / 2e0 - p.b_x) + (b.y + b.h / 2e0 - p.b_y) * (b.y + b.h / 2e0 - p.b_y)) as d
from boxes b join ball_px p on b.frame = p.frame
""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables below ``sf_dir``."""
    inner = {**{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}, **{v: view(spark, sf_dir, v) for v in NEEDS.get(name, [])}}
    return spark.sql(_named(VIEWS[name].replace("{K}", SPARK_K), inner), **{f"t_{k}": v for k, v in inner.items()})


def _named(text: str, inner: dict) -> str:
    import re

    for k in inner:
        text = re.sub(rf"\b(from|join) {k}\b", rf"\1 {{t_{k}}}", text)
    return text


def oracle(names: list[str], body: str) -> str:
    """``body`` with the named views, and those that they need, before it, for DuckDB."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n].replace('{K}', DUCK_K)})" for n in order) + "\n" + body
