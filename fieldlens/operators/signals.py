"""What detectors look at, from tracks and ball (JN2, JN7, WN4, WN15, WN16, EV15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..sources.shared import checkpoint
from . import folds
from .joins import counts_within, nearest
from .metrics import median_spread
from .windows import dead_where_missing, edge_moving_average, flips, gradient, interpolate, majority, ordered


def with_roles(rows: DataFrame, roles: DataFrame, keys: Sequence[str] = ("track_id",), keep: Sequence[str] = ("TeamA", "TeamB")) -> DataFrame:
    """JN2: rows with the role of their track; tracks without one, or with another than those to ``keep``, go."""
    return rows.join(roles.select(*keys, "role"), [*keys]).where(F.col("role").isin(*keep))


def possession_timeline(frames: DataFrame, holders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN1: ``keys, possession`` of every frame: 1 and 2 where the one at the ball (keys, role) plays for TeamA or TeamB, else 0."""
    code = F.when(F.col("role") == "TeamA", 1).when(F.col("role") == "TeamB", 2).otherwise(0).cast("bigint")
    return frames.select(*keys).join(holders.select(*keys, "role"), list(keys), "left").select(*keys, code.alias("possession"))


def court_possession(ball: DataFrame, players: DataFrame, keys: Sequence[str], half: Sequence[float], radius: float = 3.0) -> DataFrame:
    """JN7: who has the ball (bx, by): the nearest of the players (px, py) on the court, if near enough."""
    on = players.where((F.abs("px") <= half[0]) & (F.abs("py") <= half[1]))
    pairs = ball.join(on, [*keys]).withColumn("d", distance("bx", "by", "px", "py"))
    return nearest(pairs, list(keys), "d", ["track_id"], radius).select(*keys, "track_id", "role", "d")


def stream(tracks: DataFrame, keys: Sequence[str], x: str, fps: float = 25.0) -> DataFrame:
    """WN15: mean speed along ``x`` of the players that the frame before has too."""
    w = ordered([*keys, "track_id"], "frame")
    v = F.when(F.col("frame") - F.lag("frame").over(w) == 1, (F.col(x) - F.lag(x).over(w)) * fps)
    return tracks.withColumn("__v", v).groupBy(*keys, "frame").agg(F.avg("__v").alias("stream"))


def frame_signals(tracks: DataFrame, keys: Sequence[str], x: str, y: str, dt: float = 0.04, reach: int = 2) -> DataFrame:
    """WN16: players, their mean distance to their centre (0 for fewer than three) and their median speed since the last frame that occurs, if that is at most ``reach`` ago."""
    frames = tracks.select(*keys, "frame").distinct().withColumn("__was", F.lag("frame").over(ordered(keys, "frame")))
    before = tracks.select(*keys, F.col("frame").alias("__was"), "track_id", F.col(x).alias("__x"), F.col(y).alias("__y"))
    rows = tracks.join(frames, [*keys, "frame"]).join(before, [*keys, "__was", "track_id"], "left")
    gap = F.col("frame") - F.col("__was")
    w = Window.partitionBy(*keys, "frame")
    rows = rows.withColumn("__v", F.when(gap <= reach, distance(x, y, "__x", "__y") / (dt * gap))).withColumn("__d", distance(F.col(x), F.col(y), F.avg(x).over(w), F.avg(y).over(w)))
    return rows.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(__v, 0.5)").alias("speed"), F.when(F.count(F.lit(1)) >= 3, F.avg("__d")).otherwise(0.0).alias("spread"))


def goal_geometry(x: Column, y: Column, vx: Column, vy: Column, goal: tuple[float, float]) -> tuple[Column, Column]:
    """EV15: distance to a goal, and how straight the motion heads for it (1: straight; 0 without motion)."""
    gx, gy = F.lit(goal[0]) - x, F.lit(goal[1]) - y
    d, v = F.sqrt(gx * gx + gy * gy), F.sqrt(vx * vx + vy * vy)
    return d, F.when((d > 1e-6) & (v > 1e-6), (vx * gx + vy * gy) / (d * v)).otherwise(0.0)


def ball_motion(ball: DataFrame, keys: Sequence[str], frame: str, at: tuple[str, str], fps: float, top: float, smooth: int) -> DataFrame:
    """The ball without teleports and with gaps filled (``px, py``), its speed and velocity (``vx, vy``), and whether it was ``known``.

    A lost ball is dead: speed and velocity are 0 where nothing was measured, after smoothing.
    """
    w = ordered(keys, frame)
    rows = folds.teleport_guard(ball, keys, frame, *at, top / fps).withColumn("known", F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull())
    for c, name in zip("xy", at):
        rows = rows.withColumn(f"p{c}", interpolate(F.when(F.col("known") & ~F.col("teleport"), F.col(name)), F.col(frame), keys, frame))
    rows = rows.withColumns({f"v{c}": gradient(F.col(f"p{c}"), w) * fps for c in "xy"})
    rows = rows.withColumn("speed", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2))
    rows = rows.withColumn("speed", dead_where_missing(edge_moving_average(F.col("speed"), w, smooth), F.col("known")))
    return rows.withColumns({c: dead_where_missing(F.col(c), F.col("known")) for c in ("vx", "vy")})


def ball_features(ball: DataFrame, keys: Sequence[str] = ("seq",), frame: str = "frame", fps: float = 25.0, top: float = 40.0, smooth: int = 2, goal_x: float = 52.5, depth: float = 12.0, half_width: float = 9.0) -> DataFrame:
    """EV15: the ball's part of the football detectors' frames: places, speed, distance and heading to both goals, and whether it is
    within ``depth`` of a goal line and ``half_width`` of the goals' axis."""
    keys = list(keys)
    rows = ball_motion(ball, keys, frame, ("pitch_x_m", "pitch_y_m"), fps, top, smooth)
    for name, x in (("pos", goal_x), ("neg", -goal_x)):
        d, h = goal_geometry(F.col("px"), F.col("py"), F.col("vx"), F.col("vy"), (x, 0.0))
        rows = rows.withColumns({f"d_{name}": d, f"h_{name}": h})
    rows = rows.withColumn("in_goal_zone", (F.abs("px") > goal_x - depth) & (F.abs("py") < half_width)).withColumn("detected", F.col("status") == "detected").withColumn("i", F.col(frame) - 1)
    return rows.select(*keys, "i", "detected", "px", "py", "speed", "d_pos", "d_neg", "h_pos", "h_neg", "in_goal_zone")


def held_ball(ball: DataFrame, tracks: DataFrame, keys: Sequence[str], at: tuple[str, str], player_at: tuple[str, str], radius: float, near: float, vote: int) -> DataFrame:
    """For each ``i`` of the ball: ``possession`` by the nearest player of a team strictly within ``radius`` where the ball has a place (detected or predicted),
    by majority of ``vote`` rows either way; ``flip``; and ``near_a, near_b``, the players within ``near``."""
    keys = list(keys)
    own = ball.select(*keys, "i", *[F.col(c).alias(f"__b{k}") for c, k in zip(at, "xy")])
    known = own.where("__bx is not null and __by is not null").withColumn("frame", F.col("i") + 1)
    pairs = known.join(tracks.select(*keys, "frame", "track_id", "role", *[F.col(c).alias(f"__p{k}") for c, k in zip(player_at, "xy")]), [*keys, "frame"]).withColumn("d", distance("__bx", "__by", "__px", "__py"))
    holder = nearest(pairs.where(F.col("role").isin("TeamA", "TeamB")), [*keys, "i"], "d", ["track_id"], radius, strict=True).select(*keys, "i", F.when(F.col("role") == "TeamA", 1).otherwise(2).alias("__code"))
    around = counts_within(pairs, [*keys, "i"], "d", near, "role", ["TeamA", "TeamB"]).withColumnsRenamed({"near_TeamA": "near_a", "near_TeamB": "near_b"})
    rows = own.select(*keys, "i").join(holder, [*keys, "i"], "left").join(around, [*keys, "i"], "left").fillna(0, ["__code", "near_a", "near_b"])
    w = ordered(keys, "i")
    rows = rows.withColumn("possession", majority(F.col("__code"), w, vote))
    return rows.withColumn("flip", flips(F.col("possession"), w)).drop("__code")


def football_features(ball: DataFrame, tracks: DataFrame, keys: Sequence[str] = ("seq",), radius: float = 170.0, near: float = 220.0, fps: float = 25.0, at: tuple[str, str] = ("x", "y"), player_at: tuple[str, str] = ("x", "y"), **more) -> DataFrame:
    """All that the football detectors ask of a frame, from the ball (frame, status, pitch_x_m, pitch_y_m and its place in the picture) and the tracks (frame, track_id,
    role and place there).

    ``spread`` is the players' mean distance from their median place, where there are three or more, filled between such frames and smoothed over a second.
    """
    keys = list(keys)
    own = ball_features(ball, keys, fps=fps, **more)
    held = held_ball(ball.withColumn("i", F.col("frame") - 1), tracks, keys, at, player_at, radius, near, int(fps * 0.6) // 2)
    shape = median_spread(tracks, [*keys, "frame"], *player_at).select(*keys, (F.col("frame") - 1).alias("i"), F.col("spread").alias("__spread"))
    rows = own.join(held, [*keys, "i"]).join(shape, [*keys, "i"], "left")
    rows = rows.withColumn("__spread", interpolate(F.col("__spread"), F.col("i"), keys, "i"))
    return rows.withColumn("spread", edge_moving_average(F.col("__spread"), ordered(keys, "i"), int(fps) // 2)).drop("__spread")


#: Where the hoops are: 1.575 m in front of the base lines.
HOOPS = {"left": (-12.75, 0.0), "right": (12.75, 0.0)}


def basketball_features(ball: DataFrame, tracks: DataFrame, keys: Sequence[str] = ("seq",), hoops: DataFrame | None = None, fps: float = 25.0, top: float = 25.0, radius: float = 3.0, near: float = 4.0, smooth: int = 2) -> DataFrame:
    """EV15: all that the basketball detectors ask of a frame, in metres on the court, from the ball (frame, status, cx, cy) and the tracks (frame, track_id, role, cx, cy).

    ``d_left, hd_left`` and so on are distance and heading to each hoop; with ``hoops`` (keys, name: those in the sequence's picture) null for the others.
    Possession and nearness are measured from where the ball is after teleports were taken out, in frames where it has a place.  ``stream`` is the
    players' mean speed along the court, filled over frames without one and smoothed.
    """
    keys = list(keys)
    rows = ball_motion(ball, keys, "frame", ("cx", "cy"), fps, top, smooth).withColumn("i", F.col("frame") - 1).withColumn("detected", F.col("status") == "detected")
    if hoops is not None:
        seen = hoops.groupBy(*keys).agg(F.collect_set("name").alias("__seen"))
        rows = rows.join(seen, keys, "left")
    for name, place in HOOPS.items():
        d, h = goal_geometry(F.col("px"), F.col("py"), F.col("vx"), F.col("vy"), place)
        there = F.lit(True) if hoops is None else F.coalesce(F.array_contains("__seen", name), F.lit(False))
        rows = rows.withColumns({f"d_{name}": F.when(there, d), f"hd_{name}": F.when(there, h)})
    rows = checkpoint(rows.select(*keys, "i", "detected", "known", "px", "py", "speed", *[f"{c}_{name}" for name in HOOPS for c in ("d", "hd")]))
    places = rows.select(*keys, "i", *[F.when(F.col("known"), F.col(c)).alias(c) for c in ("px", "py")])
    held = held_ball(places, tracks, keys, ("px", "py"), ("cx", "cy"), radius, near, int(fps * 0.6) // 2)
    flow = stream(tracks, keys, "cx", fps).select(*keys, (F.col("frame") - 1).alias("i"), F.col("stream").alias("__stream"))
    out = rows.join(held, [*keys, "i"]).join(flow, [*keys, "i"], "left").withColumn("__stream", interpolate(F.col("__stream"), F.col("i"), keys, "i"))
    return out.withColumn("stream", edge_moving_average(F.col("__stream"), ordered(keys, "i"), smooth)).drop("__stream", "known")
