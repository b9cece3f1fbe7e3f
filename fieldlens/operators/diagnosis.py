"""Why tracks break and what the ball filter latches on (JN15, JN17-JN19, AG28-AG30, FD4, FD8, ML12, ML14, ML15)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance
from .joins import heaviest_matches, in_batches, near_another, nearest
from .sequential import schema_of
from .windows import held, ordered


@dataclass(frozen=True)
class Breaks:
    """Pixels and frames that decide why a track ended."""

    min_life: int = 2
    edge: float = 40.0
    width: float = 1920.0
    height: float = 1080.0
    occluded: float = 55.0
    max_gap: int = 30
    link: float = 60.0
    flicker: int = 3


def track_ends(tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last box (cx, cy, h) of each track, its frame, its speed by the row before (0 for a single row) and its number of rows."""
    w = Window.partitionBy(*keys, "track_id")
    rows = tracks.withColumn("__down", F.row_number().over(w.orderBy(F.desc("frame"))))
    last = lambda c, k=1: F.max(F.when(F.col("__down") == k, F.col(c)))
    return rows.groupBy(*keys, "track_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.max("frame").alias("frame"), last("cx").alias("cx"), last("cy").alias("cy"), last("h").alias("h"),
        F.coalesce(last("cx") - last("cx", 2), F.lit(0.0)).alias("vx"), F.coalesce(last("cy") - last("cy", 2), F.lit(0.0)).alias("vy"),
    )


def successors(ends: DataFrame, starts: DataFrame, keys: Sequence[str], max_gap: int, link: float) -> DataFrame:
    """JN15: for each end the first track that begins within ``max_gap`` frames where the end's speed would have brought it: ``gap, successor``.

    The least gap wins, then the least track id.
    """
    keys = list(keys)
    stretch = lambda c: F.floor(c / max_gap)
    place = lambda x, y: [F.col(x).cast("double").alias("cx"), F.col(y).cast("double").alias("cy")]
    a = ends.select(*keys, "track_id", F.col("frame").cast("bigint").alias("frame"), *place("cx", "cy"), F.col("vx").cast("double").alias("vx"), F.col("vy").cast("double").alias("vy"), stretch(F.col("frame") + 1).alias("__at"))
    b = starts.select(*keys, "track_id", F.col("frame").cast("bigint").alias("frame"), *place("cx", "cy"), F.explode(F.array(stretch(F.col("frame")), stretch(F.col("frame")) - 1)).alias("__at"))
    rows = a.unionByName(b, allowMissingColumns=True)  # starts have no speed

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby([*keys, "__at"], sort=False, dropna=False):
            ends_ = g["vx"].notna() & g["vy"].notna()
            first = _first_near(g[ends_], g[~ends_].sort_values("track_id"), max_gap, link)
            out.append(first[[*keys, "track_id", "gap", "successor"]])
        return pd.concat(out)

    kind = f"{schema_of(rows, [*keys, 'track_id'])}, gap bigint, successor {rows.schema['track_id'].dataType.simpleString()}"
    return in_batches(rows, [*keys, "__at"], find, kind)


def _first_near(ends: pd.DataFrame, starts: pd.DataFrame, max_gap: int, link: float) -> pd.DataFrame:
    """The ends that have a successor, gap after gap for those without one; a frame's starts are looked at from the least track on, more and more at a time."""
    by_frame = {f: (g[["cx", "cy"]].to_numpy(), g["track_id"].to_numpy()) for f, g in starts.groupby("frame", sort=False)}
    frame, place, speed = ends["frame"].to_numpy(), ends[["cx", "cy"]].to_numpy(), ends[["vx", "vy"]].to_numpy()
    gap, successor, left = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.arange(len(ends))
    for step in range(1, max_gap + 1):
        left = left[np.argsort(frame[left], kind="stable")]
        for some in np.split(left, np.flatnonzero(np.diff(frame[left])) + 1) if len(left) else []:
            at, ids = by_frame.get(frame[some[0]] + step, (None, None))
            if at is None:
                continue
            to = place[some] + speed[some] * step
            near = _beside(to, at, link)
            some, to, done, width = some[near], to[near], 0, 16
            while len(some) and done < len(ids):
                there = at[done : done + width]
                close = np.sqrt((to[:, None, 0] - there[None, :, 0]) ** 2 + (to[:, None, 1] - there[None, :, 1]) ** 2) < link
                hit = close.any(1)
                gap[some[hit]], successor[some[hit]] = step, ids[done + close[hit].argmax(1)]
                some, to, done = some[~hit], to[~hit], done + width
                width = max(16, min(4 * width, 1_000_000 // max(1, len(some))))
        left = left[gap[left] == 0]
    return ends.assign(gap=gap, successor=successor)[gap > 0]


def _beside(points: np.ndarray, others: np.ndarray, radius: float) -> np.ndarray:
    """Which points have one of the others in their square, as wide as the radius, or in one around it."""
    squares = np.unique(np.floor(others / radius), axis=0)
    mine = np.floor(points / radius)
    taken = {(i + x, j + y) for i, j in squares.tolist() for x in (-1, 0, 1) for y in (-1, 0, 1)}
    return np.fromiter((k in taken for k in map(tuple, mine.tolist())), bool, len(points))


def break_causes(tracks: DataFrame, keys: Sequence[str] = ("seq",), c: Breaks = Breaks()) -> DataFrame:
    """AG29: why each track (frame, cx, cy, h) ended, the first that holds of: a blip, the edge, no successor, another track close by, a short gap, a fast move."""
    keys = list(keys)
    ends = track_ends(tracks, keys)
    first = Window.partitionBy(*keys, "track_id").orderBy("frame")
    starts = tracks.withColumn("__up", F.row_number().over(first)).where("__up = 1")
    found = successors(ends, starts, keys, c.max_gap, c.link)
    near = _occluded(ends, tracks, keys, c.occluded)
    rows = ends.join(found, [*keys, "track_id"], "left").join(near, [*keys, "track_id"], "left")
    edge = (F.col("cx") < c.edge) | (F.col("cx") > c.width - c.edge) | (F.col("cy") < c.edge) | (F.col("cy") > c.height - c.edge) | (F.col("cy") + F.col("h") / 2 > c.height - c.edge)
    cause = (
        F.when(F.col("n_frames") < c.min_life, "BLIP").when(edge, "EDGE").when(F.col("gap").isNull(), "GENUINE_END")
        .when(F.col("occluded"), "OCCLUSION").when(F.col("gap") <= c.flicker, "FLICKER").otherwise("FAST_MOTION")
    )
    return rows.select(*keys, "track_id", "frame", "gap", "successor", cause.alias("cause"))


def _occluded(ends: DataFrame, tracks: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """JN18: of the tracks' ends those with another track's box within the radius."""
    return near_another(ends, tracks, keys, "frame", "track_id", "cx", "cy", radius).where("occluded").select(*keys, "track_id", "occluded")


def cause_shares(causes: DataFrame) -> DataFrame:
    """AG29: tracks and their part of all in percent, for each cause."""
    return causes.groupBy("cause").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))  # six rows


def identity_f1(matched: DataFrame, in_view: DataFrame, keys: Sequence[str], truth: str = "gt_id", track: str = "track_id") -> DataFrame:
    """JN17, AG30: true positives by the best one-to-one naming of tracks, false ones and IDF1; ``in_view``: how many there were to be seen (n)."""
    keys = list(keys)
    together = matched.groupBy(*keys, truth, track).agg(F.count(F.lit(1)).alias("n"))
    right = heaviest_matches(together, keys, "n", truth, track).groupBy(*keys).agg(F.sum("n").alias("idtp"))
    total = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matched"))
    rows = in_view.join(total, keys, "left").join(right, keys, "left").fillna(0, ["n_matched", "idtp"])
    rows = rows.withColumn("idfn", F.col("n") - F.col("idtp")).withColumn("idfp", F.col("n_matched") - F.col("idtp"))
    return rows.select(*keys, "idtp", "idfp", "idfn", (2.0 * F.col("idtp") / F.greatest(F.lit(1), 2 * F.col("idtp") + F.col("idfp") + F.col("idfn"))).alias("idf1"))


def over_merged(matched: DataFrame, keys: Sequence[str], truth: str = "gt_id", track: str = "track_id", strict: int = 3) -> DataFrame:
    """AG30: tracks that were matched to two persons or more, and those whose second person has ``strict`` frames or more."""
    counts = matched.groupBy(*keys, track, truth).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, track).orderBy(F.desc("n"), truth)))
    second = ranked.where("__r = 2")
    return ranked.where("__r = 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tracks")).join(second.groupBy(*keys).agg(F.count(F.lit(1)).alias("merged"), F.count_if(F.col("n") >= strict).alias("merged_strict")), [*keys], "left").fillna(0, ["merged", "merged_strict"])


def detection_size(picked: DataFrame, detections: DataFrame, keys: Sequence[str], radius: float = 25.0) -> DataFrame:
    """JN19: size of the raw detection nearest to the picked place (bx, by), none beyond the radius."""
    pairs = picked.join(detections, [*keys]).withColumn("d", distance("bx", "by", "x", "y"))
    size = nearest(pairs, list(keys), "d", ["det_id"], radius).select(*keys, "det_id", "w", "h", (F.col("w") * F.col("h")).alias("area"))
    return picked.join(size, [*keys], "left")


def provided_state(ball: DataFrame, keys: Sequence[str], order: str = "frame", max_gap: int = 12) -> DataFrame:
    """FD8: for each frame what the diagnosis remembers: ``jump`` (from the place provided before, per frame), frames missed before it, and ``post_reset``: seen right after more than ``max_gap`` of them."""
    w = ordered(keys, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    given = F.col("status").isin("detected", "predicted")
    was = F.last(F.when(given, F.struct(F.col(order).alias("f"), "x", "y")), True).over(before)
    seen_at = F.last(F.when(F.col("status") == "detected", F.col("__n")), True).over(before)
    rows = ball.withColumn("__n", F.row_number().over(w)).withColumn("__was", was).withColumn("missed", F.col("__n") - 1 - F.coalesce(seen_at, F.lit(0)))
    seen = F.col("status") == "detected"
    jump = distance("x", "y", "__was.x", "__was.y") / F.greatest(F.lit(1), F.col(order) - F.col("__was.f"))
    return rows.withColumn("jump", F.when(seen, jump)).withColumn("post_reset", seen & (F.col("missed") > max_gap) & F.col("__was").isNotNull()).drop("__n", "__was")


def false_positives(state: DataFrame, near: str, head: str, gate: float = 80.0) -> DataFrame:
    """ML14: signs of a false ball in a detected frame: no player near, a head, a jump after a reset; and whether there is any."""
    seen = F.col("status") == "detected"
    rows = state.withColumns({"fp_noplayer": seen & ~F.coalesce(F.col(near), F.lit(False)), "fp_head": seen & F.coalesce(F.col(head), F.lit(False)), "fp_teleport": seen & F.col("post_reset") & F.coalesce(F.col("jump") > gate, F.lit(False))})
    return rows.withColumn("fp_any", F.col("fp_noplayer") | F.col("fp_head") | F.col("fp_teleport"))


def latch_rate(frames: DataFrame, source: str, noplayer: str, head: str, keys: Sequence[str]) -> DataFrame:
    """ML14: part of all frames in which the camera is on a ball that no player is near or that is a head; frames without players (null flags) don't count as such."""
    on = F.col(source) == "ball"
    latched = on & (F.coalesce(F.col(noplayer), F.lit(False)) | F.coalesce(F.col(head), F.lit(False)))
    return frames.groupBy(*keys).agg(F.avg(latched.cast("double")).alias("latch_rate"), F.count_if(latched).alias("latched"), F.count_if(on & F.col(noplayer)).alias("fp_noplayer"), F.count_if(on & F.col(head)).alias("fp_head"), F.count_if(on).alias("ball_frames"))


def safe_zone_misses(frames: DataFrame, keys: Sequence[str], crop: tuple[float, float], size: tuple[float, float], safe: float = 0.6) -> DataFrame:
    """AG28: seen balls (x, y, fp_any) against the camera's centre (cx, cy): inside its safe zone, or missed for a false ball, a clamped camera or its lag."""
    hw, hh = crop[0] / 2, crop[1] / 2
    inside = (F.abs(F.col("x") - F.col("cx")) <= hw * safe) & (F.abs(F.col("y") - F.col("cy")) <= hh * safe)
    clamped = (F.col("cx") <= hw + 0.5) | (F.col("cx") >= size[0] - hw - 0.5) | (F.col("cy") <= hh + 0.5) | (F.col("cy") >= size[1] - hh - 0.5)
    why = F.when(inside, "inside").when(F.col("fp_any"), "fp").when(clamped, "clamp").otherwise("lag")
    rows = frames.where(F.col("status") == "detected").withColumn("why", why)
    out = rows.groupBy(*keys).agg(*[F.count_if(F.col("why") == k).alias(n) for k, n in (("inside", "inside"), ("fp", "miss_fp"), ("clamp", "miss_clamp"), ("lag", "miss_lag"))], F.count(F.lit(1)).alias("total"))
    return out.withColumn("safe_rate", F.col("inside") / F.col("total"))


def camera_target(ball: DataFrame, players: DataFrame, centre: DataFrame, keys: Sequence[str], short: int = 8, hold: int = 50, bind: float = 200.0) -> DataFrame:
    """FD4: what the camera follows: the seen ball; one predicted for fewer than ``short`` frames; the last holder while known, at most ``hold`` frames; else the players' centre.

    The holder is the player nearest to the last seen ball that had one within ``bind``.  ``source``, ``tx``, ``ty`` and ``holder`` (-1: none yet).
    """
    keys = list(keys)
    own = [*keys, "frame"]
    seen = (F.col("status") == "detected") & F.col("x").isNotNull()
    pairs = ball.where(seen).select(*own, F.col("x").alias("bx"), F.col("y").alias("by")).join(players, own).withColumn("d", distance("bx", "by", "px", "py"))
    bound = nearest(pairs, own, "d", ["track_id"], bind).select(*own, F.col("track_id").alias("__bound"))
    w = ordered(keys, "frame")
    rows = ball.join(bound, own, "left").withColumn("holder", held(F.col("__bound"), w)).withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("__since", F.col("__n") - held(F.when(seen, F.col("__n")), w))
    where = players.select(*own, F.col("track_id").alias("holder"), F.col("px").alias("hx"), F.col("py").alias("hy"))
    rows = rows.join(where, [*own, "holder"], "left").join(centre.select(*own, "mx", "my"), own, "left")
    predicted = (F.col("status") == "predicted") & F.col("x").isNotNull() & (F.col("__since") <= short)
    source = F.when(seen, "ball").when(predicted, "pred").when(F.col("hx").isNotNull() & (F.col("__since") <= hold), "holder").otherwise("centroid")
    rows = rows.withColumn("source", source)
    pick = lambda b, h, m: F.when(F.col("source").isin("ball", "pred"), F.col(b)).when(F.col("source") == "holder", F.col(h)).otherwise(F.col(m))
    return rows.select(*own, "source", pick("x", "hx", "mx").alias("tx"), pick("y", "hy", "my").alias("ty"), F.coalesce("holder", F.lit(-1)).alias("holder"))


def blended(ball: Column, centroid: Column, weight: Column) -> Column:
    """WN21: the ball and the players' centre by the weight; the centre alone without weight or ball."""
    return F.when((weight > 0) & ball.isNotNull(), weight * ball + (1 - weight) * centroid).otherwise(centroid)


def pseudo_label(head: Column, nearest_player: Column, conf: Column, far: float = 150.0, near: float = 60.0, sure: float = 0.5) -> Column:
    """ML12: ``head``, ``junk`` (far from all players), ``ball`` (sure and near one), or null: skipped."""
    return F.when(head, "head").when(F.coalesce(nearest_player > far, F.lit(True)), "junk").when((conf >= sure) & (nearest_player <= near), "ball")
