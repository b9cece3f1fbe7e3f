"""Summaries of movement, possession and involvement (AG1-AG23, PRJ9-PRJ20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import band, bin_of, clamp, distance
from .windows import edge_moving_average, islands, longest, ordered

FPS = 25.0
FOOTBALL_BANDS = ((2.0, 4.0, 5.5, 7.0, 10.0), ("walk", "jog", "run", "high", "sprint", "artefact"))
BASKETBALL_BANDS = ((1.4, 3.0, 4.5, 6.0, 9.0), ("walk", "jog", "run", "high", "sprint", "artefact"))


def steps(positions: DataFrame, keys: Sequence[str] = ("track_id",), order: str = "frame", x: str = "x_m", y: str = "y_m", fps: float = FPS) -> DataFrame:
    """Metres and speed from one row of a track to the next; rows follow each other as if no frame were missing."""
    w = ordered(keys, order)
    step = distance(x, y, F.lag(x).over(w), F.lag(y).over(w))
    return positions.withColumn("step", step).where("step is not null").withColumn("speed", F.col("step") * fps)


def track_distance(positions: DataFrame, smooth: int = 0, fps: float = FPS) -> DataFrame:
    """AG1: rows, seconds and metres of each track of two points or more; ``smooth`` averages 2k+1 points first."""
    w = ordered(["track_id"], "frame")
    p = positions
    if smooth:
        p = p.withColumn("x_m", edge_moving_average(F.col("x_m"), w, smooth)).withColumn("y_m", edge_moving_average(F.col("y_m"), w, smooth))
    p = p.withColumn("step", distance("x_m", "y_m", F.lag("x_m").over(w), F.lag("y_m").over(w)))
    out = p.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_frames"), ((F.max("frame") - F.min("frame") + 1) / fps).alias("seconds"), F.sum("step").alias("metres"))
    return out.where("n_frames >= 2")


def speed_bands(positions: DataFrame, group: Sequence[str] = ("role",), bands=FOOTBALL_BANDS) -> DataFrame:
    """AG3: metres and steps in each speed band."""
    s = steps(positions).withColumn("band", band("speed", *bands))
    return s.groupBy(*group, "band").agg(F.sum("step").alias("metres"), F.count(F.lit(1)).alias("n_steps"))


def team_distance(positions: DataFrame, artefact: float = 10.0) -> DataFrame:
    """AG2, AG4: metres of each role, those at impossible speeds apart, and the highest possible speed."""
    ok = F.col("speed") <= artefact
    return steps(positions).groupBy("role").agg(F.sum("step").alias("metres"), F.sum(F.when(ok, F.col("step")).otherwise(0.0)).alias("legal_metres"), F.max(F.when(ok, F.col("speed"))).alias("max_speed"))


def territory(points: DataFrame, group: Sequence[str], x: str = "x_m", half: float = 52.5, n: int = 3) -> DataFrame:
    """AG5: share of points in ``n`` equal parts of the length; points beyond the ends count at the ends."""
    rows = points.withColumn("part", bin_of(clamp(x, -half, half), -half, half, n))
    counts = rows.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def heatmap(points: DataFrame, group: Sequence[str], nx: int = 36, ny: int = 20, half: tuple[float, float] = (52.5, 34.0), x: str = "x_m", y: str = "y_m") -> DataFrame:
    """AG6: points in each cell; those outside are dropped."""
    cells = points.withColumn("bin_x", bin_of(x, -half[0], half[0], nx)).withColumn("bin_y", bin_of(y, -half[1], half[1], ny)).where("bin_x is not null and bin_y is not null")
    return cells.groupBy(*group, "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n"))


def formation(positions: DataFrame, min_frames: int = 150) -> DataFrame:
    """AG7: mean place of each track seen often enough."""
    out = positions.groupBy("role", "track_id").agg(F.avg("x_m").alias("x_mean"), F.avg("y_m").alias("y_mean"), F.count(F.lit(1)).alias("n_frames"))
    return out.where(F.col("n_frames") >= min_frames)


def team_spread(points: DataFrame, frame: Sequence[str], group: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """AG8: mean distance of a team's players to their centre, over the frames with ``least`` players or more."""
    w = Window.partitionBy(*group, *frame)
    rows = points.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") >= least)
    rows = rows.withColumn("__d", distance(x, y, F.avg(x).over(w), F.avg(y).over(w)))
    per = rows.groupBy(*group, *frame).agg(F.avg("__d").alias("__d"))
    return per.groupBy(*group).agg(F.avg("__d").alias("spread"), F.count(F.lit(1)).alias("n_frames"))


def median_spread(points: DataFrame, frame: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """AG10: mean distance of a frame's players to their median place."""
    centre = points.groupBy(*frame).agg(F.expr(f"percentile({x}, 0.5)").alias("__x"), F.expr(f"percentile({y}, 0.5)").alias("__y"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return points.join(centre, list(frame)).groupBy(*frame, "n").agg(F.avg(distance(x, y, "__x", "__y")).alias("spread"))


def trimmed_centroid(points: DataFrame, frame: Sequence[str], x: str, y: str, least: int = 7, part: float = 0.85, keep: int = 3) -> DataFrame:
    """AG11: centre of a frame's players; with ``least`` or more of them without those beyond the ``part`` quantile of distance."""
    w = Window.partitionBy(*frame)
    rows = points.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__d", distance(x, y, F.avg(x).over(w), F.avg(y).over(w)))
    cut = rows.groupBy(*frame).agg(F.expr(f"percentile(__d, {part})").alias("__cut"))
    rows = rows.join(cut, list(frame)).withColumn("__in", F.col("__d") <= F.col("__cut")).withColumn("__kept", F.count_if("__in").over(w))
    near = rows.where((F.col("__n") < least) | F.col("__in") | (F.col("__kept") < keep))
    return near.groupBy(*frame).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count(F.lit(1)).alias("n"))


def possession_share(timeline: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """AG12: shares of the codes 1 and 2, and what was left out."""
    n1, n2, n = F.count_if(F.col("possession") == 1), F.count_if(F.col("possession") == 2), F.count(F.lit(1))
    total = F.greatest(F.lit(1), n1 + n2)
    return timeline.groupBy(*group).agg((100.0 * n1 / total).alias("team_a_pct"), (100.0 * n2 / total).alias("team_b_pct"), (n1 + n2).alias("n_counted"), n.alias("n_total"))


def id_accumulation(positions: DataFrame, fps: float = FPS) -> DataFrame:
    """AG17: new tracks in each minute, quiet minutes too, and how many there were by then."""
    first = positions.groupBy("seq", "track_id").agg(F.min("frame").alias("f")).withColumn("minute", F.floor((F.col("f") - 1) / (60 * fps)).cast("bigint"))
    counts = first.groupBy("seq", "minute").agg(F.count(F.lit(1)).alias("new_ids"))
    span = positions.groupBy("seq").agg(F.floor((F.max("frame") - 1) / (60 * fps)).cast("bigint").alias("last"))
    spine = span.select("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("minute"))
    out = spine.join(counts, ["seq", "minute"], "left").withColumn("new_ids", F.coalesce("new_ids", F.lit(0)))
    return out.withColumn("total_ids", F.sum("new_ids").over(ordered(["seq"], "minute")))


def lifetimes(positions: DataFrame, substantial: int = 60) -> DataFrame:
    """AG18: tracks, substantial ones and quantiles of their length by sequence."""
    per = positions.groupBy("seq", "track_id").agg((F.max("frame") - F.min("frame") + 1).alias("life"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("seq").agg(F.count(F.lit(1)).alias("n_tracks"), F.count_if(F.col("n") >= substantial).alias("n_substantial"), F.expr("percentile(life, 0.5)").alias("life_p50"), F.expr("percentile(life, 0.9)").alias("life_p90"), F.max("life").alias("life_max"))


def band_time_share(positions: DataFrame, k: int = 12, min_life: int = 50, guard: float = 12.0, bands=FOOTBALL_BANDS, fps: float = FPS) -> DataFrame:
    """AG19: share of samples in each band by speed over ``k`` rows, without teleports and short tracks."""
    w = ordered(["track_id"], "frame")
    rows = positions.withColumn("life", F.count(F.lit(1)).over(Window.partitionBy("track_id"))).where(F.col("life") >= min_life)
    rows = rows.withColumn("speed", distance("x_m", "y_m", F.lag("x_m", k).over(w), F.lag("y_m", k).over(w)) / ((F.col("frame") - F.lag("frame", k).over(w)) / fps))
    rows = rows.where(F.col("speed") <= guard).withColumn("band", band("speed", *bands))
    counts = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("band", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))  # one row beside a handful of bands


def presence(positions: DataFrame, order: str = "hour_frame", gap: int = 5, min_len: int = 1) -> DataFrame:
    """WN8: stretches in which a track is there."""
    return islands(positions.select("track_id", order).distinct(), ["track_id"], order, gap, min_len)


def longest_presence(positions: DataFrame, order: str = "hour_frame", gap: int = 5) -> DataFrame:
    return longest(presence(positions, order, gap), ["track_id"])


def capped(start: Column, end: Column, cap: int = 125) -> tuple[Column, Column]:
    """PRJ20: a stretch longer than ``cap`` frames is cut to that about its middle."""
    middle = F.floor((start + end) / 2)
    first = middle - cap // 2
    long = end - start + 1 > cap
    return F.when(long, first).otherwise(start), F.when(long, first + cap - 1).otherwise(end)


def padded(start: Column, end: Column, n: Column, before: int = 50, after: int = 25) -> tuple[Column, Column]:
    """PRJ18: a clip about a stretch, inside the recording."""
    return F.greatest(F.lit(1), start - before), F.least(n, end + after)


def inclusivity(tracks: DataFrame, moments: DataFrame, substantial: int = 60) -> DataFrame:
    """AG20: of the tracks with enough frames, how many have a moment and how many only their presence."""
    have = moments.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_moments"))
    rows = tracks.where(F.col("n_frames") >= substantial).join(have, "track_id", "left").withColumn("n_moments", F.coalesce("n_moments", F.lit(0)))
    return rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n_tracks"), F.count_if(F.col("n_moments") > 0).alias("via_involvement"), F.count_if(F.col("n_moments") == 0).alias("via_presence"), F.min("n_moments").alias("least"), F.floor(F.expr("percentile(n_moments, 0.5)")).cast("bigint").alias("median"), F.max("n_moments").alias("most"))


def missed(tracks: DataFrame, moments: DataFrame, substantial: int = 60) -> DataFrame:
    """JN20: tracks with enough frames and no moment."""
    return tracks.where(F.col("n_frames") >= substantial).join(moments.select("track_id").distinct(), "track_id", "left_anti")


def top_share(counts: DataFrame, group: Sequence[str], n: str = "n", k: int = 3) -> DataFrame:
    """AG21: part of the whole that the first ``k`` have."""
    w = Window.partitionBy(*group).orderBy(F.desc(n), "track_id")
    return counts.withColumn("__r", F.row_number().over(w)).groupBy(*group).agg((F.sum(F.when(F.col("__r") <= k, F.col(n)).otherwise(0)) / F.sum(n)).alias("top_share"), F.count(F.lit(1)).alias("n_tracks"))


def tagging_volume(clips: DataFrame, seconds: Sequence[float] = (5.0, 10.0, 20.0)) -> DataFrame:
    """AG22: clips, and hours of work for each time that one takes."""
    one = clips.agg(F.count(F.lit(1)).alias("n_clips"), F.countDistinct("track_id").alias("n_tracks"))
    return one.select("n_clips", "n_tracks", F.explode(F.array(*[F.lit(s) for s in seconds])).alias("seconds_each")).withColumn("hours", F.col("n_clips") * F.col("seconds_each") / 3600)


def possession_exclusions(timeline: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """AG12: why frames weren't counted (status, pitch_x_m, aerial, d): ``d`` is the nearest player's distance, null without players."""
    return timeline.groupBy(*group, exclusion().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def exclusion(most: float = 5.0) -> Column:
    """AG12: the first reason that holds, ``counted`` if there is none."""
    return (
        F.when(F.col("status") == "lost", "no_ball_track").when(F.col("pitch_x_m").isNull(), "no_pitch").when(F.col("aerial"), "aerial")
        .when(F.col("d").isNull(), "no_players").when(F.col("d") > most, "ball_too_far").otherwise("counted")
    )


def possession_strip(timeline: DataFrame, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """WN25: stretches of one colour along the frames: who has the ball from where to where."""
    w = ordered(list(keys), "frame")
    colour = F.when(F.col("possession") == 1, "TeamA").when(F.col("possession") == 2, "TeamB").otherwise("none")
    rows = timeline.withColumn("colour", colour)
    rows = rows.withColumn("__run", F.sum(F.coalesce((F.col("colour") != F.lag("colour").over(w)).cast("int"), F.lit(1))).over(w))
    return rows.groupBy(*keys, "__run", "colour").agg(F.min("frame").alias("start"), F.max("frame").alias("end")).drop("__run")


def plausibility(features: DataFrame, keys: Sequence[str], fast: float) -> DataFrame:
    """AG16: frames, those with the ball detected, those faster than a bound, and quantiles of the speed."""
    share = F.avg(F.col("detected").cast("double")).alias("detected_share")
    return features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("n_detected"), share, F.count_if(F.col("speed") > fast).alias("fast"), *[F.expr(f"percentile(speed, {q})").alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))])
