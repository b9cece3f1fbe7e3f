"""From picture to pitch, and what is kept of it (PRJ2-PRJ17, PRJ22, PRJ24, SRC15, AG36)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_distance, project
from ..functions.text import printed
from .windows import ordered

PITCH = (52.5, 34.0)


def on_pitch(rows: DataFrame, homographies: DataFrame, keys: Sequence[str] = ("frame",), x: str = "x", y: str = "y") -> DataFrame:
    """PRJ2: ``px, py`` of rows by the matrix ``h`` (nine numbers, row by row) of their frame; rows of frames without one go."""
    px, py = project(x, y, F.col("__h"))
    return rows.join(homographies.select(*keys, F.col("h").alias("__h")), [*keys]).withColumns({"px": px, "py": py}).drop("__h")


def every_frame(still: DataFrame, n: str) -> DataFrame:
    """PRJ3: a fixed camera's matrix for each of the frames 1 to ``n``."""
    return still.where(F.col(n) >= 1).withColumn("frame", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n).cast("bigint")))).drop(n)


def near_player(balls: DataFrame, boxes: DataFrame, keys: Sequence[str], bx: str, by: str, radius: float) -> DataFrame:
    """PRJ6: ``near``: whether a box is within the radius; without any boxes in its frame a ball counts as near."""
    pairs = balls.join(boxes.select(*keys, "x", "y", "w", "h"), [*keys])
    d = box_distance(bx, by, F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    least = pairs.groupBy(*keys, bx, by).agg(F.min(d).alias("__d"))
    return balls.join(least, [*keys, bx, by], "left").withColumn("near", F.coalesce(F.col("__d") <= radius, F.lit(True))).drop("__d")


def below_top(rows: DataFrame, y: str, height: float, part: float = 0.10) -> DataFrame:
    """PRJ7: without what lies in the top part of the picture."""
    return rows.where(F.col(y) >= part * height)


def inside(x: str, y: str, half: Sequence[float] = PITCH, margin: float = 0.0) -> Column:
    """Whether a point is on the pitch or at most ``margin`` beside it."""
    return (F.abs(x) <= half[0] + margin) & (F.abs(y) <= half[1] + margin)


def ball_on_pitch(ball: DataFrame, x: str = "pitch_x_m", y: str = "pitch_y_m", half: Sequence[float] = PITCH, margin: float = 5.0) -> DataFrame:
    """PRJ8: the ball's points that can be on the pitch."""
    return ball.where(inside(x, y, half, margin))


def tracks_on_pitch(tracks: DataFrame, keys: Sequence[str] = ("track_id",), x: str = "x_m", y: str = "y_m", half: Sequence[float] = PITCH, margin: float = 2.0, least: int = 2) -> DataFrame:
    """PRJ9: the points on the pitch, of tracks that have ``least`` such points or more."""
    rows = tracks.where(inside(x, y, half, margin)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return rows.where(F.col("__n") >= least).drop("__n")


def share_on_pitch(tracks: DataFrame, keys: Sequence[str], x: str = "x_m", y: str = "y_m", half: Sequence[float] = PITCH, margin: float = 1.5) -> DataFrame:
    """PRJ10: the part of each track's points that is on the pitch."""
    return tracks.groupBy(*keys).agg(F.avg(inside(x, y, half, margin).cast("double")).alias("on_pitch"))


def places_in_picture(homographies: DataFrame, places: Sequence[tuple[str, float, float]], width: float, height: float) -> DataFrame:
    """PRJ11: which of the named places (hoops) the matrix from court to picture puts inside it, and where."""
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(x)).alias("wx"), F.lit(float(y)).alias("wy")) for n, x, y in places]))
    rows = homographies.withColumn("__p", table).select("*", "__p.*").drop("__p")
    u, v = project("wx", "wy", F.col("h"))
    return rows.withColumns({"u": u, "v": v}).where(F.col("u").between(0, width) & F.col("v").between(0, height)).drop("h", "wx", "wy")


def in_flight(x: Column, y: Column, vy: Column, height: float, part: float, fast: float) -> Column:
    """PRJ12: high in the picture, or fast up or down; false where there is no ball."""
    return F.coalesce(x.isNotNull() & ((y < part * height) | F.coalesce(F.abs(vy) > fast, F.lit(False))), F.lit(False))


def aerial_suspects(ball: DataFrame, keys: Sequence[str], order: str, x: str, y: str, fps: float = 25.0, top: float = 25.0) -> DataFrame:
    """PRJ13: ``aerial``: a projected point too far from the projected point before it, however many frames ago that was."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    was = F.last(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y"))), True).over(w)
    rows = ball.withColumn("__was", was)
    dx, dy = F.col(x) - F.col("__was.x"), F.col(y) - F.col("__was.y")
    return rows.withColumn("aerial", F.coalesce(F.sqrt(dx * dx + dy * dy) * fps > top, F.lit(False))).drop("__was")


def every_nth_frame(rows: DataFrame, keys: Sequence[str], frame: str, step: int) -> DataFrame:
    """PRJ15: the rows of every ``step``-th of the frames that occur, from the first."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(frame))
    return rows.withColumn("__rank", rank).where((F.col("__rank") - 1) % step == 0).drop("__rank")


def spread_sample(rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """PRJ16: up to ``k`` rows of each key, evenly over its length."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__step", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / k)))
    return numbered.where((F.col("__i") % F.col("__step") == 0) & (F.col("__i") / F.col("__step") < k)).drop("__i", "__step")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """PRJ17: ``n`` rows in the order of a hash of seed and key: the same for the same seed wherever rows lie."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def calibration_quality(landmark_m: Column, register_px: Column, method: Column) -> list[Column]:
    """PRJ22: the error of the landmarks in metres, else the residual in pixels, else nothing."""
    by_marks, by_fit = landmark_m.isNotNull(), register_px.isNotNull()
    return [
        F.when(by_marks, F.coalesce(method, F.lit("manual"))).when(by_fit, "auto-register (retired)").otherwise(F.coalesce(method, F.lit("unknown"))).alias("method"),
        F.when(by_marks, "landmark recon").when(by_fit, "align resid").otherwise("calib").alias("label"),
        F.when(by_marks, F.concat(printed(landmark_m, 1), F.lit(" m"))).when(by_fit, F.concat(printed(register_px, 0), F.lit(" px"))).otherwise("n/a").alias("value"),
    ]


def tag_text(types: Column, confidence: Column, start: Column, end: Column) -> Column:
    """PRJ24: what a clip is headed with."""
    return F.concat(F.replace(F.array_join(types, "+"), F.lit("_"), F.lit(" ")), F.lit("  c="), printed(confidence, 2), F.lit("  ["), printed(start, 1), F.lit("-"), printed(end, 1), F.lit("s]"))


def court_landmarks(spark: SparkSession, length: float, width: float, lane_width: float, lane_length: float, basket: float, arc: float) -> DataFrame:
    """SRC15: ``label, wx, wy``, metres from the centre of the court."""
    hx, hy, lane, line, hoop = length / 2, width / 2, lane_width / 2, length / 2 - lane_length, length / 2 - basket
    # fixed values: the names that marked pictures use
    places = {
        "center": (0.0, 0.0), "center_far": (0.0, -hy), "center_near": (0.0, hy),
        "r_baseline_far": (hx, -hy), "r_baseline_near": (hx, hy), "r_lane_base_far": (hx, -lane), "r_lane_base_near": (hx, lane), "r_lane_ft_far": (line, -lane),
        "r_lane_ft_near": (line, lane), "r_ft_center": (line, 0.0), "r_arc_top": (hoop - arc, 0.0), "r_basket": (hoop, 0.0),
        "l_baseline_far": (-hx, -hy), "l_baseline_near": (-hx, hy), "l_ft_center": (-line, 0.0), "l_basket": (-hoop, 0.0),
    }
    return spark.createDataFrame([(k, *map(float, p)) for k, p in places.items()], "label string, wx double, wy double")


def world_points(asked: DataFrame, landmarks: DataFrame, keys: Sequence[str], labels: str = "labels") -> DataFrame:
    """SRC15: the places of the labels in the order asked for; a label that isn't known has no place."""
    return asked.select(*keys, F.posexplode(labels).alias("no", "label")).join(landmarks, "label", "left").select(*keys, "no", "label", "wx", "wy")


def landmark_errors(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG36: mean distance in metres of marked points (x, y), through ``h``, from where their landmarks (wx, wy) are; marks left out don't count."""
    px, py = project("x", "y", F.col("h"))
    rows = marks.where("not pruned").withColumn("__d", F.sqrt((px - F.col("wx")) ** 2 + (py - F.col("wy")) ** 2))
    gone = marks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("pruned"), F.col("label")))).alias("pruned"))
    return gone.join(rows.groupBy(*keys).agg(F.avg("__d").alias("error_m"), F.count(F.lit(1)).alias("n_marks")), [*keys], "left")
