"""Folds over rows in order that carry a small state past the ends of Arrow batches, and the camera paths made of them (FD5, WN19, WN24)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp_centre
from .windows import interpolate


def fold_batches(df: DataFrame, keys: Sequence[str], order: Sequence, start: Callable, step: Callable, kind, finish: Callable | None = None, whole: Sequence[str] = ()) -> DataFrame:
    """``step(state, rows) -> (state, result)`` over the rows of each key in order, piece after piece.

    Rows are dealt out by key and sorted there by Spark, which spills; a task holds one batch and one state.  A key may come in several pieces, so what
    ``step`` returns must not depend on where pieces end.  Rows equal in ``whole`` (a frame) come in one piece.  ``finish(state, key) -> result`` closes a key.
    """
    keys, whole = list(keys), [*keys, *whole]
    order = [F.col(c) if isinstance(c, str) else c for c in order]

    def run(batches):
        key, state, rest = None, None, None
        for b in _and_none(batches):
            last = b is None
            if last:
                b, rest = rest, None
            elif rest is not None:
                b, rest = pd.concat([rest, b], ignore_index=True), None
            if b is None or not len(b):
                continue
            if len(whole) > len(keys) and not last:
                end = b[whole].iloc[-1]
                held = (b[whole].eq(end) | (b[whole].isna() & end.isna())).all(axis=1)
                b, rest = b[~held], b[held]
            for k, part in b.groupby(keys, sort=False, dropna=False):
                k = tuple(None if pd.isna(x) else x for x in (k if isinstance(k, tuple) else (k,)))
                if k != key:
                    if key is not None and finish:
                        yield finish(state, key)
                    key, state = k, start()
                state, out = step(state, part)
                yield out
        if key is not None and finish:
            yield finish(state, key)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as small rows may stand for much work
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, kind)


def _and_none(batches):
    yield from batches
    yield None


def schema_of(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def rate_limited(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], vmax: float, accel: float, decel: float, dead_zone: float) -> DataFrame:
    """FD5: follow each target with bounded speed, slow enough to stop at it by ``decel``; targets within the dead zone, which shortens all ways, are left.

    The first place is the first target's.  A change of speed is at most ``accel`` where it goes up and ``decel`` where it goes down.
    """
    values = list(values)

    def follow(at: list, target: float) -> list:
        place, speed = at
        way = target - place
        braking = (2 * decel * max(0.0, abs(way) - dead_zone)) ** 0.5  # from which it can still stop in time
        wanted = min(vmax, braking) if way > 0 else -min(vmax, braking)
        bound = accel if abs(wanted) > abs(speed) else decel
        speed += float(np.clip(wanted - speed, -bound, bound))
        return [place + speed, speed]

    def step(state: dict, pdf: pd.DataFrame) -> tuple:
        out = pdf[[*keys, order]].copy()
        for c in values:
            at, way = state.get(c), []
            for target in pdf[c].tolist():
                at = [target, 0.0] if at is None else follow(at, target)
                way.append(at[0])
            state[c], out[c] = at, way
        return state, out

    rows = df.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in values])
    return fold_batches(rows, keys, [order], dict, step, rows.schema)


class LowPass:
    """Second-order Butterworth filter, a value at a time; it begins as if its first value had gone on for ever."""

    def __init__(self, cutoff: float, fps: float):
        k = math.tan(math.pi * cutoff / fps)
        norm = 1 / (1 + math.sqrt(2) * k + k * k)
        self.b = (k * k * norm, 2 * k * k * norm, k * k * norm)
        self.a = (2 * (k * k - 1) * norm, (1 - math.sqrt(2) * k + k * k) * norm)

    def run(self, state: tuple | None, values: Sequence[float]) -> tuple[tuple | None, list[float]]:
        out = []
        (b0, b1, b2), (a1, a2) = self.b, self.a
        for v in values:
            z1, z2 = state or (v * (1 - b0), v * (b2 - a2))
            y = b0 * v + z1
            state = (b1 * v - a1 * y + z2, b2 * v - a2 * y)
            out.append(y)
        return state, out


#: Values that an end of a sequence is continued by.
PAD = 9


def zero_phase(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], cutoff: float, fps: float) -> DataFrame:
    """WN19: low-pass forwards, then backwards over what that gave; both ends are continued by odd reflection of up to PAD values.

    Two folds: the first also emits the rows of both continuations, the second drops them.  Either carries two numbers a value, and the first the
    values next to an end.
    """
    values = list(values)
    wave = LowPass(cutoff, fps)
    kind = f"{schema_of(df, keys)}, __at bigint, {schema_of(df, [order])}, " + ", ".join(f"`{c}` double" for c in values)

    def rows(key_rows: pd.DataFrame, at: int, orders: list, columns: list[list[float]]) -> pd.DataFrame:
        out = pd.DataFrame({"__at": range(at, at + len(orders)), order: pd.array(orders, dtype="Int64"), **dict(zip(values, columns))})
        for k in reversed(list(keys)):
            out.insert(0, k, key_rows)
        return out

    def begin() -> dict:
        return {"n": 0, "held": [], "tail": [], "filters": [None] * len(values), "key": None}

    def filtered(s: dict, points: list[tuple]) -> list[list[float]]:
        out = []
        for c in range(len(values)):
            s["filters"][c], y = wave.run(s["filters"][c], [p[1 + c] for p in points])
            out.append(y)
        return out

    def opened(s: dict) -> list[tuple]:
        """The rows that were held back with their reflection before them."""
        held, s["held"] = s["held"], None
        pad = min(PAD, len(held) - 1)
        return [(None, *(2 * a - b for a, b in zip(held[0][1:], held[j][1:]))) for j in range(pad, 0, -1)] + held

    def step(s: dict, pdf: pd.DataFrame) -> tuple:
        points = list(zip(pdf[order].tolist(), *(pdf[c].tolist() for c in values)))
        s["tail"] = (s["tail"] + points)[-(PAD + 1) :]
        if s["held"] is not None:
            s["held"] += points
            points = opened(s) if len(s["held"]) > PAD else []
        s["key"] = [pdf[k].iloc[0] for k in keys]
        return s, emit(s, points)

    def emit(s: dict, points: list[tuple]) -> pd.DataFrame:
        at, s["n"] = s["n"], s["n"] + len(points)
        out = rows(None, at, [p[0] for p in points], filtered(s, points))
        for k, v in zip(keys, s["key"]):
            out[k] = v
        return out

    def finish(s: dict, key: tuple) -> pd.DataFrame:
        points = opened(s) if s["held"] is not None else []
        tail = s["tail"]
        pad = min(PAD, len(tail) - 1)
        return emit(s, points + [(None, *(2 * a - b for a, b in zip(tail[-1][1:], tail[-1 - j][1:]))) for j in range(1, pad + 1)])

    source = df.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in values])
    forth = fold_batches(source, keys, [order], begin, step, kind, finish)

    def back(state: list, pdf: pd.DataFrame) -> tuple:
        out = pdf[[*keys, order]].copy()
        for c, name in enumerate(values):
            state[c], out[name] = wave.run(state[c], pdf[name].tolist())
        return state, out[out[order].notna()]

    return fold_batches(forth, keys, [F.desc("__at")], lambda: [None] * len(values), back, source.schema)


def camera_path(ball: DataFrame, keys: Sequence[str], frame: str, crop: tuple[float, float], picture: tuple[float, float], fps: float = 25.0, cutoff: float = 1.2, limits: tuple[float, float, float, float] | None = None) -> DataFrame:
    """WN24: where a camera that follows the ball (x, y) looks: gaps filled, low-passed both ways, kept inside the picture.

    With ``limits`` (greatest speed, acceleration, deceleration, dead zone; FD5) the path is then followed within them before it is clamped.
    """
    keys = list(keys)
    rows = ball.select(*keys, frame, *[interpolate(F.col(c), F.col(frame), keys, frame).alias(c) for c in "xy"])
    rows = zero_phase(rows, keys, frame, ["x", "y"], cutoff, fps)
    if limits:
        rows = rate_limited(rows, keys, frame, ["x", "y"], *limits)
    return rows.select(*keys, frame, *[clamp_centre(c, size, whole).alias(c) for c, size, whole in zip("xy", crop, picture)])


def ball_weight(status: Column, aerial: Column, keys: Sequence[str], order: str, detected: float = 1.0, predicted: float = 0.8, in_air: float = 0.25, decay: float = 6.0) -> Column:
    """WN20: how much the camera heeds the ball: less the longer it wasn't detected, little in the air, not at all when lost.

    The streak counts the rows since the last detection, lost ones too.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    streak = n - F.coalesce(F.last(F.when(status == "detected", n), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    fading = predicted * F.exp(-(streak - 1) / decay)
    return F.when(status == "detected", F.when(aerial, in_air).otherwise(detected)).when(status == "predicted", F.when(aerial, F.least(fading, F.lit(in_air * 0.7))).otherwise(fading)).otherwise(0.0)


def camera_quality(path: DataFrame, keys: Sequence[str], crop: tuple[float, float], picture: tuple[float, float], ball: DataFrame, players: DataFrame | None = None, truth: DataFrame | None = None, safe: float = 0.7) -> DataFrame:
    """ML15: for each sequence shares of frames with the detected ball in the safe middle of the crop, of players and of the true ball in the crop, of frames
    at the picture's rim, and the mean size of second and third differences.  ``path, ball, players, truth`` have frame, x, y; ball also status.
    """
    keys = list(keys)
    on = [*keys, "frame"]

    def inside(other: DataFrame, share: float) -> DataFrame:
        rows = other.where("x is not null and y is not null").select(*on, F.col("x").alias("__x"), F.col("y").alias("__y")).join(path, on)
        near = [F.abs(F.col(f"__{c}") - F.col(c)) <= size / 2 * share for c, size in zip("xy", crop)]
        return rows.withColumn("__in", (near[0] & near[1]).cast("double"))

    w = Window.partitionBy(*keys).orderBy("frame")
    lags = {c: [F.col(c), *[F.lag(c, k).over(w) for k in (1, 2, 3)]] for c in "xy"}
    bend = [v[0] - 2 * v[1] + v[2] for v in lags.values()]
    jerk = [v[0] - 3 * v[1] + 3 * v[2] - v[3] for v in lags.values()]
    rim = [(F.col(c) <= size / 2 + 0.5) | (F.col(c) >= whole - size / 2 - 0.5) for c, size, whole in zip("xy", crop, picture)]
    moved = path.withColumns({"__a": F.sqrt(bend[0] ** 2 + bend[1] ** 2), "__j": F.sqrt(jerk[0] ** 2 + jerk[1] ** 2), "__rim": (rim[0] | rim[1]).cast("double")})
    out = moved.groupBy(*keys).agg(F.avg("__a").alias("mean_accel"), F.avg("__j").alias("mean_jerk"), F.avg("__rim").alias("clamped"))
    parts = [inside(ball.where("status = 'detected'"), safe).groupBy(*keys).agg(F.avg("__in").alias("ball_safe"), F.count(F.lit(1)).alias("n_detected"))]
    if players is not None:
        parts.append(inside(players, 1.0).groupBy(*on).agg(F.avg("__in").alias("__in")).groupBy(*keys).agg(F.avg("__in").alias("action_in_frame")))
    if truth is not None:
        parts.append(inside(truth, 1.0).groupBy(*keys).agg(F.avg("__in").alias("truth_in_crop")))
    for p in parts:
        out = out.join(p, keys, "left")
    return out
