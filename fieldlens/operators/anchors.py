"""Moments at which a formation stands still, and identities carried from one to the next (EV16, FD10)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..sources.shared import checkpoint
from .joins import in_batches
from .sequential import schema_of
from .signals import frame_signals
from .tracking import rigid_fit
from .windows import islands, ordered


@dataclass(frozen=True)
class Anchors:
    """Greatest median speed (m/s) and least players of a still frame; least mean distance from their centre of a settled one; most players in the centre
    circle and least in each half at a kickoff; frames that a run bridges, and candidate frames that it must have."""

    speed: float = 1.2
    players: int = 6
    spread: float = 12.0
    circle: float = 10.0
    in_circle: int = 2
    in_half: int = 2
    bridge: int = 15
    frames: int = 4
    centre: tuple[float, float] = (0.0, 0.0)


def signals(tracks: DataFrame, keys: Sequence[str], c: Anchors = Anchors(), dt: float = 0.04, reach: int = 2) -> DataFrame:
    """Of each frame the players, spread and median speed, and how many stand in the circle and on either side of the centre (tracks: frame, track_id, x_m, y_m)."""
    x, y = (F.col(k) - F.lit(v) for k, v in zip(("x_m", "y_m"), c.centre))
    where = tracks.groupBy(*keys, "frame").agg(F.count_if(F.sqrt(x * x + y * y) <= c.circle).alias("in_circle"), F.count_if(x < 0).alias("left"), F.count_if(x >= 0).alias("right"))
    return frame_signals(tracks, keys, "x_m", "y_m", dt, reach).join(where, [*keys, "frame"])


def kickoff_like(c: Anchors) -> Column:
    """Still, the circle all but empty, and both halves peopled."""
    return (F.col("in_circle") <= c.in_circle) & (F.col("left") >= c.in_half) & (F.col("right") >= c.in_half)


def settled_like(c: Anchors) -> Column:
    """Still, and spread over the pitch."""
    return F.col("spread") >= c.spread


def anchors(frames: DataFrame, keys: Sequence[str], rule: Column, c: Anchors = Anchors()) -> DataFrame:
    """EV16: ``keys, start, end, n_rows, frame, speed`` of each run of still frames for which ``rule`` holds: ``frame`` is the slowest, the first of equals."""
    still = frames.where((F.col("speed") <= c.speed) & (F.col("n") >= c.players) & rule)
    slowest = F.min(F.struct("speed", "frame")).alias("__slowest")
    runs = islands(still, keys, "frame", c.bridge, 1, [slowest]).where(F.col("n_rows") >= c.frames)
    return runs.select(*keys, "start", "end", "n_rows", F.col("__slowest.frame").alias("frame"), F.col("__slowest.speed").alias("speed"))


def align(p: np.ndarray, q: np.ndarray, gate: float = 6.0, rounds: int = 12) -> list[tuple[int, int]]:
    """FD10: pairs of two formations, after turning and shifting ``p`` onto ``q``.

    From where they are, each round fits the points of ``p`` that have a nearest point of ``q`` within the gate onto that, while there are two of these; the
    pairs are then each other's nearest within the gate.  Rounds end when one picks what the last picked, as all further ones would.
    """
    if len(p) < 2 or len(q) < 2:
        return []
    moved, picked = p, None
    for _ in range(rounds):
        apart = np.linalg.norm(moved[:, None] - q[None], axis=2)
        nearest = apart.argmin(1)
        near = apart[np.arange(len(p)), nearest] <= gate
        pick = np.where(near, nearest, -1)
        if near.sum() < 2 or (picked is not None and (pick == picked).all()):
            break
        picked = pick
        turn, shift = rigid_fit(p[near], q[nearest[near]])
        moved = p @ turn.T + shift
    apart = np.linalg.norm(moved[:, None] - q[None], axis=2)
    mine, theirs = apart.argmin(1), apart.argmin(0)
    return [(i, int(j)) for i, j in enumerate(mine) if theirs[j] == i and apart[i, j] <= gate]


def aligned_pairs(found: DataFrame, tracks: DataFrame, keys: Sequence[str], gate: float = 6.0, rounds: int = 12) -> DataFrame:
    """FD10: ``keys, frame_a, frame_b, a, b``: the tracks that stand in the same place of the formations of two anchors (frame) that follow each other.

    A formation is the players of one frame, so a pair of anchors is a small group; many are aligned in a Python call.
    """
    keys = list(keys)
    steps = found.select(*keys, F.col("frame").alias("frame_b"), F.lag("frame").over(ordered(keys, "frame")).alias("frame_a")).where("frame_a is not null")
    place = tracks.select(*keys, "frame", "track_id", F.col("x_m").cast("double").alias("x"), F.col("y_m").cast("double").alias("y"))
    sides = [steps.join(place.withColumnRenamed("frame", f"frame_{s}"), [*keys, f"frame_{s}"]).select(*keys, "frame_a", "frame_b", F.lit(s).alias("side"), "track_id", "x", "y") for s in "ab"]
    rows = sides[0].unionByName(sides[1])
    kind = f"{schema_of(rows, [*keys, 'frame_a', 'frame_b'])}, a {tracks.schema['track_id'].dataType.simpleString()}, b {tracks.schema['track_id'].dataType.simpleString()}"

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        group = [*keys, "frame_a", "frame_b"]
        pdf = pdf.assign(__g=pdf.groupby(group, sort=False, dropna=False).ngroup()).sort_values(["__g", "side", "track_id"], kind="stable")
        at = np.searchsorted(2 * pdf["__g"].to_numpy() + (pdf["side"] == "b").to_numpy(), np.arange(2 * pdf["__g"].max() + 3))
        ids, places, names = pdf["track_id"].tolist(), pdf[["x", "y"]].to_numpy(), list(zip(*(pdf[c].tolist() for c in group)))
        out = []
        for i, j, end in zip(at[:-2:2].tolist(), at[1::2].tolist(), at[2::2].tolist()):
            out += [(*names[i], ids[i + m], ids[j + n]) for m, n in align(places[i:j], places[j:end], gate, rounds)]
        return pd.DataFrame(out, columns=[*keys, "frame_a", "frame_b", "a", "b"])

    return in_batches(rows, [*keys, "frame_a", "frame_b"], pairs, kind)


def carried(pairs: DataFrame, tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, track_id, root``: tracks that pairs join, directly or through others, have the least of their identities as root; all others their own.

    Each round takes the least root among a track's own and its partners', then their roots' roots, and is written out; rounds end when nothing changes.
    """
    keys = list(keys)
    both = pairs.where("a <> b").select(*keys, "a", "b").distinct()
    both = checkpoint(both.unionByName(both.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = checkpoint(tracks.select(*keys, "track_id").distinct().withColumn("root", F.col("track_id")))
    while True:
        near = both.join(roots.select(*keys, F.col("track_id").alias("b"), F.col("root").alias("__r")), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("__r").alias("__r"))
        step = roots.join(near.withColumnRenamed("a", "track_id"), [*keys, "track_id"], "left").select(*keys, "track_id", "root", F.least("root", F.coalesce("__r", "root")).alias("__new"))
        up = step.select(*keys, F.col("track_id").alias("__new"), F.col("__new").alias("__up"))
        step = checkpoint(step.join(up, [*keys, "__new"], "left").select(*keys, "track_id", "root", F.least("__new", "__up").alias("__new")))
        if step.where(F.col("root") != F.col("__new")).isEmpty():
            return step.select(*keys, "track_id", "root")
        roots = step.select(*keys, "track_id", F.col("__new").alias("root"))


def moved_between(pairs: DataFrame, tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How far each paired player stands from the place of the anchor before: ``keys, frame_b, n_pairs, mean_metres``."""
    keys = list(keys)
    at = tracks.select(*keys, "frame", "track_id", "x_m", "y_m")
    rows = pairs
    for s in "ab":
        rows = rows.join(at.select(*keys, F.col("frame").alias(f"frame_{s}"), F.col("track_id").alias(s), F.col("x_m").alias(f"__x{s}"), F.col("y_m").alias(f"__y{s}")), [*keys, f"frame_{s}", s])
    return rows.groupBy(*keys, "frame_b").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(distance("__xa", "__ya", "__xb", "__yb")).alias("mean_metres"))
