"""Sequential algorithms in numpy, applied to one sequence, frame or pair at a time (FD2, FD3, FD11, AG9)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .joins import in_batches
from .sequential import fold_batches, schema_of


@dataclass(frozen=True)
class BallFilter:
    """Constant-velocity Kalman filter over detections of one frame after the other."""

    gate: float = 80.0
    max_gap: int = 12
    init_conf: float = 0.35
    q_pos: float = 4.0
    q_vel: float = 16.0
    r_meas: float = 9.0
    #: Variances of a new track: of its place and of its speed.
    p_pos: float = 16.0
    p_vel: float = 100.0
    #: Basketball: how near to a player a ball must be that starts a track, and one that goes on with it; null: anywhere.
    start_near: float | None = None
    gate_near: float | None = None
    #: With ``start_near``: after a miss so many frames in a row need a ball in the gate before one counts.
    reacquire: int = 1
    #: Basketball: no detection on a head counts, or none while the ball is slower than this.
    reject_head: bool = False
    head_speed: float | None = None

    def _allowed(self, det: tuple, speed: float, within: float | None) -> bool:
        on_head = det[3] and (self.reject_head or (self.head_speed is not None and speed < self.head_speed))
        return not on_head and (self.start_near is None or within is None or det[4] is None or det[4] <= within)

    def run(self, frames: dict[int, list[tuple[float, float, float, bool, float | None]]], last: int) -> list[tuple]:
        """``BallTrack.step`` over frames 1 to ``last``."""
        track = BallTrack(self)
        return [row for f in range(1, last + 1) for row in track.until(f, frames.get(f, []))]


class BallTrack:
    """The filter between two frames: place and speed with their covariance, if the ball is followed, frames since it was seen, and frames that
    a ball has been in the gate for again."""

    def __init__(self, settings: BallFilter):
        self.settings = settings
        self.frame, self.missed, self.pending = 0, 0, 0
        self.mean: np.ndarray | None = None
        self.cov = np.zeros((4, 4))
        self.move = np.eye(4) + np.diag([1.0, 1.0], 2)
        self.noise = np.diag([settings.q_pos] * 2 + [settings.q_vel] * 2)

    def numbers(self) -> tuple:
        """The state as plain numbers, for a state store."""
        known = self.mean is not None
        return self.frame, self.missed, self.pending, known, (self.mean if known else np.zeros(4)).tolist(), self.cov.ravel().tolist()

    def load(self, frame: int, missed: int, pending: int, known: bool, mean: Sequence[float], cov: Sequence[float]) -> BallTrack:
        self.frame, self.missed, self.pending = int(frame), int(missed), int(pending)
        self.mean, self.cov = np.array(mean, float) if known else None, np.array(cov, float).reshape(4, 4)
        return self

    def until(self, frame: int, dets: list[tuple]) -> list[tuple]:
        """Rows of the frames up to this one: those in between had no detections."""
        return [self.step(dets if f == frame else []) for f in range(self.frame + 1, frame + 1)]

    def step(self, dets: list[tuple]) -> tuple:
        """(frame, status, x, y, vx, vy, n_dets, picked_conf) of the next frame.

        A detection is its place, confidence, whether it is on a head, and how far from the nearest player (null: not known, counts as near).
        """
        s, picked = self.settings, None
        self.frame += 1
        if self.mean is not None:
            self.mean, self.cov = self.move @ self.mean, self.move @ self.cov @ self.move.T + self.noise
            near = [(np.hypot(d[0] - self.mean[0], d[1] - self.mean[1]), d) for d in dets]
            speed = float(np.hypot(self.mean[2], self.mean[3]))
            near = [x for x in near if x[0] <= s.gate and s._allowed(x[1], speed, s.gate_near)]
            waits = bool(near) and s.start_near is not None and self.missed > 0 and self.pending + 1 < s.reacquire
            if waits:  # the ball has to be seen again before it is followed
                self.pending, self.missed = self.pending + 1, self.missed + 1
            elif near:
                self.pending = 0
                picked = min(near, key=lambda x: x[0])[1]
                gain = self.cov[:, :2] @ np.linalg.inv(self.cov[:2, :2] + np.eye(2) * s.r_meas)
                self.mean = self.mean + gain @ (np.array(picked[:2]) - self.mean[:2])
                self.cov, self.missed = self.cov - gain @ self.cov[:2], 0
            else:
                self.pending, self.missed = 0, self.missed + 1
                if self.missed > s.max_gap:
                    self.mean = None
        if self.mean is None:
            best = max((d for d in dets if d[2] >= s.init_conf and s._allowed(d, 0.0, s.start_near)), key=lambda d: d[2], default=None)
            if best:
                picked, self.missed = best, 0
                self.mean, self.cov = np.array([best[0], best[1], 0.0, 0.0]), np.diag([s.p_pos] * 2 + [s.p_vel] * 2)
        if self.mean is None:
            return self.frame, "lost", None, None, None, None, len(dets), None
        return (self.frame, "detected" if picked else "predicted", *map(float, self.mean), len(dets), float(picked[2]) if picked else None)


TRACK = "frame bigint, status string, x double, y double, vx double, vy double, n_dets bigint, picked_conf double"
TRACK_COLUMNS = [c.split()[0] for c in TRACK.split(", ")]


def detections_by_frame(pdf: pd.DataFrame, flag: str | None, near: str | None):
    """(frame, detections), frames in order from 1, detections by confidence."""
    pdf = pdf.sort_values(["frame", "conf", "x", "y"], ascending=[True, False, True, True])
    heads = pdf[flag].eq(True) if flag else [False] * len(pdf)
    apart = [None if pd.isna(d) else float(d) for d in pdf[near]] if near else [None] * len(pdf)
    frames: dict[int, list] = {}
    for f, x, y, c, g, d in zip(pdf["frame"], pdf["x"], pdf["y"], pdf["conf"], heads, apart):
        if f >= 1:
            frames.setdefault(int(f), []).append((x, y, c, bool(g), d))
    yield from frames.items()


def kalman_track(detections: DataFrame, keys: Sequence[str], settings: BallFilter = BallFilter(), flag: str | None = None, near: str | None = None) -> DataFrame:
    """FD2, FD3: a row for each frame up to the last one with detections (frame, x, y, conf); ``flag``: on a head; ``near``: distance from the nearest player.

    Frames are folded in their order; what is carried between batches is the filter.
    """
    keys = list(keys)

    def step(track: BallTrack, pdf: pd.DataFrame) -> tuple:
        out = pd.DataFrame([row for f, dets in detections_by_frame(pdf, flag, near) for row in track.until(f, dets)], columns=TRACK_COLUMNS)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return track, out.astype({c: "float64" for c in ("x", "y", "vx", "vy", "picked_conf")})

    return fold_batches(detections, keys, ["frame"], lambda: BallTrack(settings), step, f"{schema_of(detections, keys)}, {TRACK}", whole=["frame"])


def low_pass(v: np.ndarray, cutoff: float, fps: float) -> np.ndarray:
    """Second-order Butterworth, forwards and backwards, the ends continued by odd reflection."""
    k = np.tan(np.pi * cutoff / fps)
    norm = 1 / (1 + np.sqrt(2) * k + k * k)
    b = np.array([k * k, 2 * k * k, k * k]) * norm
    a1, a2 = 2 * (k * k - 1) * norm, (1 - np.sqrt(2) * k + k * k) * norm
    pad = min(9, len(v) - 1)
    if pad < 1:
        return v.astype(float)
    ext = np.concatenate([2 * v[0] - v[pad:0:-1], v, 2 * v[-1] - v[-2 : -pad - 2 : -1]]).astype(float)

    def once(x: np.ndarray) -> np.ndarray:
        # the state that a constant input of the first value leaves behind
        z1, z2 = x[0] * (1 - b[0]), x[0] * (b[2] - a2)
        out = np.empty_like(x)
        for i, t in enumerate(x):
            y = b[0] * t + z1
            z1, z2 = b[1] * t - a1 * y + z2, b[2] * t - a2 * y
            out[i] = y
        return out

    return once(once(ext)[::-1])[::-1][pad : pad + len(v)]


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull, 0 if the points are in a line."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return 0.0

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    h = np.array(half(pts) + half(reversed(pts)))
    x, y = h[:, 0], h[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def hull_areas_of(points: np.ndarray) -> np.ndarray:
    """``hull_area`` of many groups (groups x points x 2) of equally many different points, in order: all groups take a step at a time."""
    rows, total = np.arange(len(points)), np.zeros(len(points))
    for way in (points, points[:, ::-1]):
        chain, depth = np.zeros_like(points), np.zeros(len(points), int)
        for k in range(points.shape[1]):
            p, open_ = way[:, k], rows
            while True:
                open_ = open_[depth[open_] > 1]
                a, b, c = chain[open_, depth[open_] - 2], chain[open_, depth[open_] - 1], p[open_]
                open_ = open_[(b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]) <= 0]
                if not len(open_):
                    break
                depth[open_] -= 1
            chain[rows, depth] = p
            depth += 1
        a, b = chain[:, :-1], chain[:, 1:]
        total += np.where(np.arange(1, points.shape[1]) < depth[:, None], a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0], 0.0).sum(1)
    return np.abs(total) / 2


def hull_areas(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """AG9: ``area`` of each group with three points or more that aren't in a line."""
    kind = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=keys).drop_duplicates([*keys, x, y])
        pdf = pdf.assign(__g=pdf.groupby(keys, sort=False).ngroup()).sort_values(["__g", x, y])
        first = np.flatnonzero(np.diff(pdf["__g"].to_numpy(), prepend=-1))
        size, points, area = np.diff(first, append=len(pdf)), pdf[[x, y]].to_numpy(float), np.zeros(len(first))
        for n in np.unique(size[size > 2]):
            of = np.flatnonzero(size == n)
            area[of] = hull_areas_of(points[first[of][:, None] + np.arange(n)])
        return pdf.iloc[first[area > 0]][keys].assign(area=area[area > 0])

    return in_batches(df.select(*keys, x, y), keys, run, f"{kind}, area double")


def rigid_fit(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that take ``p`` closest to ``q``."""
    cp, cq = p.mean(0), q.mean(0)
    u, _, vt = np.linalg.svd((p - cp).T @ (q - cq))
    r = vt.T @ np.diag([1.0, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return r, cq - r @ cp


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """FD11: least-squares 3x3 map of at least four points (normalised direct linear transform)."""

    def norm(x):
        c, s = x.mean(0), np.sqrt(2) / max(1e-12, np.linalg.norm(x - x.mean(0), axis=1).mean())
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1.0]])

    if len(src) < 4 or np.linalg.matrix_rank(np.c_[src, np.ones(len(src))]) < 3:
        raise ValueError("four points that aren't in a line are needed")
    ts, td = norm(src), norm(dst)
    a, b = (np.c_[src, np.ones(len(src))] @ ts.T)[:, :2], (np.c_[dst, np.ones(len(dst))] @ td.T)[:, :2]
    rows = []
    for (x, y), (u, v) in zip(a, b):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.inv(td) @ np.linalg.svd(np.array(rows), full_matrices=len(rows) < 9)[2][-1].reshape(3, 3) @ ts
    return h / h[2, 2]
