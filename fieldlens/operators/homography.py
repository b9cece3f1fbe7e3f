"""Homographies from marked points, some of which may be wrong: consensus, held-out errors, pruning and refinement (FD11).

A group is the points of one frame or court; the pandas functions see one group at a time.  Draws are seeded and points are put in order
first, so results don't depend on how rows lie.  Groups with too few points, or points in a line, have no row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .tracking import homography

#: With half of the points wrong, all of so many draws miss once in 400,000 fits.
DRAWS = 200


def mapped(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points through one 3x3 map or each of several."""
    with np.errstate(all="ignore"):
        m = np.c_[points, np.ones(len(points))] @ np.swapaxes(h, -1, -2)
        return m[..., :2] / m[..., 2:]


def _through_four(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The maps of many sets of four points each, as null vectors of their equations."""
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    one, nil = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, nil, nil, nil, -u * x, -u * y, -u], -1), np.stack([nil, nil, nil, x, y, one, -v * x, -v * y, -v], -1)], 1)
    return np.linalg.svd(rows)[2][:, -1].reshape(-1, 3, 3)


def consensus(src: np.ndarray, dst: np.ndarray, within: float, draws: int = DRAWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The map that brings most points within a distance of their partners, fitted to these, and which they are.

    All sets of four are tried where there are at most ``draws`` of them, otherwise so many random ones; of equal counts the least error wins.
    """
    n = len(src)
    if n < 4:
        raise ValueError("four points are needed")
    if comb(n, 4) <= draws:
        sets = np.array(list(combinations(range(n), 4)))
    else:
        rng = np.random.default_rng(seed)
        sets = rng.integers(0, n, (2 * draws, 4))
        ordered = np.sort(sets)
        sets = sets[(ordered[:, 1:] != ordered[:, :-1]).all(1)][:draws]
    scale = lambda p: (p - p.mean(0)) / max(1e-12, p.std())
    maps = _through_four(scale(src)[sets], scale(dst)[sets])
    errors = np.linalg.norm(mapped(maps, scale(src)) - scale(dst), axis=-1) * max(1e-12, dst.std())
    good = errors <= within  # what isn't a number is none
    best = np.lexsort((np.where(good, errors, 0).sum(1), -good.sum(1)))[0]
    chosen = good[best]
    for _ in range(10):
        if chosen.sum() < 4:
            raise ValueError("no four points agree")
        h = homography(src[chosen], dst[chosen])
        again = np.linalg.norm(mapped(h, src) - dst, axis=1) <= within
        if (again == chosen).all() or again.sum() < 4:
            break
        chosen = again
    return h, chosen


def _each_group(points: DataFrame, keys: Sequence[str], extra: Sequence[str], adds: str, rows_of: Callable[[pd.DataFrame], list[list]]) -> DataFrame:
    """``rows_of`` a group's points in order, after the group's keys."""
    kind = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in [*keys, *extra])
    names = [*keys, *extra, *(x.split()[0] for x in adds.split(", "))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y", "u", "v"]).sort_values([*extra, "x", "y", "u", "v"]).reset_index(drop=True)
        try:
            rows = rows_of(pdf)
        except (ValueError, np.linalg.LinAlgError):
            rows = []
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *r] for r in rows], columns=names)

    return points.select(*keys, *extra, "x", "y", "u", "v").groupBy(*keys).applyInPandas(run, f"{kind}, {adds}")


def _pairs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf[["x", "y"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float)


def fit_homographies(points: DataFrame, keys: Sequence[str], within: float = 2.0, held: float = 0.2, seed: int = 42) -> DataFrame:
    """Each group's map of (x, y) to (u, v), fitted by consensus without a held-out share, and the errors of that.

    Where fewer than four points would be left, all are fitted and ``errors`` is empty, ``holdout`` (their mean) null.
    """

    def rows_of(pdf: pd.DataFrame) -> list[list]:
        src, dst = _pairs(pdf)
        n = len(src)
        order, n_test = np.random.default_rng(seed).permutation(n), max(1, round(n * held))
        test = order[:n_test] if n - n_test >= 4 else order[:0]
        used = np.setdiff1d(order, test)
        h, good = consensus(src[used], dst[used], within)
        errors = np.linalg.norm(mapped(h, src[test]) - dst[test], axis=1)
        return [[n, int(good.sum()), h.ravel().tolist(), errors.tolist(), float(errors.mean()) if len(errors) else None]]

    return _each_group(points, keys, [], "n_points int, n_inliers int, h array<double>, errors array<double>, holdout double", rows_of)


def _on_court(pdf: pd.DataFrame, used: np.ndarray, within: float) -> np.ndarray:
    """All picture points on the court, by the court's map to the picture that the points in use agree on."""
    src, dst = _pairs(pdf)
    h, _ = consensus(dst[used], src[used], within)
    return mapped(np.linalg.inv(h), src)


def leave_one_out(points: DataFrame, keys: Sequence[str], name: str, within: float = 5.0) -> DataFrame:
    """Of each point the distance on the court between where it is and where a fit to the others puts it; five points at least."""

    def rows_of(pdf: pd.DataFrame) -> list[list]:
        out, true = [], _pairs(pdf)[1]
        for i in range(len(pdf)) if len(pdf) >= 5 else []:
            try:
                at = _on_court(pdf, np.delete(np.arange(len(pdf)), i), within)[i]
            except (ValueError, np.linalg.LinAlgError):
                continue
            out.append([pdf[name].iloc[i], float(np.linalg.norm(at - true[i]))])
        return out

    return _each_group(points, keys, [name], "error double", rows_of)


def prune_outliers(points: DataFrame, keys: Sequence[str], name: str, most: float = 2.0, least_kept: int = 4, within: float = 5.0) -> DataFrame:
    """Which points stay when the worst goes and the rest is fitted again, until all are within ``most`` on the court or ``least_kept`` are left."""

    def rows_of(pdf: pd.DataFrame) -> list[list]:
        true, left, gone = _pairs(pdf)[1], np.arange(len(pdf)), {}
        while len(left) > least_kept:
            errors = np.linalg.norm(_on_court(pdf, left, within) - true, axis=1)[left]
            worst = int(np.argmax(errors))
            if errors[worst] <= most:
                break
            gone[int(left[worst])] = float(errors[worst])
            left = np.delete(left, worst)
        return [[pdf[name].iloc[i], i not in gone, gone.get(i)] for i in range(len(pdf))]

    return _each_group(points, keys, [name], "kept boolean, error double", rows_of)


def associate(points: np.ndarray, tags: np.ndarray, within: float) -> list[tuple[int, int]]:
    """Each point's nearest tag within the distance; of several points with one tag the nearest."""
    if not len(points) or not len(tags):
        return []
    d = np.linalg.norm(points[:, None] - tags[None], axis=2)
    nearest = d.argmin(1)
    d = d[np.arange(len(points)), nearest]
    best: dict[int, int] = {}
    for i in np.flatnonzero(d <= within):
        j = int(nearest[i])
        if j not in best or d[i] < d[best[j]]:
            best[j] = int(i)
    return [(i, j) for j, i in best.items()]


def refine_homographies(detections: DataFrame, tags: DataFrame, keys: Sequence[str], rounds: int = 5, start: float = 4.0, least: float = 2.0, within: float = 1.5, held_within: float = 3.0) -> DataFrame:
    """Each group's map, fitted again and again to what it brings near a tag; columns frame, x, y, h, and frame, u, v of the tags.

    Every other frame trains, the rest gives ``held_median`` and ``n_held``.  The gate narrows by a fifth each round.  With fewer than
    eight associations a group keeps the map it has.  A group is the sampled frames of one sequence.
    """
    kind = ", ".join(f"`{k}` {detections.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "h", "n_pairs", "n_held", "held_median"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame([], columns=names)
        tags_of = {f: t[["u", "v"]].to_numpy(float) for f, t in b.sort_values(["u", "v"]).groupby("frame")}
        frames = [(p[["x", "y"]].to_numpy(float), tags_of.get(f, np.zeros((0, 2)))) for f, p in a.sort_values(["frame", "x", "y"]).groupby("frame")]
        h, gate, n = np.array(a["h"].iloc[0], float).reshape(3, 3), start, 0

        def met(some, gate):
            found = [(p[i], t[j]) for p, t in some for i, j in associate(mapped(h, p), t, gate)]
            return np.array([x for x, _ in found]).reshape(-1, 2), np.array([y for _, y in found]).reshape(-1, 2)

        for _ in range(rounds):
            src, dst = met(frames[::2], gate)
            n = len(src)
            if n < 8:
                break
            try:
                h, _ = consensus(src, dst, within)
            except ValueError:
                break
            gate = max(least, gate * 0.8)
        src, dst = met(frames[1::2], held_within)
        errors = np.linalg.norm(mapped(h, src) - dst, axis=1)
        return pd.DataFrame([[*(a[k].iloc[0] for k in keys), h.ravel().tolist(), n, len(errors), float(np.median(errors)) if len(errors) else None]], columns=names)

    return detections.select(*keys, "frame", "x", "y", "h").groupBy(*keys).cogroup(tags.select(*keys, "frame", "u", "v").groupBy(*keys)).applyInPandas(run, f"{kind}, h array<double>, n_pairs int, n_held int, held_median double")
