"""Joins by nearness in space and time (JN1-JN24)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(pairs: DataFrame, group: Sequence[str], distance: str, ties: Sequence[str], radius: float | Column | None = None, strict: bool = False) -> DataFrame:
    """JN3-JN5: of each group the row of least distance, equals by ``ties``; none if that is beyond the radius."""
    w = Window.partitionBy(*group).orderBy(distance, *ties)
    best = pairs.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    if radius is None:
        return best
    limit = radius if isinstance(radius, Column) else F.lit(float(radius))
    return best.where(F.col(distance) < limit if strict else F.col(distance) <= limit)


def counts_within(pairs: DataFrame, group: Sequence[str], distance: str, radius: float, by: str, values: Sequence[str]) -> DataFrame:
    """JN4: how many of each kind are within a radius, a column for each of ``values``."""
    near = F.col(distance) <= radius
    return pairs.groupBy(*group).agg(*[F.count_if(near & (F.col(by) == v)).alias(f"near_{v}") for v in values])


def involved(pairs: DataFrame, group: Sequence[str], distance: str, ties: Sequence[str], mode: str, radius: float, gap: float = 1.6) -> DataFrame:
    """JN6: who is at the ball: all within the ``radius``, the ``nearest``, or the nearest if the second is ``gap`` times as far."""
    if mode == "radius":
        return pairs.where(F.col(distance) <= radius)
    w = Window.partitionBy(*group).orderBy(distance, *ties)
    ranked = pairs.withColumn("__rank", F.row_number().over(w)).withColumn("__second", F.lead(distance).over(w))
    keep = (F.col("__rank") == 1) & (F.col(distance) <= radius)
    if mode == "gap":
        keep &= F.col("__second").isNull() | (F.col("__second") >= gap * F.col(distance))
    elif mode != "nearest":
        raise ValueError(f"no such mode: {mode}")
    return ranked.where(keep).drop("__rank", "__second")


def asof_within(left: DataFrame, right: DataFrame, left_id: str, left_time: str, right_id: str, right_time: str, tolerance: int, by: Sequence[str] = ()) -> DataFrame:
    """JN8: for each left row and ``by`` value of the right side, the right row nearest in time within the tolerance.

    Times are whole numbers.  Both sides meet in buckets as wide as the tolerance: a right row goes to its own and both neighbours.  In a bucket a left row
    looks at the last right time before it and the first after it, of each ``by`` value that is there, so no two rows are paired.  Equal distances go to the
    least right id.
    """
    by = list(by)
    at = ["__bucket", *by]
    bucket = lambda t: F.floor(F.col(t) / tolerance)
    there = right.where(F.col(right_time).isNotNull()).withColumn("__bucket", F.explode(F.array(*[bucket(right_time) + d for d in (-1, 0, 1)])))
    there = there.groupBy(*at, F.col(right_time).alias("__time")).agg(F.min_by(F.struct(*[F.col(c) for c in right.columns]), right_id).alias("__right"))
    kinds = there.select(*at).distinct()
    asking = left.where(F.col(left_time).isNotNull()).select(bucket(left_time).alias("__bucket"), F.col(left_time).alias("__time"), F.struct(*[F.col(c) for c in left.columns]).alias("__left")).join(kinds, "__bucket")
    rows = there.withColumn("__asks", F.lit(0)).unionByName(asking.withColumn("__asks", F.lit(1)), allowMissingColumns=True)
    seen = [F.last("__right", True).over(Window.partitionBy(*at).orderBy(order, "__asks").rowsBetween(Window.unboundedPreceding, 0)) for order in (F.col("__time"), F.desc("__time"))]
    rows = rows.withColumns({"__before": seen[0], "__after": seen[1]}).where("__asks = 1")
    far = [F.abs(F.col("__time") - F.col(f"{c}.{right_time}")) for c in ("__before", "__after")]
    later = far[0].isNull() | (far[1] < far[0]) | ((far[1] == far[0]) & (F.col(f"__after.{right_id}") < F.col(f"__before.{right_id}")))
    best = rows.select("__left.*", F.when(later, F.col("__after")).otherwise(F.col("__before")).alias("__best")).select("*", "__best.*").drop("__best")
    return nearest(best.withColumn("dt", F.abs(F.col(left_time) - F.col(right_time))).where(F.col("dt") <= tolerance), [left_id, *by], "dt", [right_id])


def mutual_nearest(pairs: DataFrame, group: Sequence[str], left: str, right: str, distance: str, strict: bool = False) -> DataFrame:
    """JN9: each left row picks its nearest right row, and each right row keeps the nearest of those that picked it.

    ``strict`` (JN10): both must be each other's first choice among all pairs.
    """
    by_left = Window.partitionBy(*group, left).orderBy(distance, right)
    by_right = Window.partitionBy(*group, right).orderBy(distance, left)
    if strict:
        return pairs.withColumn("__l", F.row_number().over(by_left)).withColumn("__r", F.row_number().over(by_right)).where("__l = 1 and __r = 1").drop("__l", "__r")
    picked = pairs.withColumn("__l", F.row_number().over(by_left)).where("__l = 1")
    return picked.withColumn("__r", F.row_number().over(by_right)).where("__r = 1").drop("__l", "__r")


def band_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, low: int, high: int, keys: Sequence[str] = ()) -> DataFrame:
    """JN14: pairs with ``low <= right_at - left_at <= high``: the right side's buckets of ``high - low + 1`` make it an equi-join."""
    width = high - low + 1
    a = left.withColumn("__bucket", F.explode(F.array(F.floor((F.col(left_at) + low) / width), F.floor((F.col(left_at) + low) / width) + 1)))
    b = right.withColumn("__bucket", F.floor(F.col(right_at) / width))
    return a.join(b, [*keys, "__bucket"]).where((F.col(right_at) - F.col(left_at)).between(low, high)).drop("__bucket")


def contained(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """JN21: points with ``covered``: whether any range of their key holds them."""
    own = points.withColumns({"__at": F.col(at), "__kind": F.lit(1), "__open": F.lit(0)})
    opened = ranges.where(F.col(start) <= F.col(end))
    ends = [opened.select(*keys, F.col(c).alias("__at"), F.lit(kind).alias("__kind"), F.lit(step).alias("__open")) for c, kind, step in ((start, 0, 1), (end, 2, -1))]
    rows = own.unionByName(ends[0], allowMissingColumns=True).unionByName(ends[1], allowMissingColumns=True)
    open_here = F.sum("__open").over(Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("covered", open_here > 0).where("__kind = 1").drop("__at", "__kind", "__open")


def greedy_matches(pairs: DataFrame, group: Sequence[str], score: str, left: str, right: str, first: str | None = None) -> DataFrame:
    """JN13: one-to-one matches of a group, the best score first, equals by left and right id.

    With ``first`` (JN12) left rows choose in turn, those of the highest ``first`` (a detection's confidence) before others, each the best
    that is free.  A group is one image or one chain of candidates, small by nature, and is walked in one Python call.
    """
    kind = pairs.select(*group, left, right, score, *([first] if first else [])).schema
    order = [(first, False), (left, True), (score, False), (right, True)] if first else [(score, False), (left, True), (right, True)]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c, _ in order], ascending=[up for _, up in order], kind="stable")
        used_l, used_r, keep = set(), set(), []
        for k, a, b in zip(zip(*(pdf[c] for c in group)), pdf[left], pdf[right]):
            ok = (k, a) not in used_l and (k, b) not in used_r
            keep.append(ok)
            if ok:
                used_l.add((k, a))
                used_r.add((k, b))
        return pdf[keep]

    return in_batches(pairs.select(*kind.names), group, walk, kind)


def in_batches(df: DataFrame, group: Sequence[str], f, kind) -> DataFrame:
    """Applies ``f`` to many small groups at a time, whole ones: a call for each group costs more than most groups' work.

    Rows are dealt out and sorted by group; a task takes an Arrow batch after the other and keeps back only the last group of each.
    """
    group = list(group)

    def run(batches):
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            last = b[group].eq(b[group].iloc[-1]) | (b[group].isna() & b[group].iloc[-1].isna())
            last = last.all(axis=1)
            if not last.all():
                yield f(b[~last].reset_index(drop=True))
            rest = b[last]
        if rest is not None and len(rest):
            yield f(rest.reset_index(drop=True))

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as small rows may stand for much work
    return df.repartition(n, *group).sortWithinPartitions(*group).mapInPandas(run, kind)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of an assignment of least total cost (shortest augmenting paths)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            row = c[owner[j0] - 1] - u[owner[j0]] - v[1:]
            free = ~used[1:]
            better = free & (row < least[1:])
            least[1:][better], way[1:][better] = row[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            step = least[j1]
            u[owner[used]] += step
            v[used] -= step
            least[1:][free] -= step
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def heaviest(left: Sequence, right: Sequence, worth: Sequence[float]) -> np.ndarray:
    """Which of the given pairs (each once) are in one-to-one matches of greatest total worth; only pairs worth more than nothing are.

    Shortest augmenting paths over the pairs alone: most rows can have what is worth most to them, and a path only goes where others claim the same.
    """
    near: dict = {}
    for k, (i, j, w) in enumerate(zip(left, right, worth)):
        if w > 0:
            near.setdefault(i, []).append((j, w, k))
    u, v, mate, owner = {i: max(w for _, w, _ in e) for i, e in near.items()}, {}, {}, {}
    waiting = []
    for i, edges in near.items():
        free = next(((j, k) for j, w, k in edges if w == u[i] and j not in owner), None)
        if free:
            mate[i], owner[free[0]] = free, i
        else:
            waiting.append(i)
    for start in waiting:
        at, settled, way, least = {start: 0.0}, {}, {}, {}
        heap, n = [(u[start], 0, None, start)], 0  # ends: a row that goes without, or a column that is free
        i, d = start, 0.0
        while True:
            for j, w, k in near[i]:
                if j not in settled:
                    far = d + max(0.0, u[i] + v.get(j, 0.0) - w)
                    if far < least.get(j, math.inf):
                        least[j], way[j], n = far, (i, k), n + 1
                        heapq.heappush(heap, (far, n, j, i))
            while True:
                far, _, j, via = heapq.heappop(heap)
                if j is None or (j not in settled and far == least[j]):
                    break
            if j is None or j not in owner:
                break
            settled[j] = far
            i, d = owner[j], far
            at[i], n = d, n + 1
            heapq.heappush(heap, (d + u[i], n, None, i))
        for i, d in at.items():
            u[i] -= far - d
        for c, d in settled.items():
            v[c] = v.get(c, 0.0) + far - d
        if j is None:  # ``via`` goes without, and its column is passed on
            if via == start:
                continue
            j = mate.pop(via)[0]
        while True:
            i, k = way[j]
            passed = mate.get(i)
            mate[i], owner[j] = (j, k), i
            if i == start:
                break
            j = passed[0]
    kept = np.zeros(len(worth), bool)
    kept[[k for _, k in mate.values()]] = True
    return kept


def heaviest_rows(pdf: pd.DataFrame, group: Sequence[str], left: str, right: str, worth: np.ndarray) -> np.ndarray:
    """``heaviest`` in many groups at once: pairs that share neither side with another are taken as they are."""
    within = pdf.groupby(list(group), sort=False, dropna=False).ngroup().to_numpy()
    a, b = (pd.Series(within).astype("int64") * (len(pdf) + 1) + pd.factorize(pdf[c])[0] for c in (left, right))
    kept = worth > 0
    shared = np.flatnonzero((a.duplicated(keep=False) | b.duplicated(keep=False)).to_numpy() & kept)
    kept[shared] = heaviest(a.to_numpy()[shared].tolist(), b.to_numpy()[shared].tolist(), worth[shared].tolist())
    return kept


def optimal_matches(pairs: DataFrame, group: Sequence[str], cost: str, left: str, right: str, gate: float) -> DataFrame:
    """JN16: of each group (a frame) the one-to-one matches of least total cost within the gate."""
    group = list(group)
    kind = pairs.select(*group, left, right, cost).schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.drop_duplicates([*group, left, right]).reset_index(drop=True)
        kept = heaviest_rows(first, group, left, right, gate * 1e3 - np.minimum(first[cost].to_numpy(float), gate * 1e3))
        return first[kept & (first[cost] <= gate)]

    return in_batches(pairs.select(*group, left, right, cost), group, solve, kind)


def heaviest_matches(pairs: DataFrame, group: Sequence[str], worth: str, left: str, right: str) -> DataFrame:
    """JN17: of each group (a sequence) the one-to-one matches of greatest total worth; pairs that aren't given are worth nothing.

    With fewer ids on one side than on the other, one of the first side only needs as many of its best pairs as there are ids on its side: of so many one is always free.
    A group is as large as the number of such pairs.
    """
    group = list(group)
    kind = pairs.select(*group, left, right, worth).schema
    pairs = _needed(pairs.select(*kind.names), group, worth, left, right)
    return in_batches(pairs.select(*kind.names), group, lambda pdf: pdf[heaviest_rows(pdf, group, left, right, pdf[worth].to_numpy(float))], kind)


def _needed(pairs: DataFrame, group: list[str], worth: str, left: str, right: str) -> DataFrame:
    """The pairs of which a heaviest one-to-one match can be made up."""
    sides = ((left, right), (right, left))
    for me, other in sides:
        n = pairs.select(*[F.col(k).alias(f"__{k}") for k in group], me).distinct().groupBy(*[f"__{k}" for k in group]).agg(F.count(F.lit(1)).alias("__n"))
        ranked = pairs.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, me).orderBy(F.desc(worth), other)))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in group], F.lit(True))
        pairs = ranked.join(n, same).where("__rank <= __n").select(*group, left, right, worth)
    return pairs


def near_another(asking: DataFrame, rows: DataFrame, keys: Sequence[str], frame: str, track: str, x: str, y: str, radius: float) -> DataFrame:
    """JN18: the asking rows with ``occluded``: whether another track's row of the same frame is nearer than the radius.

    All that is in one square is nearer than the radius, as squares are 0.7 of it wide.  Those that are alone in theirs, at most one track for a square, look into
    the squares around it.
    """
    cell = lambda c: F.floor(F.col(c) / (0.7 * radius))
    step = F.array(*map(F.lit, (-2, -1, 0, 1, 2)))
    there = rows.select(*keys, frame, F.col(track).alias("__t"), F.col(x).alias("__x"), F.col(y).alias("__y"), cell(x).alias("__i"), cell(y).alias("__j"))
    at = [*keys, frame, "__i", "__j"]
    crowd = there.groupBy(*at).agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    all_here = asking.select(*keys, frame, track, x, y).distinct().withColumn("__i", cell(x)).withColumn("__j", cell(y)).join(crowd, at, "left")
    beside = F.coalesce((F.col("__lo") != F.col(track)) | (F.col("__hi") != F.col(track)), F.lit(False))
    crowded = all_here.where(beside).select(*keys, frame, track, x, y)
    here = all_here.where(~beside).select(*keys, frame, track, x, y).withColumn("__di", F.explode(step)).withColumn("__dj", F.explode(step)).withColumn("__i", cell(x) + F.col("__di")).withColumn("__j", cell(y) + F.col("__dj"))
    apart = F.sqrt((F.col(x) - F.col("__x")) ** 2 + (F.col(y) - F.col("__y")) ** 2)
    hit = here.join(there, [*keys, frame, "__i", "__j"]).where((F.col(track) != F.col("__t")) & (apart < radius)).select(*keys, frame, track, x, y).distinct().unionByName(crowded)
    return asking.join(hit.withColumn("__hit", F.lit(True)), [*keys, frame, track, x, y], "left").withColumn("occluded", F.coalesce("__hit", F.lit(False))).drop("__hit")
