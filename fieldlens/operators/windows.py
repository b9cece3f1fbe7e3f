"""Time-series operators over sequences of frames (WN1-WN18, WN23).

All take the key columns of a sequence and its order; a plan that chains them shuffles and sorts once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import checkpoint


def ordered(keys: Sequence[str], order: Sequence[str] | str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def edge_moving_average(v: Column, w: WindowSpec, k: int) -> Column:
    """WN1: mean of the 2k+1 values about a row, the ends continued by the first and last value."""
    if k < 1:
        return v
    near = w.rowsBetween(-k, k)
    before, after = F.count(F.lit(1)).over(w.rowsBetween(-k, -1)), F.count(F.lit(1)).over(w.rowsBetween(1, k))
    return (F.sum(v).over(near) + (k - before) * F.first(v).over(whole(w)) + (k - after) * F.last(v).over(whole(w))) / (2 * k + 1)


def gradient(v: Column, w: WindowSpec) -> Column:
    """WN2: central differences, one-sided at the ends, 0 for a single row."""
    nxt, prv = F.lead(v).over(w), F.lag(v).over(w)
    return F.coalesce((nxt - prv) / 2, nxt - v, v - prv, F.lit(0.0))


def reversed_order(keys: Sequence[str], order: str) -> WindowSpec:
    """What comes after a row comes before it here: frames that begin at the first row are kept up from row to row."""
    return Window.partitionBy(*keys).orderBy(F.desc(order))


def interpolate(v: Column, i: Column, keys: Sequence[str], order: str) -> Column:
    """WN3: linear over gaps, held at the ends; 0 if nothing is known."""
    at = F.when(v.isNotNull(), i)
    past, future = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (ordered(keys, order), reversed_order(keys, order)))
    v0, i0 = F.last(v, True).over(past), F.last(at, True).over(past)
    v1, i1 = F.last(v, True).over(future), F.last(at, True).over(future)
    inside = v0 + (v1 - v0) * (i - i0) / F.nullif(i1 - i0, F.lit(0))
    return F.coalesce(v, inside, v0, v1, F.lit(0.0))


def majority(code: Column, w: WindowSpec, k: int) -> Column:
    """WN5: the more frequent of the codes 1 and 2 about a row, 1 on ties, 0 if there is neither."""
    near = w.rowsBetween(-k, k)
    a, b = F.count(F.when(code == 1, 1)).over(near), F.count(F.when(code == 2, 1)).over(near)
    return F.when(a + b == 0, 0).when(a >= b, 1).otherwise(2)


def flips(code: Column, w: WindowSpec) -> Column:
    """WN6: a code other than 0 that differs from the last such code."""
    last = F.last(F.nullif(code, F.lit(0)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce((code != 0) & (code != last), F.lit(False))


def islands(df: DataFrame, keys: Sequence[str], order: str, bridge: int, min_len: int = 1, extra: Sequence[Column] = ()) -> DataFrame:
    """WN8: runs of ``order`` values that follow each other by at most ``bridge``: start, end, n_rows and the ``extra`` aggregates.

    WN7, runs of a mask over gapless frames that bridge ``max_gap`` false ones, is the same over the true rows with
    ``bridge = max_gap + 1``.  Runs shorter than ``min_len`` (end - start + 1) go.
    """
    w = ordered(keys, order)
    marked = df.withColumn("__new", F.coalesce((F.col(order) - F.lag(order).over(w) > bridge).cast("int"), F.lit(1)))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, "__run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n_rows"), *extra)
    return runs.where(F.col("end") - F.col("start") + 1 >= min_len).drop("__run")


def longest(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """WN9: the longest run of each key, the first of equals."""
    best = F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("__best")
    return runs.groupBy(*keys).agg(best).select(*keys, "__best.start", "__best.end")


def longest_streak(df: DataFrame, keys: Sequence[str], order: str, mask: Column) -> DataFrame:
    """WN11: the most rows in a row for which ``mask`` holds, 0 if it never does."""
    w = ordered(keys, order)
    rows = df.withColumn("__mask", mask).withColumn("__n", F.row_number().over(w))
    rows = rows.withColumn("__at", F.when(F.col("__mask"), F.col("__n") - F.count(F.when(F.col("__mask"), 1)).over(w)))
    streaks = rows.groupBy(*keys, "__at").agg(F.count(F.lit(1)).alias("__len"))
    return streaks.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__at").isNotNull(), F.col("__len"))), F.lit(0)).alias("longest_streak"))


def since(flag: Column, i: Column, w: WindowSpec) -> Column:
    """Rows since ``flag`` last held; null before it first does."""
    return i - F.last(F.when(flag, i), True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def endpoint_velocity(v: Column, n: Column, at: Column, w: WindowSpec, k: int, dt: float) -> Column:
    """WN17: slope over the last ``k`` samples or fewer; ``at`` and ``n`` are a row's number and the number of rows."""
    steps = F.least(F.lit(k), n) - 1
    past = [F.lag(v, s).over(w) for s in range(1, k)]
    first = F.coalesce(*[F.when(steps == s, past[s - 1]) for s in range(1, k)]) if k > 1 else v
    return F.when(steps < 1, 0.0).otherwise((v - first) / (steps * dt))


def held(v: Column, w: WindowSpec) -> Column:
    """The last value that is known, up to this row."""
    return F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def differences(v: Column, w: WindowSpec, n: int) -> Column:
    """WN18: the ``n``-th difference between rows: 1 is velocity, 2 acceleration, 3 jerk."""
    out = None
    for k in range(n + 1):  # binomial weights
        weight = (-1) ** k * math.comb(n, k)
        term = weight * (v if k == 0 else F.lag(v, k).over(w))
        out = term if out is None else out + term
    return out


def dead_where_missing(v: Column, known: Column) -> Column:
    """WN4: a smoothed value, 0 where nothing was measured; applied after smoothing."""
    return F.when(known, v).otherwise(0.0)


def jumps(df: DataFrame, keys: Sequence[str], frame: str, conf: str, x: str, y: str) -> DataFrame:
    """WN10: how far the most confident detection moves between frames that follow each other."""
    best = df.groupBy(*keys, frame).agg(F.max_by(F.struct(x, y), F.struct(conf, F.negative(x), F.negative(y))).alias("p"))
    # frames meet in stretches, to which the last frame before them comes along: no task has all frames of a key
    stretch = lambda c: F.floor(c / 4096)
    best = best.withColumn("__at", F.explode(F.array_distinct(F.array(stretch(F.col(frame)), stretch(F.col(frame) + 1)))))
    w = ordered([*keys, "__at"], frame)
    dx, dy = (F.col(f"p.{c}") - F.lag(F.col(f"p.{c}")).over(w) for c in (x, y))
    follows = F.col(frame) - F.lag(frame).over(w) == 1
    return best.withColumn("jump", F.when(follows, F.sqrt(dx * dx + dy * dy))).where("jump is not null").select(*keys, frame, "jump")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, parts: dict[str, float]) -> DataFrame:
    """``keys, n`` and, named as in ``parts``, exact percentiles (linear between two values) of the values that are known.

    Different values are dealt out by range and ranked in their ranges, so no task or aggregate has all values of a key.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    counted = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    rows = checkpoint(counted.repartitionByRange(*own, "__v").withColumn("__part", F.spark_partition_id()))
    sizes = rows.groupBy(*own, "__part").agg(F.sum("__n").alias("__here"))  # a row for each partition of a key
    w = Window.partitionBy(*own)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__here").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("__here").over(w))
    sizes = sizes.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], F.col("__part").alias("__p"), "__before", "n")
    same = F.col("__part") == F.col("__p")
    for k, o in zip(keys, own):
        same = same & F.col(o).eqNullSafe(F.col(k))
    last = F.sum("__n").over(Window.partitionBy(*own, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumn("__last", last).join(sizes, same).withColumn("__last", F.col("__last") + F.col("__before"))

    def at(place: Column) -> Column:
        return F.max(F.when((place < F.col("__last")) & (place >= F.col("__last") - F.col("__n")), F.col("__v")))

    found = {}
    for name, part in parts.items():
        place = (F.col("n") - 1) * part
        found |= {f"__{name}0": at(F.floor(place)), f"__{name}1": at(F.ceil(place))}
    out = ranked.groupBy(*keys, "n").agg(*[c.alias(k) for k, c in found.items()])
    place = {name: (F.col("n") - 1) * part for name, part in parts.items()}
    low, high = ({name: F.col(f"__{name}{i}") for name in parts} for i in (0, 1))
    between = {name: F.when(low[name] == high[name], low[name]).otherwise((F.ceil(p) - p) * low[name] + (p - F.floor(p)) * high[name]) for name, p in place.items()}
    return out.select(*keys, "n", *[c.alias(name) for name, c in between.items()])


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Gapless numbers from 1 over a whole table in order: ranges are numbered in their partitions and moved on by the rows of those before."""
    rows = checkpoint(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.join(before, "__part").withColumn(name, (own + F.col("__before")).cast("bigint")).drop("__part", "__before")
