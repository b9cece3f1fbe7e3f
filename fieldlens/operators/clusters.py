"""Clusters and principal directions of vectors (ML1, ML3, ML10)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dot
from .joins import in_batches
from .sequential import schema_of


def kmeans(x: np.ndarray, k: int, restarts: int, rounds: int, tolerance: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, centres and inertia of the best of some starts by k-means++; clusters are named in the order of their first rows."""
    best: tuple | None = None
    for _ in range(restarts):
        centres = x[rng.integers(len(x))][None]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
            centres = np.append(centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))][None], 0)
        for _ in range(rounds):
            label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            moved = np.stack([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
            done = ((moved - centres) ** 2).sum() <= tolerance**2
            centres = moved
            if done:
                break
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        inertia = float(d.min(1).sum())
        if best is None or inertia < best[2] * (1 - 1e-12):
            best = (d.argmin(1), centres, inertia)
    label, centres, inertia = best
    order = list(dict.fromkeys([*label.tolist(), *range(k)]))
    return np.argsort(order)[label], centres[order], inertia


def kmeans_by_group(rows: DataFrame, keys: Sequence[str], row_id: str, vector: str, k: int = 2, restarts: int = 10, rounds: int = 50, tolerance: float = 1e-4, seed: int = 42) -> DataFrame:
    """ML1: ``keys, row_id, cluster, dist, inertia`` for the vectors of each group (a clip): k-means by k-means++ with restarts.

    A clip's vectors are a group of bounded size, and many clips are clustered in a Python call.  Random numbers follow from the seed and the group's keys, and rows are
    taken by ``row_id``, so results don't depend on partitions.  Groups of fewer than ``k`` rows have a cluster for each row; null vectors are left out.
    """
    keys = list(keys)
    kind = f"{schema_of(rows, [*keys, row_id])}, cluster bigint, dist double, inertia double"
    seeded = rows.where(F.col(vector).isNotNull()).select(*keys, row_id, F.col(vector).cast("array<double>").alias("__v"), F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(2**31)).alias("__seed"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(keys, sort=False, dropna=False):
            g = g.sort_values(row_id)
            x = np.stack(g["__v"].to_list()).astype(float)
            label, centres, inertia = kmeans(x, min(k, len(x)), restarts, rounds, tolerance, np.random.default_rng(int(g["__seed"].iloc[0])))
            out.append(g[[*keys, row_id]].assign(cluster=label, dist=np.sqrt(((x - centres[label]) ** 2).sum(1)), inertia=inertia))
        return pd.concat(out) if out else pdf[[*keys, row_id]].assign(cluster=0, dist=0.0, inertia=0.0)

    return in_batches(seeded, keys, each, kind)


def gram(rows: DataFrame, vector: str) -> DataFrame:
    """``i, j, value``: sums of products of the centred components, from one pass; ``i <= j``.

    A task sends its sums of components and of their products, ``(d + 1) ** 2`` numbers whatever its rows; null vectors are left out.
    """

    def run(batches):
        total = None
        for b in batches:
            if len(b):
                flat = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                x = np.hstack([flat, np.ones((len(b), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j]), pa.array(np.full(len(i), len(total) - 1, np.int32))], ["i", "j", "s", "d"])

    sums = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "i int, j int, s double, d int").groupBy("i", "j", "d").agg(F.sum("s").alias("s"))
    ends = sums.where("j = d").select(F.col("i").alias("at"), F.col("s").alias("of"))  # the components' sums, and the number of rows
    n = sums.where("i = d").select(F.col("s").alias("n"))  # one row
    inner = sums.where("j < d")
    inner = inner.join(ends.select(F.col("at").alias("i"), F.col("of").alias("si")), "i").join(ends.select(F.col("at").alias("j"), F.col("of").alias("sj")), "j").join(n)
    return inner.select("i", "j", (F.col("s") - F.col("si") * F.col("sj") / F.col("n")).alias("value"), F.lit(0).alias("__")).drop("__")


def means(rows: DataFrame, vector: str, where: Column | None = None) -> list[float]:
    """The mean of each component, in order; a row for each component comes to the driver."""
    some = rows if where is None else rows.where(where)
    got = some.where(F.col(vector).isNotNull()).select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()
    return [r.m for r in sorted(got)]


def principal(rows: DataFrame, vector: str, k: int) -> tuple[list[float], list[list[float]], list[float]]:
    """ML3: mean, the ``k`` directions of greatest variance, and their shares of the squares; a direction's largest component is positive."""
    centre = means(rows, vector)
    g = np.zeros((len(centre), len(centre)))
    for r in gram(rows, vector).collect():  # a number for each two components
        g[r.i, r.j] = g[r.j, r.i] = r.value
    value, direction = np.linalg.eigh(g)
    value, direction = value[::-1][:k], direction[:, ::-1][:, :k]
    direction = direction * np.sign(direction[np.abs(direction).argmax(0), np.arange(direction.shape[1])])
    return centre, direction.T.tolist(), value.tolist()


def projected(vector: str, centre: Sequence[float], directions: Sequence[Sequence[float]]) -> Column:
    """ML3: coordinates of a vector along the directions."""
    shifted = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(c)) for c in centre]), lambda x, c: x - c)
    return F.element_at(F.transform(F.array(shifted), lambda s: F.array(*[F.aggregate(F.zip_with(s, F.array(*[F.lit(float(x)) for x in d]), lambda a, b: a * b), F.lit(0.0), lambda t, p: t + p) for d in directions])), 1)


def sure_anchor(rows: DataFrame, vector: str, sure: Column) -> list[float]:
    """ML10: the mean vector of the rows that are sure, scaled to length 1."""
    m = np.array(means(rows, vector, sure))
    return (m / (np.linalg.norm(m) + 1e-8)).tolist()


def to_anchor(vector: str, anchor: Sequence[float]) -> Column:
    """ML10: how far a vector points along the anchor."""
    return dot(vector, F.array(*[F.lit(float(x)) for x in anchor]))
