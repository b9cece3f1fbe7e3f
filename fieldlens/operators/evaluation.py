"""Quality of detections, classifiers and camera paths (ML5-ML19, AG26-AG28, JN11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cosine, distance, dot, iou


def best_overlaps(pred: DataFrame, truth: DataFrame, keys: Sequence[str], least: float = 0.5) -> DataFrame:
    """JN11: for each prediction (det_id, x, y, w, h) of a frame and class the true box it overlaps most, at least ``least``."""
    b = truth.select(*keys, *[F.col(c).alias(f"g_{c}") for c in ("det_id", "x", "y", "w", "h")])
    pairs = pred.join(b, list(keys)).withColumn("iou", iou(("x", "y", "w", "h"), ("g_x", "g_y", "g_w", "g_h"))).where(F.col("iou") >= least)
    w = Window.partitionBy(*keys, "det_id").orderBy(F.desc("iou"), "g_det_id")
    return pairs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def precision_recall(rows: DataFrame, score: str, truth: str, threshold: float, group: Sequence[str] = ()) -> DataFrame:
    """ML6: precision, recall, F1 and the counts at a threshold; null where there is nothing to divide by."""
    hit = F.col(score) >= threshold
    tp, fp, fn = F.count_if(hit & (F.col(truth) == 1)), F.count_if(hit & (F.col(truth) == 0)), F.count_if(~hit & (F.col(truth) == 1))
    out = rows.groupBy(*group).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def average_precision(rows: DataFrame, score: str, truth: str, group: str, tie: str) -> DataFrame:
    """ML7: 11-point average precision of each class that has any true row; equal scores go by ``tie``."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    total = F.sum(truth).over(Window.partitionBy(group))
    curve = rows.withColumn("__tp", F.sum(truth).over(w)).withColumn("__n", F.row_number().over(w)).withColumn("__all", total).where("__all > 0")
    curve = curve.select(group, (F.col("__tp") / F.col("__n")).alias("__p"), (F.col("__tp") / F.col("__all")).alias("__r"))
    at = [F.coalesce(F.max(F.when(F.col("__r") >= t / 10, F.col("__p"))), F.lit(0.0)) for t in range(11)]
    return curve.groupBy(group).agg((sum(at[1:], at[0]) / 11).alias("ap"))


def tune_threshold(rows: DataFrame, score: str, truth: str, most_rejected: float = 0.05, grid: Sequence[float] = tuple(i / 100 for i in range(1, 96))) -> DataFrame:
    """ML9: the highest threshold that rejects at most that share of the true rows, and what it rejects of the others."""
    n1, n0 = F.count_if(F.col(truth) == 1), F.count_if(F.col(truth) == 0)
    out = rows.select(score, truth, F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold"))
    out = out.groupBy("threshold").agg(F.try_divide(F.count_if((F.col(truth) == 1) & (F.col(score) < F.col("threshold"))), n1).alias("false_reject"), F.try_divide(F.count_if((F.col(truth) == 0) & (F.col(score) < F.col("threshold"))), n0).alias("true_reject"))
    return out.where(F.col("false_reject") <= most_rejected).orderBy(F.desc("threshold")).limit(1)


def filter_quality(rows: DataFrame, kept: Column, kind: str, good: str, bad: Sequence[str]) -> DataFrame:
    """ML19: share of the good that is kept and of each bad kind that is rejected, and the precision; null for what doesn't occur."""
    keep = kept.cast("double")
    out = [F.avg(F.when(F.col(kind) == good, keep)).alias("recall"), F.avg(F.when(kept, (F.col(kind) == good).cast("double"))).alias("precision")]
    return rows.agg(*out, *[F.avg(F.when(F.col(kind) == b, 1 - keep)).alias(f"reject_{b}") for b in bad])


def anchor_similarity(rows: DataFrame, vector: str, anchor: Column) -> Column:
    """ML10: cosine to an anchor vector."""
    return cosine(vector, anchor)


def appearance_score(vector: str, weights: Sequence[float], bias: float) -> Column:
    """ML11: logistic score of a vector."""
    return 1 / (1 + F.exp(-(dot(vector, F.array(*[F.lit(float(w)) for w in weights])) + bias)))


def train_probe(rows: DataFrame, vector: str, truth: str, decay: float = 1e-3, rounds: int = 300) -> tuple[list[float], float]:
    """ML8: weights and bias of a logistic model of the vectors for ``appearance_score``, with a penalty on the weights' squares; rows with a null don't train."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    train = rows.where(F.col(vector).isNotNull() & F.col(truth).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(truth).cast("double").alias("label"))
    model = LogisticRegression(regParam=decay, maxIter=rounds, standardization=False, family="binomial").fit(train)
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def rmse_by_status(track: DataFrame, truth: DataFrame, keys: Sequence[str], within: float) -> DataFrame:
    """AG27: root mean squared error, count and share within a tolerance for each status."""
    rows = track.join(truth.select(*keys, F.col("x").alias("gx"), F.col("y").alias("gy")), list(keys)).withColumn("__d", distance("x", "y", "gx", "gy")).where("__d is not null")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("rmse"), F.avg((F.col("__d") <= within).cast("double")).alias("within"))


def label_validation(labels: DataFrame, manifest: DataFrame, roles: DataFrame) -> DataFrame:
    """JN23: hand labels (idx, hand) of crops (idx, seq, track_id) against the roles of their tracks (seq, track_id, role), as one row.

    Teams are scored under the better of both namings.  Besides: labels in all and with a track that has an entry, crops of the teams that a role leaves out, and others that it
    rightly does; null for what doesn't occur.
    """
    pairs = labels.join(manifest, "idx").join(roles, ["seq", "track_id"]).select("hand", "role")
    team = F.col("hand").isin("A", "B")
    scored = team & F.coalesce(F.col("role").isin("TeamA", "TeamB"), F.lit(False))
    direct = (F.col("hand") == "A") == (F.col("role") == "TeamA")
    out_of_play = F.coalesce(F.col("role").isin("Referee", "Excluded"), F.lit(False)).cast("double")

    def share(mask: Column, value: Column) -> Column:
        return F.avg(F.when(mask, value.cast("double")))

    counts = pairs.agg(
        F.count(F.lit(1)).alias("n_matched"), F.count_if(scored).alias("n_scored"), share(scored, direct).alias("accuracy_direct"),
        share(scored & (F.col("hand") == "A"), direct).alias("__a"), share(scored & (F.col("hand") == "B"), direct).alias("__b"),
        share(team, out_of_play).alias("team_excluded"), share(F.col("hand").isin("ref", "bench"), out_of_play).alias("others_excluded"),
    )
    named = F.col("accuracy_direct") >= 1 - F.col("accuracy_direct")
    best = {f"accuracy_{k}": F.when(named, F.col(f"__{k}")).otherwise(1 - F.col(f"__{k}")) for k in "ab"}
    total = labels.agg(F.count(F.lit(1)).alias("n_labelled"))
    rows = total.join(counts)  # one row each
    return rows.select("n_labelled", "n_matched", "n_scored", "accuracy_direct", (1 - F.col("accuracy_direct")).alias("accuracy_swapped"), F.greatest(F.col("accuracy_direct"), 1 - F.col("accuracy_direct")).alias("accuracy"), *[c.alias(k) for k, c in best.items()], "team_excluded", "others_excluded")


def expand_grid(grid: dict[str, list], mode: str) -> list[dict]:
    """ML17: ``full``: all combinations; ``oat``: the first of each, then one changed at a time."""
    if mode == "full":
        out: list[dict] = [{}]
        for k in sorted(grid):
            out = [{**o, k: v} for o in out for v in grid[k]]
        return out
    base = {k: v[0] for k, v in sorted(grid.items())}
    return [base, *({**base, k: v} for k in sorted(grid) for v in grid[k][1:])]


def config_tag(config: Column) -> Column:
    """PRJ23: a map's keys and values in order, ``default`` if it is empty."""
    parts = F.array_sort(F.transform(F.map_entries(config), lambda e: F.concat(e["key"], e["value"])))
    return F.when(F.size(parts) > 0, F.array_join(parts, "_")).otherwise("default")
