"""Quality of tracks against true ones: HOTA with its parts, MOTA and IDF1 (ML16).

Tracks and truth are boxes (frame, id, x, y, w, h) of sequences.  Boxes meet within a frame, and only pairs that overlap go on, so everything between two
identities is a count of the pairs that did meet: no table has a row for each two ids.  One-to-one matches are solved frame by frame, many frames in a Python call.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..sources.shared import checkpoint
from .joins import heaviest, heaviest_matches, heaviest_rows, in_batches
from .sequential import fold_batches

#: Overlaps at which tracks are scored, in hundredths: 5, 10, ... 95.
ALPHAS = tuple(range(5, 100, 5))
_BOX = ("x", "y", "w", "h")
_CLOSE = 1e-12


def overlapping(truth: DataFrame, tracks: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """``keys, frame, gt_id, track_id, iou`` of the boxes of a frame that overlap."""
    a = truth.select(*keys, frame, "gt_id", *[F.col(c).alias(f"__g{c}") for c in _BOX])
    b = tracks.select(*keys, frame, "track_id", *_BOX)
    both = a.join(b, [*keys, frame]).withColumn("iou", iou(tuple(f"__g{c}" for c in _BOX), _BOX))
    return both.where("iou > 0").select(*keys, frame, "gt_id", "track_id", "iou")


def meetings(pairs: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """``pairs`` with ``share``, a pair's overlap as a share of what either box overlaps in its frame, and ``alone``: neither box overlaps another."""
    by_gt, by_track = Window.partitionBy(*keys, frame, "gt_id"), Window.partitionBy(*keys, frame, "track_id")
    share = F.col("iou") / (F.sum("iou").over(by_gt) + F.sum("iou").over(by_track) - F.col("iou"))
    one = F.lit(1)
    return pairs.withColumns({"share": share, "alone": (F.count(one).over(by_gt) == 1) & (F.count(one).over(by_track) == 1)})


def sizes(rows: DataFrame, keys: Sequence[str], who: str, name: str) -> DataFrame:
    return rows.groupBy(*keys, who).agg(F.count(F.lit(1)).alias(name))


def alignment(pairs: DataFrame, truth: DataFrame, tracks: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """``keys, gt_id, track_id, aligned``: how well two identities agree over their whole lives, from 0 to 1.

    In each frame a pair counts its overlap as a share of what either box overlaps; the sum is set against the rows of both identities.
    """
    met = meetings(pairs, keys, frame).groupBy(*keys, "gt_id", "track_id").agg(F.sum("share").alias("__met"))
    met = met.join(sizes(truth, keys, "gt_id", "__ng"), [*keys, "gt_id"]).join(sizes(tracks, keys, "track_id", "__nt"), [*keys, "track_id"])
    return met.select(*keys, "gt_id", "track_id", (F.col("__met") / (F.col("__ng") + F.col("__nt") - F.col("__met"))).alias("aligned"))


def best_matches(met: DataFrame, truth: DataFrame, tracks: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """For each frame the one-to-one pairs with the greatest sum of alignment times overlap, of ``meetings``, with the rows of both identities (``n_gt, n_track``).

    Meetings are dealt out by person, which gives what two identities share without a table of them, then by track.  Those that are alone are matches; only others are solved.
    """
    met = met.repartition(*keys, "gt_id").withColumn("__met", F.sum("share").over(Window.partitionBy(*keys, "gt_id", "track_id")))
    met = met.join(sizes(truth, keys, "gt_id", "n_gt"), [*keys, "gt_id"]).join(sizes(tracks, keys, "track_id", "n_track"), [*keys, "track_id"])
    worth = met.withColumn("__worth", F.col("__met") / (F.col("n_gt") + F.col("n_track") - F.col("__met")) * F.col("iou"))
    out = [*keys, frame, "gt_id", "track_id", "iou", "n_gt", "n_track"]
    kind = worth.select(*out, "__worth").schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[heaviest_rows(pdf, [*keys, frame], "gt_id", "track_id", pdf["__worth"].to_numpy(float))]

    solved = in_batches(worth.where("not alone").select(*kind.names), [*keys, frame], solve, kind)
    return worth.where("alone and __worth > 0 and not isnan(__worth)").select(*out).unionByName(solved.select(*out))


def hota(truth: DataFrame, tracks: DataFrame, keys: Sequence[str], frame: str = "frame", met: DataFrame | None = None) -> DataFrame:
    """``keys, alpha, tp, fn, fp, det_a, ass_a, loc_a, hota`` of each sequence and overlap (``alpha`` in hundredths).

    ``ass_a`` is the mean over matches of the Jaccard index of their two identities: matches of the pair against rows of either.
    """
    keys = list(keys)
    met = meetings(overlapping(truth, tracks, keys, frame), keys, frame) if met is None else met
    matched = best_matches(met, truth, tracks, keys, frame)
    # 19 overlaps are columns of a pair, counted where its matches meet, so matches move once and only sums of sequences become a row for each overlap
    reach = F.floor((F.col("iou") + _CLOSE) * 100 / 5)
    levels = range(1, len(ALPHAS) + 1)
    of_pair = matched.select(*keys, frame, "gt_id", "track_id", "iou", "n_gt", "n_track", reach.alias("__reach")).where("__reach >= 1").repartition(*keys, "gt_id", "track_id")
    of_pair = of_pair.groupBy(*keys, "gt_id", "track_id").agg(
        F.first("n_gt").alias("__ng"), F.first("n_track").alias("__nt"),
        *[F.count(F.when(F.col("__reach") >= k, F.col(frame))).alias(f"__n{k}") for k in levels], *[F.sum(F.when(F.col("__reach") >= k, F.col("iou"))).alias(f"__iou{k}") for k in levels],
    )
    jaccard = {k: F.col(f"__n{k}") / (F.col("__ng") + F.col("__nt") - F.col(f"__n{k}")) for k in levels}
    sums = of_pair.groupBy(*keys).agg(*[f for k in levels for f in (F.sum(f"__n{k}").alias(f"__tp{k}"), F.sum(f"__iou{k}").alias(f"__iou{k}"), F.sum(F.col(f"__n{k}") * jaccard[k]).alias(f"__ass{k}"))])
    each = F.array(*[F.struct(F.lit(a).alias("alpha"), *[F.col(f"__{c}{k}").alias(c) for c in ("tp", "iou", "ass")]) for k, a in zip(levels, ALPHAS)])
    found = sums.select(*keys, F.explode(each).alias("__each")).select(*keys, "__each.alpha", "__each.tp", F.col("__each.iou").alias("__iou"), F.col("__each.ass").alias("__ass"))
    every = _totals(truth, tracks, keys).withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS))))
    rows = every.join(found, [*keys, "alpha"], "left").fillna(0, ["tp", "__iou", "__ass"])
    return rows.select(*keys, "alpha", "tp", (F.col("n_gt") - F.col("tp")).alias("fn"), (F.col("n_tracks") - F.col("tp")).alias("fp"), *_hota_shares(F.col("n_gt") + F.col("n_tracks") - F.col("tp")))


def _hota_shares(either) -> list:
    det, ass = F.coalesce(F.try_divide("tp", either), F.lit(0.0)), F.coalesce(F.try_divide("__ass", "tp"), F.lit(0.0))
    return [det.alias("det_a"), ass.alias("ass_a"), F.coalesce(F.try_divide("__iou", "tp"), F.lit(1.0)).alias("loc_a"), F.sqrt(det * ass).alias("hota")]


def _totals(truth: DataFrame, tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    a = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    b = tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tracks"))
    return a.join(b, list(keys), "full").fillna(0, ["n_gt", "n_tracks"])


def combined_hota(by_sequence: DataFrame) -> DataFrame:
    """All sequences as one, for each overlap: counts are summed, association is the mean over all matches."""
    rows = by_sequence.groupBy("alpha").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"), F.sum(F.col("ass_a") * F.col("tp")).alias("__ass"), F.sum(F.col("loc_a") * F.col("tp")).alias("__iou"))
    return rows.select("alpha", "tp", "fn", "fp", *_hota_shares(F.col("tp") + F.col("fn") + F.col("fp")))


def clear_counts(truth: DataFrame, tracks: DataFrame, keys: Sequence[str], frame: str = "frame", least: float = 0.5, pairs: DataFrame | None = None) -> DataFrame:
    """``keys, tp, fn, fp, switches, mota`` of each sequence at one overlap.

    Within a frame pairs that were matched in the last frame with boxes of both kinds come before all others, then more overlap; a switch is a match with another track
    than the person's last one.  Frames are folded in their order; what is carried is the last track of each person.
    """
    keys = list(keys)
    pairs = (overlapping(truth, tracks, keys, frame) if pairs is None else pairs).where(F.col("iou") >= least - _CLOSE)
    both = truth.select(*keys, frame).distinct().join(tracks.select(*keys, frame).distinct(), [*keys, frame])
    rows = both.join(pairs.select(*keys, frame, "gt_id", "track_id", "iou"), [*keys, frame], "left")  # frames with boxes of both kinds but no pair end what was matched before them
    kind = ", ".join(f"{k} {truth.schema[k].dataType.simpleString()}" for k in keys)

    def step(state: tuple, pdf: pd.DataFrame) -> tuple:
        last, before = state
        tp = switches = 0
        there = (pdf["gt_id"].notna() & pdf["track_id"].notna()).to_numpy()
        ends = np.flatnonzero(np.diff(pdf[frame].to_numpy(), append=np.nan) != 0) + 1
        people, tracks_, overlap, there = pdf["gt_id"].tolist(), pdf["track_id"].tolist(), pdf["iou"].tolist(), there.tolist()
        begin = 0
        for end in ends.tolist():
            g, t, m = people[begin:end], tracks_[begin:end], overlap[begin:end]
            if not there[begin]:
                now = {}
            elif len(set(g)) == len(set(t)) == len(g):
                now = dict(zip(g, t))
            else:
                kept = heaviest(g, t, [w + 1000.0 * (before.get(a) == b) for a, b, w in zip(g, t, m)])
                now = {a: b for a, b, k in zip(g, t, kept) if k}
            switches += sum(last.get(a, b) != b for a, b in now.items())
            tp += len(now)
            last.update(now)
            before, begin = now, end
        return (last, before), pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "tp": [tp], "switches": [switches]})

    found = fold_batches(rows, keys, [frame], lambda: ({}, {}), step, f"{kind}, tp bigint, switches bigint", whole=[frame])
    found = found.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("switches").alias("switches"))
    every = _totals(truth, tracks, keys).join(found, keys, "left").fillna(0, ["tp", "switches"])
    fn, fp = F.col("n_gt") - F.col("tp"), F.col("n_tracks") - F.col("tp")
    return every.select(*keys, "tp", fn.alias("fn"), fp.alias("fp"), "switches", F.try_divide(F.col("tp") - fp - F.col("switches"), F.col("n_gt")).alias("mota"))


def identity_scores(truth: DataFrame, tracks: DataFrame, keys: Sequence[str], frame: str = "frame", least: float = 0.5, pairs: DataFrame | None = None) -> DataFrame:
    """``keys, idtp, idf1``: rows explained by the best one-to-one naming of tracks by people."""
    keys = list(keys)
    met = (overlapping(truth, tracks, keys, frame) if pairs is None else pairs).where(F.col("iou") >= least - _CLOSE).groupBy(*keys, "gt_id", "track_id").agg(F.count(F.lit(1)).alias("n"))
    named = heaviest_matches(met, keys, "n", "gt_id", "track_id").groupBy(*keys).agg(F.sum("n").alias("idtp"))
    every = _totals(truth, tracks, keys).join(named, keys, "left").fillna(0, ["idtp"])
    return every.select(*keys, "idtp", F.try_divide(2 * F.col("idtp"), F.col("n_gt") + F.col("n_tracks")).alias("idf1"))


def tracker_report(truth: DataFrame, tracks: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """A row for each sequence: means over all overlaps of HOTA, DetA, AssA and LocA, then MOTA, switches and IDF1 at one half."""
    keys = list(keys)
    pairs = checkpoint(meetings(overlapping(truth, tracks, keys, frame), keys, frame))
    mean = hota(truth, tracks, keys, frame, pairs).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("hota", "det_a", "ass_a", "loc_a")])
    return mean.join(clear_counts(truth, tracks, keys, frame, pairs=pairs).select(*keys, "mota", "switches"), keys).join(identity_scores(truth, tracks, keys, frame, pairs=pairs).select(*keys, "idf1"), keys)
