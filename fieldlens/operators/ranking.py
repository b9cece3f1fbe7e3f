"""Orders, top rows and reports (TK1-TK7, AG13, AG18, AG21, AG23-AG26, AG31-AG35, SO4, ML4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordered


def most_tracked(positions: DataFrame, n: int = 4, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """TK1: of each sequence the ``n`` tracks with the most rows, equals by id."""
    counts = positions.groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "track_id")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def best_moments(moments: DataFrame, n: int = 8, by: str = "confidence") -> DataFrame:
    """TK2, TK7: the ``n`` moments of highest ``by`` over all sequences, listed by sequence and start."""
    return moments.orderBy(F.desc(by), "seq", "start").limit(n).orderBy("seq", "start")


def moments_of_tracks(moments: DataFrame) -> DataFrame:
    """TK3: ``place`` of each moment in its track by strength, and of its track by the number of moments."""
    own = Window.partitionBy("seq", "track_id")
    rows = moments.withColumn("place", F.row_number().over(own.orderBy(F.desc("strength"), "start")).cast("bigint")).withColumn("n_moments", F.count(F.lit(1)).over(own))
    return rows.withColumn("track_place", F.dense_rank().over(Window.partitionBy("seq").orderBy(F.desc("n_moments"), "track_id")).cast("bigint"))


def reel_order(clips: DataFrame, keys: Sequence[str], kind: str | None = None) -> DataFrame:
    """TK4: ``no`` of each clip in its reel: the strongest first; with ``kind`` involvement before presence."""
    first = [(F.col(kind) != "involvement").cast("int")] if kind else []
    return clips.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy(*first, F.desc("strength"), "start")).cast("bigint"))


def largest_reel(reels: DataFrame, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """TK5: the reel with the most clips, the first of equals."""
    return reels.groupBy(*keys).agg(F.max_by("track_id", F.struct("n_clips", -F.col("track_id"))).alias("track_id"), F.max("n_clips").alias("n_clips"))


def detector_report(detections: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG23: of all frames those with a ball and with several, in percent; players a frame; mean and quantiles of the ball's confidence."""
    ball = F.col("cls") == "ball"
    per = detections.groupBy(*keys, "frame").agg(F.count_if(ball).alias("balls"), F.count_if(~ball).alias("players"))
    rows = frames.join(per, [*keys, "frame"], "left").fillna(0, ["balls", "players"])
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), (100.0 * F.avg((F.col("balls") > 0).cast("double"))).alias("ball_pct"), (100.0 * F.avg((F.col("balls") > 1).cast("double"))).alias("multi_pct"), F.avg("players").alias("players_per_frame"))
    conf = detections.where(ball).groupBy(*keys).agg(F.avg("conf").alias("conf_mean"), *[F.expr(f"percentile(conf, {q})").alias(f"conf_p{int(100 * q)}") for q in (0.1, 0.5, 0.9)])
    return out.join(conf, [*keys], "left")


def class_counts(labels: DataFrame, group: str = "cls") -> DataFrame:
    """AG24: labels of each class."""
    return labels.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def without_labels(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """AG24: the images that no label belongs to."""
    return images.join(labels.select(key).distinct(), key, "left_anti")


def vote_map(rows: DataFrame, track: str, cluster: str, dist: str) -> DataFrame:
    """AG13: votes of each track by cluster, in the order of the clusters, and the median distance."""
    counts = rows.groupBy(track, cluster).agg(F.count(F.lit(1)).alias("__n"))
    votes = counts.groupBy(track).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(cluster, "__n"))), lambda s: F.concat(s[cluster].cast("string"), F.lit(":"), s["__n"].cast("string"))), ",").alias("votes"))
    return votes.join(rows.groupBy(track).agg(F.expr(f"percentile({dist}, 0.5)").alias("median_dist")), track)


def detections_per_frame(positions: DataFrame, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """AG18: mean number of rows in the frames that have any."""
    return positions.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys).agg(F.avg("__n").alias("per_frame"), F.count(F.lit(1)).alias("n_frames"))


def discrimination(involved: DataFrame, substantial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG21: how well an idea of involvement tells players apart: part of the substantial tracks involved, players in a frame that has any, share of the three most involved."""
    per = involved.groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("__n"))
    ranked = per.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__n"), "track_id")))
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_involved"), (F.sum(F.when(F.col("__r") <= 3, F.col("__n")).otherwise(0)) / F.sum("__n")).alias("top3_share"))
    frames = involved.groupBy(*keys).agg((F.count(F.lit(1)) / F.countDistinct("frame")).alias("players_per_frame"))
    known = substantial.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_substantial"))
    rows = known.join(out, [*keys], "left").join(frames, [*keys], "left").fillna(0, ["n_involved", "top3_share", "players_per_frame"])
    return rows.withColumn("involved_fraction", F.col("n_involved") / F.greatest(F.lit(1), "n_substantial"))


def compare_definitions(reports: DataFrame) -> DataFrame:
    """AG35: means of the discrimination reports of each ``mode`` over sequences, and totals."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("involved_fraction", "players_per_frame", "top3_share")]
    return reports.groupBy("mode").agg(*means, F.sum("n_substantial").alias("total_substantial"), F.sum("n_involved").alias("total_involved"))


def with_total(rows: DataFrame, key: str, part: str, whole: str) -> DataFrame:
    """AG31, AG34: sums of each key and of all (key null), with the part in percent."""
    out = rows.rollup(key).agg(F.sum(part).alias(part), F.sum(whole).alias(whole))
    return out.withColumn("pct", 100.0 * F.col(part) / F.greatest(F.lit(1), whole))


def plausibility(ball: DataFrame, keys: Sequence[str], width: float, height: float, gate: float) -> DataFrame:
    """AG26: seen and provided parts of all frames and the lift, provided places inside the picture, and steps beyond the gate among frames that follow each other."""
    given = F.col("status").isin("detected", "predicted")
    w = ordered(keys, "frame")
    after = given & (F.lag("frame").over(w) == F.col("frame") - 1) & F.lag(given).over(w)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    rows = ball.withColumn("__step", F.when(after, F.sqrt(dx * dx + dy * dy)))
    inside = F.col("x").between(0, width) & F.col("y").between(0, height)
    out = rows.groupBy(*keys).agg(F.avg((F.col("status") == "detected").cast("double")).alias("raw_rate"), F.avg(given.cast("double")).alias("provided_rate"), F.avg(F.when(given, inside.cast("double"))).alias("in_frame_rate"), F.coalesce(F.avg((F.col("__step") > gate).cast("double")), F.lit(0.0)).alias("teleport_fraction"))
    return out.withColumn("lift", F.col("provided_rate") - F.col("raw_rate"))


def file_counts(files: DataFrame, path: str) -> DataFrame:
    """AG32: files by extension and by folder at the top (``what``), and those that look like annotations of a ball."""
    ext, top = F.regexp_extract(path, r"(\.[^./]+)$", 1), F.element_at(F.split(path, "/"), 1)
    looks = F.lower(F.col(path)).rlike("ball|annot|traj|label")
    each = files.select(looks.alias("looks"), F.explode(F.array(F.struct(F.lit("extension").alias("what"), ext.alias("name")), F.struct(F.lit("folder").alias("what"), top.alias("name")))).alias("s"))
    return each.select("looks", "s.*").groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if("looks").alias("n_candidates"))


def keyword_counts(texts: DataFrame, key: str, text: str, words: Sequence[str], any_of: Sequence[str]) -> DataFrame:
    """AG33: how often each word occurs in a text, whatever its case, and whether any of some does."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    times = {w: ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("bigint") for w in words}
    out = texts.select(key, *[c.alias(f"n_{w}") for w, c in times.items()])
    return out.withColumn("present", sum((F.col(f"n_{w}") for w in any_of), F.lit(0)) > 0)


def covered_frames(truth: DataFrame, provided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SO4: the frames that both have."""
    return truth.select(*keys).intersect(provided.select(*keys))


def team_of_cluster(rows: DataFrame, cluster: str, brightness: str) -> DataFrame:
    """ML4: the cluster of the highest mean brightness is TeamA, the least of equals; the others are TeamB."""
    mean = rows.groupBy(cluster).agg(F.avg(brightness).alias("mean"))
    best = mean.agg(F.max_by(cluster, F.struct("mean", -F.col(cluster))).alias("__best"))
    return mean.join(best).select(cluster, "mean", F.when(F.col(cluster) == F.col("__best"), "TeamA").otherwise("TeamB").alias("team"))


def trimmed_mean(rows: DataFrame, keys: Sequence[str], channels: Sequence[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """ML13: mean of each channel over the rows that lie between both quantiles in all channels; over all rows where there are none."""
    cuts = rows.groupBy(*keys).agg(*[F.expr(f"percentile({c}, {q})").alias(f"__{n}_{c}") for c in channels for n, q in (("lo", low), ("hi", high))])
    ok = None
    for c in channels:
        own = F.col(c).between(F.col(f"__lo_{c}"), F.col(f"__hi_{c}"))
        ok = own if ok is None else ok & own
    joined = rows.join(cuts, [*keys]).withColumn("__ok", ok)
    return joined.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(F.col("__ok"), F.col(c))), F.avg(c)).alias(c) for c in channels], F.count_if("__ok").alias("n_inside"))


def per_class(rows: DataFrame, predicted: str, truth: str, excluded: Column | None = None) -> DataFrame:
    """ML5: how many of each true class were named so, and the part of them that was left out."""
    left_out = excluded if excluded is not None else F.lit(False)
    return rows.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(predicted) == F.col(truth)).cast("double")).alias("recall"), F.avg(left_out.cast("double")).alias("excluded"))


def best_cut(rows: DataFrame, score: str, truth: str, steps: int = 80) -> DataFrame:
    """ML10: of ``steps`` even thresholds between the least and the highest score the first with the best mean of recall and rejection."""
    ends = rows.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))  # one row
    cuts = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.col("__lo") + (F.col("__hi") - F.col("__lo")) * k / (steps - 1))
    own = rows.crossJoin(ends).select(F.size(F.filter(cuts, lambda t: t <= F.col(score))).alias("__passed"), (F.col(truth) == 1).alias("__y"))
    counts = own.groupBy("__passed").agg(F.count_if("__y").alias("__pos"), F.count_if(~F.col("__y")).alias("__neg"))  # a row for each threshold at most
    all_cuts = ends.select(F.posexplode(cuts).alias("__k", "threshold"))
    got = all_cuts.join(counts, F.lit(True)).groupBy("__k", "threshold").agg(
        F.try_divide(F.sum(F.when(F.col("__passed") > F.col("__k"), F.col("__pos")).otherwise(0)), F.sum("__pos")).alias("recall"),
        F.try_divide(F.sum(F.when(F.col("__passed") <= F.col("__k"), F.col("__neg")).otherwise(0)), F.sum("__neg")).alias("reject"),
    )
    return got.where("recall is not null and reject is not null").withColumn("balance", (F.col("recall") + F.col("reject")) / 2).orderBy(F.desc("balance"), "threshold").limit(1).drop("__k")


def mean_average_precision(per_class: DataFrame) -> DataFrame:
    """ML7: mean over the classes that occur."""
    return per_class.agg(F.avg("ap").alias("map"), F.count(F.lit(1)).alias("n_classes"))
