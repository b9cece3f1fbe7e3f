"""Event detectors over frame features, and moments (EV1-EV17, FD7).

Features are one row for each sequence and frame ``i`` from 0: detected, px, py, speed, d_pos, d_neg, h_pos, h_neg (distance and heading cosine
to either goal), in_goal_zone, possession, flip, near_a, near_b, spread; basketball: d_right, d_left, hd_right, hd_left, stream.
Detectors are filters and islands over one partitioning by sequence.  Each returns seq, type, start, end, peak, confidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp
from ..operators.folds import emitted
from ..operators.windows import islands, ordered, reversed_order

KEYS = ["seq"]


@dataclass(frozen=True)
class Football:
    shot_speed: float = 9.0
    shot_heading: float = 0.30
    shot_range: float = 42.0
    bridge: int = 6
    lost_frames: int = 12
    approach: float = 8.0
    near_goal: float = 26.0
    flight_goal: float = 21.0
    run_speed: float = 7.0
    run_frames: int = 16
    run_metres: float = 18.0
    halt_speed: float = 1.6
    halt_frames: int = 38
    look_ahead: int = 60
    flank: int = 10
    dedupe: int = 15


@dataclass(frozen=True)
class Basketball:
    rim: float = 1.8
    approach: float = 4.0
    bridge: int = 6
    lost_frames: int = 10
    look_ahead: int = 50
    break_speed: float = 6.0
    break_frames: int = 16
    break_metres: float = 8.0
    dedupe: int = 15


INTEREST = {"likely_made_basket": 1.00, "fast_break": 0.82, "block_proxy": 0.74, "steal_proxy": 0.60, "shot_attempt": 0.50}


def _first_best(value: Column, at: str = "i") -> Column:
    """Frame of the highest value, the first of equals."""
    return F.max_by(F.col(at), F.struct(value, -F.col(at)))


def _event(df: DataFrame, kind: str, *more: str) -> DataFrame:
    return df.select("seq", F.lit(kind).alias("type"), F.col("start").cast("bigint"), F.col("end").cast("bigint"), F.col("peak").cast("bigint"), F.round("confidence", 2).alias("confidence"), *more)


def shots(f: DataFrame, c: Football = Football()) -> DataFrame:
    """EV1: a fast detected ball that heads for a goal in range."""
    toward = ((F.col("h_pos") > c.shot_heading) & (F.col("d_pos") < c.shot_range)) | ((F.col("h_neg") > c.shot_heading) & (F.col("d_neg") < c.shot_range))
    rows = f.where(F.col("detected") & (F.col("speed") > c.shot_speed) & toward)
    best = F.max_by(F.struct("i", "speed", F.greatest("h_pos", "h_neg").alias("h")), F.struct("speed", -F.col("i"))).alias("b")
    runs = islands(rows, KEYS, "i", c.bridge + 1, 2, [best])
    conf = clamp(0.45 + 0.5 * (F.col("b.speed") - c.shot_speed) / 16.0 + 0.2 * (F.col("b.h") - c.shot_heading), 0.2, 0.98)
    return _event(runs.withColumn("peak", F.col("b.i")).withColumn("confidence", conf), "shot")


def lost_runs(f: DataFrame, frames: int, least: list[Column], most: list[Column] = ()) -> DataFrame:
    """Stretches without detection that lie between two detected rows, which come along as ``pre`` and ``post``."""
    w = ordered(KEYS, "i")
    here = F.when(F.col("detected"), F.struct("i", *least))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = f.withColumn("pre", F.last(here, True).over(before(w))).withColumn("post", F.last(here, True).over(before(reversed_order(KEYS, "i"))))
    ends = [F.min_by("pre", "i").alias("pre"), F.max_by("post", "i").alias("post")]
    return islands(rows.where(~F.col("detected")), KEYS, "i", 3, frames, [*ends, *most]).where("pre is not null and post is not null")


def shot_flights(f: DataFrame, c: Football = Football()) -> DataFrame:
    """EV2: the ball is lost for a stretch and turns up nearer to a goal; the event is anchored where it was last seen."""
    runs = lost_runs(f, c.lost_frames, ["d_pos", "d_neg"])

    def came(d: str) -> Column:
        return F.col(f"pre.{d}") - F.col(f"post.{d}")

    hit = {d: (came(d) >= c.approach) & (F.col(f"post.{d}") <= c.near_goal) for d in ("d_pos", "d_neg")}
    rows = runs.withColumn("near", F.when(hit["d_pos"], came("d_pos")).when(hit["d_neg"], came("d_neg"))).withColumn("arrive", F.when(hit["d_pos"], F.col("post.d_pos")).when(hit["d_neg"], F.col("post.d_neg"))).where("near is not null")
    rows = rows.select("seq", F.col("pre.i").alias("start"), F.col("post.i").alias("end"), F.col("pre.i").alias("peak"), clamp(0.55 + 0.35 * F.col("near") / 40.0, 0.4, 0.95).alias("confidence"), F.round("arrive", 1).alias("arrive"))
    return _event(rows, "shot", "arrive")


def transitions(f: DataFrame, c: Football = Football()) -> DataFrame:
    """EV3: a fast ball over many frames that gets far up or down the pitch."""
    best = [_first_best(F.col("speed")).alias("peak"), F.avg("speed").alias("mean"), F.max_by("px", "i").alias("x1"), F.min_by("px", "i").alias("x0")]
    fast = islands(f.where(F.col("speed") > c.run_speed), KEYS, "i", c.bridge + 1, c.run_frames, best)
    inside = during(fast, f.select("seq", "i", "speed")).groupBy("seq", "start", "end", "peak", "x0", "x1").agg(F.avg("speed").alias("mean"))
    rows = inside.withColumn("dx", F.abs(F.col("x1") - F.col("x0"))).where(F.col("dx") >= c.run_metres)
    return _event(rows.withColumn("confidence", clamp(0.4 + 0.4 * (F.col("dx") / 50.0) + 0.2 * (F.col("mean") / 15.0), 0.2, 0.95)), "fast_transition")


def during(runs: DataFrame, frames: DataFrame, start: str | Column = "start", end: str | Column = "end") -> DataFrame:
    """The runs with the frames (seq, i) from ``start`` to ``end``: a row for each place meets its frame by equality.

    Both sides are shuffled: Spark takes the rows of all places for no larger than the runs, and would send them to the driver to broadcast them.
    """
    place = F.explode(F.sequence(F.col(start) if isinstance(start, str) else start, F.col(end) if isinstance(end, str) else end))
    return runs.withColumn("i", place).hint("merge").join(frames, ["seq", "i"])


def ahead(f: DataFrame, events: DataFrame, n: int, *aggs: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """WN14: aggregates over the frames [end, end + n) of each event."""
    names = ["seq", "start", "end", "peak", "confidence", *keep]
    w = during(events.select(*names).distinct(), f, "end", F.col("end") + (n - 1))
    return w.groupBy(*names).agg(*aggs)


def likely_goals(f: DataFrame, found: DataFrame, flights: DataFrame, c: Football = Football()) -> DataFrame:
    """EV4: after a shot the ball gets into the goal zone or goes dead; and flights that end close to a goal."""
    last = f.groupBy("seq").agg(F.max("i").alias("last"))
    w = ahead(f, found, c.look_ahead, F.bool_or("in_goal_zone").alias("zone"), ((F.avg((~F.col("detected")).cast("double")) > 0.5) | (F.avg((F.col("possession") == 0).cast("double")) > 0.5)).alias("dead"))
    rows = w.where("zone or dead").join(last, "seq")
    conf = clamp(0.25 + 0.15 * F.col("zone").cast("int") + 0.1 * F.col("dead").cast("int") + 0.2 * F.col("confidence"), 0.15, 0.6)
    a = _event(rows.withColumn("confidence", conf).withColumn("end", F.least("last", F.least(F.col("last") + 1, F.col("end") + c.look_ahead))), "likely_goal_candidate")
    b = flights.where(F.col("arrive") <= c.flight_goal).withColumn("confidence", F.least(F.lit(0.6), "confidence"))
    return a.unionByName(_event(b, "likely_goal_candidate"))


def tackles(f: DataFrame, c: Football = Football()) -> DataFrame:
    """EV5: possession flips where both teams are near, those soon after one that counted left out."""
    w = ordered(KEYS, "i").rowsBetween(-c.flank, c.flank)
    rows = f.withColumn("a", F.max("near_a").over(w)).withColumn("b", F.max("near_b").over(w)).withColumn("start", F.min("i").over(w)).withColumn("end", F.max("i").over(w)).where("flip and a >= 1 and b >= 1")
    kept = rows.join(emitted(rows, KEYS, "i", c.dedupe), ["seq", "i"]).withColumn("peak", F.col("i"))
    return _event(kept.withColumn("confidence", clamp(0.3 + 0.1 * F.least("a", "b"), 0.25, 0.7)), "tackle_proxy")


def stoppages(f: DataFrame, c: Football = Football()) -> DataFrame:
    """EV6: the ball is slow or lost for long, and players stand close or nobody has it."""
    middle = f.groupBy("seq").agg(F.expr("percentile(spread, 0.5)").alias("middle"))
    runs = islands(f.where((F.col("speed") < c.halt_speed) | ~F.col("detected")), KEYS, "i", c.bridge + 1, c.halt_frames)
    inside = during(runs, f.select("seq", "i", "spread", "possession"))
    per = inside.groupBy("seq", "start", "end").agg(F.avg("spread").alias("spread"), F.avg((F.col("possession") == 0).cast("double")).alias("free")).join(middle, "seq")
    rows = per.where("spread < middle or free > 0.6").withColumn("peak", F.col("start") + F.floor((F.col("end") - F.col("start")) / 2))
    return _event(rows.withColumn("confidence", clamp(0.25 + 0.1 * (F.col("end") - F.col("start")) / 50.0, 0.2, 0.55)), "stoppage_review")


def football_events(f: DataFrame, c: Football = Football()) -> DataFrame:
    flights = shot_flights(f, c)
    found = shots(f, c).unionByName(flights.drop("arrive"))
    return found.unionByName(transitions(f, c)).unionByName(likely_goals(f, found, flights, c)).unionByName(tackles(f, c)).unionByName(stoppages(f, c))


def moments(events: DataFrame, frames: DataFrame, interest: dict[str, float] | None = None, before: int = 100, after: int = 50, gap: int = 40, longest: int = 300) -> DataFrame:
    """EV7, EV14: events with peaks close together as one moment, padded, capped about its best peak.

    The best event has the highest confidence, with ``interest`` the highest weight of its type plus a quarter of its confidence; the first
    of equals.  ``frames`` has n for each sequence.  With ``interest`` moments are ranked.
    """
    w = ordered(KEYS, ["peak", "type", "start", "end"])
    weight = F.lit(0.0)
    for t, v in (interest or {}).items():
        weight = F.when(F.col("type") == t, v).otherwise(weight)
    rows = events.withColumn("worth", F.round(weight + 0.25 * F.col("confidence"), 6) if interest else F.col("confidence"))
    rows = rows.withColumn("__new", F.coalesce((F.col("peak") - F.lag("peak").over(w) > gap).cast("int"), F.lit(1))).withColumn("__at", F.row_number().over(w))
    rows = rows.withColumn("__c", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = rows.groupBy("seq", "__c").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.max_by("peak", F.struct("worth", -F.col("__at"))).alias("peak"), F.max("confidence").alias("confidence"), F.max("worth").alias("interest"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.count(F.lit(1)).alias("n_events"))
    per = per.join(frames, "seq").withColumn("start", F.greatest(F.lit(0), F.least("s", F.col("peak") - before))).withColumn("end", F.least(F.col("n") - 1, F.col("e") + after))
    long = F.col("end") - F.col("start") > longest
    per = per.withColumn("__s", F.when(long, F.greatest(F.lit(0), F.col("peak") - longest // 2)).otherwise(F.col("start"))).withColumn("end", F.when(long, F.least(F.col("n") - 1, F.col("peak") + longest // 2)).otherwise(F.col("end")))
    out = per.select("seq", F.col("__s").alias("start"), "end", "peak", "confidence", "types", "n_events", *([F.round("interest", 3).alias("interest")] if interest else []))
    if not interest:
        return out
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("interest"), "peak")).cast("bigint"))


def by_hoop(f: DataFrame) -> DataFrame:
    """A row for each frame and hoop with ``d`` and ``hd``."""
    hoops = F.explode(F.array(*[F.struct(F.lit(h).alias("hoop"), F.col(f"d_{h}").alias("d"), F.col(f"hd_{h}").alias("hd")) for h in ("left", "right")])).alias("x")
    return f.select("*", hoops).select("*", "x.hoop", "x.d", "x.hd").drop("x")


def _at_hoop(f: DataFrame, hoop: str) -> DataFrame:
    return f.withColumn("d", F.col(f"d_{hoop}")).withColumn("hd", F.col(f"hd_{hoop}"))


def hoop_shots(f: DataFrame, c: Basketball = Basketball()) -> DataFrame:
    """EV8, EV9: flights of a lost ball that get near a rim (``turn`` 0), and a detected ball that heads for one (1)."""
    out = None
    for hoop in ("left", "right"):
        x = _at_hoop(f, hoop)
        runs = lost_runs(x, c.lost_frames, ["d"], [F.min("d").alias("least")])
        inside = during(runs, x.select("seq", "i", F.col("d").alias("dd"))).groupBy("seq", "start", "end", "pre", "post").agg(F.min("dd").alias("least"))
        reach = F.least("least", "post.d")
        near = F.col("pre.d") - reach
        a = inside.where((near >= c.approach) & (reach <= c.rim + 1.5)).select("seq", F.col("pre.i").alias("start"), F.col("post.i").alias("end"), F.col("pre.i").alias("peak"), clamp(0.5 + 0.4 * near / 8.0, 0.35, 0.95).alias("confidence"))
        mask = F.col("detected") & (F.col("hd") > 0.3) & (F.col("d") < c.approach + c.rim) & (F.col("speed") > 3.0)
        b = islands(x.where(mask), KEYS, "i", c.bridge + 1, 3, [F.min_by("d", "i").alias("d0"), F.max_by("d", "i").alias("d1")])
        b = b.withColumn("peak", F.col("start")).withColumn("confidence", clamp(0.4 + 0.3 * (F.col("d0") - F.col("d1")) / 6.0, 0.3, 0.85))
        for turn, e in enumerate((a, b)):
            e = _event(e.withColumn("hoop", F.lit(hoop)).withColumn("turn", F.lit(turn)), "shot_attempt", "hoop", "turn")
            out = e if out is None else out.unionByName(e)
    return out


def first_shots(found: DataFrame, after: int = 5) -> DataFrame:
    """JN22: ``seq, peak, sp``: for each frame from a shot's start to ``after`` frames past its end the peak of the first such shot: right hoop before left, flights before
    headings, then by start.  A shot is a stretch of bounded length, so frames meet shots by equality."""
    turn = [F.when(F.col("hoop") == "right", 0).otherwise(1) if "hoop" in found.columns else F.lit(0), F.col("turn") if "turn" in found.columns else F.lit(0), F.col("start"), F.col("peak")]
    rows = found.select("seq", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(turn)]).alias("__turn"), F.col("peak").alias("sp"), F.explode(F.sequence("start", F.col("end") + after)).alias("peak"))
    return rows.groupBy("seq", "peak").agg(F.min_by("sp", "__turn").alias("sp"))


def made_baskets(f: DataFrame, found: DataFrame, c: Basketball = Basketball()) -> DataFrame:
    """EV10: the ball at the rim, then away from it or in other hands."""
    last = f.groupBy("seq").agg(F.max("i").alias("last"))
    out = None
    for hoop in ("left", "right"):
        x = _at_hoop(f, hoop)
        nearest = F.min_by("i", F.col("d") * 1e9 + F.col("i"))  # distances that differ by rounding alone are equal, and the first of them counts
        runs = islands(x.where(F.col("d") < c.rim), KEYS, "i", 5, 1, [nearest.alias("peak"), F.min_by("possession", "i").alias("p0")]).withColumn("confidence", F.lit(0.0))
        w = ahead(x, runs, c.look_ahead, F.bool_or(F.col("hd") < -0.2).alias("away"), F.bool_or("flip").alias("flip"), F.max_by("possession", "i").alias("p1"), keep=("p0",))
        turned = F.col("flip") | ((F.col("p1") != 0) & (F.col("p0") != 0) & (F.col("p1") != F.col("p0")))
        w = w.withColumn("turned", turned).where("away or turned").join(last, "seq")
        w = w.join(first_shots(found), ["seq", "peak"], "left")
        anchor = F.coalesce("sp", "peak")
        w = w.select("seq", F.least(anchor, "start").alias("start"), F.least("last", F.least(F.col("last") + 1, F.col("end") + c.look_ahead)).alias("end"), anchor.alias("peak"), clamp(0.4 + 0.2 * F.col("away").cast("int") + 0.2 * F.col("turned").cast("int"), 0.3, 0.7).alias("confidence"), F.lit(hoop).alias("hoop"))
        e = _event(w, "likely_made_basket", "hoop")
        out = e if out is None else out.unionByName(e)
    return out


def blocks(f: DataFrame) -> DataFrame:
    """EV11: near the rim and heading for it, then sharply away."""
    last = f.groupBy("seq").agg(F.max("i").alias("last"))
    out = None
    for hoop in ("left", "right"):
        x = _at_hoop(f, hoop)
        runs = islands(x.where(F.col("detected") & (F.col("d") < 2.8) & (F.col("hd") > 0.2)), KEYS, "i", 5, 2, [F.max_by("d", "i").alias("d0")]).withColumn("peak", F.col("start")).withColumn("confidence", F.lit(0.45))
        w = ahead(x, runs, 15, F.bool_or(F.col("hd") < -0.4).alias("away"), F.max_by("d", "i").alias("d1"), keep=("d0",)).where("away and d1 - d0 > 1.5").join(last, "seq")
        e = _event(w.withColumn("end", F.least("last", F.least(F.col("last") + 1, F.col("end") + 15))).withColumn("hoop", F.lit(hoop)), "block_proxy", "hoop")
        out = e if out is None else out.unionByName(e)
    return out


def fast_breaks(f: DataFrame, c: Basketball = Basketball()) -> DataFrame:
    """EV12: a fast ball over many frames that gets far along the court (px, in metres) while the players stream one way."""
    runs = islands(f.where(F.col("speed") > c.break_speed), KEYS, "i", c.bridge + 1, c.break_frames, [_first_best(F.col("speed")).alias("peak"), F.max_by("px", "i").alias("x1"), F.min_by("px", "i").alias("x0")])
    inside = during(runs, f.select("seq", "i", "stream")).groupBy("seq", "start", "end", "peak", "x0", "x1").agg(F.avg("stream").alias("stream"))
    rows = inside.withColumn("dx", F.abs(F.col("x1") - F.col("x0"))).where((F.col("dx") >= c.break_metres) & (F.abs("stream") > 2.0))
    return _event(rows.withColumn("confidence", clamp(0.45 + 0.35 * F.col("dx") / 20.0, 0.3, 0.9)), "fast_break")


def steals(f: DataFrame, c: Basketball = Basketball()) -> DataFrame:
    """EV13: possession flips away from both hoops, those soon after one that counted left out."""
    last = f.groupBy("seq").agg(F.max("i").alias("last"))
    rows = f.where(F.col("flip") & (F.least("d_left", "d_right") >= 5.0))
    kept = emitted(rows, KEYS, "i", c.dedupe).join(last, "seq")
    kept = kept.select("seq", F.greatest(F.lit(0), F.col("i") - 10).alias("start"), F.least("last", F.col("i") + 10).alias("end"), F.col("i").alias("peak"), F.lit(0.4).alias("confidence"))
    return _event(kept, "steal_proxy")


def basketball_events(f: DataFrame, c: Basketball = Basketball()) -> DataFrame:
    found = hoop_shots(f, c)
    out = found.drop("hoop", "turn").unionByName(made_baskets(f, found, c).drop("hoop")).unionByName(blocks(f).drop("hoop"))
    return out.unionByName(fast_breaks(f, c)).unionByName(steals(f, c))


def label_plausibility(f: DataFrame, labels: DataFrame, reach: int = 38) -> DataFrame:
    """EV17: the highest speed near each label (seq, at) and the share of frames that are slower."""
    top = during(labels, f.select("seq", "i", "speed"), F.col("at") - reach, F.col("at") + reach).groupBy("seq", "at").agg(F.max("speed").alias("peak_speed"))
    none = F.lit(None).cast("bigint")
    both = f.where("speed is not null").select("seq", F.col("speed").alias("v"), none.alias("at"), F.lit(1).alias("frame")).unionByName(top.select("seq", F.col("peak_speed").alias("v"), F.col("at").cast("bigint").alias("at"), F.lit(0).alias("frame")))
    below = F.sum("frame").over(Window.partitionBy("seq").orderBy("v", "frame").rowsBetween(Window.unboundedPreceding, 0))
    ranked = both.withColumn("slower", below / F.sum("frame").over(Window.partitionBy("seq"))).where("frame = 0")
    return ranked.select("seq", "at", F.col("v").alias("peak_speed"), "slower")
