"""What grew faster than its input, or cost too much a row, on larger tables."""

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldlens.operators import anchors, association, diagnosis, folds, identity, joins, tracker_metrics, tracking, windows
from fieldlens.plans import events, jobs
from fieldlens.streaming import queue


def test_a_small_frame_is_associated_without_arrays(monkeypatch):
    """A frame of a few boxes costs a few sums; many at a time still go through arrays, with the same outcome."""
    rng = np.random.default_rng(5)
    centre, frames = rng.random((4, 2)) * 500, []
    for f in range(1, 200):
        centre = centre + rng.normal(0, 4, (4, 2))
        seen = rng.random(4) < 0.85
        frames.append((f, [(*map(float, c), 60.0, 120.0, 0.9 if rng.random() < 0.8 else 0.15) for c in centre[seen]]))
    many = association.Tracks(association.Tracker())
    with monkeypatch.context() as m:
        m.setattr(association, "FEW", 0)
        want = [many.step(f, d) for f, d in frames]
    calls = []
    monkeypatch.setattr(association, "overlaps", lambda a, b: calls.append(1))
    few = association.Tracks(association.Tracker())
    assert [few.step(f, d) for f, d in frames] == want and few.rows() == many.rows()
    assert not calls


def test_rows_of_all_places_are_not_broadcast(spark):
    runs = spark.createDataFrame([("s", 0, 59), ("s", 30, 89)], "seq string, start bigint, end bigint")
    frames = spark.range(100).select(F.lit("s").alias("seq"), F.col("id").alias("i"))
    met = events.during(runs, frames)
    assert met.count() == 120
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_steps_are_brought_to_the_jobs(spark):
    """Not all jobs of a need to one task."""
    asked = spark.range(50).select(F.col("id").alias("job_id"), F.lit("a,b").alias("deliverables"))
    steps = spark.createDataFrame([("one", 1, None), ("two", 2, "a"), ("three", 3, "c,b")], "step string, no int, needs string")
    found = jobs.resolve_steps(asked, steps)
    assert found.count() == 150
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_folds_hold_no_sequence_in_one_row(spark):
    rows = spark.range(4000).select((F.col("id") % 2).cast("string").alias("seq"), (F.col("id") * 7 % 5000).alias("i"), (F.col("id") * 13 % 97 / 10.0).alias("x"), F.lit(0.0).alias("y"))
    kept, guarded = folds.emitted(rows, ["seq"], "i", 15), folds.teleport_guard(rows, ["seq"], "i", "x", "y", 1.6)
    want, far = set(), set()
    for seq in "01":
        last = at = None
        for r in sorted(rows.where(F.col("seq") == seq).collect(), key=lambda r: r.i):
            if last is None or r.i - last >= 15:
                want.add((seq, r.i))
                last = r.i
            if at is not None and abs(r.x - at.x) / max(1, r.i - at.i) > 1.6:
                far.add((seq, r.i))
            else:
                at = r
    assert {(r.seq, r.i) for r in kept.collect()} == want
    assert {(r.seq, r.i) for r in guarded.where("teleport").collect()} == far and guarded.count() == 4000
    for df in (kept, guarded):
        assert "collect_" not in df._jdf.queryExecution().executedPlan().toString()


def most_rows(spark, make) -> int:
    """The rows of the largest step of a plan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = make()
        df.collect()
        nodes, most = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            n = nodes.pop()
            if n.metrics().contains("numOutputRows"):
                most = max(most, n.metrics().apply("numOutputRows").value())
            nodes += [n.children().apply(k) for k in range(n.children().size())]
        return most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_as_of_pairs_no_two_rows(spark):
    """As many rows at one time as there may be."""
    left = spark.range(600).select(F.col("id").alias("l"), (F.col("id") % 30 + 95).alias("t"))
    right = spark.range(600).select(F.col("id").alias("r"), (F.col("id") * 7 % 90 * 3).alias("s"), (F.col("id") % 3).alias("tag"))
    make = lambda: joins.asof_within(left, right, "l", "t", "r", "s", 10, ["tag"])
    got = {(x.l, x.tag, x.r, x.dt) for x in make().collect()}
    want = set()
    for a in left.collect():
        best = {}
        for b in right.collect():
            if abs(a.t - b.s) <= 10:
                best[b.tag] = min(best.get(b.tag, (99, 0)), (abs(a.t - b.s), b.r))
        want |= {(a.l, tag, r, dt) for tag, (dt, r) in best.items()}
    assert got == want and len(want) > 600
    assert most_rows(spark, make) < 6000  # of up to 360,000 pairs


def test_a_heaviest_match_needs_few_pairs_of_the_smaller_side(spark):
    rng = np.random.default_rng(2)
    for n, m in ((3, 200), (200, 3), (5, 5)):
        w = rng.integers(0, 6, (n, m))
        rows = spark.createDataFrame([(None if g else "g", i, j, int(w[i, j])) for g in (0, 1) for i in range(n) for j in range(m)], "g string, a int, b int, n bigint")
        got = {r.g: r.n for r in joins.heaviest_matches(rows, ["g"], "n", "a", "b").groupBy("g").agg(F.sum("n").alias("n")).collect()}
        best = sum(w[i, j] for i, j in joins.assign(-w.astype(float)))
        assert got == {"g": best, None: best}
        assert joins._needed(rows, ["g"], "n", "a", "b").count() <= 2 * min(n, m) ** 2


def test_successors_and_neighbours_are_looked_for_without_all_pairs(spark):
    """Many tracks that end and begin in one place at one time."""
    ends = spark.range(400).select(F.lit("s").alias("seq"), F.col("id").alias("track_id"), (F.col("id") % 3).alias("frame"), (F.col("id") * 37 % 500 + 0.0).alias("cx"), (F.col("id") * 11 % 90 + 0.0).alias("cy"), F.lit(3.0).alias("vx"), F.lit(-1.0).alias("vy"))
    starts = spark.range(400).select(F.lit("s").alias("seq"), (900 - F.col("id")).alias("track_id"), (F.col("id") % 9).alias("frame"), (F.col("id") * 53 % 430 + 0.0).alias("cx"), (F.col("id") * 7 % 95 + 0.0).alias("cy"))
    make = lambda: diagnosis.successors(ends, starts, ["seq"], 6, 20.0)
    want, there = set(), starts.collect()
    for a in ends.collect():
        near = [(b.frame - a.frame, b.track_id) for b in there if 1 <= b.frame - a.frame <= 6 and ((a.cx + 3 * (b.frame - a.frame) - b.cx) ** 2 + (a.cy - (b.frame - a.frame) - b.cy) ** 2) ** 0.5 < 20]
        if near:
            want.add((a.track_id, *min(near)))
    assert {(r.track_id, r.gap, r.successor) for r in make().collect()} == want and len(want) > 100
    assert most_rows(spark, make) <= 1200
    rows = ends.withColumn("cx", F.col("cx") % 70).withColumn("cy", F.col("cy") % 40)
    ask = lambda: joins.near_another(rows, rows, ["seq"], "frame", "track_id", "cx", "cy", 30.0)
    all_ = rows.collect()
    assert {r.track_id for r in ask().where("occluded").collect()} == {a.track_id for a in all_ if any(a.track_id != b.track_id and a.frame == b.frame and (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 < 900 for b in all_)}
    assert most_rows(spark, ask) < 4000  # of 50,000 pairs


def test_percentiles_hold_no_key_in_one_aggregate(spark):
    rows = spark.range(3001).select(F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") * 71 % 1009 / 7).alias("v"))
    got = windows.percentiles(rows, ["k"], "v", {"a": 0.5, "b": 0.9, "c": 1.0})
    want = rows.where("v is not null").groupBy("k").agg(F.count("v").alias("n"), *[F.expr(f"percentile(v, {p})").alias(c) for c, p in (("a", 0.5), ("b", 0.9), ("c", 1.0))])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    boxes = spark.range(9000).select(F.lit("F").alias("cls"), F.col("id").alias("frame"), F.lit(1.0).alias("conf"), (F.col("id") * 3.0).alias("x"), F.lit(0.0).alias("y"))
    jumps = windows.jumps(boxes.where("frame <> 5000"), ["cls"], "frame", "conf", "x", "y")
    assert jumps.count() == 8997 and {r.jump for r in jumps.select("jump").distinct().collect()} == {3.0}


def test_a_fit_solves_no_larger_system_than_it_needs(monkeypatch):
    """The square of the number of points isn't made."""
    sizes, svd = [], np.linalg.svd

    def noted(a, full_matrices=True, **more):
        sizes.append(a.shape[-2] if full_matrices else 0)
        return svd(a, full_matrices=full_matrices, **more)

    monkeypatch.setattr(np.linalg, "svd", noted)
    src = np.random.default_rng(1).random((60, 2)) * 100
    h = tracking.homography(src, src * 2 + 1)
    assert np.allclose(h, [[2, 0, 1], [0, 2, 1], [0, 0, 1]], atol=1e-8) and max(sizes) < 9
    assert np.allclose(tracking.homography(src[:4], src[:4] * 2 + 1), h, atol=1e-6)


def test_hulls_of_many_groups_take_a_step_at_a_time():
    rng = np.random.default_rng(4)
    for n in range(3, 9):
        groups = [sorted({(float(a), float(b)) for a, b in rng.integers(0, 5, (n, 2))}) for _ in range(300)]
        groups = [g for g in groups if len(g) == n]
        got = tracking.hull_areas_of(np.array(groups).reshape(-1, n, 2))
        assert got.tolist() == [tracking.hull_area(np.array(g)) for g in groups]


def test_overlaps_are_counted_without_a_row_for_each_of_a_pair(spark):
    rows = spark.range(1000).select(F.lit("s").alias("seq"), F.floor(F.col("id") / 2).alias("frame"), F.col("id").alias("gt_id"), (F.col("id") % 2 * 100.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(20.0).alias("h"))
    make = lambda: tracker_metrics.hota(rows, rows.withColumnRenamed("gt_id", "track_id"), ["seq"])
    assert [(r.tp, r.fn, r.fp, r.hota) for r in make().collect()] == [(1000, 0, 0, 1.0)] * 19
    assert most_rows(spark, make) <= 2000  # of 19,000


def test_relinking_makes_no_table_of_all_candidates(spark, monkeypatch):
    """Copies of tracks, equal scores and slices, against the walk over all candidates."""
    rng = np.random.default_rng(7)
    at = lambda n: (rng.integers(0, 12, n) / 2.0).tolist()
    base = [(f"s{i % 2}", int(f), int(f) + i % 3, *p) for i, (f, *p) in enumerate(zip(rng.integers(0, 12, 120), at(120), at(120), at(120), at(120), at(120), at(120)))]
    rows = [(k * 1000 + (i * 37 % 120), s, f0, f1, x0, y0, x1, y1, vx - 3, vy - 3, vx - 3, vy - 3) for k in range(3) for i, (s, f0, f1, x0, y0, x1, y1, vx, vy) in enumerate(base)]
    ends = spark.createDataFrame(rows, "track_id bigint, seq string, f0 bigint, f1 bigint, x0 double, y0 double, x1 double, y1 double, vx0 double, vy0 double, vx1 double, vy1 double")
    rule = identity.Relink(gap=6, metres=4.0, dt=0.2, top_speed=30.0)
    all_ = identity.relink_candidates(ends, rule.gap, rule.metres, rule.dt, rule.top_speed)
    there, near = ends.collect(), set()
    for a in there:
        for b in there:
            t = (b.f0 - a.f1) * 0.2
            if a.seq == b.seq and a.track_id != b.track_id and 1 <= b.f0 - a.f1 <= 6 and math.hypot(a.x1 + a.vx1 * t - b.x0, a.y1 + a.vy1 * t - b.y0) <= 4 and math.hypot(a.x1 - b.x0, a.y1 - b.y0) / t <= 30:
                both = math.hypot(a.vx1, a.vy1), math.hypot(b.vx0, b.vy0)
                if min(both) <= 1 or (a.vx1 * b.vx0 + a.vy1 * b.vy0) / (both[0] * both[1]) >= -0.2:
                    near.add((a.track_id, b.track_id))
    assert {(r.a, r.b) for r in all_.collect()} == near
    used, want = set(), set()
    for r in sorted(all_.collect(), key=lambda r: (r.score, r.a, r.b)):
        if ("a", r.a) not in used and ("b", r.b) not in used:
            used |= {("a", r.a), ("b", r.b)}
            want.add((r.seq, r.a, r.b))
    assert len(want) > 100
    walked, walk = [], identity.fold_batches
    monkeypatch.setattr(identity, "fold_batches", lambda df, *a, **k: walked.append(df.where("score is not null").count()) or walk(df, *a, **k))
    for at_once, each in ((50, 0), (2_000_000, 8)):
        assert {tuple(r) for r in identity.relink_greedily(ends, rule, at_once, each).collect()} == want
    assert len(walked) > 2 and max(walked) < all_.count() / 4
    assert identity.relink_greedily(ends.limit(0), rule).count() == 0


class Kept:
    """A map or value state that counts what is read and written."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def exists(self):
        return bool(self.held)

    def keys(self):
        return iter(list(self.held))

    def containsKey(self, k):
        return k in self.held

    def getValue(self, k):
        self.calls += 1
        return self.held[k]

    def updateValue(self, k, v):
        self.calls += 1
        self.held[k] = v

    def removeKey(self, k):
        self.held.pop(k, None)

    def get(self):
        return self.held[()]

    def update(self, v):
        self.held[()] = v

    def clear(self):
        self.held.clear()


def test_an_hour_of_waiting_jobs_is_not_written_for_each_expiry():
    states, timers = [], set()
    new = lambda *_: states.append(Kept()) or states[-1]
    handle = SimpleNamespace(getMapState=new, getValueState=new, registerTimer=timers.add, deleteTimer=timers.discard)
    desk, hour = queue.Desk(), queue.HOUR
    desk.init(handle)
    rows = [(i, "quota_waiting", i % 100 + hour * (i % 2), None) for i in range(400)] + [(1000 + i, "ready", 0, 50 + i * hour // 100) for i in range(300)]
    list(desk.handleInputRows(("p",), iter([pd.DataFrame(rows, columns=["job_id", "state", "created_ms", "expires_ms"])]), None))
    got, until = [], 5 * hour // 2
    while timers and min(timers) <= until:
        at = min(timers)
        times = SimpleNamespace(getExpiryTimeInMs=lambda at=at: at, getCurrentWatermarkInMs=lambda: until)
        got += [r for pdf in desk.handleExpiredTimer(("p",), times, times) for r in zip(pdf["job_id"], pdf["state"], pdf["at"].astype("int64") // 1_000_000)]
        timers.discard(at)
    waiting, want = sorted((c, j) for j, s, c, _ in rows if s == "quota_waiting"), []
    for at, job in sorted((e, j) for j, s, _, e in rows if s == "ready" and e <= until):
        want.append((job, "expired", at))
        if waiting and waiting[0][0] <= at:
            want.append((waiting.pop(0)[1], "approved", at))
    assert got == want and len(want) > 400 and min(timers) > until
    assert sum(s.calls for s in states) < 40  # not some for each of 250 expiries


def test_alignment_ends_when_nothing_moves(monkeypatch):
    fits, fit = [], anchors.rigid_fit
    monkeypatch.setattr(anchors, "rigid_fit", lambda *a: fits.append(1) or fit(*a))
    p = np.random.default_rng(3).random((8, 2)) * 50
    assert anchors.align(p, p + 0.5) == [(i, i) for i in range(8)]
    assert len(fits) <= 2  # of 12 rounds
