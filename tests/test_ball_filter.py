import random
from dataclasses import replace

from fieldlens.operators.tracking import BallFilter, kalman_track
from fieldlens.streaming import live

NEAR = BallFilter(start_near=150.0, gate_near=300.0, max_gap=3)


def status(settings, frames, last):
    return [(s[1], s[7]) for s in settings.run(frames, last)]


def still(frames, **change):
    return {f: [(100.0, 100.0, 0.9, change.get("head", False), change.get("apart", 10.0))] for f in frames}


def test_a_track_starts_near_a_player_only():
    far = {1: [(10.0, 10.0, 0.95, False, 400.0), (100.0, 100.0, 0.5, False, 20.0)]}
    assert status(NEAR, far, 1) == [("detected", 0.5)] and status(BallFilter(), far, 1) == [("detected", 0.95)]
    assert status(NEAR, still([1], apart=151.0), 1) == [("lost", None)] and status(NEAR, still([1], apart=None), 1) == [("detected", 0.9)]


def test_in_the_gate_a_wider_distance_counts():
    frames = still([1]) | still([2], apart=250.0) | still([3], apart=301.0)
    assert [s for s, _ in status(NEAR, frames, 3)] == ["detected", "detected", "predicted"]


def test_after_a_miss_a_ball_must_be_seen_in_a_row():
    twice = replace(NEAR, reacquire=2, max_gap=9)
    assert [s for s, _ in status(twice, still([1, 3, 4]), 4)] == ["detected", "predicted", "predicted", "detected"]
    assert [s for s, _ in status(twice, still([1, 3, 5, 6]), 6)] == ["detected", "predicted", "predicted", "predicted", "predicted", "detected"]
    assert [s for s, _ in status(replace(twice, start_near=None), still([1, 3]), 3)] == ["detected", "predicted", "detected"]


def test_heads_block_all_or_slow_balls():
    assert [s for s, _ in status(replace(NEAR, reject_head=True), still([1], head=True), 1)] == ["lost"]
    fast = {f: [(100.0 + 20 * f, 100.0, 0.9, f == 9, 10.0)] for f in range(1, 10)}
    assert status(replace(NEAR, head_speed=8.0), fast, 9)[-1][0] == "detected" and status(replace(NEAR, reject_head=True), fast, 9)[-1][0] == "predicted"
    slow = still(range(1, 9)) | still([9], head=True)
    assert status(replace(NEAR, head_speed=8.0), slow, 9)[-1][0] == "predicted"


def test_a_lost_ball_can_start_again_in_the_same_frame():
    frames = still([1]) | {5: [(900.0, 600.0, 0.8, False, 5.0)]}
    assert [s for s, _ in status(NEAR, frames, 5)] == ["detected", "predicted", "predicted", "predicted", "detected"]


def test_columns_say_heads_and_distances(spark):
    rows = [("a", 1, 10.0, 10.0, 0.9, True, 5.0), ("a", 1, 50.0, 50.0, 0.4, None, None), ("a", 2, 51.0, 50.0, 0.8, False, 20.0)]
    df = spark.createDataFrame(rows, "seq string, frame int, x double, y double, conf double, head boolean, apart double")
    got = kalman_track(df, ["seq"], replace(NEAR, reject_head=True), "head", "apart").orderBy("frame").collect()
    assert [(r.status, r.picked_conf, r.n_dets) for r in got] == [("detected", 0.4, 2), ("detected", 0.8, 1)]


def test_rules_hold_in_streams_and_across_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [("a", f, 100.0 + 2 * f + rng.gauss(0, 1), 100.0, 0.9, f % 11 == 5, 20.0 if f % 7 else 400.0) for f in range(1, 80) if f % 9 and not 30 < f < 36]
    rows += [("a", f, 600.0, 400.0, 0.95, False, None) for f in range(2, 80, 5)]
    df = spark.createDataFrame(rows, "seq string, frame bigint, x double, y double, conf double, head boolean, apart double")
    rules = replace(NEAR, reacquire=2, head_speed=8.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        want = [(r.frame, r.status, r.x, r.y) for r in kalman_track(df, ["seq"], rules, "head", "apart").orderBy("frame").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    frames: dict = {}
    for _, f, *d in sorted(rows, key=lambda r: (r[1], -r[4])):
        frames.setdefault(f, []).append(tuple(d))
    assert [(r[0], r[1], r[2], r[3]) for r in rules.run(frames, max(frames))] == want and {s for _, s, *_ in want} == {"detected", "predicted", "lost"}
    before = 0
    for end in (1, 17, 33, 79):
        df.where(f"frame > {before} and frame <= {end}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = end
        live.run_available(live.track_ball(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rules, "head", "apart"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("frame").collect()
    assert [(r.frame, r.status, r.x, r.y) for r in got] == want
