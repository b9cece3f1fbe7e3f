"""Hand-made frames with answers by plain Python or numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.functions import geometry as g
from fieldlens.operators import evaluation, folds, identity, joins, metrics, tracking, windows
from fieldlens.plans import events, jobs
from fieldlens.sources import files
from fieldlens.streaming import live


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def series(spark, values, name="v"):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], f"seq string, i bigint, {name} double")


@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_edge_moving_average_as_numpy(spark, n):
    v, k = np.sin(np.arange(n) * 1.7), 2
    want = np.convolve(np.pad(v, k, mode="edge"), np.ones(2 * k + 1) / (2 * k + 1), mode="valid")
    got = series(spark, v.tolist()).withColumn("m", windows.edge_moving_average(F.col("v"), windows.ordered(["seq"], "i"), k)).orderBy("i").toPandas()["m"]
    assert np.allclose(got, want)


def test_gradient_and_interpolation_as_numpy(spark):
    v = [None, 1.0, None, None, 4.0, 9.0, None]
    w = windows.ordered(["seq"], "i")
    got = series(spark, v).withColumn("f", windows.interpolate(F.col("v"), F.col("i"), ["seq"], "i")).withColumn("d", windows.gradient(F.col("f"), w)).orderBy("i").toPandas()
    want = np.interp(np.arange(7), [1, 4, 5], [1, 4, 9])
    assert np.allclose(got["f"], want) and np.allclose(got["d"], np.gradient(want))
    assert series(spark, [None, None]).withColumn("f", windows.interpolate(F.col("v"), F.col("i"), ["seq"], "i")).toPandas()["f"].tolist() == [0, 0]


def test_islands_bridge_exactly(spark):
    df = spark.createDataFrame([("a", f) for f in (1, 2, 5, 9, 20)] + [("b", 3)], "seq string, i bigint")
    got = {(r.seq, r.start, r.end, r.n_rows) for r in windows.islands(df, ["seq"], "i", 3).collect()}
    assert got == {("a", 1, 5, 3), ("a", 9, 9, 1), ("a", 20, 20, 1), ("b", 3, 3, 1)}
    assert windows.islands(df, ["seq"], "i", 3, 2).count() == 1 and windows.islands(df.limit(0), ["seq"], "i", 3).count() == 0


def test_majority_ties_and_flips(spark):
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate([0, 1, 2, 0, 0, 0])], "seq string, i bigint, c int")
    w = windows.ordered(["seq"], "i")
    got = df.withColumn("m", windows.majority(F.col("c"), w, 1)).withColumn("f", windows.flips(F.col("c"), w)).orderBy("i").collect()
    assert [r.m for r in got] == [1, 1, 1, 2, 0, 0] and [r.i for r in got if r.f] == [2]


def test_nearest_ties_and_radius(spark):
    p = spark.createDataFrame([(1, 7, 3.0), (1, 5, 3.0), (2, 1, 5.0)], "frame int, track_id int, d double")
    assert [(r.frame, r.track_id) for r in joins.nearest(p, ["frame"], "d", ["track_id"], 5.0).orderBy("frame").collect()] == [(1, 5), (2, 1)]
    assert joins.nearest(p, ["frame"], "d", ["track_id"], 5.0, strict=True).count() == 1


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in joins.assign(c))
        want = min(sum(c[i, j] for i, j in zip(rows, p)) for rows in itertools.combinations(range(n), min(n, m)) for p in itertools.permutations(range(m), min(n, m)))
        assert got == pytest.approx(want)


def test_band_join_equals_range(spark):
    a = spark.createDataFrame([(i, i * 3) for i in range(20)], "a int, f int")
    b = spark.createDataFrame([(i, i * 2) for i in range(40)], "b int, t int")
    got = {(r.a, r.b) for r in joins.band_join(a, b, "f", "t", 1, 7).collect()}
    assert got == {(i, j) for i in range(20) for j in range(40) if 1 <= j * 2 - i * 3 <= 7}


def test_teleport_guard_compares_with_last_accepted(spark):
    df = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 1, 50.0, 0.0), ("s", 2, 51.0, 0.0), ("s", 3, 1.0, 0.0), ("s", 4, None, None)], "seq string, i bigint, x double, y double")
    got = folds.teleport_guard(df, ["seq"], "i", "x", "y", 1.0)
    assert [r.i for r in got.where("teleport").orderBy("i").collect()] == [1, 2] and got.count() == 5


def test_emitted_and_chains(spark):
    df = spark.createDataFrame([("s", i) for i in (1, 10, 16, 20, 31, 40)], "seq string, i bigint")
    assert sorted(r.i for r in folds.emitted(df, ["seq"], "i", 15).collect()) == [1, 16, 31]
    links = spark.createDataFrame([(i + 1, i) for i in range(9)], "id bigint, parent bigint")
    assert {(r.id, r.root) for r in folds.resolve_chains(links).collect()} == {(i + 1, 0) for i in range(9)}


def test_iou_and_boxes(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, g.iou(lit(0, 0, 2, 2), lit(2, 0, 2, 2))) == 0
    assert one(spark, g.iou(lit(0, 0, 2, 2), lit(1, 0, 2, 2))) == pytest.approx(1 / 3)
    assert one(spark, g.box_distance(*lit(3, 4, 0, 0, 0, 0))) == 5
    assert one(spark, g.project(F.lit(1.0), F.lit(1.0), [1, 0, 0, 0, 1, 0, 0, 0, 0])[0]) is None


def test_kalman_on_truth_follows_it(spark):
    df = spark.createDataFrame([("s", f, 2.0 * f, 50.0 - f, 0.9) for f in range(1, 40)], "seq string, frame bigint, x double, y double, conf double")
    got = tracking.kalman_track(df, ["seq"]).orderBy("frame").toPandas()
    assert (got["status"] == "detected").all() and np.abs(got["x"] - 2.0 * got["frame"]).iloc[10:].max() < 0.5


def test_low_pass_keeps_lines_and_homography_fits():
    v = np.linspace(0, 5, 60)
    assert np.allclose(tracking.low_pass(v, 1.2, 25.0), v, atol=0.05)
    h = np.array([[1.1, 0.1, 3], [0.02, 0.9, -2], [0.001, 0.0005, 1]])
    src = np.array([[0, 0], [10, 0], [10, 8], [0, 8], [5, 4.0]])
    m = np.c_[src, np.ones(5)] @ h.T
    assert np.allclose(tracking.homography(src, m[:, :2] / m[:, 2:]), h / h[2, 2], atol=1e-6)
    with pytest.raises(ValueError):
        tracking.homography(np.array([[0, 0], [1, 1], [2, 2], [3, 3.0]]), src[:4])
    assert tracking.hull_area(src) == pytest.approx(80) and tracking.hull_area(src[:2]) == 0


def test_truth_as_prediction_is_perfect(spark):
    df = spark.createDataFrame([(i, "a", i / 10, 1) for i in range(5)] + [(9, "a", 0.0, 0)], "id int, cls string, conf double, y int")
    assert evaluation.average_precision(df, "conf", "y", "cls", "id").first().ap <= 1
    row = evaluation.precision_recall(df, "conf", "y", 0.05).first()
    assert (row.tp, row.fp, row.fn) == (4, 0, 1) and row.precision == 1
    assert evaluation.average_precision(df.where("y = 0"), "conf", "y", "cls", "id").count() == 0


def test_territory_sums_to_100_and_last_bin_is_closed(spark):
    df = spark.createDataFrame([("a", x) for x in (-60.0, -52.5, 0.0, 52.5, 60.0)], "who string, x_m double")
    got = {r.part: r.pct for r in metrics.territory(df, ["who"]).collect()}
    assert sum(got.values()) == pytest.approx(100) and got[2] == 40


def test_votes_prefer_the_least_of_equals(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (2, 1)], "t int, c int")
    got = {r.t: (r.majority_cluster, r.purity) for r in identity.majority_vote(df, "t", "c").collect()}
    assert got == {1: (0, 0.5), 2: (1, 1.0)}


def test_moments_cluster_and_cap(spark):
    ev = spark.createDataFrame([("s", "shot", 10, 12, 11, 0.5), ("s", "tackle_proxy", 50, 52, 51, 0.6), ("s", "shot", 92, 93, 92, 0.9), ("s", "shot", 500, 900, 600, 0.4)], "seq string, type string, start bigint, end bigint, peak bigint, confidence double")
    got = events.moments(ev, spark.createDataFrame([("s", 1000)], "seq string, n bigint")).orderBy("start", "end").collect()
    assert [(r.start, r.end, r.peak, r.types) for r in got] == [(0, 102, 51, "shot,tackle_proxy"), (0, 143, 92, "shot"), (450, 750, 600, "shot")]


def test_jobs_rules(spark):
    df = spark.createDataFrame([(1, "queued", 1300.0, "event_highlights"), (2, "odd", 100.0, "x,coach_analytics")], "job_id int, state string, duration_sec double, deliverables string")
    assert df.select(jobs.deliverables(F.col("duration_sec"), F.col("deliverables")).alias("d")).first().d == ["coach_analytics"]
    assert [(r.job_id, r.broken) for r in jobs.violations(df, 0.1, 1.0).collect()] == [(2, "state,duration,deliverables")]
    clips = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3)], "clip string, track_id int")
    tags = spark.createDataFrame([("a", "Kim"), ("c", "__skip__")], "clip string, name string")
    assert {(r.clip, r.name) for r in jobs.named_clips(clips, tags).collect()} == {("a", "Kim"), ("b", "Kim"), ("d", "track_003")}


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", 2, 1, 1.0, 2.0, 4.0, 6.0, 0.5), ("A", 1, 3, 0.0, 0.0, 2.0, 2.0, 1.0)], "seq string, frame int, track_id bigint, x double, y double, w double, h double, conf double")
    files.write_mot(rows, str(tmp_path / "mot"))
    got = files.mot(spark, str(tmp_path / "mot" / "seq=A")).orderBy("frame").collect()
    assert [(r.frame, r.track_id, r.foot_x, r.foot_y) for r in got] == [(1, 3, 1.0, 2.0), (2, 1, 3.0, 8.0)]
    (tmp_path / "l.txt").write_text("0 0.5 0.5 0.1 0.2\nbad line\n1 0.1 0.1 0.1\n")
    assert files.yolo_labels(spark, str(tmp_path / "l.txt")).count() == 1
    (tmp_path / "seqinfo.ini").write_text("[Sequence]\nname=X\nseqLength=750\nimWidth=1280\nimHeight=720\nframeRate=25\n")
    assert tuple(files.sequence_info(spark, str(tmp_path / "seqinfo.ini")).first()) == ("X", 750, 1280, 720, 25.0)
    (tmp_path / "ball.json").write_text('{"2": [1, 2, 0.5], "3": [4, 5, 0.6], "7": [8, 9, 0.7]}')
    assert {(r.frame, r.x) for r in files.retimed_ball(spark, str(tmp_path / "ball.json"), 2.0).collect()} == {(1, 1.0), (2, 4.0), (4, 8.0)}


def test_grids():
    grid = {"a": [1, 2], "b": [3, 4, 5]}
    assert len(evaluation.expand_grid(grid, "full")) == 6 and len(evaluation.expand_grid(grid, "oat")) == 4


def test_streamed_sessions_equal_batch_once_closed(spark, small, tmp_path):
    src = tmp_path / "in"
    e = spark.read.parquet(f"{small}/events.parquet")
    end = spark.createDataFrame([(-1, -1)], "user_id bigint, event_id bigint").selectExpr("event_id", "timestamp_ntz'2099-01-01 00:00:00' as ts", "user_id", "'end' as event_type", "0d as value", "'' as props")
    e.write.parquet(str(src))
    stream = lambda: spark.readStream.schema(e.schema).parquet(str(src))
    live.run_available(live.sessions(stream()), str(tmp_path / "out"), str(tmp_path / "cp"))
    end.select(*e.columns).write.mode("append").parquet(str(src))
    live.run_available(live.sessions(stream()), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in live.sessions(e).collect()}


def test_streamed_ball_equals_batch(spark, tmp_path):
    rows = [("s", f, 2.0 * f, 10.0, 0.9) for f in (1, 2, 3, 6, 7, 30)]
    df = spark.createDataFrame(rows, "seq string, frame bigint, x double, y double, conf double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = live.track_ball(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("ball_live").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.frame, r.status) for r in spark.sql("select * from ball_live").collect()}
    assert got == {(r.frame, r.status) for r in tracking.kalman_track(df, ["seq"]).collect()}
