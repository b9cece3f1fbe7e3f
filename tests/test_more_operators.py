"""Projection, signals, diagnosis, reports, the job store and file forms on hand-made rows: ties, thresholds, nulls, single rows and empty tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import diagnosis, folds, joins, projection, ranking, signals, windows
from fieldlens.plans import jobs
from fieldlens.sources import files



def test_projection_drops_frames_without_matrix(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "frame int, x double, y double")
    h = spark.createDataFrame([(1, [2.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "frame int, h array<double>")
    assert [tuple(r) for r in projection.on_pitch(rows, h).collect()] == [(1, 2.0, 3.0, 5.0, 3.0)]
    assert projection.on_pitch(rows, h.limit(0)).count() == 0
    assert [r.frame for r in projection.every_frame(h.drop("frame").withColumn("n", F.lit(3)), "n").collect()] == [1, 2, 3]


def test_near_player_without_boxes_is_near(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)], "frame int, bx double, by double")
    boxes = spark.createDataFrame([(1, 10.0, 0.0, 5.0, 5.0), (2, 10.1, 0.0, 5.0, 5.0)], "frame int, x double, y double, w double, h double")
    assert [r.near for r in projection.near_player(b, boxes, ["frame"], "bx", "by", 10.0).orderBy("frame").collect()] == [True, False, True]


@pytest.mark.parametrize("n,k", [(1, 4), (4, 4), (9, 4), (10, 3)])
def test_spread_sample_as_slices(spark, n, k):
    rows = spark.createDataFrame([(1, f) for f in range(n)], "track_id int, frame int")
    assert sorted(r.frame for r in projection.spread_sample(rows, ["track_id"], ["frame"], k).collect()) == list(range(n))[:: max(1, n // k)][:k]


def test_flight_flags_and_aerial(spark):
    b = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, None, None), ("s", 3, 0.5, 0.0), ("s", 4, 3.0, 0.0)], "seq string, frame int, x double, y double")
    got = projection.aerial_suspects(b, ["seq"], "frame", "x", "y", fps=10.0, top=5.0).orderBy("frame").collect()
    assert [r.aerial for r in got] == [False, False, False, True]  # 0.5 a frame is not beyond, the gap doesn't count
    f = projection.in_flight(F.col("x"), F.col("y"), F.lit(None).cast("double"), 100.0, 0.1, 5.0)
    assert [r.f for r in b.select(f.alias("f")).collect()] == [True, False, True, True]


def test_features_as_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = np.cumsum(rng.normal(0, 0.1, 40)), np.cumsum(rng.normal(0, 0.1, 40))
    lost = {5, 6, 7, 20, 39}
    rows = [("s", i + 1, "lost" if i in lost else "detected", None if i in lost else float(x[i]), None if i in lost else float(y[i])) for i in range(40)]
    got = signals.ball_features(spark.createDataFrame(rows, "seq string, frame bigint, status string, pitch_x_m double, pitch_y_m double")).orderBy("i").toPandas()
    known = [i for i in range(40) if i not in lost]
    px, py = (np.interp(range(40), known, v[known]) for v in (x, y))
    speed = np.convolve(np.pad(np.hypot(np.gradient(px), np.gradient(py)) * 25, 2, mode="edge"), np.ones(5) / 5, mode="valid")
    speed[sorted(lost)] = 0
    assert np.allclose(got["px"], px) and np.allclose(got["speed"], speed)
    assert np.allclose(got["d_pos"], np.hypot(52.5 - px, py)) and (got["h_pos"][sorted(lost)] == 0).all()


def test_break_causes_in_order(spark):
    t = [(1, 1, 500, 500)]  # a blip
    t += [(2, f, 500 + f, 500) for f in (1, 2)] + [(3, 3, 503, 500), (3, 4, 504, 500)]  # 2 goes on as 3 at once, 3 ends for good
    t += [(4, f, 20, 500) for f in (1, 2)]  # at the edge
    t += [(5, f, 900, 900) for f in (1, 2)] + [(6, f, 900, 910) for f in range(1, 30)]  # beside another; goes on as 8
    t += [(8, f, 900, 901) for f in (10, 11)]
    t += [(9, f, 1200, 300) for f in (1, 2)] + [(10, f, 1200, 310) for f in (12, 13)]  # found again much later
    df = spark.createDataFrame([("s", a, f, float(x), float(y), 40.0) for a, f, x, y in t], "seq string, track_id bigint, frame bigint, cx double, cy double, h double")
    got = {r.track_id: r.cause for r in diagnosis.break_causes(df).collect()}
    assert got == {1: "BLIP", 2: "FLICKER", 3: "GENUINE_END", 4: "EDGE", 5: "OCCLUSION", 6: "GENUINE_END", 8: "GENUINE_END", 9: "FAST_MOTION", 10: "GENUINE_END"}
    assert diagnosis.break_causes(df.limit(0)).count() == 0


def test_idf1_is_the_best_naming(spark):
    rng = np.random.default_rng(2)
    m = rng.integers(0, 9, (4, 5))
    rows = [("s", g, t) for g in range(4) for t in range(5) for _ in range(m[g, t])]
    got = diagnosis.identity_f1(spark.createDataFrame(rows, "seq string, gt_id int, track_id int"), spark.createDataFrame([("s", 120), ("none", 3)], "seq string, n bigint"), ["seq"]).collect()
    best = max(sum(m[g, t] for g, t in enumerate(p)) for p in itertools.permutations(range(5), 4))
    by = {r.seq: r for r in got}
    assert by["s"].idtp == best and by["s"].idf1 == pytest.approx(2 * best / (2 * best + (m.sum() - best) + (120 - best))) and by["none"].idf1 == 0


def test_greedy_matches_by_confidence(spark):
    p = [("f", 1, 10, 0.6, 0.9), ("f", 1, 11, 0.8, 0.9), ("f", 2, 11, 0.95, 0.5), ("f", 2, 10, 0.55, 0.5)]
    df = spark.createDataFrame(p, "frame string, a int, b int, iou double, conf double")
    assert {(r.a, r.b) for r in joins.greedy_matches(df, ["frame"], "iou", "a", "b", first="conf").collect()} == {(1, 11), (2, 10)}
    assert {(r.a, r.b) for r in joins.greedy_matches(df, ["frame"], "iou", "a", "b").collect()} == {(2, 11), (1, 10)}


def test_camera_goes_from_ball_to_holder_to_centre(spark):
    ball = [("s", f, st, 1.0 if st != "lost" else None, 1.0 if st != "lost" else None) for f, st in enumerate(["detected", "predicted", "predicted", "lost", "lost", "detected"], 1)]
    players = [("s", f, 7, 2.0, 2.0) for f in (1, 2, 3, 4, 6)] + [("s", f, 8, 50.0, 50.0) for f in range(1, 7)]
    p = spark.createDataFrame(players, "seq string, frame int, track_id int, px double, py double")
    c = p.groupBy("seq", "frame").agg(F.avg("px").alias("mx"), F.avg("py").alias("my"))
    got = diagnosis.camera_target(spark.createDataFrame(ball, "seq string, frame int, status string, x double, y double"), p, c, ["seq"], short=1, bind=5.0).orderBy("frame").collect()
    assert [(r.source, r.tx, r.holder) for r in got] == [("ball", 1.0, 7), ("pred", 1.0, 7), ("holder", 2.0, 7), ("holder", 2.0, 7), ("centroid", 50.0, 7), ("ball", 1.0, 7)]


def test_chains_and_cycles(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(1, 20)] + [(100, 101), (101, 100)], "id bigint, parent bigint")
    got = {r.id: r.root for r in folds.resolve_chains(links).collect()}
    assert got == {**{i: 1 for i in range(2, 21)}, 100: 100, 101: 101}
    assert sorted(tuple(r) for r in folds.dense_components(spark.createDataFrame([(5, 9), (6, 3), (7, 9)], "id int, root int")).collect()) == [(5, 1), (6, 0), (7, 1)]
    assert folds.resolve_chains(links.limit(0)).count() == 0


def test_covered_points_keep_their_number(spark):
    pts = spark.createDataFrame([("a", 5), ("a", 5), ("a", 9), ("b", 5)], "k string, at int")
    rng = spark.createDataFrame([("a", 1, 5), ("a", 4, 8)], "k string, s int, e int")
    assert sorted((r.k, r.at, r.covered) for r in joins.contained(pts, rng, "at", "s", "e", ["k"]).collect()) == [("a", 5, True), ("a", 5, True), ("a", 9, False), ("b", 5, False)]


def test_global_rank_is_gapless(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = windows.global_rank(df, ["v", "id"], "no").orderBy("v", "id").toPandas()["no"].tolist()
    assert got == list(range(1, 1001))


def test_jobs_rules(spark):
    j = spark.createDataFrame([(1, 10, "submitted", 3), (2, 10, "quota_waiting", 2), (3, 11, "quota_waiting", 1), (4, 11, "uploading", 4)], "job_id int, user_id int, state string, created_at int")
    assert [r.job_id for r in jobs.promoted(j, 10, 5).collect()] == [3] and jobs.promoted(j, 5, 5).count() == 0
    d = spark.createDataFrame([(1, "approve"), (4, "approve"), (2, "reject"), (3, "other")], "job_id int, action string")
    assert {r.job_id: (r.allowed, r.next_state) for r in jobs.decided(j, d).collect()} == {1: (True, "approved"), 4: (False, "uploading"), 2: (True, "rejected"), 3: (False, "quota_waiting")}
    admins = spark.createDataFrame([(99,)], "user_id int")
    assert jobs.visible(j, 10, admins).count() == 2 and jobs.visible(j, 99, admins).count() == 4 and jobs.visible(j, 12, admins).count() == 0
    assert [r.job_id for r in jobs.insertable(j, 10).collect()] == [1]
    new = jobs.updated(j, spark.createDataFrame([(1, "queued", 77)], "job_id int, state string, user_id int"))
    assert {(r.job_id, r.state, r.user_id) for r in new.collect() if r.job_id == 1} == {(1, "queued", 10)}
    u = spark.createDataFrame([(1, 10, 0), (2, 10, 10), (3, 9, 4)], "job_id int, total bigint, done bigint")
    assert [r.header for r in jobs.chunk_ranges(u, 4).orderBy("job_id", "start").collect()] == ["bytes 0-3/10", "bytes 4-7/10", "bytes 8-9/10", "bytes 4-7/9", "bytes 8-8/9"]
    paths = ["a/b", "/a", "../a", "a/../b", "a..b", "C:\\x", "a\\..\\b", "\\x"]
    got = {r.p: r.ok for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", jobs.safe_path(F.col("p")).alias("ok")).collect()}
    assert {p for p, ok in got.items() if ok} == {"a/b", "a..b"}
    assert spark.range(1).select(jobs.friendly(F.lit("?")).alias("m")).first().m == jobs.OTHER_STAGE


def test_manifests_of_both_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"clips": [{"clip": "x/y/c1.mp4", "track_id": 3}]}')
    (tmp_path / "b.json").write_text('[{"clip_id": "c2.mp4", "clip": "z"}]')
    assert sorted((r.clip_id, r.track_id) for r in jobs.manifest(spark, str(tmp_path)).collect()) == [("c1.mp4", 3), ("c2.mp4", None)]


def test_ball_truth_of_both_forms(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"3": [1.5, 2.5]}')
    (tmp_path / "b.txt").write_text("4,1,2\n5.0 3 4 9\nbad,1,2\n6 1\n")
    assert sorted(tuple(r) for r in files.ball_truth(spark, str(tmp_path)).collect()) == [(3, 1.5, 2.5), (4, 1.0, 2.0), (5, 3.0, 4.0)]


def test_records_go_out_in_order_and_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, 1, 0.5), ("a", 1, 2, 0.25), ("b", 1, 1, 1.0)], "seq string, frame int, track_id int, x double")
    for form in ("json", "csv", "parquet"):
        files.write_records(rows, str(tmp_path / form), form)
        back = spark.read.format(form).options(**({"header": "true"} if form == "csv" else {})).load(str(tmp_path / form))
        assert sorted((r.seq, int(r.frame)) for r in back.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_mot_stream_writes_what_has_arrived(spark, tmp_path):
    kind = "seq string, frame int, track_id int, x double, y double, w double, h double, conf double"
    spark.createDataFrame([("a", 1, 2, 1.0, 2.0, 3.0, 4.0, 0.5)], kind).write.parquet(str(tmp_path / "in"))
    q = files.stream_mot(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1,2,1.00,2.00,3.00,4.00,0.50,-1,-1,-1"]


def test_layouts_and_annotated_images(spark):
    p = spark.createDataFrame([("r/test/images/a.jpg",), ("r/images/test/b.jpg",), ("r/test/labels/a.txt",)], "path string")
    assert sorted((r.what, r.stem) for r in files.split_listing(p, "r", "test").collect()) == [("images", "a"), ("labels", "a")]
    assert files.split_listing(p, "r", "val").count() == 0
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 20.0)], "frame int, xtl double, ytl double, xbr double, ybr double")
    imgs = spark.createDataFrame([(1, "a", 100, 100), (2, "b", 100, 100)], "frame int, image string, width int, height int")
    assert [(r.cx, r.h) for r in files.annotated_images(boxes, imgs).orderBy("frame").collect()] == [(0.05, 0.2), (None, None)]


def test_reports_on_empty_tables(spark):
    t = spark.createDataFrame([], "seq string, track_id int, frame int, x double, y double, status string")
    assert ranking.most_tracked(t).count() == 0 and ranking.plausibility(t, ["seq"], 1.0, 1.0, 1.0).count() == 0
    assert signals.frame_signals(t, ["seq"], "x", "y").count() == 0 and diagnosis.provided_state(t, ["seq"]).count() == 0
    best = ranking.best_cut(spark.createDataFrame([(0.1, 0), (0.9, 1), (0.8, 1)], "s double, y int"), "s", "y", 9).first()
    assert (best.recall, best.reject) == (1.0, 1.0) and best.threshold == pytest.approx(0.2)
