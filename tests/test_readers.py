"""File readers, crops, delivery folders and the shared folder."""

import json

import pytest
from pyspark.sql import functions as F

from fieldlens.functions import geometry as g
from fieldlens.operators import evaluation, identity
from fieldlens.plans import jobs
from fieldlens.sources import files, shared


def test_tracks_of_a_frame_window(spark, tmp_path):
    (tmp_path / "A.txt").write_text("1,7,10,20,30,40,0.9,-1,-1,-1\n5,7,11,20,30,40,0.8,-1,-1,-1\n\n9,8,1,2,3,4,0.5,-1,-1,-1\n")
    got = files.mot(spark, str(tmp_path), 2, 8).collect()
    assert [(r.seq, r.frame, r.track_id, r.foot_x, r.foot_y, r.cx, r.cy) for r in got] == [("A", 5, 7, 26.0, 60.0, 26.0, 40.0)]
    assert {r.frame for r in files.mot(spark, str(tmp_path)).collect()} == {1, 5, 9}


def test_cached_detections_by_centre(spark, tmp_path):
    (tmp_path / "S.txt").write_text("3,10,20,4,8,0.7\n\n")
    assert [tuple(r) for r in files.detections(spark, str(tmp_path)).collect()] == [("S", 3, 12.0, 24.0, 4.0, 8.0, pytest.approx(0.7))]


def test_game_state(spark, tmp_path):
    doc = {
        "images": [{"image_id": "3000001", "file_name": "000001.jpg"}, {"image_id": "3000002", "file_name": "000002.jpg"}],
        "annotations": [
            {"image_id": "3000002", "track_id": 4, "category_id": 1, "bbox_image": {"x": 1, "y": 2, "w": 3, "h": 4}, "bbox_pitch": {"x_bottom_middle": 5.5, "y_bottom_middle": -6.5}, "attributes": {"team": "left", "role": "player"}},
            {"image_id": "3000001", "track_id": 9, "category_id": 4, "bbox_image": {"x": 1, "y": 2, "w": 3, "h": 4}, "bbox_pitch": None, "attributes": {"team": None, "role": "ball"}},
            {"image_id": "3000001", "track_id": 5, "category_id": 2, "bbox_image": {"x": 9, "y": 8, "w": 7, "h": 6}, "bbox_pitch": None, "attributes": {"team": "right", "role": "goalkeeper"}},
        ],
    }
    (tmp_path / "G.json").write_text(json.dumps(doc, indent=1))
    got = sorted(files.game_state(spark, str(tmp_path)).collect(), key=lambda r: r.frame)
    assert [(r.seq, r.frame, r.track_id, r.x, r.x_bottom_middle, r.team, r.role) for r in got] == [("G", 1, 5, 9.0, None, "right", "goalkeeper"), ("G", 2, 4, 1.0, 5.5, "left", "player")]


def test_frame_of_an_action(spark):
    df = spark.createDataFrame([(1000, 0), (1020, 0), (1060, 0), (30_000, 10_000)], "p bigint, s bigint")
    assert [r.f for r in df.select(files.action_frame(F.col("p"), F.col("s")).alias("f")).collect()] == [25, 26, 26, 500]  # 25.5 and 26.5 go to even


def test_sensor_samples(spark, tmp_path):
    lines = ["2013-11-03 18:00:00.500000,5,30.5,20.25,0,0,0,1.5,0", "2013-11-03 18:00:00,9,1,2,0,0,0,0.5,0", "rubbish", "2013-11-03 18:00:01,x,1,2,0,0,0,0,0", "2013-11-03 18:00:02,3,,2,0,0,0,0,0"]
    (tmp_path / "z.csv").write_text("\n".join(lines) + "\n")
    got = files.sensors(spark, str(tmp_path)).collect()
    assert [(r.tag, r.x, r.y, r.speed) for r in got] == [(9, 1.0, 2.0, 0.5), (5, 30.5, 20.25, 1.5)]


def test_label_lines(spark, tmp_path):
    (tmp_path / "im_1.txt").write_text("0 0.5 0.25 0.1 0.2\n1.0 0 0 1 1\n0 0.5 0.5\n\n")
    got = sorted(map(tuple, files.yolo_labels(spark, str(tmp_path)).collect()))
    assert got == [("im_1", 0, 0.5, 0.25, 0.1, 0.2), ("im_1", 1, 0.0, 0.0, 1.0, 1.0)]


def test_annotated_tracks(spark, tmp_path):
    box = '<box frame="{}" outside="{}" xtl="1.5" ytl="2" xbr="11.5" ybr="22"/>'
    (tmp_path / "a.xml").write_text(f'<annotations><track id="0" label="ball">{box.format(3, 0)}{box.format(4, 1)}{box.format(5, 0)}</track><track id="1" label="player">{box.format(6, 0)}{box.format(7, 0)}</track></annotations>')
    got = sorted(map(tuple, files.annotation_xml(spark, str(tmp_path / "a.xml")).collect()))
    assert got == [(3, 1.5, 2.0, 11.5, 22.0), (5, 1.5, 2.0, 11.5, 22.0)]


def test_what_is_not_done_yet(spark):
    listed = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "name string")
    assert sorted(r.name for r in files.unseen(listed, spark.createDataFrame([("a",)], "name string"), "name").collect()) == ["b", "c"]


def test_parts_and_squares_of_boxes(spark):
    df = spark.createDataFrame([(10.0, 20.0, 40.0, 100.0), (-30.0, 5.0, 20.0, 20.0)], "x double, y double, w double, h double")
    got = df.select(F.array(*g.sub_box("x", "y", "w", "h", 0.25, 0.75, 0.2, 0.55)).alias("t"), F.array(*g.square_crop("x", "y", "w", "h", 1.2, 200, 120)).alias("s")).collect()
    assert got[0].t == [20.0, 40.0, 20.0, 35.00000000000001] or got[0].t == pytest.approx([20, 40, 20, 35])
    assert got[0].s == [0.0, 10.0, 90.0, 120.0] and got[1].s == [0.0, 3.0, -8.0, 27.0]


def test_folders_of_deliveries(spark):
    paths = ["s/player_highlights/reels/a.mp4", "s/events/clips/b.mp4", "s/coach/c.csv", "s/report.pdf", "s/tmp/x.json"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.f for r in df.select(jobs.delivery_folder(F.col("p")).alias("f")).collect()] == ["player_highlights", "event_highlights", "coach_analytics", "coach_analytics", None]


def test_off_the_court_is_excluded_first(spark):
    df = spark.createDataFrame([(1, 9.0, 0, 0.1), (2, 8.0, 0, 0.9), (3, 1.0, 0, 0.9), (4, 1.0, 1, 0.5), (5, 1.0, 1, None)], "track_id int, mean_dist double, majority_cluster int, court double")
    got = {r.track_id: r.role for r in identity.outlier_roles(df, 0.7, "court").collect()}
    assert got == {1: "Excluded", 2: "Referee", 3: "TeamA", 4: "TeamB", 5: "TeamB"}


def test_labels_that_match_nothing(spark):
    labels = spark.createDataFrame([(1, "A"), (2, "bench")], "idx int, hand string")
    manifest = spark.createDataFrame([(1, "s", 5)], "idx int, seq string, track_id int")
    (r,) = evaluation.label_validation(labels, manifest, spark.createDataFrame([], "seq string, track_id int, role string")).collect()
    assert (r.n_labelled, r.n_matched, r.n_scored, r.accuracy, r.others_excluded) == (2, 0, 0, None, None)
    (r,) = evaluation.label_validation(labels, manifest, spark.createDataFrame([("s", 5, "TeamB")], "seq string, track_id int, role string")).collect()
    assert (r.n_matched, r.n_scored, r.accuracy_direct, r.accuracy, r.accuracy_a) == (1, 1, 0.0, 1.0, 1.0)


def test_checkpoints_need_a_shared_folder_off_the_local_machine():
    class Absent:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Absent()

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    session = type("Session", (), {"conf": Absent(), "sparkContext": Context()})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.checkpoint(type("Frame", (), {"sparkSession": session})())
