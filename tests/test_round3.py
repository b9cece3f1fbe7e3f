"""What differed from its SQL, or grew faster than its input, on larger tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from fieldlens.functions.text import printed
from fieldlens.operators import joins, projection, tracker_metrics
from fieldlens.plans import events
from fieldlens.streaming import live


def test_numbers_are_printed_as_c_prints_them(spark):
    values = [0.0, -0.0, 0.5, 1.5, 2.5, 0.25, 0.35, 1.005, 0.125, 9.96, 99.5, -2.5, -0.04, 2.0**49 + 0.5, 1041.39 / 7 + 0.0123, *(k / 800 for k in range(4000))]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in range(4):
        got = rows.select("v", printed(F.col("v"), digits).alias("t")).collect()
        assert [(r.v, r.t) for r in got] == [(r.v, "%.*f" % (digits, r.v)) for r in got]
    half = spark.range(1).select(*projection.calibration_quality(F.lit(None).cast("double"), F.lit(2.5), F.lit("football"))).first()
    assert half.value == "2 px"


def test_rim_of_equal_distances_is_the_first_frame(spark):
    """Distances that rounding alone sets apart are equal in the SQL too."""
    d = [5.0, 1.0 + 1e-15, 1.0, *[5.0] * 60]
    rows = [("s", i, x, 5.0, -1.0, 0.0, True, 1, False) for i, x in enumerate(d)]
    f = spark.createDataFrame(rows, "seq string, i bigint, d_left double, d_right double, hd_left double, hd_right double, detected boolean, possession int, flip boolean")
    none = spark.createDataFrame([], "seq string, type string, start bigint, end bigint, peak bigint, confidence double")
    (r,) = events.made_baskets(f, none).collect()
    assert r.peak == 1 and math.isclose(r.confidence, 0.6)
    frames = spark.createDataFrame([("s", len(d))], "seq string, n bigint")
    (m,) = events.moments(events.made_baskets(f, none).drop("hoop"), frames, events.INTEREST, gap=20, longest=275).collect()
    assert (m.peak, m.rank) == (1, 1)


def test_new_ids_count_in_the_window_of_their_least_time(spark, tmp_path):
    """Whichever file of a batch is read first."""
    late = [(u, f"2024-01-01 05:{m:02d}:30") for u in ("7", "8", "null") for m in range(60)] + [("9", "2024-01-02 00:00:00")]
    early = [(u, "2024-01-01 04:10:30.25") for u in ("7", "null")] + [("8", "2024-01-01 04:12:00")]
    for name, rows in (("a", late), ("b", early)):
        texts = ", ".join(f"({u}, timestamp '{t}')" for u, t in rows)
        spark.sql(f"select cast(user_id as bigint) as user_id, ts from values {texts} t(user_id, ts)").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{name}"))
    stream = spark.readStream.schema("user_id bigint, ts timestamp").parquet(str(tmp_path / "in/*"))
    live.run_available(live.new_ids(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(str(r.start), r.new_ids) for r in spark.read.schema("start timestamp, new_ids bigint").parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01 04:10:00", 2), ("2024-01-01 04:12:00", 1)}


def test_sparse_matching_is_as_heavy_as_dense():
    rng = np.random.default_rng(3)
    for t in range(1000):
        n, m = rng.integers(1, 9, 2)
        w = (rng.integers(0, 4, (n, m)).astype(float) if t % 2 else rng.random((n, m))) * (rng.random((n, m)) < rng.random())
        i, j = np.nonzero(w)
        kept = joins.heaviest(i.tolist(), j.tolist(), w[i, j].tolist())
        assert math.isclose(w[i, j][kept].sum(), sum(w[a, b] for a, b in joins.assign(-w)), abs_tol=1e-9)
        assert len(set(i[kept])) == kept.sum() == len(set(j[kept]))


def test_boxes_of_two_ids_that_meet_twice_in_a_frame_count_by_the_best(spark):
    """Whichever of them comes last."""
    box = "seq string, frame bigint, {} bigint, x double, y double, w double, h double"
    truth = spark.createDataFrame([("s", 1, 1, 0.0, 0.0, 10.0, 10.0)], box.format("gt_id"))
    for places in ((0.0, 4.0), (4.0, 0.0)):
        tracks = spark.createDataFrame([("s", 1, 5, x, 0.0, 10.0, 10.0) for x in places], box.format("track_id")).coalesce(1)
        assert {r.tp for r in tracker_metrics.hota(truth, tracks, ["seq"]).collect()} == {1}
