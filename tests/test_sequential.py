"""Folds, camera paths, clusters and the job queue against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import clusters, sequential, signals, tracking
from fieldlens.streaming import live, queue


@pytest.fixture
def tiny_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def follow(targets, vmax, accel, decel, zone):
    at, v, out = targets[0], 0.0, [targets[0]]
    for t in targets[1:]:
        far = abs(t - at) - zone
        goal = np.sign(t - at) * min(vmax, (2 * decel * far) ** 0.5) if far > 0 else 0.0
        step = accel if abs(goal) > abs(v) else decel
        v = goal if abs(goal - v) <= step else v + np.sign(goal - v) * step
        at += v
        out.append(at)
    return out


def test_rate_limits_follow_the_rule(spark, tiny_batches):
    rng = np.random.default_rng(1)
    paths = {k: np.cumsum(rng.normal(0, 2, n)) for k, n in (("a", 90), ("b", 1), ("c", 37))}
    df = spark.createDataFrame([(k, i, float(v), float(-v)) for k, p in paths.items() for i, v in enumerate(p)], "k string, i bigint, x double, y double").repartition(4)
    got = sequential.rate_limited(df, ["k"], "i", ["x", "y"], 1.5, 0.3, 0.2, 0.7).orderBy("k", "i").toPandas()
    for k, p in paths.items():
        assert np.allclose(got[got.k == k].x, follow(p.tolist(), 1.5, 0.3, 0.2, 0.7)) and np.allclose(got[got.k == k].y, follow((-p).tolist(), 1.5, 0.3, 0.2, 0.7))


def test_targets_in_the_dead_zone_are_left(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 0.4, -0.5, 0.3, 0.5])], "k string, i bigint, x double")
    assert {r.x for r in sequential.rate_limited(df, ["k"], "i", ["x"], 5.0, 1.0, 1.0, 0.5).collect()} == {0.0}


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 11, 23, 200])
def test_low_pass_in_folds_equals_the_array_version(spark, tiny_batches, n):
    v = np.cumsum(np.random.default_rng(n).normal(0, 1, n))
    df = spark.createDataFrame([(k, i, float(x), float(2 * x)) for k in ("a", None) for i, x in enumerate(v)], "k string, i bigint, x double, y double").repartition(3)
    got = sequential.zero_phase(df, ["k"], "i", ["x", "y"], 1.2, 25.0).orderBy("k", "i").toPandas()
    want = tracking.low_pass(v, 1.2, 25.0)
    assert len(got) == 2 * n and np.allclose(got.x, np.tile(want, 2)) and np.allclose(got.y, 2 * np.tile(want, 2))


def test_low_pass_keeps_slow_waves_and_drops_fast_ones():
    t = np.arange(400) / 25.0
    slow, fast = np.sin(2 * np.pi * 0.2 * t), np.sin(2 * np.pi * 8 * t)
    got = tracking.low_pass(slow + fast, 1.2, 25.0)[50:-50]
    assert np.abs(got - slow[50:-50]).max() < 0.03


def test_keys_change_within_and_between_batches(spark, tiny_batches):
    df = spark.createDataFrame([(i % 5 if i % 5 else None, i) for i in range(97)], "k bigint, i bigint")
    out = sequential.fold_batches(df, ["k"], ["i"], lambda: 0, lambda s, p: (s + len(p), p.iloc[:0]), "k bigint, i bigint", lambda s, key: __import__("pandas").DataFrame({"k": [key[0]], "i": [s]}))
    assert {(r.k, r.i) for r in out.collect()} == {(None, 20), (1, 20), (2, 19), (3, 19), (4, 19)}


def test_ball_weight_streaks(spark):
    rows = [("s", i, st, air) for i, (st, air) in enumerate([("predicted", False), ("detected", False), ("predicted", False), ("lost", False), ("predicted", False), ("predicted", True), ("detected", True), ("lost", True)])]
    df = spark.createDataFrame(rows, "seq string, i int, st string, air boolean")
    got = [r.w for r in df.withColumn("w", sequential.ball_weight(F.col("st"), F.col("air"), ["seq"], "i")).orderBy("i").collect()]
    assert got == pytest.approx([0.8, 1.0, 0.8, 0.0, 0.8 * math.exp(-2 / 6), 0.25 * 0.7, 0.25, 0.0])


# ---- clusters


def test_clusters_of_many_groups(spark):
    rng = np.random.default_rng(5)
    rows, data = [], {}
    for g in range(6):
        x = np.vstack([rng.normal(0, 1, (20 + g, 3)), rng.normal(2, 1, (15, 3))])
        data[g] = x
        rows += [(g, i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (9, 0, [1.0, 2.0, 3.0]), (8, 0, None)], "g bigint, i bigint, v array<double>")
    got = clusters.kmeans_by_group(df.repartition(7), ["g"], "i", "v").toPandas()
    again = clusters.kmeans_by_group(df.repartition(2), ["g"], "i", "v").toPandas()
    key = ["g", "i"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert len(got) == len(rows) + 1 and set(got[got.g == 9].cluster) == {0}
    for g, x in data.items():
        mine = got[got.g == g]
        assert np.isclose((mine.dist**2).sum(), mine.inertia.iloc[0])
        least = min(plain_inertia(x, np.random.default_rng(s)) for s in range(60))
        assert mine.inertia.iloc[0] <= least * 1.001


def plain_inertia(x, rng):
    c = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(50):
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.stack([x[label == k].mean(0) if (label == k).any() else c[k] for k in range(2)])
    return ((x[:, None] - c) ** 2).sum(2).min(1).sum()


def test_directions_equal_a_singular_value_decomposition(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (80, 5)) @ np.diag([5, 3, 2, 1, 0.5]) @ rng.normal(0, 1, (5, 5)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "i bigint, v array<double>").repartition(4)
    centre, directions, squares = clusters.principal(df, "v", 3)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(centre, x.mean(0)) and np.allclose(squares, s[:3] ** 2)
    assert all(abs(np.dot(a, b)) == pytest.approx(1) and max(a, key=abs) > 0 for a, b in zip(directions, vt))
    low = df.where("v is not null").select("i", clusters.projected("v", centre, directions).alias("low")).orderBy("i").toPandas()
    assert np.allclose(np.stack(low.low.to_list()), c @ np.array(directions).T)
    assert np.allclose([r.value for r in clusters.gram(df, "v").orderBy("i", "j").collect()], (c.T @ c)[np.triu_indices(5)])


def test_anchor_of_sure_rows(spark):
    df = spark.createDataFrame([(True, [3.0, 0.0]), (True, [1.0, 4.0]), (False, [9.0, 9.0]), (None, [1.0, 1.0])], "sure boolean, v array<double>")
    assert clusters.sure_anchor(df, "v", F.col("sure")) == pytest.approx([2 / 8**0.5, 2 / 8**0.5])


# ---- features


def test_goal_zone_is_deep_and_narrow(spark):
    rows = [("s", i + 1, "detected", x, y) for i, (x, y) in enumerate([(41.0, 8.5), (41.0, 9.5), (40.0, 0.0), (-45.0, -8.0), (50.0, 11.0)])]
    got = signals.ball_features(spark.createDataFrame(rows, "seq string, frame bigint, status string, pitch_x_m double, pitch_y_m double"), top=1e9).orderBy("i").collect()
    assert [r.in_goal_zone for r in got] == [True, False, False, True, False]


# ---- the queue


def plain_queue(jobs, until):
    out, waiting = [], {}
    for pool in {j[0] for j in jobs}:
        steps = sorted([(j[3], 0, j[1]) for j in jobs if j[0] == pool and j[2] == "quota_waiting"] + [(j[4], 1, j[1]) for j in jobs if j[0] == pool and j[2] == "ready" and j[4] is not None])
        waiting = []
        for at, kind, job in steps:
            if kind == 0:
                waiting.append(job)
            elif at <= until:
                out.append((pool, job, "expired", at))
                if waiting:
                    out.append((pool, waiting.pop(0), "approved", at))
    return sorted(out)


def test_queue_on_timers_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    jobs = []
    for i in range(300):
        created = int(rng.integers(0, 300_000)) * 1000
        state = ["ready", "quota_waiting", "submitted"][rng.integers(3)]
        jobs.append((f"p{i % 3}", i, state, created, created + 1000 * int(rng.choice([5_000, 20_000, 20_000])) if state == "ready" and i % 17 else None))
    jobs.sort(key=lambda j: j[3])
    kind = "pool string, job_id bigint, state string, created_at timestamp, expires_at timestamp"

    def frame(rows):
        return spark.createDataFrame(rows, "pool string, job_id bigint, state string, c bigint, e bigint").select("pool", "job_id", "state", F.timestamp_millis("c").alias("created_at"), F.timestamp_millis("e").alias("expires_at"))

    source = str(tmp_path / "in")
    for part in (jobs[:100], jobs[100:230], jobs[230:]):
        frame(part).coalesce(1).write.mode("append").parquet(source)
        live.run_available(queue.queue_stream(spark.readStream.schema(kind).parquet(source), "1 minute"), str(tmp_path / "out"), str(tmp_path / "state"))
    until = max(j[3] for j in jobs) - 60_000
    want = plain_queue(jobs, until)
    pick = [F.col("pool"), F.col("job_id"), F.col("state"), F.unix_millis("at").alias("at")]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*pick).collect())) == want
    assert sorted(map(tuple, queue.queue_batch(frame(jobs), F.timestamp_millis(F.lit(until))).select(*pick).collect())) == want
    assert any(r[2] == "approved" for r in want)
