import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import evaluation, homography

H = np.array([[0.09, 0.004, -55.0], [-0.003, 0.11, -40.0], [0.00002, 0.0001, 1.0]])
POINTS = "g int, name string, x double, y double, u double, v double"


def marked(spark, n, wrong=(), seed=0, noise=0.0, groups=(1,)):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        p = rng.uniform(0, 1000, (n, 2))
        q = homography.mapped(H, p) + rng.normal(0, noise, (n, 2)) if noise else homography.mapped(H, p)
        for i in range(n):
            off = 25.0 if i in wrong else 0.0
            rows.append((g, f"p{i:02d}", *map(float, p[i]), float(q[i][0] + off), float(q[i][1] - off)))
    return spark.createDataFrame(rows, POINTS)


@pytest.mark.parametrize("n,wrong", [(6, (2,)), (30, (0, 3, 4, 9, 11, 20)), (4, ())])
def test_consensus_ignores_wrong_points(n, wrong):
    rng = np.random.default_rng(n)
    p = rng.uniform(0, 1000, (n, 2))
    q = homography.mapped(H, p)
    q[list(wrong)] += 30
    h, good = homography.consensus(p, q, 0.1)  # six points can be bent to within a metre of a wrong one
    assert set(np.flatnonzero(~good)) == set(wrong) and np.allclose(h, H, atol=1e-6)


def test_too_few_or_in_a_line():
    line = np.array([[i, 2.0 * i] for i in range(6)])
    for p in (line[:3], line):
        with pytest.raises(ValueError):
            homography.consensus(p, p, 1.0)


def test_fits_hold_out_a_fifth(spark):
    r = homography.fit_homographies(marked(spark, 20), ["g"]).first()
    assert (r.n_points, r.n_inliers, len(r.errors)) == (20, 16, 4) and r.holdout < 1e-6 and np.allclose(np.reshape(r.h, (3, 3)), H, atol=1e-6)
    few = homography.fit_homographies(marked(spark, 4), ["g"]).first()
    assert few.errors == [] and few.holdout is None and few.n_inliers == 4
    assert homography.fit_homographies(marked(spark, 3), ["g"]).count() == 0
    assert homography.fit_homographies(marked(spark, 8).limit(0), ["g"]).count() == 0
    assert homography.fit_homographies(marked(spark, 8).withColumn("x", F.lit(None).cast("double")), ["g"]).count() == 0


def test_fits_do_not_depend_on_how_rows_lie(spark):
    df = marked(spark, 25, wrong=(1, 2), noise=0.05, groups=(1, 2, 3))
    a, b = (sorted((r.g, tuple(r.h), r.holdout) for r in homography.fit_homographies(x, ["g"]).collect()) for x in (df, df.orderBy(F.desc("x")).repartition(3)))
    assert a == b


def test_leave_one_out_finds_the_wrong_point(spark):
    got = {r.name: r.error for r in homography.leave_one_out(marked(spark, 9, wrong=(4,)), ["g"], "name").collect()}
    assert len(got) == 9 and got["p04"] == pytest.approx(25 * 2**0.5, abs=1e-3) and max(e for k, e in got.items() if k != "p04") < 1e-3
    assert homography.leave_one_out(marked(spark, 4), ["g"], "name").count() == 0


def test_pruning_drops_wrong_points_only(spark):
    got = {r.name: (r.kept, r.error) for r in homography.prune_outliers(marked(spark, 12, wrong=(2, 7)), ["g"], "name").collect()}
    assert {k for k, (kept, _) in got.items() if not kept} == {"p02", "p07"} and got["p02"][1] > 2 and got["p00"] == (True, None)
    assert all(r.kept for r in homography.prune_outliers(marked(spark, 4), ["g"], "name").collect())


def test_refinement_comes_nearer(spark):
    rng = np.random.default_rng(5)
    dets, tags, off = [], [], H.copy()
    off[:2, 2] += (1.0, -0.8)
    for f in range(10):
        p = rng.uniform(100, 1000, (12, 2))
        q = homography.mapped(H, p)
        dets += [(1, f, float(x), float(y), off.ravel().tolist()) for x, y in p]
        tags += [(1, f, float(u), float(v)) for u, v in q]
    d = spark.createDataFrame(dets, "g int, frame int, x double, y double, h array<double>")
    t = spark.createDataFrame(tags, "g int, frame int, u double, v double")
    r = homography.refine_homographies(d, t, ["g"]).first()
    assert r.held_median < 0.01 and r.n_held == 60 and r.n_pairs > 50
    alone = homography.refine_homographies(d, t.limit(0), ["g"]).first()
    assert alone.h == off.ravel().tolist() and alone.n_held == 0 and alone.held_median is None


def test_association_keeps_the_nearest_of_a_tag():
    assert sorted(homography.associate(np.array([[0, 0], [0.5, 0], [9, 9.0]]), np.array([[0.6, 0], [50, 50.0]]), 1.0)) == [(1, 0)]


def test_probe_learns_a_direction(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 8))
    rows = spark.createDataFrame([(r.tolist(), int(r[0] - r[3] > 0)) for r in x] + [(None, 1), ([0.0] * 8, None)], "vec array<double>, good int")
    w, b = evaluation.train_probe(rows, "vec", "good")
    p = rows.where("vec is not null and good is not null").select("good", evaluation.appearance_score("vec", w, b).alias("p"))
    assert p.where((F.col("p") >= 0.5) == (F.col("good") == 1)).count() > 390 and w[0] > 0 > w[3]
