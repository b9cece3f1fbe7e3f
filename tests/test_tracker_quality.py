"""Tracker quality, association and anchors against plain versions written from the rules."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import anchors, association, joins, tracker_metrics
from fieldlens.streaming import live
from fieldlens.streaming.association import associate_stream

BOX = "seq string, frame bigint, {} bigint, x double, y double, w double, h double"


def overlap(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


def best(worth):
    """The assignment of greatest worth, by trying all."""
    n, m = worth.shape
    if n > m:
        return [(i, j) for j, i in best(worth.T)]
    return max(([*enumerate(p)] for p in itertools.permutations(range(m), n)), key=lambda x: sum(worth[i, j] for i, j in x))


def frames_of(rows):
    out = {}
    for f, who, *box in rows:
        out.setdefault(f, []).append((who, box))
    return out


def plain_hota(truth, tracks):
    gt, tr = frames_of(truth), frames_of(tracks)
    people, ids = sorted({r[1] for r in truth}), sorted({r[1] for r in tracks})
    ng, nt = ({k: sum(r[1] == k for r in rows) for k in names} for rows, names in ((truth, people), (tracks, ids)))
    every = range(min([*gt, *tr]), max([*gt, *tr]) + 1)
    sims = {f: np.array([[overlap(a, b) for _, b in tr.get(f, [])] for _, a in gt.get(f, [])]).reshape(len(gt.get(f, [])), len(tr.get(f, []))) for f in every}
    met = {}
    for f, s in sims.items():
        for i, j in zip(*np.nonzero(s)):
            k = gt[f][i][0], tr[f][j][0]
            met[k] = met.get(k, 0) + s[i, j] / (s[i].sum() + s[:, j].sum() - s[i, j])
    aligned = {(g, t): v / (ng[g] + nt[t] - v) for (g, t), v in met.items()}
    out = {}
    for alpha in range(5, 100, 5):
        tp, count, loc = 0, {}, 0.0
        for f, s in sims.items():
            if s.size:
                worth = np.array([[aligned.get((g, t), 0) * s[i, j] for j, (t, _) in enumerate(tr[f])] for i, (g, _) in enumerate(gt[f])])
                for i, j in best(worth):
                    if s[i, j] >= alpha / 100 - 1e-12:
                        k = gt[f][i][0], tr[f][j][0]
                        count[k], tp, loc = count.get(k, 0) + 1, tp + 1, loc + s[i, j]
        ass = sum(n * n / (ng[g] + nt[t] - n) for (g, t), n in count.items()) / max(1, tp)
        fn, fp = len(truth) - tp, len(tracks) - tp
        det = tp / (tp + fn + fp)
        out[alpha] = (tp, fn, fp, det, ass, loc / tp if tp else 1.0, (det * ass) ** 0.5)
    return out


def plain_clear(truth, tracks, least=0.5):
    gt, tr, last, before, tp, switches = frames_of(truth), frames_of(tracks), {}, {}, 0, 0
    for f in sorted(set(gt) & set(tr)):
        s = np.array([[overlap(a, b) for _, b in tr[f]] for _, a in gt[f]])
        worth = np.where(s >= least - 1e-12, s + [[1000.0 * (before.get(g) == t) for t, _ in tr[f]] for g, _ in gt[f]], 0)
        before = {gt[f][i][0]: tr[f][j][0] for i, j in best(worth) if worth[i, j] > 0}
        switches += sum(g in last and last[g] != t for g, t in before.items())
        tp, last = tp + len(before), {**last, **before}
    return tp, len(truth) - tp, len(tracks) - tp, switches, (tp - (len(tracks) - tp) - switches) / len(truth)


@pytest.fixture(scope="module")
def scene():
    """Ten frames of four people who cross, with tracks that are shaky, missing, doubled and swapped."""
    rng = np.random.default_rng(7)
    truth, tracks = [], []
    for f in range(1, 11):
        for g in range(4):
            if (f, g) in {(3, 1), (4, 1)}:
                continue
            x, y = 20.0 * g + (f * 4 if g % 2 else -f * 4), 5.0 * g
            truth.append((f, g, x, y, 30.0, 60.0))
            if rng.random() < 0.85 and f != 6:
                t = g if f < 6 or g not in (0, 2) else 2 - g
                tracks.append((f, 10 + t, x + rng.normal(0, 4), y + rng.normal(0, 4), 30.0 + rng.normal(0, 2), 60.0))
        if f % 4 == 0:
            tracks.append((f, 99, 25.0, 8.0, 30.0, 60.0))
    return truth, tracks


def tables(spark, scene, seqs=("s",)):
    return [spark.createDataFrame([(s, *r) for s in seqs for r in rows], BOX.format(who)).repartition(3) for rows, who in zip(scene, ("gt_id", "track_id"))]


def test_hota_equals_the_plain_version(spark, scene):
    truth, tracks = tables(spark, scene, ("s", "t"))
    got = tracker_metrics.hota(truth, tracks, ["seq"])
    want = plain_hota(*scene)
    rows = got.collect()
    assert len(rows) == 2 * 19
    for r in rows:
        assert tuple(r)[2:] == pytest.approx(want[r.alpha])
    both = {r.alpha: r for r in tracker_metrics.combined_hota(got).collect()}
    assert both[50].tp == 2 * want[50][0] and both[50].hota == pytest.approx(want[50][6])


def test_switches_and_accuracy_equal_the_plain_version(spark, scene):
    truth, tracks = tables(spark, scene)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for least in (0.3, 0.5, 0.7):
            (r,) = tracker_metrics.clear_counts(truth, tracks, ["seq"], least=least).collect()
            assert (r.tp, r.fn, r.fp, r.switches, r.mota) == pytest.approx(plain_clear(*scene, least))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert r.switches >= 0 and plain_clear(*scene, 0.3)[3] > 0


def test_tracker_scores_without_tracks_or_truth(spark, scene):
    truth, tracks = tables(spark, scene)
    rows = tracker_metrics.hota(truth, tracks.limit(0), ["seq"]).collect()
    assert len(rows) == 19 and all((r.tp, r.fn, r.fp, r.hota) == (0, len(scene[0]), 0, 0) for r in rows)
    assert tracker_metrics.tracker_report(truth.limit(0), tracks.limit(0), ["seq"]).collect() == []
    (r,) = tracker_metrics.tracker_report(truth, truth.withColumnRenamed("gt_id", "track_id"), ["seq"]).collect()
    assert (r.hota, r.det_a, r.ass_a, r.mota, r.idf1, r.switches) == pytest.approx((1, 1, 1, 1, 1, 0))


def test_identity_score_is_the_best_naming(spark, scene):
    truth, tracks = scene
    gt, tr = frames_of(truth), frames_of(tracks)
    people, ids = sorted({r[1] for r in truth}), sorted({r[1] for r in tracks})
    met = np.zeros((len(people), len(ids)))
    for f in set(gt) & set(tr):
        for g, a in gt[f]:
            for t, b in tr[f]:
                met[people.index(g), ids.index(t)] += overlap(a, b) >= 0.5
    n = sum(met[i, j] for i, j in best(met))
    (r,) = tracker_metrics.identity_scores(*tables(spark, scene), ["seq"]).collect()
    assert r.idtp == n and r.idf1 == pytest.approx(2 * n / (len(truth) + len(tracks)))


# ---- association


def walk(seed, n=60, objects=4):
    """Boxes that move evenly, some missing, some unsure."""
    rng = np.random.default_rng(seed)
    rows, truth = [], []
    for f in range(1, n + 1):
        for k in range(objects):
            x, y = 100.0 * k + 1.5 * f * (1 if k % 2 else -1), 50.0 * k + 0.5 * f
            truth.append((f, k, x, y, 40.0, 80.0))
            if rng.random() > 0.08 and not (k == 1 and 20 <= f < 26):
                rows.append((f, x + rng.normal(0, 0.5), y + rng.normal(0, 0.5), 40.0, 80.0, 0.15 if rng.random() < 0.15 else 0.8))
    return rows, truth


DETS = "seq string, frame bigint, x double, y double, w double, h double, conf double"


def test_tracks_follow_objects(spark):
    rows, truth = walk(1)
    dets = spark.createDataFrame([("s", *r) for r in rows], DETS)
    tracks = association.associate(dets, ["seq"]).cache()
    (r,) = tracker_metrics.tracker_report(spark.createDataFrame([("s", *r) for r in truth], BOX.format("gt_id")), tracks, ["seq"]).collect()
    assert r.switches == 0 and r.ass_a > 0.8 and tracks.select("track_id").distinct().count() == 4
    assert association.associate(dets.limit(0), ["seq"]).collect() == []


def test_tracks_do_not_depend_on_batches(spark):
    rows, _ = walk(2)
    dets = spark.createDataFrame([(s, *r) for s in ("s", "t") for r in rows] + [("s", None, 1.0, 1.0, 1.0, 1.0, 0.9), ("s", 5, None, 1.0, 1.0, 1.0, 0.9)], DETS).repartition(5)
    want = sorted(map(tuple, association.associate(dets, ["seq"]).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, association.associate(dets, ["seq"]).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r[2:] for r in want if r[0] == "s"] == [r[2:] for r in want if r[0] == "t"]


@pytest.mark.parametrize("cuts", [(60,), (1, 2, 30, 60), (7, 20, 23, 41, 60)])
def test_stream_of_detections_equals_batch(spark, tmp_path, cuts):
    rows, _ = walk(3)
    dets = spark.createDataFrame([(s, *r) for s in ("s", "t") for r in rows], DETS)
    want = sorted(map(tuple, association.associate(dets, ["seq"]).collect()))
    source, before = str(tmp_path / "in"), 0
    for k, end in enumerate(cuts):
        dets.where(F.col("frame").between(before + 1, end)).coalesce(1).write.mode("append").parquet(source)
        before = end
        live.run_available(associate_stream(spark.readStream.schema(dets.schema).parquet(source)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("seq", "frame", "track_id", "x", "y", "w", "h", "conf").collect())) == want
    dets.where("frame < 5").write.mode("append").parquet(source)  # late
    live.run_available(associate_stream(spark.readStream.schema(dets.schema).parquet(source)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_lost_tracks_are_kept_for_the_buffer():
    t = association.Tracks(association.Tracker(buffer=5))
    box = np.array([[10.0, 10.0, 20.0, 40.0, 0.9]])
    for f in range(1, 4):
        assert [r[0] for r in t.step(f, box)] == [1]
    assert [r[0] for r in t.step(8, box)] == [1]  # four frames without it
    t.step(15, box)
    assert [r[0] for r in t.step(16, box)] == [2]  # six frames without it: a new one, seen twice
    low = np.array([[10.0, 10.0, 20.0, 40.0, 0.15]])
    assert [r[0] for r in t.step(17, low)] == [2] and t.step(18, np.array([[300.0, 10.0, 20.0, 40.0, 0.15]])) == []


# ---- anchors


def plain_align(p, q, gate=6.0, rounds=12):
    moved = [complex(*x) for x in p]
    start, target = list(moved), [complex(*x) for x in q]
    if len(p) < 2 or len(q) < 2:
        return []
    for _ in range(rounds):
        pick = [min(range(len(target)), key=lambda j: abs(a - target[j])) for a in moved]
        use = [i for i, j in enumerate(pick) if abs(moved[i] - target[j]) <= gate]
        if len(use) < 2:
            break
        cp, cq = (sum(v) / len(use) for v in ([start[i] for i in use], [target[pick[i]] for i in use]))
        turn = sum((start[i] - cp).conjugate() * (target[pick[i]] - cq) for i in use)
        turn = turn / abs(turn) if abs(turn) > 0 else 1
        moved = [(a - cp) * turn + cq for a in start]
    pick = [min(range(len(target)), key=lambda j: abs(a - target[j])) for a in moved]
    back = [min(range(len(moved)), key=lambda i: abs(moved[i] - b)) for b in target]
    return [(i, j) for i, j in enumerate(pick) if abs(moved[i] - target[j]) <= gate and back[j] == i]


@pytest.mark.parametrize("seed", range(6))
def test_alignment_follows_the_rule(spark, seed):
    rng = np.random.default_rng(seed)
    p = rng.uniform(-40, 40, (10, 2))
    a = rng.normal(0, 0.05)
    q = (p @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + rng.normal(0, 1.5, 2) + rng.normal(0, 0.3, p.shape))[rng.permutation(10)[: 8 if seed % 2 else 10]]
    q = np.vstack([q, rng.uniform(-40, 40, (2, 2))])
    assert anchors.align(p, q) == plain_align(p, q) and len(anchors.align(p, q)) >= 6
    assert anchors.align(p[:1], q) == [] and anchors.align(p, q + 500) == []


def test_pairs_of_anchors_and_identities(spark):
    rng = np.random.default_rng(3)
    at = rng.uniform(-30, 30, (8, 2))
    rows = []
    for k, f in enumerate((10, 50, 90)):
        place = at + [k * 1.0, -0.5 * k] + rng.normal(0, 0.1, at.shape)
        rows += [("s", f, i + 100 * k, *map(float, x)) for i, x in enumerate(place) if (i, k) != (3, 1)]
    tracks = spark.createDataFrame(rows, "seq string, frame bigint, track_id bigint, x_m double, y_m double")
    found = spark.createDataFrame([("s", 10), ("s", 50), ("s", 90), ("other", 5)], "seq string, frame bigint")
    pairs = anchors.aligned_pairs(found, tracks, ["seq"])
    got = {(r.frame_a, r.frame_b, r.a, r.b) for r in pairs.collect()}
    assert got == {(10, 50, i, i + 100) for i in range(8) if i != 3} | {(50, 90, i + 100, i + 200) for i in range(8) if i != 3}
    roots = {r.track_id: r.root for r in anchors.carried(pairs, tracks, ["seq"]).collect()}
    assert roots == {i + 100 * k: 203 if (i, k) == (3, 2) else i for i in range(8) for k in range(3) if (i, k) != (3, 1)}
    moved = {r.frame_b: r.n_pairs for r in anchors.moved_between(pairs, tracks, ["seq"]).collect()}
    assert moved == {50: 7, 90: 7}


def test_slowest_frame_of_a_run_is_the_anchor(spark):
    rows = [("s", f, 8, v, 20.0, 1, 4, 4) for f, v in [(1, 0.9), (2, 0.4), (3, 0.4), (4, 0.8), (30, 0.1), (31, 0.1), (60, 1.0), (61, 5.0), (62, 0.5), (63, 0.7), (64, 0.6)]]
    frames = spark.createDataFrame(rows, "seq string, frame bigint, n bigint, speed double, spread double, in_circle bigint, left bigint, right bigint")
    c = anchors.Anchors()
    got = {(r.start, r.end, r.n_rows, r.frame) for r in anchors.anchors(frames, ["seq"], anchors.settled_like(c), c).collect()}
    assert got == {(1, 4, 4, 2), (60, 64, 4, 62)}
    assert anchors.anchors(frames.withColumn("in_circle", F.lit(3)), ["seq"], anchors.kickoff_like(c), c).count() == 0


def test_strict_mutual_nearest(spark):
    rows = [(1, 10, 1.0), (1, 11, 2.0), (2, 10, 0.5), (2, 11, 3.0), (3, 12, 1.0)]
    pairs = spark.createDataFrame(rows, "a int, b int, d double")
    assert {(r.a, r.b) for r in joins.mutual_nearest(pairs, [], "a", "b", "d", strict=True).collect()} == {(2, 10), (3, 12)}
    assert {(r.a, r.b) for r in joins.mutual_nearest(pairs, [], "a", "b", "d").collect()} == {(2, 10), (3, 12)}
