"""Registered queries do their whole job: no rows are left out as the tables grow."""

from pyspark.sql import functions as F

from fieldlens import catalog
from fieldlens.sources import fixtures


def test_kalman_tracks_every_frame(spark):
    sf = "/root/testdata/sf0.01"  # its longest sequences have over 2,000 frames
    ball = fixtures.view(spark, sf, "ball").where("status <> 'lost'").groupBy("seq").agg(F.max("frame").alias("last"))
    want = {r.seq: r["last"] for r in ball.collect()}
    got = {r.seq: r.n for r in catalog.queries()["kalman_track"](spark, sf).groupBy("seq").agg(F.count("*").alias("n")).collect()}
    assert max(want.values()) > 2000
    assert got == want
