"""Every operator on texts: nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import bisect
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldlens.llm import attention_lm, bpe, common, fingerprints, line_dedup, near_embeddings, ngram_join, packing, quality_gam, sharding, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("id", "n", "a", "b", "place", "part", "block", "kind", "key", "size", "slot", "shard", "score", "held_out", "features", "quality", "hash", "words", "line", "kept", "n_lines", "doc", "of_text", "total")
LONG = " ".join(f"w{i * 7919 % 30011}" for i in range(60_000))
TIE = "the same words stand in this text once and again"
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, TIE), (6, TIE), (6, TIE), (7, LONG), (8, "x" * 300_000), (None, "a text without an id goes through too"), (None, None), (-9, "Ünïcödé 日本語 \U0001f642 text of a negative id")]
TIK, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def labels(docs):
    return docs.where("doc_id is not null").select("doc_id", (F.abs("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))


OPERATORS = {
    "bpe": lambda d: bpe.digest_documents(d, TIK, P.PATTERN),
    "ngram_join": ngram_join.link_documents,
    "ngram_join_keep": ngram_join.keep_one,
    "quality_gam": lambda d: quality_gam.scored(d, quality_gam.train(d, labels(d))),
    "quality_gam_keep": lambda d: quality_gam.keep_good(d, quality_gam.train(d, labels(d))),
    "attention_lm": lambda d: attention_lm.score_documents(d, TIK, P.PATTERN),
    "sharding": lambda d: sharding.shard_documents(d, 4),
    "line_dedup": lambda d: line_dedup.deduplicate(d, short=True),
    "packing": lambda d: packing.pack(packing.tokenise(d, JSON, P.PATTERN)),
    "fingerprints": fingerprints.compare_with_edits,
}
FILTERS = ("ngram_join_keep", "quality_gam_keep", "line_dedup")


def docs(spark, rows, clash):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH))) if clash else df


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_with_clashing_columns(spark, name):
    d = docs(spark, ROWS, True)
    out = OPERATORS[name](d)
    got = out.collect()
    ids = Counter(r.doc_id for r in got)
    if name in FILTERS:
        assert out.columns == d.columns and set(ids) <= {i for i, _ in ROWS}
    elif name == "packing":
        assert set(ids) == {i for i, _ in ROWS} and ids[7] > 60
    else:
        assert ids == Counter(i for i, _ in ROWS)
    if name in ("bpe", "quality_gam", "sharding", "fingerprints"):
        plain = OPERATORS[name](docs(spark, ROWS, False))
        keep = [c for c in plain.columns if c not in ("slot", "shard")]
        assert sorted(map(str, out.select(keep).collect())) == sorted(map(str, plain.select(keep).collect()))
    if name == "quality_gam":
        assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    if name == "attention_lm":
        assert len({r.score for r in got if r.doc_id == 6}) == 1 and all(r.score < 0 for r in got)
    if name == "fingerprints":
        assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](docs(spark, [], True)).collect() == []


@pytest.mark.parametrize("name", ["ngram_join", "line_dedup", "attention_lm", "quality_gam", "packing"])
def test_only_nulls_and_empty_texts(spark, name):
    rows = [(1, None), (2, ""), (3, None), (None, "")]
    got = OPERATORS[name](docs(spark, rows, False)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)


def test_shard_bytes_are_near_equal(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randrange(0, 60)) for i in range(20_000)]
    got = sharding.shard_documents(docs(spark, rows, False), 40).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in got]
    assert len(sizes) == 40 and max(sizes) < 1.02 * min(sizes)


def test_shard_bytes_are_near_equal_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{i} " + "word " * rng.randrange(0, 60)) for i in range(20_000)]
    got = sharding.shard_documents(docs(spark, rows, False), 40)
    sizes = [r.s for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 40 and max(sizes) < 1.02 * min(sizes)
    assert {r.map_version for r in got.select("map_version").distinct().collect()} == {2}


def test_binary_search_of_bounds(spark):
    for n in (1, 2, 255, 1000, 20_000):
        bounds = sorted(random.Random(n).sample(range(10 * n), n))
        keys = [-1, 0, bounds[0], bounds[-1], bounds[n // 2], bounds[n // 2] + 1, 10 * n + 5]
        df = spark.createDataFrame([(k,) for k in keys], "k bigint")
        got = [r.p for r in df.select(fingerprints.up_to(F.from_json(F.lit(str(bounds)), "array<bigint>"), n, F.col("k")).alias("p")).collect()]
        assert got == [bisect.bisect_right(bounds, k) for k in keys]


def test_labelled_ids_train_once(spark, monkeypatch):
    rows = [(i, f"text number {i} of some words") for i in range(60) for _ in range(5)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(60) for _ in range(3)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_gam, "fit", lambda x, y: seen.append(len(y)))
    quality_gam.train(docs(spark, rows, True), marks)
    monkeypatch.setattr(quality_gam, "MAX_TRAIN", 10)
    quality_gam.train(docs(spark, rows, True), marks)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(60)), 10]


def hot_lines():
    rng = random.Random(6)
    words = ["stone", "river", "light", "window", "garden", "paper"]
    boiler = "all rights reserved by the owners of this page"
    return [(i, "\n".join([boiler, " ".join(rng.choice(words) for _ in range(9)) + f" {i}", boiler[:-1] + "s" if i % 50 == 0 else "x"])) for i in range(400)]


def test_repeats_of_a_line_meet_once(spark, monkeypatch):
    d = docs(spark, hot_lines(), False).repartition(4)
    want = sorted(map(str, line_dedup.deduplicate(d, short=True).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(str, line_dedup.deduplicate(d, short=True).collect())) == want
    keys = spark.createDataFrame([(1, 1, 0)] * 500 + [(1, 2, 5), (2, 2, 1)], "key bigint, id bigint, at int").repartition(4)
    got = line_dedup.meeting(keys, spark.createDataFrame([(1,)], "key bigint"), 2)
    assert sorted(map(tuple, got.collect())) == [(1, 1, True), (1, 2, False)]


def test_a_shingle_that_all_texts_share_is_sent_once_a_block(spark):
    tokens = np.array([5 << 16, 7 << 16, 5 << 16, 9 << 16, 7 << 16, 5 << 16, 11 << 16], np.uint64)
    kept, owners, own = ngram_join._combined(tokens, np.array([0, 0, 1, 1, 2, 3, 3]), 5)
    assert (kept >> np.uint64(16)).tolist() == [5, 7, 9, 11] and owners.tolist() == [ngram_join.SEVERAL, ngram_join.SEVERAL, 1, 3] and own.tolist() == [2, 1, 1, 1, 0]
    assert ngram_join._combined(tokens[:0], np.zeros(0, int), 2)[2].tolist() == [0, 0]
    rng = random.Random(2)
    licence = "this text is free for all to use as they like best".split()
    rows = []
    for i in range(300):
        body = [f"w{rng.randrange(400)}" for _ in range(20)]
        rows.append((i, " ".join(body + licence)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(body + licence + ["end"])))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(docs(spark, rows, False).repartition(3)).collect()}
    for i in range(0, 300, 10):
        a, b = sets[i], sets[1000 + i]
        assert (got[1000 + i] == got[i]) == (100 * len(a & b) >= 75 * len(a | b))
    assert sum(k != v for k, v in got.items()) == 30


def test_near_next_equals_jaccard_below_k(spark):
    rng = random.Random(8)
    base = [f"v{rng.randrange(900)}" for _ in range(150)]
    rows = [(i, " ".join(base[: 150 - 10 * i])) for i in range(6)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    got = {r.doc_id: r.near_next for r in fingerprints.compare_with_edits(docs(spark, rows, False)).collect()}
    for i in range(6):
        a, b = sets[i], sets[(i + 1) % 6]
        assert got[i] == pytest.approx(len(a & b) / len(a | b))


def test_held_out_rows_follow_the_checksum(spark):
    rows = [(i, f"text number {i}") for i in range(40)]
    got = OPERATORS["quality_gam"](docs(spark, rows, False)).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows}
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_checkpoints_need_a_shared_folder_off_the_local_machine(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.ensure_checkpoint_dir(session)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline_from_end_to_end(spark, tmp_path, rows):
    d = docs(spark, rows, True)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels(d).write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality(spark, d, str(tmp_path)).collect()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in kept} and bool(got) == bool(kept)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(x))]
        assert [a for a, _ in sorted(x)] == ends[:-1] and ends[-1] <= 1024


def test_vectors_with_odd_rows_and_clashing_columns(spark):
    v = [1.0, 0.5, -0.25, 2.0]
    rows = [(1, v, 0), (2, [2 * x for x in v], 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0] * 4, 0), (7, [float("nan")] * 4, 0), (8, [1.0, None, 1.0, 1.0], 0), (9, [-x for x in v], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("id", "a", "b", "n", "hash", "key", "part", "component", "tree", "leaf"))))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_embeddings.link_embeddings(df, 0.93).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), **{i: (0, i, True) for i in range(3, 10)}}


def test_pages_with_repeated_and_null_ids(spark, tmp_path):
    rows = [(5, "<p>a</p>"), (5, "<p>a</p>"), (2, "<p>b</p>"), (None, "<p>b</p>"), (None, None), (7, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("url", F.lit("http://x"))
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), keep_payload=False).collect()
    assert len(got) == 6 and sorted(r.payload_bytes for r in got) == [0, 0, 8, 8, 8, 8]
    assert sum(r.record_type == "response" for r in got) >= 3
