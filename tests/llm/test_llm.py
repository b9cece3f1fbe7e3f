"""Corpus operators against brute force, libraries and round trips, with nulls, empty and long texts, ties and clashing columns."""

import base64
import gzip
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldlens.llm import attention_lm, bpe, components, fingerprints, line_dedup, near_embeddings, ngram_join, packing, quality_gam, sharding, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = ["", " ", "a  b", " x", "x ", "\n\n a\n b", "a" * 5000, "'ss 's it's", "a b 　c", "é" * 300, "ab" * 900 + " " + "x" * 901, "<|endoftext|> 12 345", "日本語 \U0001f642\U0001f642", "\x1c a\x1cb", "Tab\there, there. there!"]


def corpus(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)
    return df.withColumn("id", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("a", F.lit(2)).withColumn("place", F.lit(0)) if extra else df


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "en", "or", "ai", "su"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, short, empty, null and unrelated texts."""
    rng = random.Random(5)
    out = [(i, words(rng, rng.randrange(1, 120))) for i in range(60)]
    base = words(rng, 90).split()
    for k in range(12):
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"edit{k}{rng.randrange(99)}"
        out.append((100 + k, " ".join(w)))
    return [*out, (200, None), (201, ""), (202, "one two"), (203, "ONE two"), (204, out[0][1]), (205, "line one is here now\nline two is here too\nline one is here now"), (206, "x" * 200_000)]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark, texts, tik):
    rows = [*texts, *((1000 + i, t) for i, t in enumerate(ODD))]
    got = {r.doc_id: r for r in bpe.digest_documents(corpus(spark, rows, True), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in rows:
        ids = tik.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digest_documents(corpus(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_queue_one_by_one_is_the_same(tik):
    data, kind = bpe.load(P.path("byte_bpe_50k.json"))
    v = bpe.encoder(data, P.PATTERN, kind).vocabulary
    pieces = [b"abcabcaaaa", b"thethethe", b"aaaaaaaaaaaaaaaaa", b"x", b"", "éè".encode() * 9]
    assert v.encode(pieces) == [v.encode_one(p) for p in pieces] == [tuple(tik.encode_ordinary(p.decode())) for p in pieces]
    bits, ranks = bpe.RankBitmap(70_000), [5, 69_999, 4096, 63, 64, 5]
    for x in ranks:
        bits.add(x)
    assert [bits.pop() for _ in range(6)] == [5, 63, 64, 4096, 69_999, -1]


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 16))
    x = np.concatenate([base, base[:60] + 0.1 * rng.standard_normal((60, 16)), base[:5], base[:5] * 2, base[0] + 0.02 * rng.standard_normal((600, 16))])
    label = [int(i) % 3 for i in range(len(x) - 600)] + [0] * 600
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, label))]
    bad = [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] * 16, 0), (5003, [float("inf")] + [1.0] * 15, 0), (5004, x[0].tolist(), None), (5005, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("leaf", F.lit(1))
    got = {r.vec_id: r for r in near_embeddings.link_embeddings(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    forest = components.Forest(len(x))
    for i, j in zip(*np.nonzero(near)):
        forest.join(int(i), int(j))
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= near[i].sum() for i in range(len(x))) and found >= 0.99 * near.sum()
    assert np.mean([got[i].component_id == forest.root(i) for i in range(len(x))]) > 0.99
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(5000, 5006)) and len(got) == len(rows) + 6
    assert near_embeddings.link_embeddings(df.limit(0)).count() == 0
    twice = near_embeddings.link_embeddings(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.0, 0.0], 0)], "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in twice) == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    return out


def groups(texts):
    s = sets_of(texts)
    ids = list(s)
    forest = components.Forest(len(ids))
    for a, b in itertools.combinations(range(len(ids)), 2):
        x, y = s[ids[a]], s[ids[b]]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            forest.join(a, b)
    least = {}
    for k, i in enumerate(ids):
        least[forest.root(k)] = min(i, least.get(forest.root(k), i))
    return {i: (len(s[i]), least[forest.root(k)]) for k, i in enumerate(ids)}


def test_ngram_join_equals_brute_force(spark, texts, monkeypatch):
    want = groups(texts)
    for size in (512, 3):  # small blocks, too
        monkeypatch.setattr(ngram_join, "GROUP", size)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(corpus(spark, texts, True)).collect()}
        assert got == want
    kept = {r.doc_id for r in ngram_join.keep_one(corpus(spark, texts)).collect()}
    assert kept == {c for _, c in want.values()}
    assert ngram_join.link_documents(corpus(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, long), (2, long + " tail"), (3, "other " + long[: len(long) // 2]), (5, "a b c d e f g h"), (5, "one two three four five six"), (6, "a b c d e f g h"), (4, "one two three four five six")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(corpus(spark, rows, True)).collect())
    assert got == [(1, 39_996, 1), (2, 39_997, 1), (3, len(long[: len(long) // 2].split()) - 3, 3), (4, 2, 4), (5, 2, 4), (5, 4, 5), (6, 4, 5)]
    assert sorted((r.doc_id, r.text[:3]) for r in ngram_join.keep_one(corpus(spark, rows)).collect()) == [(1, "w0 "), (3, "oth"), (4, "one"), (5, "a b")]
    null = ngram_join.link_documents(corpus(spark, [(None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert {(r.doc_id, r.component_id) for r in null} == {(None, None), (1, 1)}


def test_trie_finds_what_it_should():
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(30), rng.randrange(1, 25))) for _ in range(60)]
    trie = ngram_join.Trie()
    for k, s in enumerate(sets):
        trie.add(s, len(s), k)
    for s in sets:
        want = {k for k, t in enumerate(sets) if 100 * len(set(s) & set(t)) >= 75 * len(set(s) | set(t))}
        assert set(trie.matches(s, len(s))) == want


def test_quality_model_learns_and_scores_all(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality_gam.train(docs, labels)
    got = quality_gam.scored(docs.unionByName(corpus(spark, [(10**6, None), (10**6 + 1, "")])), model).toPandas()
    assert len(got) == docs.count() + 2 and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"]))
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    assert set(quality_gam.scored(docs, quality_gam.train(docs, labels.limit(0))).toPandas()["score"]) == {0.5}


def test_gam_beats_the_base_rate_held_out():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)  # a pair, which no single feature shows
    m = quality_gam.fit(x[:2000], y[:2000])
    assert np.mean((m.score(x[2000:]) > 0.5) == y[2000:]) > 0.95


def test_attention_is_causal_and_gradients_hold():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 500, 70).astype(np.int32)
    sample, targets, _ = attention_lm.windows(ids, np.array([0, 70]))
    m = attention_lm.Model(attention_lm.fresh(rng), rng.integers(0, attention_lm.CLASSES, attention_lm.N_IDS).astype(np.int32), np.zeros(attention_lm.N_IDS, np.float32), np.full(attention_lm.N_IDS, attention_lm.TOP), np.zeros((attention_lm.TOP + 1,) * 2, np.float32), np.zeros(attention_lm.N_IDS, np.float32))
    changed = sample.copy()
    changed[0, -1] = 7
    a, b = m.forward(sample), m.forward(changed)
    assert np.allclose(a[0, :-1], b[0, :-1]) and not np.allclose(a[0, -1], b[0, -1])
    assert np.allclose(np.exp(a).sum(-1), 1, atol=1e-4)
    fast = m.class_log_probability(sample, m.class_of[np.where(targets >= 0, targets, 0)])
    assert np.allclose(fast, np.take_along_axis(a, m.class_of[np.where(targets >= 0, targets, 0)][..., None], -1)[..., 0], atol=1e-4)
    assert (targets >= 0).sum() == 70 and sorted(targets[targets >= 0]) == sorted(ids)
    _, g = m.gradients(sample, targets)
    for k in ("q", "o", "down", "out"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w, old = m.weights[k], m.weights[k][i]
        w[i] = old + 1e-2
        up = m.gradients(sample, targets)[0]
        w[i] = old - 1e-2
        assert (up - m.gradients(sample, targets)[0]) / 2e-2 == pytest.approx(g[k][i], rel=0.3)
        w[i] = old


def test_base_scores_equal_brute_force(spark, texts):
    rows = texts
    got = {r.doc_id: r for r in attention_lm.score_documents(corpus(spark, rows, True), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = {}
    for i, w in toks.items():
        for x in w if not held[i] else []:
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, w in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)) and r.score < 0


def test_sharding(spark, texts):
    rows = [*texts, *((1000 + i, "word " * (i % 40)) for i in range(3000))]
    got = sharding.shard_documents(corpus(spark, rows, True), 8).toPandas()
    want = {i: len((t or "").encode()) + 16 for i, t in rows}
    assert dict(zip(got["doc_id"], got["size"])) == want and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    assert dict(zip(got["doc_id"], got["text_crc32"])) == {i: zlib.crc32((t or "").encode()) for i, t in rows}
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])
    assert sharding.shard_documents(corpus(spark, []), 8).count() == 0


def test_slot_maps_are_edited_little(spark, tmp_path):
    rng = np.random.default_rng(0)
    w = rng.integers(50, 150, 4096).tolist()
    first = sharding.place(w, 40)
    loads = np.bincount(first.shard_of, w, 40)
    assert loads.max() - loads.min() <= max(w)
    w2 = [x * 3 if k == 0 else x for x, k in zip(w, first.shard_of)]
    second = sharding.rebalance(first, w2)
    l2 = np.bincount(second.shard_of, w2, 40)
    assert second.version == 2 and l2.max() < 1.1 * l2.mean() and len(second.moved) < 300
    assert all(a == b for s, (a, b) in enumerate(zip(first.shard_of, second.shard_of)) if s not in set(second.moved))
    for m in (first, second):
        m.save(spark, str(tmp_path / "maps"))
    assert sharding.load_map(spark, str(tmp_path / "maps")).shard_of == second.shard_of
    assert sharding.load_map(spark, str(tmp_path / "maps"), 1).shard_of == first.shard_of


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def kept_lines(rows, short=False):
    lines = [(i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if len(x) >= line_dedup.MIN_CHARS or short and x.strip()]
    first = {}
    for i, k, x in sorted(lines):
        first.setdefault(x, (i, k))
    names = list(first)
    forest = components.Forest(len(names))
    for a, b in itertools.combinations(range(len(names)), 2):
        if min(len(names[a]), len(names[b])) >= line_dedup.MIN_CHARS and abs(len(names[a]) - len(names[b])) <= 2 and edit(names[a], names[b]) <= 2:
            forest.join(a, b)
    best = {}
    for k, x in enumerate(names):
        best[forest.root(k)] = min(first[x], best.get(forest.root(k), first[x]))
    keep = set(best.values())
    gone = {(i, k) for i, k, _ in lines} - keep
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    base = [words(rng, 6) + " tail" for _ in range(12)]
    def change(x):
        x = list(x)
        for _ in range(rng.randrange(0, 4)):
            p, o = rng.randrange(len(x)), rng.random()
            x[p : p + 1] = [] if o < 0.3 else [x[p], "z"] if o < 0.6 else ["q"]
        return "".join(x)
    rows = [(i, "\n".join(change(rng.choice(base)) for _ in range(rng.randrange(1, 5)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "short\nshort\n\n"), (53, base[0]), (54, "y" * 30_000)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(corpus(spark, rows, True)).collect()}
    assert got == kept_lines(rows)
    assert line_dedup.deduplicate(corpus(spark, [])).count() == 0
    short = {r.doc_id: r.text for r in line_dedup.deduplicate(corpus(spark, [(1, "Les.\n\nLes."), (2, "les.\nLes.\n "), (None, "Les.\n\n ")]), short=True).collect()}
    assert short == {None: "Les.\n\n ", 1: "", 2: "les.\n "}


def test_lines_of_one_large_near_group(spark):
    """Many lines that share segments, some within two edits of each other, most not."""
    rng = random.Random(12)
    base = words(rng, 14).split()
    lines = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            p = rng.randrange(len(w))
            w[p] = rng.choice([w[p] + "x", w[p][:-1] or "q", "".join(rng.choice("abcdefgh") for _ in w[p])])
        lines.append(" ".join(w))
    rows = [(i, x) for i, x in enumerate(lines)]
    for rounds in (0, 2):
        line_dedup.ROUNDS, kept = rounds, line_dedup.ROUNDS
        try:
            got = {r.doc_id: r.text for r in line_dedup.deduplicate(corpus(spark, rows)).collect()}
        finally:
            line_dedup.ROUNDS = kept
        assert got == kept_lines(rows)
    assert line_dedup.deduplicate(corpus(spark, rows)).columns == corpus(spark, rows).columns


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abé\U0001f642 ") for _ in range(rng.randrange(0, 30)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randrange(0, 2)] = rng.choice(["", "a", "c"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), edits).alias("d")).collect():
        d = edit(r.a, r.b)
        assert (r.d == d) if d <= edits else (r.d > edits)


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    pages = [(i, f"http://x.example/{i} a", rng.choice(["<p>same</p>", "<p>é</p>" * i, None, ""])) for i in range(40)] + [(99, None, "long " * 100_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("first", F.lit(1)).withColumn("sha", F.lit("x"))
    warc.write_archives(df, str(tmp_path / "w"))
    got = {int(r.record_id): r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    first = {}
    for i, _, h in pages:
        first.setdefault(h or "", i)
    for i, _, h in pages:
        r, data = got[i], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", str(first[h or ""])))
        assert r.record_type == "revisit" or bytes(r.payload) == data
    for f in (tmp_path / "w").glob("part-*"):
        assert gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") >= 0


def test_warc_ranges_with_magics_inside_records(spark, tmp_path):
    rng = random.Random(1)
    pay = {i: b"x" * rng.randrange(2000) + warc.MAGIC + rng.randbytes(rng.randrange(3000)) + warc.MAGIC * rng.randrange(3) + b"\x1f\x1f\x8b" for i in range(120)}
    stored = lambda i: gzip.compress(gzip.decompress(warc.record(i, "u", pay[i], None, False, "d")), 0, mtime=0)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(map(stored, range(80))) + warc.END)
    (tmp_path / "w" / "b.warc").write_bytes(b"".join(map(stored, range(80, 120))))
    for size in ("700", "3000", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {int(r.record_id): bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == pay


def test_warc_files_named_gz_are_split_too(spark, tmp_path):
    rng = random.Random(6)
    pay = {i: rng.randbytes(rng.randrange(3000)) for i in range(150)}
    (tmp_path / "w").mkdir()
    for name, ids in (("a.warc.gz", range(100)), ("b.warc.gz", range(100, 150))):
        (tmp_path / "w" / name).write_bytes(b"".join(warc.record(i, "u", pay[i], None, False, "d") for i in ids))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        assert warc._as_they_are(spark, str(tmp_path / "w")).rdd.getNumPartitions() > 10
        got = {int(r.record_id): bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == pay


def test_warc_without_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_packing(spark, texts):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*texts, (300, "a <|endoftext|> b"), (301, "<|endoftext|>"), (302, "x<|endoftext|><|endoftext|>  y")]
    got = packing.pack(packing.tokenise(corpus(spark, texts, True), P.path("byte_bpe_50k.json"), P.PATTERN), partition_rows=7).toPandas()
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = got[got["doc_id"] == i].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids) and (own["length"].iloc[1:] == 1024).all()
        for s, n, c in zip(own["start"], own["length"], own["ids_crc32"]):
            assert zlib.crc32(ids[s : s + n].tobytes()) == c
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by["length"].sum() <= 1024).all() and all((g["offset"] == g["length"].cumsum() - g["length"]).all() for _, g in by)
    assert len(by) <= -(-got["length"].sum() // 1024) + 2
    assert packing.pack(packing.tokenise(corpus(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN)).count() == 0


def test_pieces_that_never_fit_together_stay_in_many_tasks(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "cast(0 as bigint) as start", "cast(if(id = 7, 1, 600) as bigint) as length", "id as ids_crc32")
    got = packing.pack(rows.withColumn("piece", F.col("piece").cast("int")), partition_rows=100).toPandas()
    assert len(got) == 3000 and got["sequence_id"].nunique() in (2999, 3000)
    assert (got["sequence_id"] // 2**32).value_counts().max() < 400  # of the tasks that gave out sequences


def test_packing_by_rounds_is_nearly_as_good_as_in_one_task(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1, 700) for _ in range(4000)]
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = packing.pack(rows, partition_rows=500).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 1024 and sorted(got["doc_id"]) == list(range(4000))
    assert got["sequence_id"].nunique() <= len(packing.best_fit(sizes, 1024)) * 1.01 + 2


def test_best_fit_uses_the_fullest_bin_that_fits():
    assert sorted(map(sorted, packing.best_fit([6, 5, 4, 4, 1], 10))) == [[0, 2], [1, 3, 4]]


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(corpus(spark, texts, True)).collect()}
    order = [i for i, _ in sorted(texts)]
    text = {i: t or "" for i, t in texts}
    s = sets_of(texts)
    for k, i in enumerate(order):
        t, nxt = text[i], text[order[(k + 1) % len(order)]]
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        e = sets_of([(0, edited)])[0]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(len(s[i] & e) / len(s[i] | e) if s[i] | e else 1.0)  # exact below K shingles
    assert got[202].fingerprint == got[203].fingerprint and got[0].fingerprint == got[204].fingerprint
    assert fingerprints.compare_with_edits(corpus(spark, [])).count() == 0
    one = fingerprints.compare_with_edits(corpus(spark, [(None, "a b c d e f g h"), (3, None)])).collect()
    assert len(one) == 2


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(4)
    a, b = words(rng, 3000).split(), words(rng, 3000).split()
    df = spark.createDataFrame([(" ".join(a), " ".join(a[:2000] + b[:1000]), " ".join(a[:1500]))], "x string, y string, z string")
    x, y, z = (fingerprints.sketch(F.col(c)) for c in "xyz")
    r = df.select(fingerprints.resemblance(x, y).alias("j"), fingerprints.containment(z, x).alias("c"), fingerprints.distinct_count(x).alias("n"), (fingerprints.merge(x, z) == x).alias("m")).first()
    sa, sb = sets_of([(0, df.first().x)])[0], sets_of([(0, df.first().y)])[0]
    assert r.j == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.12) and r.c > 0.85 and r.n == pytest.approx(len(sa), rel=0.25) and r.m


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)] + [(500, 600 + i) for i in range(50)], "a bigint, b bigint")
    got = {r.id: r.component for r in components.connected_components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 500: 500, **{600 + i: 500 for i in range(50)}}
    assert components.connected_components(e.limit(0)).count() == 0


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, small)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows, before = {r.doc_id: r for r in out.collect()}, {r.doc_id: r for r in seen.collect()}
        if name == "quality":
            q = {r.doc_id: r.quality for r in labels.collect()}
            assert np.mean([(i in rows) == (q[i] == 1) for i in q if i in before]) > 0.95
        elif name == "lines":
            assert {i: r.text for i, r in rows.items()} == kept_lines([(i, r.text) for i, r in before.items()], short=True)
        else:
            assert set(rows) == {c for _, c in groups([(i, r.text) for i, r in before.items()]).values()}
        seen = spark.createDataFrame(list(rows.values()), docs.schema)
    packed = corpus_pipeline.pack(spark, seen, small)
    assert packed.select("doc_id").distinct().count() == seen.count()
    assert corpus_pipeline.run(spark, small).count() == packed.count()
