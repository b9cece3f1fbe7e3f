"""Perplexity rules, collocations and resampling against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import collocations, perplexity, queries, resampling, runs

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("id", "n", "a", "l", "r", "f", "phrase", "rank", "key", "size", "range", "run", "place", "data", "weight", "score", "bits", "middle", "eligible", "n_words", "words", "reference", "slice")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n, share=0.2):
    stop = ["the", "of", "and", "in", "a"]
    return " ".join(rng.choice(stop) if rng.random() < 0.5 else "".join(rng.choice(["th", "en", "or", "ai", "su"]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, prose(rng, rng.randrange(5, 150)), rng.choice(["en", "en", "fr", None])) for i in range(80)]
    out += [(100 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "en") for i in range(4)]
    out += [(110 + i, " ".join(w + "***" for w in prose(rng, 60).split()), "en") for i in range(4)]
    out += [(120, "one two three four five " * 30, "en"), (121, None, "en"), (122, "", None), (123, " \n\t ", "fr"), (124, "x" * 120_000, "en"), (125, prose(rng, 9000), "fr"), (126, "Ünï the cödé 日本語 of the \U0001f642 text. The the\tthe  the! of", "xx")]
    return [*out, (130, out[3][1], out[3][2]), (130, out[3][1], out[3][2]), (-7, out[5][1], out[5][2]), (None, out[8][1], "en"), (None, None, None), (131, "a line is here\nb\na line is here\n\n\na line is here \nb", "en")]


def table(spark, rows, clash=False, parts=3):
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).repartition(parts)
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH))) if clash else df


# ---- rules


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines, dup, old = (text or "").split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in old
            old.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def symbol(b):
    c = chr(b)
    return c if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() and b < 128 else " " if b in (32, 9, 10, 11, 12, 13) else "." if c in ".,;:'\"()-!?" else "~" if b > 127 else "#"


class Plain:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        self.c = {4: Counter()}
        for t in texts:
            s = "   " + "".join(map(symbol, t.encode()))
            self.c[4].update(s[i : i + 4] for i in range(len(s) - 3))
        for k in (3, 2, 1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.total, self.kinds = {}, {}, {}
        for k, c in self.c.items():
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
            self.d[k] = [0, *(min(max(j - (j + 1) * y * n[j + 1] / max(n[j], 1), 0), j) for j in (1, 2, 3))] if y is not None else [0, 0.5, 1, 1.5]
            self.total[k], self.kinds[k] = Counter(), defaultdict(float)
            for g, m in c.items():
                self.total[k][g[:-1]] += m
                self.kinds[k][g[:-1]] += self.d[k][min(m, 3)]

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / 32
        low, h, m = self.p(g[1:]), g[:-1], self.c[k][g]
        if not self.total[k][h]:
            return low
        return (m - self.d[k][min(m, 3)] + self.kinds[k][h] * low) / self.total[k][h]

    def bits(self, t):
        s = "   " + "".join(map(symbol, t.encode()))
        return -sum(math.log2(self.p(s[i : i + 4])) for i in range(len(s) - 3)) / max(1, len(s) - 3)


def test_rules_equal_brute_force(spark, rows):
    got = perplexity.judged(table(spark, rows, True)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    of = {(i, t, lang or "und"): counts(t) for i, t, lang in rows}
    failed = {k: n[0] < 10 or 100 * n[4] > 20 * n[0] for k, n in of.items()}
    ref = [(lang or "und", t) for i, t, lang in rows if not failed[(i, t, lang or "und")] and 10 * of[(i, t, lang or "und")][2] <= of[(i, t, lang or "und")][0]]
    size = Counter()
    for lang, t in ref:
        size[lang] += len(t.encode())
    models = {lang: Plain([t for x, t in ref if x == lang]) for lang in size if size[lang] * 32 >= sum(size.values())}
    whole = Plain([t for _, t in ref])
    bits = {k: models.get(k[2], whole).bits(k[1] or "") for k in of}
    middle = {}
    for lang in size:
        v = sorted(round(models.get(lang, whole).bits(t) * 1000) for x, t in ref if x == lang)
        middle[lang] = v[(len(v) + 1) // 2 - 1] / 1000
    by_id = defaultdict(list)
    for k in of:
        by_id[k[0]].append(k)
    checked = 0
    for r in got:
        if len(by_id[r.doc_id]) > 1:
            continue
        (k,) = by_id[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == of[k] and r.base_failed == failed[k]
        assert math.log2(r.perplexity) == pytest.approx(bits[k], abs=1e-4)
        if k[2] in middle:
            off = bits[k] - middle[k[2]]
            assert r.kept == (not failed[k] and math.log2(0.73) <= off <= math.log2(2.2))
        else:
            assert r.kept == (not failed[k])
        checked += 1
    assert checked > 90
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in (*range(100, 104), *range(110, 114), 120, 121, 122, 123, 124)) and kept[125]


def test_shares_of_a_model_sum_to_one():
    rng = random.Random(2)
    codes, _ = perplexity.grams(pa.array([prose(rng, 3000)]))
    parts = perplexity.estimate(np.bincount(codes, minlength=perplexity.GRAMS), "en")
    keys, log_p, contexts, left = map(np.concatenate, parts)
    a, b = np.argsort(keys), np.argsort(contexts)
    m = perplexity.Model(["en"], keys[a], log_p[a], contexts[b], left[b])
    for context in [*rng.sample(range(32**3), 40), *(codes[:40] // 32).tolist()]:
        assert (2 ** m.score(context * 32 + np.arange(32), 0)).sum() == pytest.approx(1)


def test_rules_tell_apart_bytes_beyond_ascii(spark):
    rng = random.Random(9)

    def text(syllables):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(80))

    rows = [(i, text(["во", "на", "ли", "то"]), "ru") for i in range(60)]
    foreign = [(100 + i, "".join(c if c == " " else chr(rng.choice([0x100, 0x380, 0x530, 0x590]) + rng.randrange(48)) for c in t), "ru") for i, t, _ in rows[:3]]
    got = {r.doc_id: r for r in perplexity.judged(table(spark, rows + foreign)).collect()}
    assert all(got[i].kept for i, _, _ in rows) and not any(got[i].kept or got[i].base_failed for i, _, _ in foreign)
    assert all(got[100 + i].byte_perplexity > 3 * got[i].byte_perplexity for i in range(3))


def test_shares_of_bytes_in_a_class_sum_to_one():
    rng = random.Random(2)
    at, codes = perplexity.spellings(pa.array([prose(rng, 3000) + " Ünï日本語, 12.5", None, "", "Ж"]))
    assert len(at) == len(codes) and codes[-1] & 255 == 0x96 and codes[-2] == (32 << 16) + (32 << 8) + 0xD0
    parts = perplexity.estimate_bytes(*np.unique(codes.astype(np.int64), return_counts=True), "en")
    keys, log_p, contexts, left = map(np.concatenate, parts)
    a, b = np.argsort(keys), np.argsort(contexts)
    m = perplexity.Model(["en"], keys[a], log_p[a], contexts[b], left[b])
    for context in [*rng.sample(range(256**2), 40), *(codes[:40] // 256).tolist()]:
        share = 2 ** m.spell(context * 256 + np.arange(256), 0)
        for kind in range(32):
            members = perplexity.CLASS_OF == kind
            assert not members.any() or share[members].sum() == pytest.approx(1)


def test_rules_keep_clean_labelled_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_kneser_ney(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in got}
    assert n.get((1, False, False), 0) <= 0.005 * n[(1, False, True)]
    assert n.get((0, False, True), 0) <= 0.1 * n[(0, False, False)]


# ---- collocations


def phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        own = {p: a for p, a in c.items() if " " in p and a >= least}
        inner = Counter()
        for p, a in own.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    inner[" ".join(w[i : i + k])] = max(inner[" ".join(w[i : i + k])], a)
        found = []
        for p, a in own.items():
            w = p.split(" ")
            if not (inner[p] and 100 * inner[p] >= 80 * a):
                cuts = [(c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w))]
                s, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
                found.append((-s, -a, p.encode(), (p, a, l, r, n[lang], s)))
        out += [(lang, k + 1, *x[3]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, cells, patterns, top", [(30, None, 400_000, 2000), (3, 1 << 16, 300, 40), (2, 1 << 16, 400_000, 2000)])
def test_collocations_equal_brute_force(spark, rows, least, cells, patterns, top):
    got = collocations.collocations(table(spark, rows, True), least, top, cells, patterns)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases(rows, least, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_words_of_two_languages_are_told_apart(spark):
    rows = [(1, "es en es en", "en"), (2, "es en es en es en", "es"), (3, "es en", "fr")]
    assert sorted(map(tuple, collocations.collocations(table(spark, rows), 1).collect())) == phrases(rows, 1, 2000)


def test_phrases_end_with_pieces_and_texts(spark):
    rows = [(i, t, "en") for i, t in enumerate(["a b. a b", "a b", "b\ta  b", "B, a\x0bb", "a", "b", "a-b a\x00b", "É é É é"])]
    assert sorted(map(tuple, collocations.collocations(table(spark, rows), 1).collect())) == phrases(rows, 1, 2000)


def test_products_pass_64_bits(spark):
    big = 4 * 10**18
    counted = spark.createDataFrame([("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b c", 3, big - 2), ("en", "b c", 2, big), ("en", "c", 1, big)], "lang string, phrase string, size int, f bigint")
    got = collocations.ranked(counted, spark.createDataFrame([("en", big)], "lang string, n bigint")).collect()
    assert [(r.phrase, r.l, r.r, r.score) for r in got] == [("a b c", big, big, 2_000_000 * (big - 2) // (2 * big))]


def test_passes_hold_every_language_once():
    sizes = {"en": 700, "de": 120, "fr": 100, "es": 90, "und": 5}
    got = collocations.passes(sizes, 250)
    assert got == [(["en"], 0, 3), (["en"], 1, 3), (["en"], 2, 3), (["de", "fr"], 0, 1), (["es", "und"], 0, 1)] and collocations.passes({}, 9) == []


def test_automata_read_only_what_their_words_begin():
    codes, reach = np.arange(12, dtype=np.int32), np.array([4, 3, 2, 1, 2, 1, 1, 3, 2, 1, 1, 1], np.int32)
    whole = collocations.joined(codes, reach, np.arange(12))
    assert whole.tolist() == [-1, 0, 1, 2, 3, -1, 4, 5, -1, 6, -1, 7, 8, 9, -1, 10, -1, 11]
    parts = [collocations.joined(codes, reach, np.flatnonzero(codes % 4 == k)) for k in range(4)]
    assert [x.tolist() for x in parts] == [[-1, 0, 1, 2, 3, -1, 4, 5, -1, 8, 9], [-1, 1, 2, 3, -1, 5, -1, 9], [-1, 2, 3, -1, 6, -1, 10], [-1, 3, -1, 7, 8, 9, -1, 11]]
    assert collocations.joined(codes[:0], reach[:0], np.zeros(0, np.int64)).tolist() == []


def test_many_automata_read_little_more_than_one():
    rng = np.random.default_rng(3)
    codes, reach = rng.integers(0, 900, 50_000).astype(np.int32), rng.integers(1, 5, 50_000).astype(np.int32)
    reach = np.minimum(reach, np.arange(50_000, 0, -1))
    read = [len(collocations.joined(codes, reach, np.flatnonzero(codes % 40 == k))) for k in range(40)]
    assert sum(read) < 5 * len(codes)  # 40 passes over all words before


def test_sketch_bounds_are_never_below_counts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)[rng.zipf(1.3, 20_000) % 300]
    batches = [collocations.packed_hits(x, 1 << 16, 30) for x in np.array_split(keys, 7)]
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        for x in b.column(1).to_pylist():
            total += np.bincount(np.frombuffer(x, np.uint16), minlength=1 << 16)
    sketch = collocations.Sketch(np.packbits(total >= 30))
    value, n = np.unique(keys, return_counts=True)
    assert sketch.passes(value[n >= 30]).all() and not sketch.passes(value[n < 30]).all()


# ---- draws


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]


def drawn(rows, target):
    def bucket(x):
        return zlib.crc32(x.encode()) % 10_000

    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    out = []
    for i, text, _ in rows:
        w, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    return out


@pytest.mark.parametrize("ranges", [None, 1, 6, 40])
def test_draws_equal_brute_force(spark, rows, ranges):
    target = [rows[7][1], None, "", rows[9][1]]
    got = resampling.resample(table(spark, rows, True, 5), spark.createDataFrame([(t,) for t in target], "text string"), ranges=ranges).collect()
    want = drawn(rows, target)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_features, r.weight, r.score) for r in got) == sorted((i is None, i or 0, n, w, s) for i, n, w, s, _ in want)
    able = sorted((-s, i is not None, i or 0) for i, _, _, s, ok in want if ok)
    ranked = sorted((r["rank"], (-r.score, r.doc_id is not None, r.doc_id or 0)) for r in got if r["rank"] is not None)
    n = 25 * len(able) // 100
    assert [k for k, _ in ranked] == list(range(1, n + 1)) and [x for _, x in ranked] == able[:n]


def test_many_rows_of_one_score_are_split(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.range(6000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit(text).alias("text")).repartition(6)
    runs_ = resampling.checkpoint(resampling.sorted_runs(resampling.scored(docs, np.zeros(resampling.BUCKETS, np.int64))))
    cut = resampling.pieces(runs_, resampling.splitters(runs_, 6000, 10))
    sizes = [r.n for r in cut.groupBy("range").agg(F.sum("n").alias("n")).collect()]
    assert sum(sizes) == 6000 and len(sizes) > 7 and max(sizes) < 1800
    got = resampling.resample(docs, docs.select("text"), ranges=10).where("rank is not null").select("rank").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1501))


def test_tournament_merges_and_leaves_the_rest():
    rng = random.Random(9)
    for k in (1, 2, 3, 5, 8, 13):
        streams = [sorted((rng.randrange(50), i, j) for j in range(rng.randrange(0, 9))) for i in range(k)]
        whole = sorted(x for s in streams for x in s)
        tree = resampling.Tournament([iter(s) for s in streams])
        first = [x for _, x in zip(range(7), tree)]
        assert first == whole[:7] and sorted(tree.rest()) == whole[7:]


def test_checksums_of_pairs():
    words = ["a", "", "日本語", "x" * 200, "zebra"]
    got, of, n = resampling.buckets(pa.array([" ".join(words), None, "y" * 70 + " " + "z" * 63 + " " + "q" * 62]))
    want = [[zlib.crc32(x.encode()) % 10_000 for x in features(t)[1]] for t in (" ".join(words), "", "y" * 70 + " " + "z" * 63 + " " + "q" * 62)]
    assert [sorted(got[of == k].tolist()) for k in range(3)] == [sorted(x) for x in want] and n.tolist() == [4, 0, 3]


# ---- all three


@pytest.mark.parametrize("empty", [[], [(1, None, None), (2, "", "en"), (None, " ", None)]])
def test_empty_tables_and_texts(spark, empty):
    docs = table(spark, empty, True, 1)
    assert Counter(r.doc_id for r in perplexity.judged(docs).collect()) == Counter(i for i, _, _ in empty)
    assert collocations.collocations(docs).collect() == []
    got = resampling.resample(docs, docs.select("text")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in empty) and all((r.n_features, r.weight, r["rank"]) == (0, 0, None) for r in got)


def test_words_of_sliced_arrays():
    texts = pa.array(["skip me", None, "One  two", "", "three"]).slice(1)
    w = runs.words(texts, runs.all_but(runs.SPACES))
    assert [w.different[k] for k in w.codes] == [b"one", b"two", b"three"] and w.bounds.tolist() == [0, 0, 2, 2, 3]
