"""The corpus operators do their whole job: nothing is left out as the tables grow."""

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa

import corpus_pipeline
from fieldlens.llm import attention_lm, bpe, queries

WORDS = "the of and river stone light carried under over seven green window table paper winter summer quiet garden yellow mountain".split()


def test_attention_learns_from_every_training_text(spark):
    rng = np.random.default_rng(3)
    share = 1 / np.arange(1, len(WORDS) + 1)
    texts = [" ".join(rng.choice(WORDS, 25, p=share / share.sum())) for _ in range(9000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    path = P.path("byte_bpe_50k.tiktoken")
    model = attention_lm.train(docs, path, P.PATTERN)
    data, kind = bpe.load(path)
    own = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    ids, cuts = attention_lm.id_runs(pa.array(own), bpe.encoder(data, P.PATTERN, kind))
    counts = np.bincount(ids, minlength=attention_lm.N_IDS)
    ranked = np.argsort(model.top_of, kind="stable")[: (counts > 0).sum()]
    assert list(ranked) == list(np.argsort(-counts, kind="stable")[: len(ranked)])
    inputs, targets, of = attention_lm.windows(ids, cuts)
    assert model.shown % len(of) == 0 and model.shown >= len(of)
    a, b = ids[:-1], ids[1:]
    inside = a != attention_lm.END
    x, y = a[inside][0], b[inside][0]
    assert np.isclose(model.follows[model.top_of[x], model.top_of[y]], ((a == x) & (b == y)).sum() / (a == x).sum())
    assert model.log_probability(inputs, targets).sum() > 1.01 * (np.log(counts[ids] / len(ids))).sum()


def test_equal_short_lines_go_too(spark, tmp_path):
    rows = [(1, "Les.\n\nAnd ornd.\nLes.\n  "), (2, "Les.\nLex.\n\n  \nAnd ornd."), (3, None), (4, "a line that is long enough\nLes."), (5, "a line that is long enouhg")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = {1: "Les.\n\nAnd ornd.\n  ", 2: "Lex.\n\n  ", 3: None, 4: "a line that is long enough", 5: ""}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_gone, r.n_near) for r in queries.op7_segment_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (0, 0), 4: (1, 0), 5: (1, 1)}
