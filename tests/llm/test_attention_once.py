"""The attention model reads each text once and shows windows of all kinds in every round."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from fieldlens.llm import attention_lm, bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def test_each_text_is_read_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["stone", "river", "light", "And", "seven,"], k=rng.randrange(0, 60)))) for i in range(50)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").mapInPandas(counted, "doc_id bigint, text string")
    assert attention_lm.score_documents(docs, PATH, P.PATTERN).count() == 50
    assert read.value == 50


def test_every_round_shows_first_and_last_windows():
    """In texts of two windows each round shows both kinds, and over the rounds each window is shown once."""
    of = np.concatenate([attention_lm.turns(0, 1000), attention_lm.turns(1000, 4000)])
    both = np.stack([np.bincount(of[k::2], minlength=attention_lm.ROUNDS) for k in (0, 1)])
    assert both.sum() == 4000 and both.min() > 400


def test_words_are_told_apart_by_their_ids():
    texts = ["", None, " ", "a b a", "AB ab aB", "\x1c a\x1cb", "it's its it 's", "x" * 700 + " x", "日本語 \U0001f642\U0001f642 日本 語", " b b 　b", "<|endoftext|> 12 345", "  two  spaces "]
    data, kind = bpe.load(PATH)
    enc = bpe.encoder(data, P.PATTERN, kind)
    ids, cuts = attention_lm.id_runs(pa.array(texts), enc)
    again, same = attention_lm.id_runs(pa.array(texts), enc)
    assert (ids == again).all() and (cuts == same).all()
    hashes, bounds = attention_lm.word_runs(ids, cuts, attention_lm.begins_word(enc.vocabulary.tokens))
    words = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("far", [1, 40])
def test_gradients_hold_where_exponentials_leave_the_range(far):
    """Losses are those of the plain pass, also where its greatest value has to be taken off first."""
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 300, 100).astype(np.int32)
    inputs, targets, _ = attention_lm.windows(ids, np.array([0, 70, 70, 100]))
    m = attention_lm.Model(attention_lm.fresh(rng), rng.integers(0, attention_lm.CLASSES, attention_lm.N_IDS).astype(np.int32), *[None] * 4)
    for k in ("q", "out"):
        m.weights[k] *= far
    scored = []
    loss, g = m.gradients(inputs, targets, scored)
    want = np.take_along_axis(m.forward(inputs), m.class_of[np.where(targets >= 0, targets, 0)][..., None], -1)[..., 0][targets >= 0]
    assert np.allclose(scored[0][targets >= 0], want, atol=1e-3, rtol=1e-4) and loss == pytest.approx(-want.mean(), rel=1e-4)
    assert all(np.isfinite(x).all() for k, x in g.items() if k != "id_in")
