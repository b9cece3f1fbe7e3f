"""Quality rules by n-gram perplexity: a modified Kneser-Ney model and perplexity bands for each language.

Symbols.  Bytes fall into 32 classes: the small letters, and one class each for capitals, digits, white space, sentence marks, other ASCII and
bytes beyond ASCII.  A text is its symbols after three blanks, and n-grams go up to four symbols, so a language has no more than
``32 ** 4`` of them however large the corpus is.  Which byte of its class a symbol is, is modelled as well: by the class and the two bytes before it, which are
``256 ** 3`` at most.  Both together give each byte of a text its share.

Model.  Spark counts the four-grams of the reference texts: those that pass the base rules and have a symbol of ``[#*$%&|<>]`` for ten words at most.
Lower orders count the different symbols before an n-gram.  Each order has its three discounts by its counts of counts; orders are interpolated.
The model is two sorted arrays of 64-bit hashes of language and n-gram, with a log-probability each, and with a back-off weight each.
Bytes are modelled in the same way, but shares are among the bytes of a class, and where nothing was seen they are equal.
Languages with less than 1 / ``MODELS`` of the reference symbols share one model of all reference texts, so there are ``MODELS`` + 1 models at most.

Verdict.  The base rules reject texts with fewer than ten words or with over a fifth of the words in repeated five-word windows.  A
language's middle is the median perplexity a symbol of its reference texts; of other texts those below ``LOW`` or above ``HIGH`` times
that are rejected.  This holds for the perplexity of the classes and for that of the bytes themselves (``byte_perplexity``): classes alone don't tell apart the
letters of scripts beyond ASCII.  Perplexity is rounded in the median to a thousandth of a bit.

Null texts have no words and fail the base rules, as empty texts do; a null language counts as ``und``.  A language without reference texts has no band and
rejects nothing more.  Repeated rows and equal texts of a language get equal verdicts.  Very long texts are measured whole.  Other columns are left
out, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, chunks
from .runs import SPACES, all_but, bytes_of, code_points, words

LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
SYMBOLS = b"#[*$%&|<>]"
#: Words that a reference text must have for each of SYMBOLS.
WORDS_A_SYMBOL = 10
ORDER, KINDS = 4, 32
#: Bytes that a byte is told by, itself included.
SPAN = 3
GRAMS = KINDS**ORDER
BLANK = 28
MODELS = 32
LOW, HIGH = 0.73, 2.2
#: Characters that are measured together; longer texts are taken whole.
CHUNK = 8_000_000
#: Languages whose counts a task holds before it hands them on.
HELD = 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_P = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    out = np.full(256, 30, np.uint8)
    out[97:123] = np.arange(26)
    out[65:91], out[48:58], out[128:] = 26, 27, 31
    out[list(SPACES)] = BLANK
    out[list(b".,;:'\"()-!?")] = 29
    return out


CLASS_OF = _classes()
#: Bytes in the class of each byte, and which of them the class leaves open.
MATES = np.bincount(CLASS_OF, minlength=KINDS)[CLASS_OF]
OPEN = MATES > 1
WORD, SYMBOL = all_but(SPACES), ~all_but(SYMBOLS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, how many of its words lie in windows of WINDOW words that it holds twice or more."""
    n, texts = len(codes), len(bounds) - 1
    if n < WINDOW:
        return np.zeros(texts, np.int64)
    text = np.repeat(np.arange(texts), np.diff(bounds))
    at = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    key = text[at].astype(np.uint64)
    for k in range(WINDOW):
        key = _mix(key * _P + codes[at + k].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    same = (key[order[:-1]] == key[order[1:]]) & (text[a] == text[b])
    for k in range(WINDOW):  # hashes only bring windows together
        same &= codes[a + k] == codes[b + k]
    change = np.zeros(n + 1, np.int64)
    again = np.unique(np.append(a[same], b[same]))
    change[again] += 1
    change[again + WINDOW] -= 1
    return np.diff(np.append(0, np.cumsum(np.cumsum(change[:-1]) > 0))[bounds])


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    w = words(texts, WORD, lower=False)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[w.cuts])

    return {
        "n_words": np.diff(w.bounds),
        "word_chars": per_text(w.inside & code_points(w.data)),
        "n_symbols": per_text(SYMBOL[w.data]),
        "n_dup_lines": np.fromiter((repeated_lines(t or "") for t in texts.to_pylist()), np.int64, len(texts)),
        "n_repeat_words": repeated_words(w.codes, w.bounds),
    }


def base_failed(x: dict[str, np.ndarray]) -> np.ndarray:
    return (x["n_words"] < LEAST_WORDS) | (100 * x["n_repeat_words"] > MOST_REPEATED * x["n_words"])


def referenced(x: dict[str, np.ndarray]) -> np.ndarray:
    """Which texts the models are counted on."""
    return ~base_failed(x) & (WORDS_A_SYMBOL * x["n_symbols"] <= x["n_words"])


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of the four-gram that ends at each symbol of all texts, and where each text begins and the last ends."""
    data, cuts = bytes_of(texts)
    n, lead = len(cuts) - 1, ORDER - 1
    s = np.full(len(data) + lead * n, BLANK, np.int32)
    own = np.arange(len(data)) + lead * (np.repeat(np.arange(n), np.diff(cuts)) + 1)
    s[own] = CLASS_OF[data]
    code = s.copy()
    for k in range(1, ORDER):
        code[lead:] += s[lead - k : len(s) - k] * KINDS**k
    return code[own], cuts


def spellings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all bytes that their class leaves open, and the number of each with the SPAN - 1 bytes before it."""
    data, cuts = bytes_of(texts)
    n, lead = len(cuts) - 1, SPAN - 1
    s = np.full(len(data) + lead * n, 32, np.uint8)
    own = np.arange(len(data)) + lead * (np.repeat(np.arange(n), np.diff(cuts)) + 1)
    s[own] = data
    at = np.flatnonzero(OPEN[data])
    code, own = np.zeros(len(at), np.int32), own[at]
    for k in range(SPAN):
        code |= s[own - k].astype(np.int32) << (8 * k)
    return at, code


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken from counts of 0, 1, 2, and 3 or more."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in range(1, 5))
    if not n1 or not n2:
        return np.array([0, 0.5, 1, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / max(n3, 1)], 0, [0, 1, 2, 3])


@dataclass
class Model:
    """Sorted hashes of language, order and n-gram (``keys``) or context (``contexts``), with logarithms to base 2."""

    names: list[str]
    keys: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_left: np.ndarray

    def number(self, lang: str) -> int:
        """The model for a language; the last is that of all."""
        return self.names.index(lang) if lang in self.names else len(self.names)

    def score(self, codes: np.ndarray, lang: int) -> np.ndarray:
        """Log-probability of the last symbol of each four-gram after the others."""
        orders = [(k, codes % KINDS**k) for k in range(ORDER, 0, -1)]
        return self._backed_off([(k, gram, gram // KINDS) for k, gram in orders], np.full(len(codes), -np.log2(KINDS)), lang)

    def spell(self, codes: np.ndarray, lang: int) -> np.ndarray:
        """Log-probability of the last byte of each number of ``spellings`` in its class, after the others."""
        orders = [(k, codes % 256**k) for k in range(SPAN, 0, -1)]
        return self._backed_off([(f"bytes {k}", gram, before(gram)) for k, gram in orders], -np.log2(MATES[codes & 255]), lang)

    def _backed_off(self, orders: list, none: np.ndarray, lang: int) -> np.ndarray:
        """By (order, n-grams, contexts) from the longest to the shortest; ``none`` is for what no order knows."""
        out, open_ = np.zeros(len(none)), np.ones(len(none), bool)
        for order, gram, context in orders:
            at = np.flatnonzero(open_)
            found, value = lookup(self.keys, self.log_p, hashed(gram[at], order, self.title(lang)))
            out[at[found]] += value[found]
            open_[at[found]] = False
            rest = at[~found]
            known, left = lookup(self.contexts, self.log_left, hashed(context[rest], order, self.title(lang)))
            out[rest[known]] += left[known]
        out[open_] += none[open_]
        return out

    def title(self, lang: int) -> str | None:
        return self.names[lang] if lang < len(self.names) else None


def before(gram: np.ndarray) -> np.ndarray:
    """The bytes before the last, with its class."""
    return (gram >> 8) * KINDS + CLASS_OF[gram & 255]


def hashed(gram: np.ndarray, order: int | str, lang: str | None) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(f"{order}:{'' if lang is None else '=' + lang}")
    return _mix(_mix(gram.astype(np.uint64) + np.uint64(1)) * _P + np.uint64(seed))


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at].astype(np.float64)


def estimate(counts: np.ndarray, lang: str | None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Hashes and values of one language from the counts of all its four-grams."""
    by_order = {ORDER: counts.reshape((KINDS,) * ORDER).astype(np.float64)}
    for order in range(ORDER - 1, 0, -1):
        by_order[order] = (by_order[order + 1] > 0).sum(0).astype(np.float64)
    p, out = np.full(KINDS, 1 / KINDS), ([], [], [], [])
    for order in range(1, ORDER + 1):
        c = by_order[order]
        taken = discounts(c)[np.minimum(c, 3).astype(np.int64)]
        total = c.sum(-1, keepdims=True)
        left = taken.sum(-1, keepdims=True) / np.maximum(total, 1)
        p = np.where(total > 0, (c - taken) / np.maximum(total, 1) + left * p, p)
        seen, begun = np.flatnonzero(c.reshape(-1) > 0), np.flatnonzero(total.reshape(-1) > 0)
        for k, x in enumerate((hashed(seen, order, lang), np.log2(p.reshape(-1)[seen]), hashed(begun, order, lang), np.log2(np.maximum(left.reshape(-1)[begun], 1e-12)))):
            out[k].append(x)
    return out


def estimate_bytes(gram: np.ndarray, n: np.ndarray, lang: str | None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Hashes and values of one language's bytes within their classes, from the counts ``n`` of the numbers of ``spellings``, which are in order."""
    by_order = {SPAN: (gram, n)}
    for order in range(SPAN - 1, 0, -1):
        by_order[order] = np.unique(by_order[order + 1][0] % 256**order, return_counts=True)
    lower, p, out = None, None, ([], [], [], [])
    for order in range(1, SPAN + 1):
        seen, c = by_order[order]
        taken = discounts(c)[np.minimum(c, 3)]
        begun, of = np.unique(before(seen), return_inverse=True)
        total = np.bincount(of, c, len(begun))
        left = np.bincount(of, taken, len(begun)) / np.maximum(total, 1)
        below = 1 / MATES[seen] if p is None else p[np.searchsorted(lower, seen % 256 ** (order - 1))]
        lower, p = seen, (c - taken) / total[of] + left[of] * below
        for k, x in enumerate((hashed(seen, f"bytes {order}", lang), np.log2(p), hashed(begun, f"bytes {order}", lang), np.log2(np.maximum(left, 1e-12)))):
            out[k].append(x)
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n``: the four-grams of the reference texts, and from GRAMS on the numbers of ``spellings``."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def handed_on():
            for lang, x in held.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at])], ["lang", "gram", "n"])
            held.clear()

        for b in chunks(batches, "text", CHUNK):
            texts, langs = b.column(1), b.column(0).to_pylist()
            ok = referenced(measure(texts))
            codes, cuts = grams(texts)
            at, spelt = spellings(texts)
            for lang in dict.fromkeys(x for x, use in zip(langs, ok) if use):
                own = np.fromiter((use and x == lang for x, use in zip(langs, ok)), bool, len(langs))
                if lang not in held and len(held) >= HELD:
                    yield from handed_on()
                own = np.repeat(own, np.diff(cuts))
                held[lang] = held.get(lang, 0) + np.bincount(codes[own], minlength=GRAMS)
                gram, n = np.unique(spelt[own[at]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram + np.int32(GRAMS)), pa.array(n)], ["lang", "gram", "n"])
        yield from handed_on()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model:
    """Models of the languages with at least 1 / MODELS of the reference symbols, and one of all; a model has at most GRAMS counts of classes and 256 ** SPAN of bytes."""
    counts = checkpoint(count_grams(docs))
    symbols = counts.where(F.col("gram") < GRAMS)
    total = symbols.agg(F.sum("n")).first()[0] or 0
    large = [r.lang for r in symbols.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") * MODELS >= total).orderBy("lang").collect()]  # MODELS rows
    parts = []
    for lang, rows in [*((x, counts.where(F.col("lang") == x)) for x in large), (None, counts.groupBy("gram").agg(F.sum("n").alias("n")))]:
        got = rows.select("gram", "n").toArrow()  # GRAMS rows and those of bytes, of which UTF-8 leaves few
        gram, n = got["gram"].to_numpy(), got["n"].to_numpy()
        dense = np.zeros(GRAMS, np.int64)
        dense[gram[gram < GRAMS]] = n[gram < GRAMS]
        parts.append(estimate(dense, lang))
        order = np.argsort(gram)[int((gram < GRAMS).sum()) :]
        parts.append(estimate_bytes(gram[order].astype(np.int64) - GRAMS, n[order], lang))
    keys, log_p, contexts, log_left = (np.concatenate([x for p in parts for x in p[k]]) for k in range(4))
    a, b = np.argsort(keys), np.argsort(contexts)
    return Model(large, keys[a], log_p[a].astype(np.float32), contexts[b], log_left[b].astype(np.float32))


def bits(model: Model, texts: pa.Array, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits a symbol that the model of its language needs for the classes of each text, and for its bytes; 0 for texts without symbols."""
    codes, cuts = grams(texts)
    at, spelt = spellings(texts)
    sizes = np.diff(cuts)
    of = np.fromiter(map({x: model.number(x) for x in set(langs)}.__getitem__, langs), np.int64, len(langs))
    value, more = np.zeros(len(codes)), np.zeros(len(codes))
    for k in np.unique(of):
        mine = np.repeat(of == k, sizes)
        own, open_ = np.flatnonzero(mine), mine[at]
        c = codes[own]
        present = np.flatnonzero(np.bincount(c, minlength=GRAMS))
        table = np.zeros(GRAMS)
        table[present] = model.score(present, int(k))
        value[own] = table[c]
        different, place = np.unique(spelt[open_], return_inverse=True)
        more[at[open_]] = model.spell(different.astype(np.int64), int(k))[place]

    def a_symbol(x: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(np.append(x, 0), cuts[:-1]) if len(sizes) else np.zeros(0)
        return np.where(sizes > 0, -total / np.maximum(sizes, 1), 0)

    return a_symbol(value), a_symbol(value + more)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang``, COUNTS, ``base_failed``, ``reference``, ``bits`` and ``byte_bits`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most (MODELS + 1) * (GRAMS + 256 ** SPAN) entries of 12 bytes, a few MB in practice

    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            x = measure(b.column(2))
            rest = [pa.array(x[k].astype(np.int64)) for k in COUNTS] + [pa.array(base_failed(x)), pa.array(referenced(x)), *map(pa.array, bits(shared.value, b.column(2), b.column(1).to_pylist()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *rest], ["doc_id", "lang", *COUNTS, "base_failed", "reference", "bits", "byte_bits"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang string, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", base_failed boolean, reference boolean, bits double, byte_bits double")


def middles(rows: DataFrame, bits: str, middle: str) -> DataFrame:
    """``lang`` and ``middle``, the median bits of its reference texts, from counts of thousandths of a bit."""
    binned = rows.where("reference").groupBy("lang", F.round(F.col(bits) * 1000).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = binned.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang"))).where("2 * upto >= all")
    return half.groupBy("lang").agg((F.min("bin") / 1000).alias(middle))


def judged(docs: DataFrame) -> DataFrame:
    """Counts, perplexity and verdict of every document."""
    rows = checkpoint(scored(docs, train(docs)))
    out = rows.join(middles(rows, "bits", "middle"), "lang", "left").join(middles(rows, "byte_bits", "byte_middle"), "lang", "left")

    def inside(bits: str, middle: str):
        return F.coalesce((F.col(bits) - F.col(middle)).between(float(np.log2(LOW)), float(np.log2(HIGH))), F.lit(True))

    def power(bits: str):
        return F.pow(F.lit(2.0), bits)

    kept = ~F.col("base_failed") & inside("bits", "middle") & inside("byte_bits", "byte_middle")
    return out.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), power("bits").alias("perplexity"), power("middle").alias("middle"), power("byte_bits").alias("byte_perplexity"), power("byte_middle").alias("byte_middle"))
