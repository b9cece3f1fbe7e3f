"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins and has a lookup table, learned by cyclic boosting: round after round, feature after feature, a
tree of few leaves is fitted to the gradients of the logistic loss in the bins and added to the table with a small step.  The
pairs that would lower the remaining loss most then get tables over coarser bins of both features, boosted likewise.  A
score is the logistic of the sum of table entries.

The model is fitted on the driver on at most ``MAX_TRAIN`` labelled ids (those of least hash), one row for each: of several labels the least, of several texts that with
the least features; every document is scored, from its whole text.  Null and empty texts have all-zero features and are scored like any text.  Rows without a label, or with a label
other than 0 or 1, don't train.  With no labelled rows every score is 0.5; with one class its rate.  Repeated rows
are scored alike.  Very long texts are measured whole.  ``scored`` leaves other columns out and ``keep_good`` passes them
through, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, tidy

MAX_TRAIN = 20_000
THRESHOLD = 0.7
BINS = 48
PAIR_BINS = 10
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 8
STEP = 0.15
FEATURES = ("log_length", "upper", "digit", "mark", "symbol", "bar", "newline", "beyond_ascii", "stop", "repeated_next", "different_words", "top_word", "word_length", "word_length_spread", "different_lines", "shouting", "comma", "long_words")


def _classes() -> np.ndarray:
    of = np.zeros((256, 9))
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?;:\"'()-", b"#$%&*@^~=+<>/\\_{}[]`", b"|", b"\n", bytes(range(128, 256)), b".", b",")):
        of[list(chars), k] = 1
    return of


CLASSES = _classes()


def features(text: str) -> list[float]:
    """One value for each of FEATURES."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES / len(data)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = len(words)
    return [
        np.log1p(len(data)), share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7],
        sum(map(eq, words, words[1:])) / max(1, n - 1), len(counts) / n, max(counts.values()) / n,
        float(sizes.mean()), float(sizes.std()), len(set(lines)) / max(1, len(lines)), data.count(b"!!") / n, share[8], float((sizes > 20).mean()),
    ]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Vectorised additions of table entries."""
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for k in {k for p in self.pairs for k in p}}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step function over bins: greedy splits by gain."""
    cuts = [0, len(g)]
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = _gain(cg[m] - cg[a], ch[m] - ch[a]) + _gain(cg[b] - cg[m], ch[b] - ch[m]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(m[k]))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Four quadrants over the bins of two features, and their gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, at = -1.0, (1, 1)
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if a.size:
        gain = 0
        for q in ((cg[a, b], ch[a, b]), (cg[-1, b] - cg[a, b], ch[-1, b] - ch[a, b]), (cg[a, -1] - cg[a, b], ch[a, -1] - ch[a, b]), (cg[-1, -1] - cg[a, -1] - cg[-1, b] + cg[a, b], ch[-1, -1] - ch[a, -1] - ch[-1, b] + ch[a, b])):
            gain = gain + _gain(*q)
        k = np.unravel_index(gain.argmax(), gain.shape)
        best, at = float(gain[k]), (int(k[0]) + 1, int(k[1]) + 1)
    out = np.zeros_like(g)
    for rows in (slice(0, at[0]), slice(at[0], None)):
        for cols in (slice(0, at[1]), slice(at[1], None)):
            if g[rows, cols].size:
                out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    n_features = len(FEATURES)
    if not len(y) or y.min() == y.max():
        rate = np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-6, 1 - 1e-6)
        empty = [np.zeros(0)] * n_features
        return Model(float(np.log(rate / (1 - rate))), empty, [np.zeros(1)] * n_features, [], empty, [])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(n_features)]
    bins = [np.searchsorted(edges[k], x[:, k], "right") for k in range(n_features)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for k in range(n_features):
            p = 1 / (1 + np.exp(-total))
            m = len(tables[k])
            step = STEP * shallow_tree(np.bincount(bins[k], y - p, m), np.bincount(bins[k], p * (1 - p), m))
            tables[k] += step
            total += step[bins[k]]
    pair_edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for k in range(n_features)]
    coarse = [np.searchsorted(pair_edges[k], x[:, k], "right") for k in range(n_features)]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    gains = sorted(((cross_tree(*grids(i, j))[1], i, j) for i in range(n_features) for j in range(i)), reverse=True)
    pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in zip(pair_tables, pairs):
            step = STEP * cross_tree(*grids(i, j))[0]
            t += step
            total += step[coarse[i], coarse[j]]
    return Model(base, edges, tables, pairs, pair_edges, pair_tables)


def held_out(doc_id) -> F.Column:
    """Rows that must not train: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on the labelled rows that aren't held out, one for each id and at most MAX_TRAIN of them."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")  # MAX_TRAIN rows
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in chunks(batches, "text"):
            x = [features(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    found = texts.select("doc_id", "y", "text").mapInArrow(tidy(run), f"doc_id {kind}, y int, x array<double>")
    got = found.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("doc_id")  # MAX_TRAIN rows
    return fit(np.array(got["x"].tolist()).reshape(-1, len(FEATURES)), got["y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""

    def run(batches):
        for b in chunks(batches, "text"):
            x = np.array([features(t or "") for t in b.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all their columns, that the model accepts; their texts are scored where they are read."""

    def run(batches):
        for b in chunks(batches, "text"):
            x = np.array([features(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)
