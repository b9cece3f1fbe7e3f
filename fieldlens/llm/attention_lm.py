"""Language-model scores: a causal self-attention model in numpy on subword ids, beside a word unigram base.

Model.  A text is its words, lower-cased, each as the subword ids of a space and the word, and an end.  Ids belong to classes by the
ids around them; attention over the ids before gives the next class, and the id follows from its class by its share in all
training texts, mixed with its share after the id before where that is known well.  Ids' ranks, what stands around them, and shares are counted over all
training texts, and the weights are trained on every window of them: in ``ROUNDS`` rounds each task takes gradient steps on its windows, a part of them in each round, dealt by
a hash of their numbers, and the mean of the tasks' weights begins the next round.  All windows are shown once, however many there are.  A text is scored in windows of ``WINDOW`` inputs that overlap by ``OVERLAP``: each id once, with at least that
much before it where the text has so much.  Windows of many texts go through the masked attention together.  Texts are read and tokenised once; counts, training and scores
all go by the blocks of ids that this leaves, and weights that are only used as products are multiplied first.

Base.  Words are told apart by hashes of their ids.  Their counts over the whole corpus are gathered and given back in packed form: for each block of documents and range of
word hashes a sorted array, and from each range to each block the sums for its documents.  No word list comes to the driver.

Null and empty texts have the end as their only token.  Without training texts no word is known and the model is as initialised.
Repeated rows are scored alike; a null id isn't held out.  Ids that occur equally often are ranked by number.  Very long texts are scored
whole, in as many windows as they need.  Other columns are left out, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, gather, load
from .common import checkpoint, chunks
from .ngram_join import PACKED, PACKED_KIND, _emit, _gathered, _mix

WINDOW, OVERLAP = 32, 8
DIM, HIDDEN, CLASSES = 24, 48, 64
#: Ids whose neighbours are counted in pairs.
TOP = 1024
#: Ids as neighbours of which others get their classes, and how often an id has to be seen for that.
AROUND, SEEN = 400, 5
#: Characters that are tokenised together, and ids whose windows are laid out together; longer texts are taken whole.
CHUNK, LAID_OUT = 12_000_000, 500_000
ROUNDS, BATCH, RATE = 4, 128, 4e-3
#: Windows that are scored together, words whose ids a Python worker keeps, and documents of a block at most.
AT_ONCE, KEPT, OF_BLOCK = 128, 1_000_000, 60_000
#: Windows that make a task of their own worth while.
PER_TASK = 20_000
#: Ids, or numbers of the other weights, whose means are taken together.
SLICE = 1024
#: How much the shares of ids after an id may count; the likeliest is taken.
MIXTURES = np.linspace(0.05, 0.95, 19)
END = 50256
N_IDS = 50257
FOLDS, HELD = 7, 2


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def id_runs(texts: pa.Array, enc) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of each text's words with an end after them, joined, and where each text begins and the last ends."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = parts.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    words = parts.flatten().dictionary_encode()
    index = words.indices.to_numpy().astype(np.int64)
    real = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[index]
    flat, starts = word_ids(words.dictionary, enc)
    ids, upto = gather(flat, starts, index[real])
    cuts = upto[np.append(0, np.cumsum(real))[bounds]]
    n = len(cuts) - 1
    out = np.full(len(ids) + n, END, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(cuts))] = ids
    return out, cuts + np.arange(n + 1)


def word_ids(words: pa.StringArray, enc) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a space and each word, joined, and where each word's begin and the last end; a Python worker keeps the first ``KEPT`` words it meets."""
    met, flat, starts = getattr(enc, "met", None) or (pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64))
    at = pc.fill_null(pc.index_in(words, value_set=met), -1).to_numpy().astype(np.int64)
    new = np.flatnonzero(at < 0)
    fresh_words = words.take(pa.array(new))
    more, bounds = enc._runs(pc.binary_join_element_wise(" ", fresh_words, ""))
    at[new] = len(met) + np.arange(len(new))
    flat, starts = np.append(flat, more).astype(np.int32), np.append(starts, starts[-1] + bounds[1:])
    room = max(0, KEPT - len(met))
    if room and len(new):
        met = pa.concat_arrays([met, fresh_words.slice(0, room)])
        enc.met = met, flat[: starts[len(met)]], starts[: len(met) + 1]
    return gather(flat, starts, at)


def pieces(cuts: np.ndarray):
    """Runs of texts whose windows are laid out together."""
    i, n = 0, len(cuts) - 1
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(cuts, cuts[i] + LAID_OUT, "right")) - 1))
        yield i, j
        i = j


def n_windows(cuts: np.ndarray) -> int:
    return int((-(-np.diff(cuts) // (WINDOW - OVERLAP))).sum())


def windows(ids: np.ndarray, cuts: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of all windows, or of those whose numbers are given, -1 where there is none, and the text each is of."""
    stride = WINDOW - OVERLAP
    sizes = np.diff(cuts)
    per = -(-sizes // stride)
    of = np.repeat(np.arange(len(sizes)), per)
    first = (np.arange(len(of)) - np.repeat(np.append(0, np.cumsum(per))[:-1], per)) * stride
    if only is not None:
        of, first = of[only], first[only]
    place = first[:, None] + np.arange(-OVERLAP, stride)
    inside = (place >= 0) & (place < sizes[of][:, None])
    at = cuts[:-1][of][:, None] + place
    padded = np.append(ids, END)
    target = np.where(inside, padded[np.where(inside, at, 0)], -1)
    before = np.where(place == 0, END, padded[np.where(inside, np.maximum(at - 1, 0), 0)])
    return np.where(inside, before, -1).astype(np.int32), target[:, OVERLAP:].astype(np.int32), of


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    class_of: np.ndarray
    log_share: np.ndarray
    #: Place of an id among the most frequent, TOP for all others; shares of ids after an id; how much these count after each id.
    top_of: np.ndarray
    follows: np.ndarray
    trust: np.ndarray
    #: Windows that the weights were trained on, each as often as it was shown.
    shown: int = 0

    def forward(self, inputs: np.ndarray) -> np.ndarray:
        """Log-probabilities of the classes at the scored places of each window, step by step; what follows gives the same with fewer passes."""
        w = self.weights
        real = inputs >= 0
        ids = np.where(real, inputs, END)
        x = w["class_in"][self.class_of[ids]] + w["id_in"][ids]
        own = x[:, OVERLAP:]
        q, k, v = own @ w["q"], x @ w["k"], x @ w["v"]
        scores = q @ k.transpose(0, 2, 1) * np.float32(DIM**-0.5) + w["by_distance"][DISTANCE]
        scores += np.where(real[:, None, :], np.float32(0), np.float32(-1e9))
        scores += MASK
        scores -= scores.max(-1, keepdims=True)
        a = np.exp(scores, out=scores)
        a /= a.sum(-1, keepdims=True)
        h = own + a @ v @ w["o"]
        top = h + np.maximum(h @ w["up"] + w["up_bias"], 0) @ w["down"]
        logits = top @ w["out"] + w["out_bias"]
        logits -= logits.max(-1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(-1, keepdims=True))
        return logits

    def joint(self) -> tuple[np.ndarray, ...]:
        """Weights that are only used as products or together: queries with keys, values with outputs, and layers with their biases."""
        w = self.weights
        return (w["q"] @ w["k"].T) * np.float32(DIM**-0.5), w["v"] @ w["o"], np.vstack([w["up"], w["up_bias"]]), np.vstack([w["out"], w["out_bias"]]), (w["by_distance"][DISTANCE] + MASK).ravel()

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, scored: list | None = None, far: bool = False) -> tuple[float, dict[str, np.ndarray]]:
        """The loss and its gradients; to ``scored`` goes the log-probability of each target's class.  ``far``: exponentials would leave the range of numbers."""
        w, (qk, vo, up, out, bias) = self.weights, self.joint()
        (b, t), real, mask = targets.shape, inputs >= 0, targets >= 0
        cls = self.class_of.take(np.where(mask, targets, END).ravel())
        each, order, starts, place = grouped(np.where(real, inputs, END).astype(np.uint16).ravel())
        known = w["class_in"].take(self.class_of[each], 0) + w["id_in"].take(each, 0)
        x = np.hstack([known, np.ones((len(each), 1), np.float32)]).take(place, 0).reshape(b, WINDOW, DIM + 1)  # the last column, here and below, is 1 for sums and biases
        keys, own = x[..., :DIM], x[:, OVERLAP:, :DIM].reshape(-1, DIM)
        # attention's exponentials and their gradients, one below the other, and what they are multiplied with
        both, sides = np.empty((b, 2 * t, WINDOW), np.float32), np.empty((b, 2 * t, DIM + 1), np.float32)
        sides[:, t:, :DIM] = (known @ qk).take(place.reshape(b, WINDOW)[:, OVERLAP:], 0)
        e = np.matmul(sides[:, t:, :DIM], keys.transpose(0, 2, 1), out=both[:, :t])
        exponentials(e, bias, real, far)
        mixed = e @ x
        z = 1 / mixed[..., DIM:]
        mixed = (mixed[..., :DIM] * z).reshape(-1, DIM)
        h, top = np.empty((b * t, DIM + 1), np.float32), np.empty((b * t, DIM + 1), np.float32)
        np.add(mixed @ vo, own, out=h[:, :DIM])
        h[:, DIM] = top[:, DIM] = 1
        act = h @ up
        np.maximum(act, np.float32(0), out=act)
        np.add(act @ w["down"], h[:, :DIM], out=top[:, :DIM])
        p = top @ out
        if far:
            p -= p.max(1, keepdims=True)
        at = np.arange(0, p.size, CLASSES) + cls
        of_target = p.ravel()[at]
        np.exp(p, out=p)
        total = p @ np.ones(CLASSES, np.float32)
        if not far and not (np.isfinite(total).all() and np.isfinite(z).all() and total.all()):
            return self.gradients(inputs, targets, scored, True)
        of_target = (of_target - np.log(total)).reshape(b, t)
        if scored is not None:
            scored.append(of_target)
        n = max(1, int(mask.sum()))
        share = (mask.ravel() / n).astype(np.float32)
        p *= (share / total)[:, None]
        p.ravel()[at] -= share
        d_out, d_top = top.T @ p, p @ w["out"].T
        d_act = d_top @ w["down"].T
        d_act *= act > 0
        d_up, d_h = h.T @ d_act, d_act @ w["up"].T
        d_h += d_top
        d_vo, d_mixed = mixed.T @ d_h, d_h @ vo.T
        np.multiply(d_mixed.reshape(b, t, DIM), z, out=sides[:, :t, :DIM])
        np.multiply(np.einsum("ij,ij->i", d_mixed, mixed).reshape(b, t), -z[..., 0], out=sides[:, :t, DIM])
        d_e = np.matmul(sides[:, :t], x.transpose(0, 2, 1), out=both[:, t:])
        d_e *= e
        d_query = (d_e @ keys).reshape(-1, DIM)
        d_qk = (own.T @ d_query) * np.float32(DIM**-0.5)
        d_x = both.transpose(0, 2, 1) @ sides[..., :DIM]
        d_h += d_query @ qk.T
        d_x[:, OVERLAP:] += d_h.reshape(b, t, DIM)
        g = {"q": d_qk @ w["k"], "k": d_qk.T @ w["q"], "v": d_vo @ w["o"].T, "o": w["v"].T @ d_vo, "up": d_up[:-1], "up_bias": d_up[-1], "down": act.T @ d_top, "out": d_out[:-1], "out_bias": d_out[-1]}
        g["by_distance"] = np.bincount(DISTANCE.ravel(), np.ones(b, np.float32) @ d_e.reshape(b, -1), WINDOW).astype(np.float32)
        rows = d_x.reshape(-1, DIM).take(order, 0)
        sums = np.add.reduceat(rows, starts)
        g["id_in"] = each, rows, starts, sums
        g["class_in"] = np.zeros_like(w["class_in"])
        of_class, order, starts, _ = grouped(self.class_of[each].astype(np.uint16))
        g["class_in"][of_class] = np.add.reduceat(sums.take(order, 0), starts)
        return -float(of_target[mask].sum()) / n, g

    def tables(self) -> tuple[np.ndarray, ...]:
        """For each id what it is as a key, as a query and, with a 1 after it, as a value; and the joint weights."""
        w, joint = self.weights, self.joint()
        x = w["class_in"][self.class_of] + w["id_in"]
        return x, x @ joint[0], np.hstack([x @ joint[1], np.ones((N_IDS, 1), np.float32)]), joint

    def class_log_probability(self, inputs: np.ndarray, classes_: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Of one class at each scored place: as ``forward``, with fewer passes over the data where numbers stay in range."""
        x, queries, values, (_, _, up, out, bias) = tables or self.tables()
        result = np.empty(classes_.shape, np.float32)
        for i in range(0, len(inputs), AT_ONCE):
            real = inputs[i : i + AT_ONCE] >= 0
            ids = np.where(real, inputs[i : i + AT_ONCE], END)
            b, t, keys = len(ids), classes_.shape[1], x.take(ids, 0)
            e = queries.take(ids[:, OVERLAP:], 0) @ keys.transpose(0, 2, 1)
            exponentials(e, bias, real, False)
            mixed = e @ values.take(ids, 0)
            h, top = np.empty((b * t, DIM + 1), np.float32), np.empty((b * t, DIM + 1), np.float32)
            np.add(mixed[..., :DIM] / mixed[..., DIM:], keys[:, OVERLAP:], out=h.reshape(b, t, DIM + 1)[..., :DIM])
            h[:, DIM] = top[:, DIM] = 1
            act = h @ up
            np.maximum(act, np.float32(0), out=act)
            np.add(act @ self.weights["down"], h[:, :DIM], out=top[:, :DIM])
            logits = top @ out
            own = logits.ravel()[np.arange(0, logits.size, CLASSES) + classes_[i : i + AT_ONCE].ravel()]
            own -= np.log(np.exp(logits, out=logits) @ np.ones(CLASSES, np.float32))
            result[i : i + AT_ONCE] = own.reshape(b, t)
            if not np.isfinite(own).all():
                result[i : i + AT_ONCE] = np.take_along_axis(self.forward(inputs[i : i + AT_ONCE]), classes_[i : i + AT_ONCE][..., None], -1)[..., 0]
        return result

    def log_probability(self, inputs: np.ndarray, targets: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Natural logarithm of each target's probability, 0 where there is no target."""
        mask = targets >= 0
        safe = np.where(mask, targets, END)
        before = np.where(mask, inputs[:, OVERLAP:], END)
        p = self.class_log_probability(inputs, self.class_of.take(safe), tables)
        p += self.log_share.take(safe)
        np.exp(p, out=p)
        p += self.trust.take(before) * (self.follows.take(self.top_of.take(before) * (TOP + 1) + self.top_of.take(safe)) - p)
        return np.where(mask, np.log(p), 0)

    def score(self, ids: np.ndarray, cuts: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """log10 probability of each text."""
        out, tables = np.zeros(len(cuts) - 1), tables or self.tables()
        for i, j in pieces(cuts):
            inputs, targets, of = windows(ids[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
            for k in range(0, len(of), 1024):
                out[i:j] += np.bincount(of[k : k + 1024], self.log_probability(inputs[k : k + 1024], targets[k : k + 1024], tables).sum(1, dtype=np.float64), j - i)
        return out / np.log(10)


def exponentials(scores: np.ndarray, bias: np.ndarray, real: np.ndarray, far: bool) -> None:
    """In place of attention's scores their exponentials, 0 for what isn't there; ``far`` takes the greatest off first."""
    scores += bias.reshape(scores.shape[1:])
    some = np.flatnonzero(~real.all(1))
    if far:
        scores[some] += np.where(real[some][:, None, :], np.float32(0), np.float32(-1e9))
        scores -= scores.max(-1, keepdims=True)
    np.exp(scores, out=scores)
    scores[some] *= real[some][:, None, :]


def grouped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids that occur, the places in their order, where each id's begin, and for each place which of the ids is there."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    new = np.append(True, ids[1:] != ids[:-1])
    place = np.empty(len(ids), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return ids[starts], order, starts, place


_PLACES = np.arange(OVERLAP, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
DISTANCE = np.clip(_PLACES, 0, WINDOW - 1)
MASK = np.where(_PLACES >= 0, np.float32(0), np.float32(-1e9))


def known_ids(counts: np.ndarray) -> np.ndarray:
    """Ids that are seen often enough to get a class by what stands around them, most frequent first."""
    seen = counts.copy()
    seen[END] = 0
    known = np.flatnonzero(seen >= SEEN)
    return known[np.argsort(-seen[known], kind="stable")]


def classes(known: np.ndarray, around: np.ndarray, counts: np.ndarray, spaced: np.ndarray) -> np.ndarray:
    """Ids to classes: known ones by k-means of what stands before and after them, rare ones by whether a word begins with them."""
    of = np.where(spaced, CLASSES - 2, CLASSES - 3).astype(np.int32)
    of[END] = CLASSES - 1
    k = min(CLASSES - 3, len(known))
    if k < 2:
        return of
    x = np.sqrt(around)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    x = x @ axes[:, ::-1][:, :32]
    centres = x[:k].copy()
    weight = np.sqrt(counts[known])
    for _ in range(20):
        label = (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        for c in range(k):
            m = label == c
            if m.any():
                centres[c] = np.average(x[m], axis=0, weights=weight[m])
    of[known] = label
    return of


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def r(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    return {"class_in": r(CLASSES, DIM) * 3, "id_in": np.zeros((N_IDS, DIM), np.float32), "q": r(DIM, DIM), "k": r(DIM, DIM), "v": r(DIM, DIM), "o": r(DIM, DIM) * 0.5, "by_distance": np.linspace(1, -1, WINDOW, dtype=np.float32), "up": r(DIM, HIDDEN), "up_bias": np.zeros(HIDDEN, np.float32), "down": r(HIDDEN, DIM) * 0.5, "out": r(DIM, CLASSES) * 0.5, "out_bias": np.zeros(CLASSES, np.float32)}


def begin(counts: np.ndarray, pairs: np.ndarray, top_of: np.ndarray, class_of: np.ndarray, seed: int = 7) -> tuple[Model, np.ndarray]:
    """A model with its shares and fresh weights, and how far each id's followers are known."""
    smooth = counts + 0.05
    total = np.bincount(class_of, smooth, CLASSES)
    follows = np.zeros((TOP + 1, TOP + 1), np.float32)
    follows[:TOP, :TOP] = pairs / np.maximum(pairs.sum(1, keepdims=True), 1)
    after = np.append(pairs.sum(1), 0.0)
    model = Model(fresh(np.random.default_rng(seed)), class_of, np.log(smooth / total[class_of]).astype(np.float32), top_of, follows, np.zeros(N_IDS, np.float32))
    mass = np.bincount(class_of, counts, CLASSES) + 1.0
    model.weights["out_bias"][:] = np.log(mass / mass.sum())
    return model, (after / (after + 50.0))[top_of].astype(np.float32)


ROUND = "part int, n bigint, a binary, b binary, c binary"
ROUND_KIND = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


@dataclass
class State:
    """What a round begins with: the model, its weights but those of ids with running means of their gradients and of the squares, one below the other, and steps taken."""

    model: Model
    known: np.ndarray
    flat: np.ndarray
    step: int = 0

    @classmethod
    def of(cls, model: Model, known: np.ndarray) -> State:
        own = np.concatenate([x.ravel() for k, x in model.weights.items() if k != "id_in"])
        return cls(model, known, np.stack([own, np.zeros_like(own), np.zeros_like(own)])).copy()

    def copy(self) -> State:
        """Another one, with a model whose weights are parts of its row."""
        flat, weights, at = self.flat.copy(), {}, 0
        for k, x in self.model.weights.items():
            if k == "id_in":
                weights[k] = x.copy()
            else:
                weights[k] = flat[0, at : at + x.size].reshape(x.shape)
                at += x.size
        return replace(self, model=replace(self.model, weights=weights), flat=flat)

    def learn(self, inputs: np.ndarray, targets: np.ndarray, rate: float, move_ids: bool, likelihood: np.ndarray | None) -> None:
        """A gradient step; ``likelihood`` of the targets under each of MIXTURES is added to."""
        self.step += 1
        scored, (w, m, v) = [], self.flat
        _, g = self.model.gradients(inputs, targets, scored)
        if likelihood is not None:
            mask = targets >= 0
            after, before = targets[mask], inputs[:, OVERLAP:][mask]
            own = np.exp(scored[0][mask] + self.model.log_share[after])
            more = self.known[before] * (self.model.follows[self.model.top_of[before], self.model.top_of[after]] - own)
            each = own + MIXTURES[:, None] * more  # in double precision, where products of four stay in range
            while each.shape[1] % 4:
                each = np.hstack([each, np.ones((len(each), 1))])
            likelihood += np.log(each.reshape(len(each), 4, -1).prod(1)).sum(1)
        some, rows, starts, total = g["id_in"]
        if move_ids:  # ids move away from their classes once those have settled
            if max(rows.max(), -rows.min()) * BATCH > 1:
                total = np.add.reduceat(np.clip(rows * BATCH, -1, 1), starts) / BATCH
            self.model.weights["id_in"][some] -= np.float32(4 * rate * BATCH) * total
        grad = np.concatenate([g[k].ravel() for k in self.model.weights if k != "id_in"])
        m += np.float32(0.1) * (grad - m)
        v += np.float32(0.02) * (grad * grad - v)
        w -= np.float32(rate / (1 - 0.9**self.step)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.98**self.step))) + np.float32(1e-8))


def _blocks(batches):
    """Ids and cuts of each row."""
    for b in batches:
        for ids, cuts in zip(b.column(0), b.column(1)):
            yield np.frombuffer(ids.as_py(), np.uint16).astype(np.int32), np.frombuffer(cuts.as_py(), np.int64)


def turns(first: int, upto: int) -> np.ndarray:
    """The round in which each of a task's windows is shown: one for each, whatever place the window has in its text."""
    return (_mix(np.arange(first, upto, dtype=np.uint64) + np.uint64(1)) % np.uint64(ROUNDS)).astype(np.int64)


def _round(sent, rnd: int):
    """Steps on the windows whose turn it is; weights, and how far ids have moved, in slices."""

    def run(batches):
        state, rng = sent.value.copy(), np.random.default_rng([7, rnd, TaskContext.get().partitionId()])
        old, seen, n, at = sent.value.model.weights["id_in"], np.zeros(N_IDS, np.int64), 0, 0
        likelihood = np.zeros(len(MIXTURES))
        rate = RATE * (1 - rnd / ROUNDS) + 1e-5
        for ids, cuts in ((ids[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]) for ids, cuts in _blocks(batches) for i, j in pieces(cuts)):
            upto = at + n_windows(cuts)
            inputs, targets, _ = windows(ids, cuts, np.flatnonzero(turns(at, upto) == rnd))
            at = upto
            n += len(inputs)
            seen += np.bincount(inputs[inputs >= 0], minlength=N_IDS)
            order = rng.permutation(len(inputs))
            for i in range(0, len(order), BATCH):
                state.learn(inputs[order[i : i + BATCH]], targets[order[i : i + BATCH]], rate, rnd > 0, likelihood if rnd == ROUNDS - 1 else None)
        if not n:
            return
        flat = state.flat.ravel()
        rows = [(-2 - k // SLICE, n, flat[k : k + SLICE].tobytes(), None, None) for k in range(0, len(flat), SLICE)]
        rows.append((-1, n, likelihood.tobytes(), np.array([state.step], np.int64).tobytes(), None))
        moved = state.model.weights["id_in"] - old
        for k in range(0, N_IDS, SLICE):
            some = np.flatnonzero(seen[k : k + SLICE]) if rnd else []
            if len(some):
                rows.append((k // SLICE, n, moved[k + some].tobytes(), seen[k + some].tobytes(), some.astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROUND_KIND)], schema=ROUND_KIND)

    return run


def _means(pdf: pd.DataFrame) -> pd.DataFrame:
    """A slice's mean over the tasks: of weights by their windows, of an id's move by how often each task met it; likelihoods are summed."""
    part, n = int(pdf["part"].iloc[0]), int(pdf["n"].sum())
    if part == -1:
        a, b = sum(np.frombuffer(x, np.float64) for x in pdf["a"]), max(int(np.frombuffer(x, np.int64)[0]) for x in pdf["b"])
        return pd.DataFrame([(part, n, a.tobytes(), np.array([b], np.int64).tobytes(), None)], columns=ROUND_KIND.names)
    if part < -1:
        a = sum(np.frombuffer(x, np.float32).astype(np.float64) * m for x, m in zip(pdf["a"], pdf["n"])) / n
        return pd.DataFrame([(part, n, a.astype(np.float32).tobytes(), None, None)], columns=ROUND_KIND.names)
    moved, times = np.zeros((SLICE, DIM)), np.zeros(SLICE)
    for a, b, c in pdf[["a", "b", "c"]].itertuples(index=False):
        some, m = np.frombuffer(c, np.int32), np.frombuffer(b, np.int64)
        moved[some] += np.frombuffer(a, np.float32).reshape(-1, DIM) * m[:, None]
        times[some] += m
    mean = (moved / np.maximum(times, 1)[:, None]).astype(np.float32)
    return pd.DataFrame([(part, n, mean.tobytes(), None, None)], columns=ROUND_KIND.names)


def fit(blocks: DataFrame, shown: int, model: Model, known: np.ndarray) -> Model:
    """Trains the weights on all windows of the blocks, ``shown`` of them."""
    state, share = State.of(model, known), 0.5
    blocks = blocks.select("ids", "cuts").coalesce(max(1, shown // PER_TASK))
    for rnd in range(ROUNDS if shown else 0):
        sent = blocks.sparkSession.sparkContext.broadcast(state)  # of fixed size, about 15 MB
        got = blocks.mapInArrow(_round(sent, rnd), ROUND).groupBy("part").applyInPandas(_means, ROUND).toPandas()  # at most the weights
        sent.destroy()
        got = got.set_index("part").sort_index()
        if not len(got):
            continue
        state.flat.ravel()[:] = np.concatenate([np.frombuffer(x, np.float32) for x in got.loc[got.index < -1, "a"][::-1]])
        for k, x in got.loc[got.index >= 0, "a"].items():
            own = state.model.weights["id_in"][k * SLICE : (k + 1) * SLICE]
            own += np.frombuffer(x, np.float32).reshape(-1, DIM)[: len(own)]
        state.step = int(np.frombuffer(got.at[-1, "b"], np.int64)[0])
        state.model.shown += int(got.at[-1, "n"])
        share = float(MIXTURES[np.frombuffer(got.at[-1, "a"], np.float64).argmax()])
    state.model.trust = (share * known).astype(np.float32)
    return state.model


BLOCK = "own boolean, n_docs bigint, n_windows bigint, ids binary, cuts binary, about binary"


def tokenised(docs: DataFrame, data: bytes, pattern: str, kind: str) -> DataFrame:
    """Blocks of documents to learn from (``own``) and of others: ids, where each document's begin and the last end, and doc_ids with whether there is one.  Texts are read here alone."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            for own in (True, False):
                some = b.filter(pc.equal(b.column(1), not own))
                for x in (some.slice(i, OF_BLOCK) for i in range(0, len(some), OF_BLOCK)):
                    ids, cuts = id_runs(x.column(2), encoder(data, pattern, kind))
                    about = np.stack([np.asarray(pc.fill_null(x.column(0), 0)).astype(np.int64), np.asarray(pc.is_valid(x.column(0))).astype(np.int64)])
                    yield pa.RecordBatch.from_pydict({"own": [own], "n_docs": [len(x)], "n_windows": [n_windows(cuts)], "ids": [ids.astype(np.uint16).tobytes()], "cuts": [cuts.astype(np.int64).tobytes()], "about": [about.tobytes()]})

    return checkpoint(rows.mapInArrow(run, BLOCK))


def begins_word(tokens: list[bytes]) -> np.ndarray:
    """Ids that a word begins with: those, and no others, begin with a space."""
    return np.array([t.startswith(b" ") for t in tokens] + [False] * N_IDS)[:N_IDS]


def train(docs: DataFrame, path: str, pattern: str) -> Model:
    """A model of the training texts."""
    data, kind = load(path)
    return trained(tokenised(docs, data, pattern, kind), begins_word(encoder(data, pattern, kind).vocabulary.tokens))


def trained(blocks: DataFrame, spaced: np.ndarray) -> Model:
    """Classes, shares and weights, all of them by every training text."""
    blocks = blocks.where("own")
    shown = int(blocks.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0])

    def totals(of, *sizes: int) -> list[np.ndarray]:
        """Over all blocks, the sums of the counts of cells that ``of`` gives for ids and those before them."""

        def run(batches):
            sums = [np.zeros(n, np.int32) for n in sizes]
            for ids, cuts in _blocks(batches):
                own = ids.astype(np.int64)
                before = np.append(END, own[:-1])
                before[cuts[:-1]] = END
                for total, cells in zip(sums, of(before, own)):
                    np.add.at(total, cells, np.int32(1))
            for k, total in enumerate(sums):
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["what", "cell", "n"])

        got = blocks.select("ids", "cuts").mapInArrow(run, "what int, cell int, n bigint").groupBy("what", "cell").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each cell
        out = [np.zeros(n) if n <= (TOP + 1) ** 2 else np.zeros(n, np.float32) for n in sizes]
        for k, into in enumerate(out):
            own = got[got["what"] == k]
            into[own["cell"].to_numpy()] = own["n"].to_numpy()
        return out

    (counts,) = totals(lambda before, own: (own,), N_IDS)
    top_of = np.full(N_IDS, TOP, np.int64)
    top_of[np.argsort(-counts, kind="stable")[:TOP]] = np.arange(TOP)
    known = known_ids(counts)
    wide = min(AROUND, len(known))
    row, col = np.full(N_IDS, -1), np.full(N_IDS, wide)
    row[known], col[known[:wide]] = np.arange(len(known)), np.arange(wide)
    width = 2 * (wide + 1)

    def neighbours(before, own):
        a, b = row[before] >= 0, row[own] >= 0
        return top_of[before] * (TOP + 1) + top_of[own], np.append(row[before[a]] * width + col[own[a]], row[own[b]] * width + wide + 1 + col[before[b]])

    pairs, around = totals(neighbours, (TOP + 1) ** 2, len(known) * width)
    class_of = classes(known, around.reshape(len(known), width), counts, spaced)
    model, trust_of = begin(counts, pairs.reshape(TOP + 1, TOP + 1)[:TOP, :TOP], top_of, class_of)
    return fit(blocks, shown, model, trust_of)


def word_runs(ids: np.ndarray, cuts: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, by their ids, which no other word has; and where each document's begin and the last end."""
    starts = np.flatnonzero(spaced[ids])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    place = np.arange(len(ids)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(ids)]])))
    mixed = _mix(ids.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))
    mixed[ids == END] = 0
    return np.add.reduceat(mixed, starts), np.searchsorted(starts, cuts)


def _pack(parts: int, spaced: np.ndarray, model):
    def run(batches):
        block, m = TaskContext.get().partitionId() << 32, model.value
        tables = m.tables()
        for own, ids, cuts, about in (x for b in batches for x in zip(*(b.column(k) for k in ("own", "ids", "cuts", "about")))):
            ids, cuts = np.frombuffer(ids.as_py(), np.uint16).astype(np.int32), np.frombuffer(cuts.as_py(), np.int64)
            doc_ids, known = np.frombuffer(about.as_py(), np.int64).reshape(2, -1)
            hashes, bounds = word_runs(ids, cuts, spaced)
            sizes = np.diff(bounds)
            head = np.stack([doc_ids, np.full(len(known), int(not own.as_py())), known, sizes, m.score(ids, cuts, tables).view(np.int64)])
            order = np.argsort(hashes)
            new = np.append(True, hashes[order][1:] != hashes[order][:-1])[: len(order)]
            cells = np.sort((np.cumsum(new) - 1) << 16 | np.repeat(np.arange(len(sizes)), sizes)[order])
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])[: len(cells)])
            times = np.diff(np.append(first, len(cells))) * (1 if own.as_py() else -1)
            times = times.astype(np.int16 if len(times) == 0 or abs(times).max() < 2**15 else np.int32)
            tokens, owners = hashes[order][new][cells[first] >> 16], (cells[first] & 0xFFFF).astype(np.uint16)
            shift = np.uint64(64 - (parts - 1).bit_length())
            at = np.searchsorted(tokens >> shift, np.arange(parts + 1, dtype=np.uint64)).tolist()
            rows = [(block % parts, block, 0, head.tobytes(), None, None)]
            rows += [(p, block, 1, tokens[i:j].tobytes(), owners[i:j].tobytes(), times[i:j].tobytes()) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
            yield _emit(rows)
            block += 1

    return run


def _range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of a range's words; to each block the sums for its documents, and the range's totals."""
    tokens, owners, cuts, blocks = _gathered(pdf)
    times = [np.frombuffer(x, np.int16 if len(x) == 2 * n else np.int32) for x, n in zip(pdf.loc[pdf["kind"] == 1, "c"], np.diff(cuts))]
    times = np.concatenate(times).astype(np.int64) if times else np.zeros(0, np.int64)
    order = np.argsort(tokens)
    start = np.append(True, np.diff(tokens[order]) != 0) if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(start) - 1
    counts = np.bincount(group, np.maximum(times, 0), int(start.sum())).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    c, n = counts[group], np.abs(times)
    rows = [tuple(r) for r in pdf.loc[pdf["kind"] == 0, PACKED_KIND.names].itertuples(index=False)]
    rows.append((0, -1 - int(pdf["part"].iloc[0]), 2, np.array([counts.sum(), (counts > 0).sum()], np.int64).tobytes(), None, None))
    logs = np.log10(c + 1.0) * n
    for block, i, j in zip(blocks, cuts.tolist(), cuts[1:].tolist()):
        rows.append((0, block, 1, np.bincount(owners[i:j], logs[i:j]).tobytes(), np.bincount(owners[i:j], n[i:j] * (c[i:j] > 0)).astype(np.int64).tobytes(), None))
    return pd.DataFrame(rows, columns=PACKED_KIND.names)


_SUMS = "total boolean, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double"


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's documents, or the totals of a range as n_tokens and n_known."""
    names = [c.split()[0] for c in _SUMS.split(", ")]
    if pdf["kind"].iloc[0] == 2:
        n, v = np.frombuffer(pdf["a"].iloc[0], np.int64)
        return pd.DataFrame([(True, None, False, int(n), int(v), 0.0, 0.0)], columns=names).astype({"doc_id": "Int64"})
    ids, held, known, n_words, scores = np.frombuffer(pdf.loc[pdf["kind"] == 0, "a"].iloc[0], np.int64).reshape(5, -1)
    logs, n_known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for a, b in pdf.loc[pdf["kind"] == 1, ["a", "b"]].itertuples(index=False):
        x, y = np.frombuffer(a, np.float64), np.frombuffer(b, np.int64)
        logs[: len(x)] += x
        n_known[: len(y)] += y
    out = pd.DataFrame({"total": False, "doc_id": pd.array(ids.copy(), "Int64"), "held_out": held > 0, "n_tokens": n_words + 1, "n_known": n_known, "logs": logs, "score": scores.view(np.float64)})
    out["doc_id"] = out["doc_id"].mask(known == 0)
    return out[names]


def score_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    data, kind = load(path)
    blocks, spaced = tokenised(docs, data, pattern, kind), begins_word(encoder(data, pattern, kind).vocabulary.tokens)
    model = docs.sparkSession.sparkContext.broadcast(trained(blocks, spaced))  # of fixed size, about 10 MB
    n_docs, n_train = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("own"), F.col("n_docs"))), F.lit(0))).first()
    parts = max(64, 1 << (n_docs // 8000).bit_length())
    sums = blocks.mapInArrow(_pack(parts, spaced, model), PACKED).groupBy("part").applyInPandas(_range, PACKED)
    sums = checkpoint(sums.groupBy("block").applyInPandas(_sums, _SUMS))
    n, v = sums.where("total").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()
    n, v = n + n_train, v + (n_train > 0)  # the end counts too
    base = F.col("logs") + F.lit(float(np.log10(n_train + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))
    return sums.where("not total").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(n_train > 0))).alias("n_known"), F.lit(int(n)).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
