"""Byte-level BPE with a hierarchical-bitmap rank queue.

Every pending merge sits in the bucket of its rank as a position of a linked list of symbols.  A bitmap of three
levels over the ranks says which buckets hold something; find-first-set over it names the next rank.  Entries whose
pair has changed since are skipped when their bucket is taken.  Many pre-tokens are laid out in one list, with no links
between them, so a bucket is merged for all of them by a few array operations; the work for one pre-token of n
symbols stays O(n) queue operations however long it is.

Null text counts as empty and gives no ids.  Repeated rows and ties have no influence: rows are independent.  Very long texts are encoded
whole.  Other columns are left out, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import chunks

NONE = np.int32(2**31 - 1)
#: Marks that, after a word, are a pre-token of their own.
MARKS = pa.array(list(".,;:!?"))


class RankBitmap:
    """The ranks that have a bucket, as 64-ary bitmaps of three levels."""

    def __init__(self, n: int):
        self.low = [0] * ((n >> 6) + 1)
        self.mid = [0] * ((n >> 12) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> int:
        """The least rank, which is taken out; -1 when there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        w = self.mid[a]
        b = a << 6 | (w & -w).bit_length() - 1
        w = self.low[b]
        bit = w & -w
        rank = b << 6 | bit.bit_length() - 1
        self.low[b] = w ^ bit
        if w == bit:
            self.mid[a] ^= 1 << (b & 63)
            if not self.mid[a]:
                self.top ^= 1 << a
        return rank


class Vocabulary:
    """Merges of a byte-level BPE: for each pair of ids its rank and the id it becomes."""

    def __init__(self, tokens: list[bytes], pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        order = np.argsort(pairs)
        self.tokens, self.pairs, self.ranks, self.merged = tokens, pairs[order], ranks[order], merged[order]
        self.n_ranks = int(ranks.max()) + 1 if len(ranks) else 1
        self.of_rank = np.zeros(self.n_ranks, np.int32)
        self.of_rank[ranks] = merged
        by_bytes = {t: i for i, t in enumerate(tokens) if len(t) == 1}
        self.byte_ids = np.array([by_bytes[bytes([b])] for b in range(256)], np.int32)
        self.of_bytes = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    @classmethod
    def from_tiktoken(cls, data: bytes) -> Vocabulary:
        """Rank files: any two neighbours whose bytes together are a token may merge, by the rank of that token."""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        tokens = [b""] * (max(ranks.values()) + 1)
        pairs, to = [], []
        for t, r in ranks.items():
            tokens[r] = t
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    pairs.append(a << 32 | b)
                    to.append(r)
        return cls(tokens, np.array(pairs, np.int64), np.array(to, np.int32), np.array(to, np.int32))

    @classmethod
    def from_json(cls, data: bytes) -> Vocabulary:
        """Files of the tokenizers library: the merges listed, by their place in the list."""
        model = json.loads(data)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of_char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = model["vocab"]
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if all(c in of_char for c in t):
                tokens[i] = bytes(of_char[c] for c in t)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        return cls(tokens, pairs, np.arange(len(merges), dtype=np.int32), np.array([vocab[a + b] for a, b in merges], np.int32))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each pre-token."""
        ids, upto = self.encode_flat(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ids, upto = ids.tolist(), upto.tolist()
        return [tuple(ids[i:j]) for i, j in zip(upto, upto[1:])]

    def encode_flat(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens as their bytes, joined, and their lengths; ids, joined, and where each pre-token's begin and the last end."""
        ends = np.cumsum(lengths)
        sym = self.byte_ids[data]
        n = len(sym)
        sym = np.append(sym, np.int32(0))
        nxt = np.arange(1, n + 2, dtype=np.int32)
        nxt[ends[lengths > 0] - 1] = n  # n: no neighbour
        prv = np.arange(-1, n, dtype=np.int32)
        prv[(ends - lengths)[lengths > 0]] = n
        rank_at = np.full(n + 1, NONE, np.int32)
        if n:
            rank_at[: n - 1] = self.of_bytes[data[:-1], data[1:]]
            rank_at[:n][nxt[:n] == n] = NONE
        linked = np.flatnonzero(rank_at[:n] != NONE).astype(np.int32)
        alive = np.ones(n, bool)
        bits = RankBitmap(self.n_ranks)
        buckets: dict[int, list[np.ndarray]] = {}

        def push(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
            for i, j in zip(cuts, cuts[1:]):
                r = int(ranks[i])
                if r in buckets:
                    buckets[r].append(places[i:j])
                else:
                    buckets[r] = [places[i:j]]
                    bits.add(r)

        redo = []
        if len(linked):
            push(rank_at[linked], linked)
        while (r := bits.pop()) >= 0:
            held = buckets.pop(r)
            p = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            p = p[rank_at[p] == r]
            if len(p) > 1:
                joint = p[1:] == nxt[p[:-1]]
                if joint.any():  # a run such as aaaa: from the left, every other pair
                    first = np.append(True, ~joint)
                    at = np.arange(len(p))
                    p = p[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            if not len(p):
                continue
            q = nxt[p]
            after = nxt[q]
            sym[p] = self.of_rank[r]
            nxt[p] = after
            prv[after] = p
            alive[q] = False
            rank_at[q] = NONE
            before = prv[p]
            left = before < n
            places = np.concatenate([p, before[left]])
            right = nxt[places]
            ok = right < n
            new = np.full(len(places), NONE, np.int32)
            new[ok] = self.rank(sym[places[ok]], sym[right[ok]])
            rank_at[places] = new
            if (new < r).any():
                redo.extend(np.searchsorted(ends, places[new < r], "right").tolist())
            some = new != NONE
            if some.any():
                push(new[some], places[some])
        ids, upto = sym[:n][alive], np.append(0, np.append(0, np.cumsum(alive))[ends])
        if redo:  # a merge whose result may go first: one merge at a time
            parts = np.split(ids, upto[1:-1])
            for k in set(redo):
                parts[k] = np.array(self.encode_one(data[ends[k] - lengths[k] : ends[k]].tobytes()), np.int32)
            ids, upto = np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
        return ids, upto

    def encode_one(self, piece: bytes) -> tuple[int, ...]:
        """The same queue with one merge at a time: always the leftmost pair of the least rank."""
        import heapq

        sym = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(sym)
        nxt, prv, bits = list(range(1, n + 1)), list(range(-1, n - 1)), RankBitmap(self.n_ranks)
        buckets: dict[int, list[int]] = {}
        table = dict(zip(self.pairs.tolist(), self.ranks.tolist()))

        def rank(i: int) -> int | None:
            return table.get(sym[i] << 32 | sym[nxt[i]]) if sym[i] >= 0 and nxt[i] < n else None

        def push(i: int) -> None:
            if i >= 0 and (r := rank(i)) is not None:
                if r not in buckets:
                    buckets[r] = []
                    bits.add(r)
                heapq.heappush(buckets[r], i)

        for i in range(n):
            push(i)
        while (r := bits.pop()) >= 0:
            places = buckets.pop(r)
            i = heapq.heappop(places)
            if places:
                buckets[r] = places
                bits.add(r)
            if rank(i) != r:
                continue
            j = nxt[i]
            sym[i], nxt[i], sym[j] = int(self.of_rank[r]), nxt[j], -1
            if nxt[i] < n:
                prv[nxt[i]] = i
            push(prv[i])
            push(i)
        return tuple(x for x in sym if x >= 0)


def gather(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat``, joined, and where each begins and the last ends."""
    lengths = (starts[1:] - starts[:-1])[which]
    upto = np.append(0, np.cumsum(lengths))
    return flat[np.repeat(starts[:-1][which] - upto[:-1], lengths) + np.arange(upto[-1])], upto


class TextEncoder:
    """Whole texts to ids.

    Between two single spaces pre-tokens don't depend on what stands beyond them, so each different run between spaces is
    split and encoded once for a batch.  Texts in which a space meets other white space are split as a whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall

    def _runs(self, runs: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each run; a word, with or without a mark after it, needs no pattern."""
        lead = pc.starts_with(runs, " ")
        body = pc.if_else(lead, pc.utf8_slice_codeunits(runs, 1), runs)
        stem, last = pc.utf8_slice_codeunits(body, 0, -1), pc.utf8_slice_codeunits(runs, -1)
        word = pc.utf8_is_alpha(body).to_numpy(zero_copy_only=False)
        marked = ~word & pc.and_(pc.utf8_is_alpha(stem), pc.is_in(last, MARKS)).to_numpy(zero_copy_only=False)
        other = ~word & ~marked
        found = [self.find(x) for x in runs.filter(pa.array(other)).to_pylist()]
        pieces = pa.concat_arrays([runs.filter(pa.array(word)), pc.utf8_slice_codeunits(runs.filter(pa.array(marked)), 0, -1), last.filter(pa.array(marked)), pa.array(list(chain.from_iterable(found)), pa.string())])
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy()
        n_word, n_marked = int(word.sum()), int(marked.sum())
        counts = np.where(word, 1, 2)
        counts[other] = [len(x) for x in found]
        upto = np.append(0, np.cumsum(counts))
        order = np.empty(upto[-1], np.int64)
        order[upto[:-1][word]] = index[:n_word]
        order[upto[:-1][marked]] = index[n_word : n_word + n_marked]
        order[upto[:-1][marked] + 1] = index[n_word + n_marked : n_word + 2 * n_marked]
        if found:
            places = np.repeat(upto[:-1][other], counts[other])
            order[places + np.arange(len(places)) - np.repeat(np.append(0, np.cumsum(counts[other]))[:-1], counts[other])] = index[n_word + 2 * n_marked :]
        flat, bounds = gather(*self._pieces(coded.dictionary), order)
        return flat, bounds[upto]

    def _pieces(self, different: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        data = different.cast(pa.binary())
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        held = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(data) and data.buffers()[2] else np.zeros(0, np.uint8)
        return self.vocabulary.encode_flat(held, np.diff(offsets))

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        runs = parts.flatten().dictionary_encode()
        which, different = runs.indices.to_numpy().astype(np.int64), runs.dictionary
        space = lambda x: pc.fill_null(pc.utf8_is_space(x), False).to_numpy(zero_copy_only=False)
        empty = pc.equal(different, "").to_numpy(zero_copy_only=False)
        ends_so = space(pc.utf8_slice_codeunits(different, -1))
        edge = empty | ends_so | space(pc.utf8_slice_codeunits(different, 0, 1))
        bad = edge[which]
        firsts = which[bounds[:-1]]
        bad[bounds[:-1]] = empty[firsts] | ends_so[firsts]
        heads, head_of = np.unique(firsts, return_inverse=True)
        which[bounds[:-1]] = len(different) + head_of
        flat, starts = self._runs(pa.concat_arrays([pc.binary_join_element_wise(" ", different, ""), different.take(pa.array(heads))]))
        flat, upto = gather(flat, starts, which)
        upto = upto[bounds]
        out = [flat[i:j] for i, j in zip(upto.tolist(), upto[1:].tolist())]
        whole = np.flatnonzero(np.add.reduceat(bad, bounds[:-1])).tolist()
        if whole:
            found = [self.find(x) for x in texts.take(pa.array(whole)).to_pylist()]
            coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            flat, upto = gather(*self._pieces(coded.dictionary), coded.indices.to_numpy().astype(np.int64))
            cut = upto[np.append(0, np.cumsum([len(x) for x in found]))]
            for k, i, j in zip(whole, cut.tolist(), cut[1:].tolist()):
                out[k] = flat[i:j]
        return out


_encoders: dict = {}


def encoder(data: bytes, pattern: str, kind: str) -> TextEncoder:
    """One for each vocabulary and Python worker."""
    key = (hashlib.md5(data).digest(), pattern, kind)
    if key not in _encoders:
        _encoders[key] = TextEncoder(Vocabulary.from_json(data) if kind == "json" else Vocabulary.from_tiktoken(data), pattern)
    return _encoders[key]


def load(path: str) -> tuple[bytes, str]:
    """A vocabulary file and its kind; it is read by the driver and goes to the tasks with the function (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read(), "json" if path.endswith(".json") else "tiktoken"


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, the ids of the whole text."""
    data, kind = load(path)

    def run(batches):
        for b in chunks(batches, "text"):
            ids = encoder(data, pattern, kind).encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind_of_id = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as text").mapInArrow(run, f"id {kind_of_id}, ids array<int>").withColumnRenamed("id", id_col)


def decode(vocabulary: Vocabulary, ids: list[int]) -> bytes:
    return b"".join(map(vocabulary.tokens.__getitem__, ids))


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text, decode the ids again, and return their number and the digests of both."""
    data, kind = load(path)

    def run(batches):
        enc = encoder(data, pattern, kind)
        names = [str(i) for i in range(len(enc.vocabulary.tokens))]
        for b in chunks(batches, "text"):
            n, a, z = [], [], []
            for ids in map(np.ndarray.tolist, enc.encode(b.column(1))):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                z.append(hashlib.sha256(decode(enc.vocabulary, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
