"""N-gram Jaccard self-join by prefix trees.

A text's set holds the 64-bit hashes of its different five-word shingles.  Two sets link when their intersection has at least three
quarters of their union.  The join goes through these steps, all exact:

1. Equal sets count as one, under the least id of their documents.
2. A set can only link if enough of its least hashes occur in other sets: of partners' ``n - ceil(0.75 n) + l`` least hashes at
   least ``l`` are common.  Hashes travel packed, a sorted array for each range of hash values and block of documents, and only
   counts come back, so this costs eight bytes for each of half the shingles.
3. For the sets that are left, the shingles that occur in several of them are ordered by document frequency, the rarest first.
   Shingles of one set alone come before these, so its prefix of ``n - ceil(0.75 n) + 1`` reaches few or no shared ones.
4. Sets with a common prefix shingle are compared.  Each shingle has a pivot among its sets, and each set joins the group of the
   pivot it meets most often; the sets of a group are all compared, in pairs of blocks.  That is done for ROUNDS choices of pivots, and
   then for those pairs that were in no group together and still lie in different components.  (Within a component a further link changes nothing.)
   These pairs must also pass a bound: a set's signature has the parities of its shared shingles by hash, SIGNED bits, so that two sets differ
   in at least as many shingles as their signatures in bits, and in those that one of them has alone.  Sets to compare are stored in a
   prefix tree in the global order, which the others walk: overlaps of common beginnings are shared, and a subtree goes as soon as
   what can still be gained on either side isn't enough.
5. Components of the links that were found.

Null and empty texts have the empty set and link with nothing.  Texts with one to four words have one shingle.  Documents with a null
id link with nothing either, and their component is null.  Rows with one id but different texts are documents of their own that share a name.
Ties don't matter.  Very long texts are taken whole; how many parts the work has goes by bytes.  Other columns are left out, whatever
their names.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, chunks, compact, tidy
from .components import Forest, connected_components

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
GROUP = 512
#: Times that sets are grouped by pivots, each time by another choice of these.
ROUNDS = 2
#: Bits of a set's signature, a multiple of 64.
SIGNED = 1024
#: Bytes of text, or shingles, that make a part of its own worth while.
PART_BYTES, PART_SHINGLES = 24_000_000, 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and where each text's begin and the last end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten().dictionary_encode()
    bounds = parts.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    index = words.indices.to_numpy()
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    real = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[index]
    return of[index[real]], np.append(0, np.cumsum(real))[bounds]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    w, bounds = word_hashes(texts)
    if len(w) >= words:
        s = w[: len(w) - words + 1].copy()
        for k in range(1, words):
            s = s * _P + w[k : len(w) - words + 1 + k]
        s = _mix(s)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for h in w[a:b]:
                x = np.uint64((int(x) * int(_P) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(_mix(np.array([x])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(s):
        return 0, 0
    return int(s.sum().view(np.int64)), int(_mix(s * _P).sum().view(np.int64))


def need(n: int) -> int:
    """Common shingles that a partner must have with a set of ``n``, at least."""
    return -(-NUMERATOR * n // DENOMINATOR)


def longer(n: int) -> int:
    """How many common shingles the longer prefix of step 2 asks for."""
    return -(-n // 4)


PACKED = "part int, block bigint, kind int, a binary, b binary, c binary"
PACKED_KIND = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), PACKED_KIND)], schema=PACKED_KIND)


def _cut(block: int, tokens: np.ndarray, owners: np.ndarray, parts: int) -> list[tuple]:
    """A block's tokens by range of values."""
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    shift = np.uint64(64 - (parts - 1).bit_length())
    cuts = np.searchsorted(tokens >> shift, np.arange(parts + 1, dtype=np.uint64)).tolist()
    return [(p, block, 1, tokens[i:j].tobytes(), owners[i:j].astype(np.uint16).tobytes(), None) for p, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]


#: The owner of a token that several sets of a block have.
SEVERAL = 0xFFFF


def _combined(tokens: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One token of those that several of a block's ``n`` sets have, and for each set how many such it has: these are shared whatever other blocks hold."""
    order = np.argsort(tokens >> np.uint64(16), kind="stable")
    tokens, owners = tokens[order], owners[order]
    start = np.append(True, tokens[1:] >> np.uint64(16) != tokens[:-1] >> np.uint64(16)) if len(tokens) else np.zeros(0, bool)
    first = np.flatnonzero(start)
    several = np.diff(np.append(first, len(tokens))) > 1
    own = np.bincount(owners[several[np.cumsum(start) - 1]], minlength=n) if len(tokens) else np.zeros(n, np.int64)
    return tokens[first], np.where(several, SEVERAL, owners[first]), own


def _blocks(parts: int, half: bool):
    """Packs batches of (id, text, hash of the text) or (id, text, k1, k2); ``half``: the longer prefix only, 48 bits of each hash."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in (x for big in chunks(batches, "text") for x in (big.slice(i, 60_000) for i in range(0, len(big), 60_000))):
            sets = shingle_sets(b.column(1))
            ids = b.column(0)
            if not half:  # rows of one id but another text came along
                keep = [i for i, (s, x, y) in enumerate(zip(sets, b.column(2).to_pylist(), b.column(3).to_pylist())) if set_key(s) == (x, y)]
                sets, ids = [sets[i] for i in keep], ids.take(pa.array(keep, pa.int64()))
            if not len(ids):
                continue
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            known = np.asarray(pc.is_valid(ids))
            head = np.stack([np.asarray(pc.fill_null(ids, 0)).astype(np.int64), sizes, known.astype(np.int64), *np.array([set_key(s) for s in sets], np.int64).T])
            if half:
                head = np.vstack([head, np.asarray(b.column(2)).astype(np.int64)])
            rows = [(number % parts, number, 0, head.tobytes(), None, None)]
            taken = [s[: n - need(n) + longer(n)] if half else s for s, n in zip(sets, sizes.tolist())]
            owners = np.repeat(np.arange(len(sets)), list(map(len, taken)))
            tokens = np.concatenate(taken) if taken else np.zeros(0, np.uint64)
            keep = known[owners]
            tokens, owners = tokens[keep], owners[keep]
            if half:
                tokens, owners, own = _combined(tokens, owners, len(sets))
                rows[0] = (*rows[0][:3], np.vstack([head, own]).tobytes(), None, None)
            yield _emit(rows + _cut(number, tokens, owners, parts))
            number += 1

    return run


def _gathered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    own = pdf[pdf["kind"] == 1]
    tokens = [np.frombuffer(x, np.uint64) for x in own["a"]]
    owners = [np.frombuffer(x, np.uint16) if x is not None else (t & np.uint64(0xFFFF)).astype(np.uint16) for t, x in zip(tokens, own["b"])]
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(1, np.int64), []
    return np.concatenate(tokens), np.concatenate(owners), np.append(0, np.cumsum([len(x) for x in tokens])), own["block"].tolist()


def _frequencies(tokens: np.ndarray) -> np.ndarray:
    """How often each one's value occurs."""
    order = np.argsort(tokens)
    t = tokens[order]
    start = np.append(True, t[1:] != t[:-1]) if len(t) else np.zeros(0, bool)
    counts = np.diff(np.append(np.flatnonzero(start), len(t)))
    out = np.empty(len(t), np.int64)
    out[order] = np.repeat(counts, counts)
    return out


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, how many shingles of each set others have too."""
    tokens, owners, cuts, blocks = _gathered(pdf)
    shared = _frequencies(tokens >> np.uint64(16)) > 1
    rows = [tuple(r) for r in pdf.loc[pdf["kind"] == 0, ["part", "block", "kind", "a", "b", "c"]].itertuples(index=False)]
    for block, i, j in zip(blocks, cuts.tolist(), cuts[1:].tolist()):
        own = owners[i:j][shared[i:j] & (owners[i:j] != SEVERAL)]
        if len(own):
            rows.append((0, block, 1, np.bincount(own).astype(np.uint32).tobytes(), None, None))
    return pd.DataFrame(rows, columns=PACKED_KIND.names)


def _alive(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block, and whether step 2 leaves them."""
    heads = pdf[pdf["kind"] == 0]
    ids, sizes, known, k1, k2, of_text, own = np.frombuffer(heads["a"].iloc[0], np.int64).reshape(7, -1)
    counts = own.copy()
    for x in pdf.loc[pdf["kind"] == 1, "a"]:
        c = np.frombuffer(x, np.uint32)
        counts[: len(c)] += c
    least = np.array([longer(need(n)) for n in sizes.tolist()])
    alive = (sizes > 0) & (counts >= least) & (known > 0)
    return pd.DataFrame({"doc_id": pd.array(np.where(known, ids, 0), "Int64").copy(), "n": sizes, "k1": k1, "k2": k2, "of_text": of_text, "alive": alive}).assign(doc_id=lambda d: d["doc_id"].mask(known == 0))


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, the shingles that several sets have, whose they are and how many sets have them."""
    tokens, owners, cuts, blocks = _gathered(pdf)
    df = _frequencies(tokens)
    rows = [tuple(r) for r in pdf.loc[pdf["kind"] == 0, ["part", "block", "kind", "a", "b", "c"]].itertuples(index=False)]
    for block, i, j in zip(blocks, cuts.tolist(), cuts[1:].tolist()):
        own = df[i:j] > 1
        if own.any():
            rows.append((0, block, 1, tokens[i:j][own].tobytes(), owners[i:j][own].tobytes(), df[i:j][own].astype(np.uint32).tobytes()))
    return pd.DataFrame(rows, columns=PACKED_KIND.names)


def _signature(tokens: np.ndarray) -> np.ndarray:
    """Parities of how many tokens fall on each of SIGNED places, in 64-bit words."""
    odd = np.bincount((tokens % np.uint64(SIGNED)).astype(np.int64), minlength=SIGNED) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each set's shared shingles, the rarest first, and those of them in its prefix."""
    heads, own = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
    ids, sizes = np.frombuffer(heads["a"].iloc[0], np.int64).reshape(5, -1)[:2]
    out: list[tuple] = []
    if len(own):
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in own["a"]])
        owners = np.concatenate([np.frombuffer(x, np.uint16) for x in own["b"]])
        df = np.concatenate([np.frombuffer(x, np.uint32) for x in own["c"]])
        order = np.lexsort((tokens, df, owners))
        tokens, owners, df = tokens[order], owners[order], df[order]
        cuts = np.searchsorted(owners, np.arange(len(ids) + 1)).tolist()
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            n = int(sizes[k])
            prefix = n - need(n) + 1 - (n - (j - i))
            if j > i and prefix > 0:
                out.append((int(ids[k]), n, tokens[i:j].tobytes(), tokens[i : i + prefix].view(np.int64).tolist(), n - (j - i), _signature(tokens[i:j]).tolist()))
    return pd.DataFrame(out, columns=["rep", "n", "shared", "prefix", "alone", "signature"])


class Trie:
    """Sets in the global order; beginnings are shared, and what one set alone has left is kept as a run."""

    __slots__ = ("children", "least", "deepest", "ends")

    def __init__(self):
        self.children: dict = {}
        self.least, self.deepest, self.ends = 1 << 60, 0, []

    def add(self, tokens: list[int], n: int, name: int) -> None:
        node, depth = self, 0
        while True:
            node.least, node.deepest = min(node.least, n), max(node.deepest, len(tokens) - depth)
            if depth == len(tokens):
                node.ends.append((n, name))
                return
            t = tokens[depth]
            below = node.children.get(t)
            if below is None:
                node.children[t] = (tokens[depth + 1 :], n, name)
                return
            if isinstance(below, tuple):  # a run: it becomes a node that holds it
                run, m, other = below
                below = node.children[t] = Trie()
                below.add(run, m, other)
            node, depth = below, depth + 1

    def matches(self, tokens: list[int], n: int, joined=lambda name: False) -> list[int]:
        """Names of the sets that link with a set of ``n`` shingles, ``tokens`` of them shared with others.

        Sets that are ``joined`` to it already, by other links, are passed over.
        """
        place = {t: i for i, t in enumerate(tokens)}
        have, total, found = place.keys(), len(tokens), []
        stack = [(self, 0, 0)]  # overlap so far, how far in ``tokens``
        while stack:
            node, overlap, at = stack.pop()
            if DENOMINATOR * (overlap + min(total - at, node.deepest)) < NUMERATOR * (n + node.least - overlap - min(total - at, node.deepest)):
                continue
            for m, name in node.ends:
                if DENOMINATOR * overlap >= NUMERATOR * (n + m - overlap) and not joined(name):
                    found.append(name)
            for t, below in node.children.items():
                i = place.get(t)
                o, a = (overlap, at) if i is None else (overlap + 1, i + 1)
                if isinstance(below, tuple):
                    run, m, name = below
                    most = o + min(total - a, len(run))
                    if DENOMINATOR * most >= NUMERATOR * (n + m - most) and not joined(name):
                        o += len(have & set(run))
                        if DENOMINATOR * o >= NUMERATOR * (n + m - o):
                            found.append(name)
                else:
                    stack.append((below, o, a))
        return found


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The partners of one set among the sets it is to be compared with."""
    query = pdf[pdf["b"].isna()]
    if not len(query):
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    a, trie = int(query["a"].iloc[0]), Trie()
    for b, n, shared in pdf.loc[pdf["b"].notna(), ["b", "n", "shared"]].itertuples(index=False):
        trie.add(np.frombuffer(shared, np.uint64).tolist(), int(n), int(b))
    found = trie.matches(np.frombuffer(query["shared"].iloc[0], np.uint64).tolist(), int(query["n"].iloc[0]))
    return pd.DataFrame({"a": [a] * len(found), "b": found}).astype("int64")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; partners of ``a`` are dealt out in groups of about GROUP."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    others = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    others = others.join(sets.select(F.col("rep").alias("b"), "n", "shared"), "b").select("a", "salt", "b", "n", "shared")
    own = salts.join(sets.select(F.col("rep").alias("a"), "n", "shared"), "a")
    own = own.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "n", "shared")
    return compact(own.unionByName(others).groupBy("a", "salt").applyInPandas(_walk, "a bigint, b bigint"))


def _among(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join the sets of a block, or those of two blocks with each other."""
    pdf = pdf.sort_values(["n", "rep"]).reset_index(drop=True)
    whole = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    tokens = [np.frombuffer(x, np.uint64).tolist() for x in pdf["shared"]]
    sizes, reps, left = pdf["n"].tolist(), pdf["rep"].tolist(), pdf["left"].tolist()
    forest, trie, links = Forest(len(pdf)), Trie(), []
    if not whole:
        for k in range(len(pdf)):
            if left[k]:
                trie.add(tokens[k], sizes[k], k)
    for k in range(len(pdf)):
        if not whole and left[k]:
            continue
        for other in trie.matches(tokens[k], sizes[k], lambda x: forest.root(x) == forest.root(k)):
            if forest.root(other) != forest.root(k):
                forest.join(other, k)
                links.append((reps[k], reps[other]))
        if whole:
            trie.add(tokens[k], sizes[k], k)
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _within(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among all sets of each group (rep, pivot), in pairs of blocks of about GROUP sets."""
    sized = groups.join(groups.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1"), "pivot")
    block = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j"), (block <= k).alias("left")))
    dealt = sized.select("pivot", "rep", F.explode(each).alias("x")).select("pivot", "rep", "x.*").join(sets.select("rep", "n", "shared"), "rep")
    return compact(dealt.groupBy("pivot", "i", "j").applyInPandas(_among, "a bigint, b bigint"))


def _fits(n: str, m: str):
    return F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR


def _may_link() -> Column:
    """Whether sizes and signatures of the sets a and b allow that they link: seven times what one has alone is at most what both have."""
    apart = F.col("alone_a") + F.col("alone_b")
    for k in range(SIGNED // 64):
        apart += F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b")))
    return _fits("n_a", "n_b") & (apart * (DENOMINATOR + NUMERATOR) <= (F.col("n_a") + F.col("n_b")) * (DENOMINATOR - NUMERATOR))


def link_sets(sets: DataFrame) -> DataFrame:
    """Components of the ordered sets (rep, n, shared, prefix, alone, signature) that link with another: ``id, component``."""
    words = compact(sets.select("rep", "n", F.explode("prefix").alias("w")))
    shared = words.groupBy("w").agg(F.count("*").alias("df")).where("df > 1").select("w")
    words = compact(words.join(shared, "w"))
    grouped, links = words, None
    for turn in range(ROUNDS):
        pivots = grouped.groupBy("w").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep")).alias("p")).select("w", F.col("p.rep").alias("pivot"))
        common = grouped.join(pivots, "w").groupBy("rep", "pivot").agg(F.count("*").alias("common"))
        groups = compact(common.groupBy("rep").agg(F.max_by("pivot", F.struct("common", "pivot")).alias("pivot")))
        found = _within(groups, sets)
        links = found if links is None else links.unionByName(found)
        # on with the shingles whose sets aren't all in one group
        grouped = grouped.join(groups.withColumnRenamed("pivot", f"p{turn}"), "rep")
        apart = grouped.groupBy("w").agg(F.min(f"p{turn}").alias("lo"), F.max(f"p{turn}").alias("hi")).where("lo <> hi").select("w")
        grouped = compact(grouped.join(apart, "w"))
    comps = connected_components(links)
    placed = grouped.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    mixed = placed.groupBy("w").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("w")
    signed = sets.select("rep", "alone", *[F.col("signature")[k].alias(f"s{k}") for k in range(SIGNED // 64)])
    rest = compact(placed.join(mixed, "w").join(signed, "rep"))
    parted = ["c", *(f"p{t}" for t in range(ROUNDS))]
    names = [*parted, "n", "alone", *(f"s{k}" for k in range(SIGNED // 64))]
    x, y = (rest.select("w", F.col("rep").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in names]) for k in "ab")
    # sets of one group have been compared, those of one component need no further link
    new = (F.col("a") < F.col("b")) & _may_link()
    for c in parted:
        new &= F.col(f"{c}_a") != F.col(f"{c}_b")
    more = _verified(compact(x.join(y, "w").where(new).select("a", "b").distinct()), sets)
    return connected_components(links.unionByName(more))


def _power(n: int) -> int:
    return max(64, 1 << n.bit_length())


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, of_text, n_shingles, least, component_id`` of every document; ``least``: id and text hash of the first in its component."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = _power(int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // PART_BYTES)
    packed = rows.withColumn("of_text", F.xxhash64("text")).mapInArrow(tidy(_blocks48(parts)), PACKED)
    known = packed.groupBy("part").applyInPandas(_counted, PACKED).groupBy("block").applyInPandas(_alive, "doc_id bigint, n bigint, k1 bigint, k2 bigint, of_text bigint, alive boolean")
    known = checkpoint(known)
    name = F.struct("doc_id", "of_text")
    reps = known.where("alive").groupBy("k1", "k2", "n").agg(F.min(name).alias("first"), F.min("doc_id").alias("id"))
    reps = checkpoint(reps.withColumn("rep", F.monotonically_increasing_id()))
    texts = rows.join(reps.select("id", "rep", "k1", "k2"), "id").select("rep", "text", "k1", "k2")
    few = _power(int(reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // PART_SHINGLES)
    sets = texts.mapInArrow(tidy(_blocks(few, False)), PACKED).groupBy("part").applyInPandas(_shared, PACKED)
    sets = checkpoint(sets.groupBy("block").applyInPandas(_ordered, "rep bigint, n bigint, shared binary, prefix array<bigint>, alone bigint, signature array<bigint>"))
    comps = link_sets(sets).withColumnRenamed("id", "rep")
    named = reps.join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = named.join(named.groupBy("component").agg(F.min("first").alias("least")), "component").select("k1", "k2", "n", "least")
    out = known.where("alive").join(named, ["k1", "k2", "n"]).unionByName(known.where("not alive").withColumn("least", name))
    return out.select("doc_id", "of_text", F.col("n").alias("n_shingles"), "least", F.col("least.doc_id").alias("component_id"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    return linked(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _blocks48(parts: int):
    run = _blocks(parts, True)

    def cut(batches):
        for b in run(batches):
            # the owner stands in the low 16 bits: eight bytes for a shingle
            rows = []
            for part, block, kind, a, o, c in zip(*(x.to_pylist() for x in b.columns)):
                if kind == 1:
                    a = ((np.frombuffer(a, np.uint64) & np.uint64(0xFFFFFFFFFFFF0000)) | np.frombuffer(o, np.uint16)).tobytes()
                    o = None
                rows.append((part, block, kind, a, o, c))
            yield _emit(rows)

    return cut


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, without those that have an earlier near-duplicate, by id and then by text hash; of equal rows one stays."""
    kept = linked(docs).where(F.struct("doc_id", "of_text") == F.col("least")).select(F.col("doc_id").alias("__id"), F.col("of_text").alias("__of_text")).distinct()
    rows = docs.where("doc_id is not null").withColumns({"__id": F.col("doc_id").cast("bigint"), "__of_text": F.xxhash64(F.col("text").cast("string"))})
    rows = rows.join(kept, ["__id", "__of_text"], "left_semi").dropDuplicates(["__id", "__of_text"])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))
