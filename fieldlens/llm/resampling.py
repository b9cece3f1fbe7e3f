"""Importance resampling towards a target distribution, drawn without replacement.

Weights.  A text's features are its words and pairs of neighbouring words, hashed into ``BUCKETS`` buckets by CRC-32.  Spark counts the buckets
of the documents and of the target texts; a bucket's gain is the logarithm of the ratio of its smoothed shares, and a document's weight the mean gain of its
features, looked up in one array of gains.  CRC-32 is linear, so a pair's follows from its words' by four table lookups.

Draw.  A document's score is its weight plus Gumbel noise from its id.  Each partition's eligible documents are a run, sorted by score and stored.  Rows of
each run at equal distances split the order, ties by id, run and place in it, into ranges of near ``RANGE_ROWS`` rows, however many scores are equal.  Runs are cut at the splitters, and each range's pieces are merged by a tournament tree that reads blocks from the pieces in the task's scratch file; a range's ranks begin
after the rows of all ranges before it.  The merge stops at the draw's size: the range that holds it is merged so far, and later ranges aren't merged at all.

Null and empty texts, and texts without words, have no features, weigh 0 and aren't eligible.  A null id counts as the empty string in the noise and comes before all
others in ties.  Rows of one id and equal scores stand in any order; each has a rank of its own.  With no target texts, or no documents, gains follow from the
same formula with zero counts.  Very long texts are taken whole.  Other columns are left out, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import tempfile
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, chunks
from .runs import all_but, words

BUCKETS = 10_000
SEED, LEAST_WORDS, PERCENT = 7, 20, 25
#: Rows that make a range of their own worth while, and ranges at most.
RANGE_ROWS, MOST_RANGES = 20_000, 10_000
#: Rows of a piece that are in memory at a time.
BLOCK = 4096
CHUNK = 8_000_000
WORD = all_but(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
FIELDS = ("id", "known", "n_features", "weight", "score")


def _tables(longest: int = 64) -> np.ndarray:
    """``[n, k, b]``: what byte ``k`` of a checksum, of value ``b``, adds to the checksum ``n`` bytes on."""
    unit = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # of one byte: the polynomial's table
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, longest + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ unit[out[n - 1] & np.uint32(255)]
    return out


SHIFT = _tables()


def checksums_after(first: np.ndarray, size: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Checksums of joined strings from the first one's, and the second one's size (below ``len(SHIFT)``) and checksum."""
    out = second.copy()
    for k in range(4):
        out ^= SHIFT[size, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features, the text each is of, and each text's number of words."""
    w = words(texts, WORD)
    codes, text, different = w.codes, w.text_of, w.different
    one = np.fromiter(map(zlib.crc32, different), np.uint32, len(different))
    spaced = np.fromiter((zlib.crc32(b" " + x) for x in different), np.uint32, len(different))
    size = np.fromiter(map(len, different), np.int64, len(different)) + 1
    a, b = codes[:-1], codes[1:]
    inside = text[:-1] == text[1:] if len(text) else np.zeros(0, bool)
    a, b = a[inside], b[inside]
    short = size[b] < len(SHIFT)
    two = np.zeros(len(a), np.uint32)
    two[short] = checksums_after(one[a[short]], size[b[short]], spaced[b[short]])
    for k in np.flatnonzero(~short):
        two[k] = zlib.crc32(b" " + different[b[k]], int(one[a[k]]))
    return np.append(one[codes], two) % np.uint32(BUCKETS), np.append(text, text[:-1][inside] if len(text) else text), np.diff(w.bounds)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket over all texts of a column named ``text``; BUCKETS numbers come to the driver."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in chunks(batches, "text", CHUNK):
            total += np.bincount(buckets(b.column(0))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(y) + 1) * (s + BUCKETS) / ((int(x) + 1) * (t + BUCKETS)))) for x, y in zip(source, target)], np.int64)


def noise(h: int) -> float:
    return -1000 * math.log(-math.log((h + 0.5) / 4294967296))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id, n_features, weight, score, eligible`` of each document; the texts go no further than this scan."""

    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            of, text, n_words = buckets(b.column(2))
            n = np.bincount(text, minlength=len(n_words)).astype(np.int64)
            total = np.bincount(text, gain[of], len(n_words)).astype(np.int64)  # whole numbers below 2 ** 53
            weight = total // np.maximum(n, 1)
            score = weight + np.fromiter((math.floor(noise(h)) for h in b.column(1).to_pylist()), np.int64, len(weight))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(weight), pa.array(score), pa.array(n_words >= LEAST_WORDS)], ["id", "n_features", "weight", "score", "eligible"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), h.alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, n_features bigint, weight bigint, score bigint, eligible boolean")


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Each partition's rows with ``run`` and ``place``: the eligible first, by descending score and ascending id."""
    ordered = rows.sortWithinPartitions(F.desc("eligible"), F.desc("score"), F.asc_nulls_first("id"))

    def run(batches):
        at, number = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), number, np.int32)), pa.array(np.arange(at, at + len(b)))], [*b.schema.names, "run", "place"])
            at += len(b)

    return ordered.mapInArrow(run, "id bigint, n_features bigint, weight bigint, score bigint, eligible boolean, run int, place bigint")


def order_keys(b: pa.RecordBatch) -> list[tuple]:
    """What rows are ordered by: no two rows are equal."""
    score, ids, run, place = (b.column(b.schema.get_field_index(k)).to_pylist() for k in ("score", "id", "run", "place"))
    return [(-s, i is not None, i or 0, r, p) for s, i, r, p in zip(score, ids, run, place)]


def splitters(runs: DataFrame, eligible: int, ranges: int | None = None) -> list[tuple]:
    """Keys between ranges, from about eight rows for each range, taken at equal distances from a place in each run that its number decides."""
    ranges = ranges or max(1, min(MOST_RANGES, eligible // RANGE_ROWS))
    if ranges == 1 or not eligible:
        return []
    every = max(1, eligible // (8 * ranges))
    chosen = F.col("eligible") & (F.pmod(F.col("place") + F.xxhash64("run"), F.lit(every)) == 0)
    keys = sorted(k for b in runs.where(chosen).select("score", "id", "run", "place").toArrow().to_batches() for k in order_keys(b))
    step = max(1, len(keys) // ranges)
    return keys[step - 1 :: step][: ranges - 1]


PIECES = "range int, run int, place bigint, n int, data binary"


def pieces(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Every run's eligible rows, packed, cut at the splitters."""
    shared = runs.sparkSession.sparkContext.broadcast(cuts)  # below MOST_RANGES keys of five numbers

    def run(batches):
        from bisect import bisect_left, bisect_right

        for b in batches:
            keys = order_keys(b)
            if not keys:
                continue
            if any(x > y for x, y in zip(keys, keys[1:])):
                raise ValueError("a run isn't sorted")
            ids = b.column(0)
            packed = np.stack([np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()).astype(np.int64), *(np.asarray(b.column(k)) for k in (1, 2, 3))], 1).astype(np.int64)
            first = bisect_right(shared.value, keys[0])
            at = 0
            out = []
            for k in range(first, len(shared.value) + 1):
                end = bisect_left(keys, shared.value[k]) if k < len(shared.value) else len(keys)
                if end > at:
                    out.append((k, keys[at][3], keys[at][4], end - at, packed[at:end].tobytes()))
                at = end
                if at == len(keys):
                    break
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["range", "run", "place", "n", "data"])

    return runs.where("eligible").select("id", "n_features", "weight", "score", "run", "place").mapInArrow(run, PIECES)


class Tournament:
    """Merges sorted streams of keys: an inner node holds the loser of the match below it, and a new head plays only those on its way up."""

    DONE = (math.inf,)

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams = streams
        self.size = 1 << max(0, len(streams) - 1).bit_length()
        self.heads = [next(x, self.DONE) for x in streams] + [self.DONE] * (self.size - len(streams))
        self.loser = [0] * self.size
        winner = [0] * self.size + list(range(self.size))
        for k in range(self.size - 1, 0, -1):
            a, b = winner[2 * k : 2 * k + 2]
            winner[k], self.loser[k] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.first = winner[1] if self.size > 1 else 0

    def __iter__(self) -> Iterator[tuple]:
        return self

    def __next__(self) -> tuple:
        k, heads, loser = self.first, self.heads, self.loser
        out = heads[k]
        if out is self.DONE:
            raise StopIteration
        heads[k] = next(self.streams[k], self.DONE)
        at = (k + self.size) // 2
        while at:
            if heads[loser[at]] < heads[k]:
                loser[at], k = k, loser[at]
            at //= 2
        self.first = k
        return out

    def rest(self) -> Iterator[tuple]:
        """What is left, not merged."""
        yield from (x for x in self.heads if x is not self.DONE)
        yield from chain.from_iterable(self.streams)


RANKED = "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint"


def rows_of(x: np.ndarray, first: int | None) -> pa.RecordBatch:
    """Rows of FIELDS with ranks from ``first`` on, or without."""
    ranks = pa.nulls(len(x), pa.int64()) if first is None else pa.array(np.arange(first, first + len(x)))
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0], mask=x[:, 1] == 0), *(pa.array(x[:, k]) for k in (2, 3, 4)), ranks], ["doc_id", "n_features", "weight", "score", "rank"])


def merged(cut: DataFrame, before: dict[int, int], draw: int) -> DataFrame:
    """The rows of the ranges in ``before``, which says how many rows come before each; the first ``draw`` of all have ranks."""
    shared = cut.sparkSession.sparkContext.broadcast(before)  # MOST_RANGES numbers
    width = 8 * len(FIELDS)

    def stream(scratch, run: int, at: list[tuple[int, int, int]]) -> Iterator[tuple]:
        for place, n, offset in at:
            for k in range(0, n, BLOCK):
                scratch.seek(offset + k * width)
                block = np.frombuffer(scratch.read(min(BLOCK, n - k) * width), np.int64).reshape(-1, len(FIELDS))
                for j, row in enumerate(block.tolist()):
                    yield (-row[4], row[1], row[0], run, place + k + j, row)

    def merge(scratch, runs: dict[int, list], at: int):
        tree = Tournament([stream(scratch, run, sorted(x)) for run, x in sorted(runs.items())])
        while block := [x[5] for x in islice(tree, max(0, min(BLOCK, draw - at)))]:
            yield rows_of(np.array(block), at + 1)
            at += len(block)
        rest = tree.rest()
        while block := [x[5] for x in islice(rest, BLOCK)]:
            yield rows_of(np.array(block), None)

    def run(batches):
        with tempfile.TemporaryFile() as scratch:
            runs: dict[int, list] = {}
            now, end = None, 0
            for b in batches:
                for k, of, place, n, data in zip(*(c.to_pylist() for c in b.columns)):
                    if k != now and runs:
                        yield from merge(scratch, runs, shared.value[now])
                        runs, end = {}, 0
                    now = k
                    scratch.seek(end)
                    scratch.write(data)
                    runs.setdefault(of, []).append((place, n, end))
                    end += len(data)
            if runs:
                yield from merge(scratch, runs, shared.value[now])

    mine = cut.where(F.col("range") <= max(before, default=-1))
    return mine.repartition(max(1, len(before)), "range").sortWithinPartitions("range").mapInArrow(run, RANKED)


def unpacked(cut: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for data in b.column(4).to_pylist():
                yield rows_of(np.frombuffer(data, np.int64).reshape(-1, len(FIELDS)), None)

    return cut.mapInArrow(run, RANKED)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, ranges: int | None = None) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document: the drawn ones have ranks from 1, the best score first."""
    runs = checkpoint(sorted_runs(scored(docs, gains(bucket_counts(docs), bucket_counts(target)))))
    eligible = runs.where("eligible").count()
    draw = percent * eligible // 100
    cut = checkpoint(pieces(runs, splitters(runs, eligible, ranges)))
    sizes = sorted((r["range"], r.n) for r in cut.groupBy("range").agg(F.sum("n").alias("n")).collect())  # MOST_RANGES rows
    upto = np.append(0, np.cumsum([n for _, n in sizes])).tolist()
    before = {k: b for (k, _), b in zip(sizes, upto) if b < draw}
    rest = runs.where(~F.col("eligible")).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return merged(cut, before, draw).unionByName(unpacked(cut.where(F.col("range") > max(before, default=-1)))).unionByName(rest)
