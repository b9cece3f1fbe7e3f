"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents longer than a sequence are cut; the first piece takes the remainder and all others fill a sequence of their own.
The remaining pieces are packed by hierarchical residual packing: each partition packs its own pieces best-fit, longest first,
emits the sequences that are nearly full, or that the shortest item left wouldn't fit in, and hands on the others as items.  The items of
``FAN_IN`` partitions, or of fewer where they would be more than ``partition_rows``, are merged and packed again, and so on to one partition,
which emits everything.  If a round brings hardly any items together, more won't either: the next round emits everything in all of
its partitions.  A round's output is written to the checkpoint folder before the
next one reads it, so a lost executor can't make two rounds see different packings.

Added tokens of the tokenizer's file (such as an end of text) stand for themselves in a text, as the library has it by default.

Null and empty texts are one piece that holds only the end id.  Ties go by length, then the order of the rows; repeated
rows are packed like others.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, load
from .common import checkpoint, chunks, tidy

CAPACITY = 1024
#: A sequence this full is emitted at once.
NEARLY_FULL = 0.995
FAN_IN = 8
#: More than this share of a round's items left as items: packing them again brings little.
STALLED = 0.9
END_ID = 2


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items, longest first, each into the fullest bin that it fits in; indices of the items of each bin."""
    bins: list[list[int]] = []
    spare: list[int] = []  # the free amounts that occur, in order
    of_spare: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(spare, lengths[i])
        if at == len(spare):
            k, free = len(bins), capacity
            bins.append([])
        else:
            free = spare[at]
            k = of_spare[free].pop()
            if not of_spare[free]:
                del of_spare[free], spare[at]
        bins[k].append(i)
        if left := free - lengths[i]:
            if left not in of_spare:
                insort(spare, left)
                of_spare[left] = []
            of_spare[left].append(k)
    return bins


ITEM = "used int, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>, sequence_id bigint"


def _pack(rnd: int, capacity: int, last: bool, least: int):
    """Packs the items of a partition, of which the shortest anywhere is ``least``; a null ``sequence_id`` marks what the next round gets."""

    def run(batches):
        used: list[int] = []
        members: list[list] = []
        for b in batches:
            used += b.column(0).to_pylist()
            members += b.column(1).to_pylist()
        base, kind = (rnd << 56) | (TaskContext.get().partitionId() << 32), pa.schema([("used", pa.int32()), ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))), ("sequence_id", pa.int64())])
        bins = best_fit(used, capacity)
        for lo in range(0, len(bins), 5000):
            rows = []
            for k, held in enumerate(bins[lo : lo + 5000], lo):
                total, own = 0, []
                for m in (m for i in held for m in members[i]):
                    own.append(m | {"offset": total})
                    total += m["length"]
                rows.append({"used": total, "members": own, "sequence_id": base | k if last or total >= NEARLY_FULL * capacity or total + least > capacity else None})
            yield pa.RecordBatch.from_pylist(rows, kind)

    return run


def added_tokens(data: bytes, kind: str) -> dict[str, int]:
    """Those that the file lists beside its vocabulary, with their ids."""
    return {t["content"]: t["id"] for t in json.loads(data).get("added_tokens", [])} if kind == "json" else {}


def encode(enc, texts: pa.Array, added: dict[str, int]) -> list[np.ndarray]:
    """Ids of each text; added tokens are taken out before the rest is encoded."""
    if not any(pc.any(pc.match_substring(texts, t)).as_py() for t in added):
        return enc.encode(texts)
    parts = [re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", t or "") for t in texts.to_pylist()]
    plain = iter(enc.encode(pa.array([x for p in parts for x in p[::2]], pa.string())))
    return [np.concatenate([[added[x]] if k % 2 else next(plain) for k, x in enumerate(p)]) for p in parts]


def tokenise(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32``, and their ``ids`` where asked for."""
    data, kind = load(path)
    added = added_tokens(data, kind)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids

    def run(batches):
        for b in chunks(batches, "text"):
            out: list[list] = [[] for _ in fields]
            for doc, ids in zip(b.column(0).to_pylist(), encode(encoder(data, pattern, kind), b.column(1), added)):
                ids = np.append(ids, end_id).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    for column, v in zip(out, (doc, k, start, length, zlib.crc32(own), own.astype(np.int32))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields)], schema=pa.schema(fields))

    columns = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(tidy(run), columns)


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_rows: int = 20_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece; ``pieces`` is read once for a checkpoint."""
    pieces = checkpoint(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"))
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("bigint").alias("offset"))
    row = pieces.select(F.col("length").cast("int").alias("used"), F.array(item).alias("members"), F.lit(None).cast("bigint").alias("sequence_id"))
    full, items = row.where(F.col("used") >= capacity), row.where(F.col("used") < capacity)
    done = [full.withColumn("sequence_id", F.monotonically_increasing_id())]
    count, least = items.agg(F.count("*"), F.coalesce(F.min("used"), F.lit(0))).first()
    n, rnd, last = max(1, -(-count // partition_rows)), 1, False
    while True:
        last = last or n == 1
        items = items.repartition(n) if n > 1 else items.coalesce(1)
        packed = checkpoint(items.mapInArrow(_pack(rnd, capacity, last, least), ITEM))
        done.append(packed.where("sequence_id is not null"))
        if last:
            break
        items, before = packed.where("sequence_id is null"), count
        count, least = items.agg(F.count("*"), F.coalesce(F.min("used"), F.lit(0))).first()
        n, rnd, last = max(-(-n // FAN_IN), -(-count // partition_rows), 1), rnd + 1, count > STALLED * before
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.explode("members").alias("m"), "sequence_id").select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
