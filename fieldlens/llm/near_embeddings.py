"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Equal vectors of a label count as one with their number, by 128 bits of hash.  For each of ``TREES`` trees the vectors of a label are split at
the median of a random direction, those near it go to both sides, and what is still larger than twice ``LEAF`` is split again, as
many levels in a round as its size asks for.  A level of a tree has one direction; its groups have cuts of their own.  These come
from a bounded sample of the group that is split (``SAMPLE`` vectors); every vector is routed.  Vectors are compared
within leaves only, all of them, by cosine in double precision.  A pair that several leaves hold counts in the first of them, so no
pair leaves a task: a leaf returns how many links each vector has and one link for each vector to join the components.
A group that splits hardly divide (many nearly equal vectors) is compared in pairs of blocks, which takes the square of its size, in many tasks.

Recall is a matter of probability: with these parameters a pair at the threshold is parted in about 5 % of the splits and has
``TREES`` chances; closer ones less often.  Precision is exact.  Vectors that are null, zero, of another length than the others or hold null or
non-finite components, and those without a label, link with nothing (of another length: with those of that length) and are their own
component.  Ties don't matter; rows with one and the same ``vec_id`` are counted as different vectors of one id.  Other columns are left
out, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .components import connected_components

TREES = 6
#: Vectors of a leaf that splits aim at; twice as many are left together.
LEAF = 384
SAMPLE = 2000
#: How near a cut a vector goes to both sides, times the square root of the dimension.
MARGIN = 0.12
#: Levels of splits in a round, at most, and how much of a group a split leaves on one side, with spill.
DEPTH, LEFT = 6, 0.55
#: A group that holds more than this share, to the power of the levels, of the group before isn't split any more: it is dense, and would only be copied.
STUCK = 0.75
#: Rows of a block; paths of splits have as many bits at most, the first of them set.
BLOCK, PATH_BITS = 1024, 57


def directions(tree: int, depth: int, levels: int, dim: int) -> np.ndarray:
    """The random unit directions of so many levels below a depth of a tree."""
    d = np.stack([np.random.default_rng([tree, depth + k, dim]).standard_normal(dim) for k in range(levels)])
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def units(vectors, dim: int) -> np.ndarray:
    """Unit vectors in double precision; single-precision input is kept as such, which loses nothing."""
    vectors = list(vectors)
    x = np.frombuffer(b"".join(vectors), np.float32 if len(vectors[0]) == 4 * dim else np.float64).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Medians of the splits below one node, in heap order."""
    tree, label, path, dim, levels = (int(pdf[c].iloc[0]) for c in ("tree", "label", "path", "dim", "levels"))
    proj = units(pdf["vec"], dim) @ directions(tree, path.bit_length() - 1, levels, dim).T
    cuts, held = np.zeros(2**levels - 1), {0: np.arange(len(proj))}
    for node in range(2**levels - 1):
        rows, level = held.pop(node), (node + 1).bit_length() - 1
        cuts[node] = np.median(proj[rows, level]) if len(rows) else 0.0
        low = proj[rows, level] < cuts[node]
        held[2 * node + 1], held[2 * node + 2] = rows[low], rows[~low]
    return pd.DataFrame({"tree": [tree], "label": [label], "path": [path], "dim": [dim], "cuts": [cuts.tolist()]})


def route(x: np.ndarray, cuts: np.ndarray, dirs: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves they go to, several for rows near a cut; each row has cuts of its own."""
    proj = x @ dirs.T
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level in range(len(dirs)):
        d = proj[rows, level] - cuts[rows, node]
        low, high = d < margin, d >= -margin
        rows, node = np.concatenate([rows[low], rows[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
    return rows, node - (2 ** len(dirs) - 1)


ROUTED = pa.schema([("tree", pa.int32()), ("label", pa.int64()), ("path", pa.int64()), ("dim", pa.int32()), ("id", pa.int64()), ("most", pa.float64())])


def _routes(batches):
    for b in batches:
        t = b.to_pandas()
        t["depth"] = np.frompyfunc(int.bit_length, 1, 1)(t["path"].astype(object)).astype(np.int64) - 1
        for (tree, depth, levels, dim), g in t.groupby(["tree", "depth", "levels", "dim"], sort=False):
            rows, leaf = route(units(g["vec"], dim), np.stack(g["cuts"]), directions(tree, depth, levels, dim), MARGIN / np.sqrt(dim))
            out = g.iloc[rows]
            out = out.assign(path=(out["path"] << levels) + leaf, most=out["n"] * STUCK**levels)
            yield pa.RecordBatch.from_pandas(out[ROUTED.names], ROUTED, preserve_index=False)


def _together(near: np.ndarray, own: np.ndarray, a: list, b: list) -> None:
    """Takes from ``near`` the pairs of rows that are both in a leaf before ``own``."""
    r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(r):
        return
    sides = [np.concatenate([np.asarray(x[i]) for i in some]) for x, some in ((a, r), (b, c))]
    of = [np.repeat(np.arange(len(some)), [len(x[i]) for i in some]) for x, some in ((a, r), (b, c))]
    before = [x < own for x in sides]
    places, at = np.unique(np.concatenate([x[k] for x, k in zip(sides, before)]), return_inverse=True)
    holds = [np.zeros((len(r), len(places)), np.float32), np.zeros((len(c), len(places)), np.float32)]
    holds[0][of[0][before[0]], at[: before[0].sum()]] = 1
    holds[1][of[1][before[1]], at[before[0].sum() :]] = 1
    near[np.ix_(r, c)] &= holds[0] @ holds[1].T == 0


def _settle(label: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the rows ``a`` and ``b`` of linked pairs the least label they reach."""
    i, j = np.nonzero(near)
    x, y = a[i], b[j]
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label[:] = label[label]
        some = label[x] != label[y]
        x, y = x[some], y[some]


def compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links within a leaf, or between the two blocks ``left`` and right, that no earlier common leaf holds."""
    pdf = pdf.sort_values("id", kind="stable", ignore_index=True)
    whole, left, own, dim = bool(pdf["whole"].iloc[0]), pdf["left"].to_numpy(), pdf["leaf"].iloc[0], int(pdf["dim"].iloc[0])
    every = np.arange(len(pdf))
    a, b = (every, every) if whole else (every[left], every[~left])
    ids, copies, leaves = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), pdf["leaves"].tolist()
    links, label = np.zeros(len(pdf), np.int64), every.copy()
    if len(a) and len(b):
        x = units(pdf["vec"], dim)
        for lo in range(0, len(a), BLOCK):
            rows = a[lo : lo + BLOCK]
            near = x[rows] @ x[b].T >= threshold
            if whole:
                near[np.arange(len(rows)), np.arange(lo, lo + len(rows))] = False
            _together(near, own, [leaves[i] for i in rows], leaves if whole else [leaves[i] for i in b])
            links[rows] += near @ copies[b]
            if not whole:
                links[b] += copies[rows] @ near
            _settle(label, near, rows, b)
    some = np.flatnonzero(links)
    return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[label[some]]})


def link_embeddings(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    good = (F.col("n") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0)).alias("v"), F.col(label_col).cast("bigint").alias("label"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))
    rows = rows.withColumn("n", F.size("v")).withColumn("usable", usable)
    key = ["label", "h1", "h2"]
    keyed = rows.select("vec_id", "usable", F.when(F.col("usable"), F.col("v")).alias("v"), F.when(F.col("usable"), F.col("label")).alias("label"), F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit("second")).alias("h2"))
    same = keyed.where("usable").groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64

    def packed(batches):
        for b in batches:
            v = b.column(b.num_columns - 1)
            ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False).astype(kind)
            data = [flat[i:j].tobytes() for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(ends).astype(np.int32)), pa.array(data, pa.binary())], [*b.schema.names[:-1], "dim", "vec"])

    named = same.select(F.monotonically_increasing_id().alias("id"), *key, "vec_id", "copies", "v")
    same = checkpoint(named.mapInArrow(packed, "id bigint, label bigint, h1 bigint, h2 bigint, vec_id bigint, copies bigint, dim int, vec binary"))
    node, vecs = ["tree", "label", "path", "dim"], same.select("id", "vec")
    going = same.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "label", F.lit(1).cast("bigint").alias("path"), "dim", "id", F.lit(float("inf")).alias("most"))
    done = None
    while True:  # rows go without their vectors, which are joined where they are needed
        going = checkpoint(going)
        sized = going.join(going.groupBy(*node).agg(F.count("*").alias("n")), node)
        stays = (F.col("n") <= 2 * LEAF) | (F.col("n") > F.col("most")) | (F.col("path") >= 1 << (PATH_BITS - DEPTH))
        leaves = sized.where(stays).select("label", "dim", "id", "n", (F.col("path") * 8 + F.col("tree")).alias("leaf"))
        done = leaves if done is None else done.unionByName(leaves)
        rest = sized.where(~stays).drop("most").withColumn("levels", F.least(F.lit(DEPTH), F.ceil(F.log(F.col("n") / LEAF) / -np.log(LEFT))).cast("int"))
        if rest.isEmpty():
            break
        sample = rest.where(F.pmod(F.xxhash64("id", "tree", "path"), F.lit(1 << 20)) < F.lit(float(SAMPLE << 20)) / F.col("n"))
        cuts = sample.join(vecs, "id").groupBy(*node).applyInPandas(fit, "tree int, label bigint, path bigint, dim int, cuts array<double>")
        going = rest.join(cuts, node).join(vecs, "id").select(*node, "id", "vec", "n", "levels", "cuts").mapInArrow(_routes, "tree int, label bigint, path bigint, dim int, id bigint, most double")
    done = checkpoint(done)
    held = done.groupBy("id").agg(F.collect_set("leaf").alias("leaves"))
    blocks = F.ceil(F.col("n") / (2 * BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit("block")), blocks).cast("int")
    each = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j"), (block <= k).alias("left"), (block == k).alias("whole")))
    dealt = done.where("n > 1").join(held, "id").join(same.select("id", "copies", "vec"), "id").select("label", "dim", "leaf", "leaves", "id", "copies", "vec", F.explode(each).alias("x"))
    found = checkpoint(dealt.select("*", "x.*").drop("x").groupBy("label", "dim", "leaf", "i", "j").applyInPandas(lambda g: compare(g, threshold), "id bigint, links bigint, root bigint"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = same.drop("vec", "dim").join(links, "id", "left").join(comps, "id", "left").withColumn("of", F.coalesce("component", "id"))
    per = per.join(per.groupBy("of").agg(F.min("vec_id").alias("least")), "of")
    per = checkpoint(per.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least"))
    out = keyed.drop("v").join(per, key, "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
