"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return shared or current.get()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="fieldlens-checkpoint-")
    sc.setCheckpointDir(shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from what was written: lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers each that make a part of their own worth while.
PART_ROWS = 100_000


def parts_for(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def compact(df: DataFrame) -> DataFrame:
    """A checkpoint of rows of a few numbers, in as many parts as its rows ask for: a small table doesn't go through hundreds of tasks and files."""
    df = checkpoint(df)
    return df.coalesce(parts_for(df.count()))


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def chunks(batches, column: str, limit: int = 24_000_000):
    """Arrow batches cut into runs of at most ``limit`` characters of ``column`` (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


def tidy(run):
    """``run`` over Arrow batches; when it has ended, memory that isn't in use any more goes back to the machine, as an idle worker would keep it."""

    def whole(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return whole
