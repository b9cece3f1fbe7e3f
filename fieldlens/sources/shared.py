"""The shared folder that jobs cut their lineage in."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder named in ``spark.checkpoint.dir`` and go on from what was written; a folder of our own only in local mode, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="fieldlens-checkpoint-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def folder(spark) -> str:
    """The shared folder itself."""
    checkpoint(spark.range(0))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
