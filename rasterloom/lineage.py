"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint under spark.checkpoint.dir; only a local master may do without that setting."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="rasterloom-"))
    return df.checkpoint()
