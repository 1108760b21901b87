"""Batch manifests: one row of text parameters for each job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def jobs(manifest: DataFrame, kinds: dict[str, str], common: dict | None = None) -> DataFrame:
    """Typed parameters of each job.

    kinds: the known parameters and their SQL types; other columns are ignored. A job's own
    value comes before the common one; a parameter that neither gives is null. A range such as
    "(0, 200)" has type array<double>. Text that is not of its type is null."""
    common = common or {}

    def typed(name: str, kind: str):
        if name not in manifest.columns:
            return F.lit(common.get(name)).cast(kind).alias(name)
        own = F.col(name)
        if kind == "array<double>":
            parts = F.split(F.regexp_replace(own, r"[()\[\]\s]", ""), ",")
            own = F.transform(parts, lambda v: v.try_cast("double"))
        else:
            own = own.try_cast(kind)
        return (F.coalesce(own, F.lit(common[name]).cast(kind)) if name in common else own).alias(name)

    return manifest.select(*[typed(n, k) for n, k in kinds.items()])
