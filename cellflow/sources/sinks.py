"""Sinks: Parquet by partition, CSV with provenance, tables named by a hash of their parameters."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cells(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def write_control(df: DataFrame, path: str, **provenance: str) -> None:
    df.select("easting", "northing", "h_mean", *[F.lit(v).alias(k) for k, v in provenance.items()]).write.mode("overwrite").option("header", "true").csv(path)


def params_key(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, params: dict, make) -> DataFrame:
    """The table of these parameters: read if it was written whole (its writer leaves _SUCCESS), else made and written. Other failures to read
    are errors."""
    path = f"{root}/{params_key(params)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
