"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the separators of words, [\x20\x09-\x0D].
WHITESPACE = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast up to so many rows and bytes, as measured.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 32_000_000


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast; a column that the frame lacks is null. Everything else is left behind, so extra columns can't clash."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset only a local session, as in tests, has one below /tmp."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "/tmp/checkpoints"
    return path.rstrip("/")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and a lost executor loses none of it."""
    return _write(df, name)[0]


class Scratch:
    """Kept tables that a computation reads more than once. They are deleted when its block ends, by when what it hands on must have been
    kept itself (outside of the block's tables): a result is a table of its own and never reads these."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.paths.append(path)
        return out

    def __exit__(self, *_) -> None:
        for path in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of at most so many rows for the actions inside: of whole texts, few are then held at once beside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fits(df: DataFrame, size: Column | int = 16) -> bool:
    """Whether a kept table's measured rows and bytes (size: of a row, as a column or a number) allow a broadcast."""
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size if isinstance(size, Column) else F.lit(size)), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def small(df: DataFrame, size: Column | int = 16) -> DataFrame:
    """df, a kept table, marked for broadcast if it fits; beyond, a join exchanges both sides."""
    return F.broadcast(df) if fits(df, size) else df


def rows_where(df: DataFrame, condition: Column) -> DataFrame:
    """The struct column _row of the rows that meet a condition over computed columns, as columns. A generator instead of a filter, which
    Catalyst would push below the projections and write out there once for each use of what they compute."""
    return df.select(F.explode(F.when(condition, F.array("_row"))).alias("_row")).select("_row.*")


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none. A one-character separator keeps Java's split off the regex path."""
    flat = F.translate(F.coalesce(text, F.lit("")), WHITESPACE[1:], " " * (len(WHITESPACE) - 1))
    return F.array_remove(F.split(flat, " "), "")


def label_fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))
