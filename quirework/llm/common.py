"""Shared plumbing: table access, shared-folder scratch tables, word rules."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, save, shared_folder  # noqa: F401

#: Word separators of every operator here: space and the ASCII controls 09-0D.
SEPARATORS = r"[\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")), F.lit(SEPARATOR_CHARS))


def word_array(text: Column) -> Column:
    """Words of a text ([] for null, empty or blank texts)."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SEPARATORS))


def word_count(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SEPARATORS))).cast("long")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(each: Callable) -> Callable:
    """``each`` for ``mapInArrow``, after which the Python worker gives freed memory back to the system: Spark keeps workers for later tasks."""

    def run(batches):
        yield from each(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def maybe_broadcast(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``most_rows`` (narrow) rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
