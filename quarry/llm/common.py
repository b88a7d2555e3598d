"""What the operators of this subpackage share: input tables, staged tables and small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.storage import discard, shared_dir, stage, staged_path

__all__ = ["WORD", "discard", "groups_for", "input_bytes", "let", "parts_for", "shared_dir", "stage", "staged_path", "table"]

#: A word is a run of anything but space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: What rows that come from no files are taken to hold, in bytes.
UNKNOWN = 64 << 20


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, from file sizes; no job runs. Of rows without files it has none: UNKNOWN."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else UNKNOWN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose scan has fewer tasks than there are cores is dealt to all of them first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def groups_for(df: DataFrame, bytes_each: int) -> int:
    """Hash groups of so many bytes of the input; their number grows with it without bound."""
    return input_bytes(df) // bytes_each + 8


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """Shuffle partitions that grow with the input, from the session's own count to 200,000; beyond that they grow in size, and sort on disk."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(own, min(200_000, input_bytes(df) // bytes_each + 1)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
