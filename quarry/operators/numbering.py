"""Numbering rows in a global order without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stage as settled


def numbered(df: DataFrame, *order: Column | str, name: str = "n", parts: int | None = None) -> DataFrame:
    """df with its 1-based place in a total order: range partitions are sorted apart, and counts of earlier ones added.

    Only a count for each partition is gathered.
    """
    many = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(many, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = settled(rows).withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_id", "_before")
