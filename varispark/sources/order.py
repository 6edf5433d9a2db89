"""Row numbers in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_vidx(df: DataFrame, name: str = "vidx") -> DataFrame:
    """Number rows from 0 in partition order: counts of partitions give offsets, rows never move."""
    rows = df.withColumn("_m", F.monotonically_increasing_id())
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    # one row a partition
    offsets = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_o"))
    return rows.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + row).drop("_m", "_p", "_o")
