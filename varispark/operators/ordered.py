"""Sequential kernels: the rows of a group pass through one task in order, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varispark.session import ship_package


def ordered(df: DataFrame, by: str | None, *columns: Column) -> DataFrame:
    """``_g`` (the group), vidx and ``columns``; each partition has whole groups, in order of vidx. The sort spills to disk."""
    ship_package(df.sparkSession)
    rows = df.select((F.lit(0) if by is None else F.col(by)).alias("_g"), F.col("vidx").cast("bigint").alias("vidx"), *columns)
    return rows.repartition("_g").sortWithinPartitions("_g", "vidx")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Parts of batches that belong to one group, and whether the group begins there."""
    last: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("_g"))
        at = 0
        for end, group in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            yield last != [group], batch.slice(at, end - at)
            last, at = [group], end
