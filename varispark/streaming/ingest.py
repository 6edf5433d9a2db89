"""Streaming ingest of VCF text: files that arrive are parsed and aggregated in position windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varispark.sources.vcf import VcfHeader, parse_vcf_lines


def stream_vcf(spark: SparkSession, folder: str, header: VcfHeader, **options) -> DataFrame:
    """A stream of parsed rows from every file that appears in ``folder``."""
    return parse_vcf_lines(spark.readStream.text(folder), header, **options)


def windowed_counts(rows: DataFrame, size: int) -> DataFrame:
    """Running number of variants of each chromosome and tumbling position window."""
    return rows.groupBy("variants_CHROM", F.floor((F.col("variants_POS") - 1) / size).alias("w")).agg(F.count("*").alias("n"))


def to_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, until the folder's present files are taken in."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
