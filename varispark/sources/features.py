"""GFF3 in, FASTA out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varispark.sources.order import with_vidx


def parse_attributes(text: Column) -> Column:
    """MAP of ``k=v;...``: URL-decoded, split at the first ``=``; a bare key maps to ``true``."""
    entries = F.filter(F.split(F.trim(text), ";"), lambda e: e != "")
    key = lambda e: F.url_decode(F.substring_index(e, "=", 1))
    value = lambda e: F.when(e.contains("="), F.url_decode(F.regexp_replace(e, "^[^=]*=", ""))).otherwise("true")
    pairs = F.transform(entries, lambda e: F.struct(key(e).alias("key"), value(e).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])))


def read_gff3(spark: SparkSession, path: str, attributes: Sequence[str] | None = None, region: str | None = None, score_fill: float = -1, phase_fill: int = -1, attributes_fill: str = ".") -> DataFrame:
    """vidx and the nine columns, with the named attributes as columns; other lines are skipped."""
    lines = with_vidx(spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith(">")).withColumn("c", F.split("value", "\t")).where(F.size("c") == 9))
    c = lambda i: F.col("c")[i]
    df = lines.select("vidx", c(0).alias("seqid"), c(1).alias("source"), c(2).alias("type"), c(3).cast("bigint").alias("start"), c(4).cast("bigint").alias("end"), F.coalesce(c(5).try_cast("double"), F.lit(float(score_fill))).alias("score"), c(6).alias("strand"), F.coalesce(c(7).try_cast("int"), F.lit(phase_fill)).alias("phase"), parse_attributes(c(8)).alias("attributes"))
    if region is not None:
        from varispark.sources.vcf import parse_region

        chrom, a, b = parse_region(region)
        df = df.where(F.col("seqid") == chrom)
        if a is not None:
            df = df.where((F.col("end") >= a) & (F.col("start") <= b))
    for a in attributes or ():
        df = df.withColumn(a, F.coalesce(F.try_element_at("attributes", F.lit(a)), F.lit(attributes_fill)))
    return df


def write_fasta(df: DataFrame, path: str, name: str = "name", sequence: str = "sequence", width: int = 80) -> None:
    """A record of each row, wrapped at ``width``."""
    body = F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("value")).write.text(path)
