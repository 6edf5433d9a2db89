"""Genotype-shaped views of the star-schema test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefixes of allele-count columns in the SQL: all calls, and the populations 0 to 3.
POPS = {"a": None, "b": 0, "c": 1, "d": 2, "e": 3}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vidx, pos, ac (all) and ac_b to ac_e (populations): each line item is one allele call of its part."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    # dimension tables: their size follows the number of suppliers, and Spark checks it before broadcasting
    pop = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("pop"))
    rows = li.join(pop, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = []
    for prefix, p in POPS.items():
        for k, flag in enumerate("ANR"):
            on = F.col("l_returnflag") == flag
            counts.append(F.count_if(on if p is None else on & (F.col("pop") == p)).alias(f"{prefix}{k}"))
    got = rows.groupBy(F.col("l_partkey").alias("vidx")).agg(*counts)
    arrays = [F.array(*[F.col(f"{x}{k}") for k in range(3)]).alias("ac" if x == "a" else f"ac_{x}") for x in POPS]
    return got.select("vidx", (F.col("vidx") + 1).alias("pos"), *arrays)


CALLS_SQL = (
    "pop as (select s_suppkey, n_regionkey pop from supplier join nation on s_nationkey = n_nationkey), v as (select l_partkey vidx, l_partkey + 1 pos, "
    + ", ".join(f"count(*) filter (where l_returnflag = '{flag}'{'' if p is None else f' and pop = {p}'}) {x}{k}" for x, p in POPS.items() for k, flag in enumerate("ANR"))
    + " from lineitem join pop on l_suppkey = s_suppkey group by l_partkey)"
)

N_SAMPLES = 20


def grid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vidx, pos, gt and h: diploid calls of 20 samples at every part, with missing alleles."""
    p = F.col("p_partkey")

    def allele(s, k):
        h = (p * 7919 + s * 104729 + k * 1299709 + p * s * 31) % 1009
        return F.when(h < 60, -1).when(h < 60 + (p * 37) % 900, 1).otherwise(0).cast("tinyint")

    gt = F.transform(F.sequence(F.lit(0), F.lit(N_SAMPLES - 1)), lambda s: F.array(allele(s, F.lit(0)), allele(s, F.lit(1))))
    df = read(spark, sf_dir, "part").select(p.alias("vidx"), (p * 10 + 1).alias("pos"), gt.alias("gt"))
    return df.withColumn("h", F.flatten("gt"))


GRID_SQL = (
    "g as (select p_partkey vidx, p_partkey * 10 + 1 pos, s, k, 2 * s + k hidx, "
    "case when h < 60 then -1 when h < 60 + (p_partkey * 37) % 900 then 1 else 0 end a from "
    "(select p_partkey, s, k, (p_partkey * 7919 + s * 104729 + k * 1299709 + p_partkey * s * 31) % 1009 h "
    f"from part, range({N_SAMPLES}) t(s), range(2) u(k))), "
    "c as (select vidx, pos, s, max(case when k = 0 then a end) x, max(case when k = 1 then a end) y from g group by all)"
)
