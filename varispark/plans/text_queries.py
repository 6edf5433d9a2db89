"""Registered queries over text formats: lines made of the test tables are parsed, read and written, and SQL tells the fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varispark.plans.views import read
from varispark.session import scratch_dir
from varispark.sources import features, vcf
from varispark.streaming import ingest

HEADER = """##fileformat=VCFv4.1
##FILTER=<ID=q10,Description="Quality below 10">
##FILTER=<ID=s50,Description="Few samples">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">
##INFO=<ID=ANN,Number=1,Type=String,Description="Annotation">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\ttwo"""


def _at(values: str, by: str) -> str:
    """SQL, in both dialects, of an item of a list of texts by the part key."""
    items = values.split(" ")
    return "case p_partkey % {} {} end".format(by, " ".join(f"when {i} then '{v}'" for i, v in enumerate(items[:-1])) + f" else '{items[-1]}'")


_REF, _ALT, _FILTER = _at("A C G T", "4"), _at(". A,TT G C,A,T TT", "5"), _at("PASS q10 q10;s50 .", "4")
_GT1, _GT2 = _at("0|1 1/1 ./. 0/2 0 1|0", "6"), _at("0/0 . 1|2", "3")
_ANN = "concat('T|missense_variant|MODERATE|G', p_size, '|id|transcript|t', p_partkey % 9, '|coding|', p_size, '/60|c.', p_partkey, 'A>T|p.L', p_size, 'F|', p_partkey, '/900|', p_size, '/800||17')"
_INFO = f"case when p_partkey % 6 = 0 then '.' else concat('DP=', p_size, case when p_partkey % 5 = 1 then ';AF=0.5,0.25' else ';AF=0.5' end, case when p_partkey % 2 = 0 then ';DB' else '' end, ';ANN=', {_ANN}) end"
_FIELDS = [
    "concat('chr', p_partkey % 3 + 1)", "cast(p_partkey * 10 + 1 as string)", "case when p_partkey % 7 = 0 then '.' else concat('rs', p_partkey) end", _REF, _ALT,
    "case when p_partkey % 11 = 0 then '.' else cast(p_size + 0.5 as string) end", _FILTER, _INFO, "'GT:DP'", f"concat({_GT1}, ':', p_partkey % 50)", _GT2,
]
#: The same fields as a table.
_SITES = (
    f"s as (select p_partkey vidx, p_size::int sz, p_partkey % 3 + 1 chrom, p_partkey * 10 + 1 pos, p_partkey % 7 = 0 no_id, {_REF} ref, case when p_partkey % 5 = 0 then [] else string_split({_ALT}, ',') end alts, "
    f"{_FILTER} filt, p_partkey % 6 <> 0 has, {_GT1} g1, {_GT2} g2 from part)"
)
_GT_SQL = lambda g, k: f"coalesce(try_cast(list_extract(regexp_split_to_array({g}, '[/|]'), {k}) as int), -1)"


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vidx, value): a line of text for each part."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("vidx"), F.concat_ws("\t", *[F.expr(f) for f in _FIELDS]).alias("value"))


def _parsed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return vcf.parse_vcf_lines(vcf_lines(spark, sf_dir), vcf.parse_header(HEADER.split("\n")), **options)


def _v(name: str) -> Column:
    return F.col(f"variants_{name}")


def vcf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _parsed(spark, sf_dir, fields=["*"])
    gt = F.col("calldata_GT")
    call = lambda i, k: gt[i][k].cast("int")
    return d.select(
        "vidx", _v("CHROM").alias("chrom"), _v("POS").cast("bigint").alias("pos"), _v("ID").alias("id"), _v("REF").alias("ref"), *[_v("ALT")[i].alias(f"alt{i}") for i in range(3)],
        F.nanvl(_v("QUAL").cast("double"), F.lit(-1.0)).alias("qual"), *[_v(f"FILTER_{f}").alias(f.lower()) for f in ("PASS", "q10", "s50")], _v("DP").alias("dp"), _v("DB").alias("db"),
        *[F.nanvl(_v("AF")[i].cast("double"), F.lit(-1.0)).alias(f"af{i}") for i in range(2)], _v("numalt").alias("numalt"), _v("altlen")[0].alias("altlen"), _v("is_snp").alias("is_snp"),
        *[call(i, k).alias(f"g{i}{k}") for i in range(2) for k in range(2)], *[F.col("calldata_DP")[i].alias(f"dp{i}") for i in range(2)],
    )


_FIELDS_SQL = (
    "select vidx, 'chr' || chrom chrom, pos, case when no_id then '.' else 'rs' || vidx end id, ref, "
    + ", ".join(f"coalesce(alts[{i + 1}], '') alt{i}" for i in range(3))
    + ", case when vidx % 11 = 0 then -1 else sz + 0.5 end::double qual, filt = 'PASS' pass, filt like 'q10%' q10, filt like '%s50' s50, case when has then sz else -1 end dp, has and vidx % 2 = 0 db, "
    "case when has then 0.5 else -1 end::double af0, case when has and vidx % 5 = 1 then 0.25 else -1 end::double af1, len(alts)::int numalt, (coalesce(len(alts[1]), 1) - 1)::int altlen, len(alts) > 0 and len(list_filter(alts, lambda a: len(a) <> 1)) = 0 is_snp, "
    + ", ".join(f"{_GT_SQL(g, k + 1)} g{i}{k}" for i, g in enumerate(("g1", "g2")) for k in range(2))
    + ", (vidx % 50)::int dp0, -1 dp1 from s"
)


def vcf_region_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _parsed(spark, sf_dir, fields=["POS", "calldata/GT"], region="chr2:1-1500", samples=["two"])
    return d.select("vidx", _v("POS").cast("bigint").alias("pos"), F.size("calldata_GT").alias("n"), F.col("calldata_GT")[0][1].cast("int").alias("allele"))


def vcf_genotype_ac(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _parsed(spark, sf_dir, fields=["calldata/GT"], types={"GT": "genotype_ac"}, alt_number=2)
    c = F.col("calldata_GT")
    return d.select("vidx", *[c[i][k].cast("int").alias(f"c{i}{k}") for i in range(2) for k in range(3)])


_AC_SQL = lambda g, k: f"len(list_filter(regexp_split_to_array({g}, '[/|]'), lambda x: x = '{k}'))::int"


def vcf_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _parsed(spark, sf_dir, fields=["ANN"]).where("variants_ANN <> ''")
    a = d.select("vidx", *vcf.split_annotation(F.col("variants_ANN")))
    return a.select("vidx", *[F.col(f"ANN_{x}").alias(x.lower()) for x in ("Annotation", "Gene_Name", "Feature_ID", "Rank", "HGVS_c", "HGVS_p", "cDNA_pos", "cDNA_length", "CDS_pos", "CDS_length", "AA_pos", "Distance")])


def vcf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as VCF text without calls, and read again as files."""
    path = scratch_dir(spark)
    vcf.write_vcf(_parsed(spark, sf_dir, fields=["variants/*"], exclude_fields=["ANN", "numalt", "altlen", "is_snp"]), path, number={"AF": "A"})
    d = vcf.read_vcf(spark, path, fields=["variants/*"])
    return d.select(_v("CHROM").alias("chrom"), _v("POS").cast("bigint").alias("pos"), _v("ID").alias("id"), _v("ALT")[1].alias("alt1"), F.nanvl(_v("QUAL").cast("double"), F.lit(-1.0)).alias("qual"), _v("DP").alias("dp"), F.nanvl(_v("AF")[1].cast("double"), F.lit(-1.0)).alias("af1"), _v("DB").alias("db"), _v("FILTER_s50").alias("s50"))


def vcf_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of text are taken in as a stream, written exactly once, and counted in windows."""
    source, target, marks = (scratch_dir(spark) for _ in range(3))
    vcf_lines(spark, sf_dir).select("value").write.text(source)
    rows = ingest.stream_vcf(spark, source, vcf.parse_header(HEADER.split("\n")), fields=["CHROM", "POS"])
    ingest.to_parquet(rows, target, marks).awaitTermination()
    return ingest.windowed_counts(spark.read.schema(rows.schema).parquet(target), 500).select(_v("CHROM").alias("chrom"), "w", "n")


def gff3_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as features of their nations, written as GFF3 and read with a region and attributes."""
    path = scratch_dir(spark)
    s = read(spark, sf_dir, "supplier")
    line = F.concat_ws("\t", F.concat(F.lit("n"), F.col("s_nationkey")), F.lit("src"), F.lit("gene"), F.col("s_suppkey") * 10 + 1, F.col("s_suppkey") * 10 + 15, F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=s"), F.col("s_suppkey"), F.lit(";Name=a%20b%3D"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, ";odd=1").otherwise("")))
    s.select(line.alias("value")).unionByName(spark.createDataFrame([("##gff-version 3",), ("a broken line",)], "value string")).write.text(path)
    d = features.read_gff3(spark, path, attributes=["ID", "Name", "odd"])
    return d.select("seqid", "type", "start", "end", "score", "phase", F.col("ID").alias("id"), F.col("Name").alias("name"), "odd")


def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    features.write_fasta(read(spark, sf_dir, "nation").select("n_name", F.repeat(F.lit("ACGT"), F.col("n_nationkey") + 1).alias("dna")), path, "n_name", "dna", width=30)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (vcf_fields, vcf_region_sample, vcf_genotype_ac, vcf_annotation, vcf_round_trip, vcf_stream_windows, gff3_attributes, fasta_lines)}
SQL = {
    "vcf_fields": f"with {_SITES} {_FIELDS_SQL}",
    "vcf_region_sample": f"with {_SITES} select vidx, pos, 1 n, {_GT_SQL('g2', 2)} allele from s where chrom = 2 and pos <= 1500",
    "vcf_genotype_ac": f"with {_SITES} select vidx, " + ", ".join(f"{_AC_SQL(g, k)} c{i}{k}" for i, g in enumerate(("g1", "g2")) for k in range(3)) + " from s",
    "vcf_annotation": f"with {_SITES} select vidx, 'missense_variant' annotation, 'G' || sz gene_name, 't' || vidx % 9 feature_id, sz rank, vidx || 'A>T' hgvs_c, 'L' || sz || 'F' hgvs_p, vidx::int cdna_pos, 900 cdna_length, sz cds_pos, 800 cds_length, -1 aa_pos, 17 distance from s where has",
    "vcf_round_trip": f"with {_SITES}, f as ({_FIELDS_SQL}) select chrom, pos, id, alt1, qual, dp, af1, db, s50 from f",
    "vcf_stream_windows": f"with {_SITES} select 'chr' || chrom chrom, (pos - 1) // 500 w, count(*) n from s group by 1, 2",
    "gff3_attributes": "select 'n' || s_nationkey seqid, 'gene' type, s_suppkey * 10 + 1 start, s_suppkey * 10 + 15 \"end\", -1.0::double score, -1 phase, 's' || s_suppkey id, 'a b=' || s_nationkey name, case when s_suppkey % 2 = 0 then '1' else '.' end odd from supplier",
    "fasta_lines": "select value, count(*) n from (select '>' || n_name value from nation union all select dna[i * 30 + 1:i * 30 + 30] from (select repeat('ACGT', n_nationkey + 1) dna from nation), unnest(range(0, (len(dna) - 1) // 30 + 1)) t(i)) group by value",
}
