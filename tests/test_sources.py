"""Readers and writers on files written here."""

import math

from pyspark.sql import functions as F

from varispark.sources import features, vcf
from varispark.streaming import ingest

TEXT = """##fileformat=VCFv4.1
##FILTER=<ID=q10,Description="Quality below 10">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency">
##INFO=<ID=DB,Number=0,Type=Flag,Description="known">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
1\t10\trs1\tA\tC\t29.5\tPASS\tDP=14;AF=0.5;DB\tGT:DP\t0|1:3\t1/1:.
1\t20\t.\tAG\tA,T\t.\tq10\tAF=0.1,0.2\tGT\t.\t0/2
2\t5\t.\tG\t.\t50\t.\t.\tGT:DP\t0/0:7\t./.
"""


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_read_vcf(spark, tmp_path):
    p = _write(tmp_path, "a.vcf", TEXT)
    df = vcf.read_vcf(spark, p, fields=["*"])
    rows = df.orderBy("vidx").collect()
    assert [r.vidx for r in rows] == [0, 1, 2] and [r.variants_POS for r in rows] == [10, 20, 5]
    assert [list(r.variants_ALT) for r in rows] == [["C", "", ""], ["A", "T", ""], ["", "", ""]]
    assert [r.variants_numalt for r in rows] == [1, 2, 0] and [r.variants_is_snp for r in rows] == [True, False, False]
    assert list(rows[1].variants_altlen) == [-1, -1, 0] and [r.variants_FILTER_PASS for r in rows] == [True, False, False]
    assert [r.variants_FILTER_q10 for r in rows] == [False, True, False] and [r.variants_DP for r in rows] == [14, -1, -1]
    assert [r.variants_DB for r in rows] == [True, False, False] and abs(rows[1].variants_AF[1] - 0.2) < 1e-6 and math.isnan(rows[1].variants_QUAL)
    assert [list(map(list, r.calldata_GT)) for r in rows] == [[[0, 1], [1, 1]], [[-1, -1], [0, 2]], [[0, 0], [-1, -1]]]
    assert [list(r.calldata_DP) for r in rows] == [[3, -1], [-1, -1], [7, -1]]


def test_vcf_options(spark, tmp_path):
    p = _write(tmp_path, "a.vcf", TEXT)
    assert set(vcf.read_vcf(spark, p).columns) == {"vidx", *(f"variants_{x}" for x in ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER_PASS")), "calldata_GT"}
    assert [r.variants_POS for r in vcf.read_vcf(spark, p, fields=["POS"], region="1:15-30").collect()] == [20]
    one = vcf.read_vcf(spark, p, fields=["calldata/GT"], samples=["B"]).orderBy("vidx").collect()
    assert [list(r.calldata_GT[0]) for r in one] == [[1, 1], [0, 2], [-1, -1]]
    flat = vcf.vcf_to_dataframe(vcf.read_vcf(spark, p, fields=["CHROM", "ALT"]))
    assert flat.columns == ["vidx", "CHROM", "ALT_1", "ALT_2", "ALT_3"] and flat.orderBy("vidx").first().ALT_2 is None


def test_write_vcf_round_trip(spark, tmp_path):
    p = _write(tmp_path, "a.vcf", TEXT)
    df = vcf.read_vcf(spark, p, fields=["variants/*"])
    out = str(tmp_path / "out")
    vcf.write_vcf(df, out)
    lines = [r.value for r in spark.read.text(out).collect()]
    body = sorted(x for x in lines if not x.startswith("#"))
    assert body[0].split("\t")[:7] == ["1", "10", "rs1", "A", "C", "29.5", "PASS"] and body[0].split("\t")[7] == "AF=0.5;DB;DP=14"
    assert any(x.startswith("##INFO=<ID=DP,Number=1,Type=Integer") for x in lines)


def test_gff_and_fasta(spark, tmp_path):
    p = _write(tmp_path, "a.gff", "##gff-version 3\n1\tx\tgene\t5\t90\t.\t+\t.\tID=g1;Name=a%20b;odd\n2\tx\texon\t7\t8\t0.5\t-\t1\tParent=g1\nbroken line\n")
    rows = features.read_gff3(spark, p, attributes=["ID", "Name", "Parent"]).orderBy("vidx").collect()
    assert [(r.seqid, r.start, r.end, r.score, r.phase, r.ID, r.Name, r.Parent) for r in rows] == [("1", 5, 90, -1.0, -1, "g1", "a b", "."), ("2", 7, 8, 0.5, 1, ".", ".", "g1")]
    assert features.read_gff3(spark, p, region="1:80-100").count() == 1
    out = str(tmp_path / "fa")
    features.write_fasta(spark.createDataFrame([("s", "ACGTACGTAC")], "name string, sequence string"), out, width=4)
    assert "\n".join(r.value for r in spark.read.text(out).collect()) == ">s\nACGT\nACGT\nAC"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src, "a.vcf", TEXT)
    header = vcf.read_vcf_headers(spark, str(src))
    rows = ingest.stream_vcf(spark, str(src), header, fields=["CHROM", "POS"])
    q = ingest.to_parquet(rows, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, ingest.windowed_counts(got, 15).collect())) == [("1", 0, 1), ("1", 1, 1), ("2", 0, 1)]
    assert got.agg(F.count("*")).first()[0] == 3


def test_cached_results(spark, tmp_path):
    from varispark.sources.cache import cached

    calls = []

    @cached(str(tmp_path))
    def numbers(spark, n, step=1):
        calls.append(n)
        return spark.range(0, n, step)

    assert [numbers(spark, 6, step=2).count(), numbers(spark, 6, step=2).count(), numbers(spark, 4).count()] == [3, 3, 4]
    assert calls == [6, 4]


def test_set_index(spark):
    import pytest

    from varispark.operators import index

    make = lambda rows: spark.createDataFrame([(v, *r) for v, r in enumerate(rows)], "vidx long, chrom string, pos long")
    good = make([("2", 5), ("2", 9), ("1", 1), ("1", 1), ("1", 4)])
    assert [tuple(r["index"]) for r in index.set_index(good, "chrom", "pos").orderBy("vidx").collect()][2] == ("1", 1)
    for bad, kw in ((make([("1", 5), ("1", 4)]), {}), (make([("1", 5), ("2", 4), ("1", 9)]), {}), (good, {"unique": True})):
        with pytest.raises(ValueError):
            index.set_index(bad, "chrom", "pos", **kw)
    with pytest.raises(ValueError):
        index.set_index(good, "pos")
