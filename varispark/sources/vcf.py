"""VCF in and out. The header is read on the driver and makes the schema; rows are split by Catalyst projections.

Only the requested fields are parsed, a region becomes a filter before any other
column is split, and sample selection is a slice of the sample columns.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varispark.sources.order import with_vidx

#: VCF types to Spark's, and the fill of each.
_TYPES = {"Integer": "int", "Float": "float", "String": "string", "Character": "string", "Flag": "boolean"}
_FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL")
_COMPUTED = ("numalt", "altlen", "is_snp")
DEFAULT_ALT_NUMBER = 3


@dataclass
class VcfHeader:
    lines: list[str] = field(default_factory=list)
    filters: dict[str, dict] = field(default_factory=dict)
    infos: dict[str, dict] = field(default_factory=dict)
    formats: dict[str, dict] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)


_META = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,>]*)')


def parse_header(lines: Sequence[str]) -> VcfHeader:
    """Later duplicates win; a missing #CHROM line is an error."""
    h = VcfHeader(list(lines))
    for line in lines:
        for kind, into in (("FILTER", h.filters), ("INFO", h.infos), ("FORMAT", h.formats)):
            if line.startswith(f"##{kind}=<"):
                d = {k: v.strip('"') for k, v in _META.findall(line.split("=", 1)[1].strip("<>\r\n"))}
                if "ID" in d:
                    into[d["ID"]] = d
        if line.startswith("#CHROM"):
            h.samples = line.rstrip("\r\n").split("\t")[9:]
            return h
    raise ValueError("VCF has no #CHROM line")


def read_vcf_headers(spark: SparkSession, path: str) -> VcfHeader:
    """The leading lines, in growing pieces, of the first file by name."""
    first = min(spark.read.text(path).inputFiles())
    n = 256
    while True:
        rows = [r[0] for r in spark.read.text(first).take(n)]
        head = [x for x in rows if x.startswith("#")]
        if any(x.startswith("#CHROM") for x in head) or len(rows) < n or len(head) < len(rows):
            return parse_header(head)
        n *= 8


def _number(d: Mapping[str, str], alt_number: int, overrides: Mapping[str, int], name: str) -> int:
    if name in overrides:
        return overrides[name]
    n = d.get("Number", ".")
    return {"A": alt_number, "R": alt_number + 1, "G": 3, ".": 1}.get(n) or (int(n) if n.isdigit() and int(n) > 0 else 1)


def _lenient(x: Column, kind: str) -> Column:
    """Number at the start of the text; ``.`` and the like are missing."""
    if kind == "string":
        return x
    pattern = r"^[+-]?\d+" if kind in ("int", "bigint", "smallint", "tinyint") else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    return F.regexp_extract(x, pattern, 0).try_cast(kind)


#: What stands for missing in each type.
_FILL = {"int": -1, "bigint": -1, "smallint": -1, "tinyint": -1, "float": float("nan"), "double": float("nan"), "string": ""}


def _values(text: Column, kind: str, n: int, fills: Mapping, name: str, sep: str = ",") -> Column:
    """One value, or an array of n: surplus ones are dropped, absent ones filled."""
    fill = F.lit(fills.get(name, _FILL[kind])).cast(kind)
    parts = F.split(F.when(text.isNull() | text.startswith("."), F.lit("")).otherwise(text), sep)
    value = lambda x: F.coalesce(_lenient(F.when((x != "") & (x != "."), x), kind), fill)
    if n == 1:
        return value(F.get(parts, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: value(F.coalesce(F.get(parts, i), F.lit(""))))


def _genotype(text: Column, ploidy: int) -> Column:
    parts = F.split(text, "[/|]")
    return F.transform(F.sequence(F.lit(0), F.lit(ploidy - 1)), lambda i: F.coalesce(F.get(parts, i).try_cast("tinyint"), F.lit(-1).cast("tinyint")))


def resolve_fields(header: VcfHeader, fields: Sequence[str] | None, exclude: Sequence[str] = ()) -> list[str]:
    """Names as variants/X and calldata/Y; understands *, variants/*, calldata/*, INFO, FILTER and bare names."""
    filters = [f"variants/FILTER_{f}" for f in ["PASS", *[f for f in header.filters if f != "PASS"]]]
    infos = [f"variants/{i}" for i in header.infos]
    every = [*(f"variants/{f}" for f in _FIXED), *filters, *infos, *(f"variants/{f}" for f in _COMPUTED)]
    data = [f"calldata/{f}" for f in header.formats] if header.samples else []
    if fields is None:
        fields = [*(f"variants/{f}" for f in _FIXED), "variants/FILTER_PASS", *(["calldata/GT"] if header.samples else [])]
    groups = {"*": [*every, *data], "variants/*": every, "variants*": every, "calldata/*": data, "calldata*": data, "INFO": infos, "variants/INFO": infos, "FILTER": filters, "variants/FILTER": filters}
    out: list[str] = []
    for f in fields:
        if f == "samples":
            continue
        if f in groups:
            names = groups[f]
        elif "/" in f:
            names = [f]
        elif f in header.formats and f not in header.infos and f not in _FIXED:
            names = [f"calldata/{f}"]
        else:
            names = [f"variants/{f}"]
        out += [n for n in names if n not in out]
    for n in out:
        if n not in every and n not in data:
            warnings.warn(f"{n} is not declared in the header", stacklevel=2)
    skip = set(exclude) | {f"variants/{e}" for e in exclude} | {f"calldata/{e}" for e in exclude}
    return [n for n in out if n not in skip]


def parse_region(region: str) -> tuple[str, int | None, int | None]:
    m = re.fullmatch(r"(.+?)(?::([\d,]+)-([\d,]+))?", region)
    return m[1], *(int(x.replace(",", "")) if x else None for x in m.groups()[1:])


def parse_vcf_lines(lines: DataFrame, header: VcfHeader, fields: Sequence[str] | None = None, exclude_fields: Sequence[str] = (), types: Mapping[str, str] | None = None, numbers: Mapping[str, int] | None = None, alt_number: int = DEFAULT_ALT_NUMBER, fills: Mapping | None = None, region: str | None = None, samples: Sequence[str | int] | None = None, ploidy: int = 2) -> DataFrame:
    """Parse lines of text (column ``value``); works on streams too."""
    types, numbers, fills = types or {}, numbers or {}, fills or {}
    df = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    c = F.split("value", "\t")
    df = df.withColumn("_c", c)
    if region is not None:
        chrom, a, b = parse_region(region)
        df = df.where(F.col("_c")[0] == chrom)
        if a is not None:
            df = df.where(F.col("_c")[1].cast("bigint").between(a, b))
    col = lambda i: F.get(F.col("_c"), F.lit(i))
    alts = F.when(col(4).startswith("."), F.array().cast("array<string>")).otherwise(F.split(col(4), ","))
    info = F.when(col(7).startswith("."), F.lit("")).otherwise(col(7))
    flags = F.when(col(6).startswith("."), F.array().cast("array<string>")).otherwise(F.split(col(6), "[;,:]"))
    out: list[Column] = [F.col(x) for x in lines.columns if x != "value"]
    index = {s: i for i, s in enumerate(header.samples)}
    chosen = list(range(len(header.samples))) if samples is None else sorted(index[s] if isinstance(s, str) else s for s in samples if not isinstance(s, str) or s in index)
    for name in resolve_fields(header, fields, exclude_fields):
        group, f = name.split("/", 1)
        as_ = f"{group}_{f}"
        if group == "variants":
            if f == "CHROM":
                v = col(0)
            elif f == "POS":
                v = col(1).try_cast("int")
            elif f == "ID":
                v = col(2)
            elif f == "REF":
                v = col(3)
            elif f == "ALT":
                n = numbers.get("ALT", alt_number)
                v = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(alts, i), F.lit(""))) if n > 1 else F.coalesce(F.get(alts, F.lit(0)), F.lit(""))
            elif f == "QUAL":
                v = F.coalesce(_lenient(col(5), "float"), F.lit(float("nan")).cast("float"))
            elif f.startswith("FILTER_"):
                v = F.array_contains(flags, f[7:])
            elif f == "numalt":
                v = F.size(alts)
            elif f == "altlen" and f not in header.infos:
                size = lambda a: F.when(a.isin("*", "."), 0).otherwise(F.length(a))
                v = F.transform(F.sequence(F.lit(0), F.lit(alt_number - 1)), lambda i: F.coalesce(size(F.get(alts, i)) - F.length(col(3)), F.lit(0)))
            elif f == "is_snp":
                v = (F.length(col(3)) == 1) & (F.size(alts) > 0) & F.forall(alts, lambda a: (F.length(a) == 1) & ~a.isin("*", "."))
            else:
                d = header.infos.get(f, {})
                kind = types.get(f, types.get(name, _TYPES.get(d.get("Type", "String"), "string")))
                entries = F.filter(F.split(info, ";"), lambda e: (e == f) | e.startswith(f + "="))
                entry = F.get(entries, F.size(entries) - 1)
                v = F.coalesce(entry.isNotNull(), F.lit(False)) if kind == "boolean" else _values(F.when(entry.contains("="), F.substring(entry, len(f) + 2, 1 << 30)), kind, _number(d, alt_number, numbers, f), fills, f)
        else:
            d = header.formats.get(f, {})
            kind = types.get(f, types.get(name, _TYPES.get(d.get("Type", "String"), "string")))
            where = F.array_position(F.split(col(8), ":"), f)
            cells = F.transform(F.array(*[F.lit(9 + i) for i in chosen]) if chosen else F.array().cast("array<int>"), lambda i: F.get(F.col("_c"), i))
            sub = lambda s: F.when(where > 0, F.get(F.split(s, ":"), (where - 1).cast("int")))
            if f == "GT" and types.get("GT", types.get(name, "genotype")) == "genotype":
                v = F.transform(cells, lambda s: _genotype(F.coalesce(sub(s), F.lit(".")), numbers.get("GT", ploidy)))
            elif f == "GT" and types.get("GT", types.get(name)) == "genotype_ac":
                # calls of each allele up to alt_number; the others, and missing ones, are not counted
                counts = lambda s: F.transform(F.sequence(F.lit(0), F.lit(alt_number)), lambda k: F.size(F.filter(F.split(s, "[/|]"), lambda a: a.try_cast("int") == k)).cast("tinyint"))
                v = F.transform(cells, lambda s: counts(F.coalesce(sub(s), F.lit("."))))
            else:
                n = _number(d, alt_number, numbers, f)
                v = F.transform(cells, lambda s: _values(F.coalesce(sub(s), F.lit(".")), kind, n, fills, f))
        out.append(v.alias(as_))
    return df.select(*out)


def read_vcf(spark: SparkSession, path: str, rename_fields: Mapping[str, str] | None = None, **options) -> DataFrame:
    """vidx and the requested fields as variants_X and calldata_Y; plain or gzip text."""
    header = read_vcf_headers(spark, path)
    lines = with_vidx(spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")))
    out = parse_vcf_lines(lines, header, **options)
    names = {k.replace("/", "_"): v.replace("/", "_") for k, v in (rename_fields or {}).items()}
    if len({names.get(c, c).lower() for c in out.columns}) < len(out.columns):
        raise ValueError("renamed fields clash")
    return out.withColumnsRenamed(names)


def samples_df(spark: SparkSession, header: VcfHeader) -> DataFrame:
    return spark.createDataFrame(list(enumerate(header.samples)), "sidx int, sample string")


def vcf_to_dataframe(df: DataFrame) -> DataFrame:
    """Variant fields only; arrays become NAME_1..n and empty texts NULL."""
    out: list[Column] = []
    for f in df.schema.fields:
        if not f.name.startswith("variants_"):
            continue
        name, kind = f.name[9:], f.dataType.simpleString()
        null = lambda c: F.nullif(c, F.lit(""))
        if kind.startswith("array"):
            n = df.select(F.max(F.size(f.name))).first()[0] or 0
            out += [(null(F.col(f.name)[i]) if "string" in kind else F.col(f.name)[i]).alias(f"{name}_{i + 1}") for i in range(n)]
        else:
            out.append((null(F.col(f.name)) if kind == "string" else F.col(f.name)).alias(name))
    return df.select("vidx", *out)


def vcf_to_csv(df: DataFrame, path: str, **options) -> None:
    vcf_to_dataframe(df).drop("vidx").write.options(header=True, **options).csv(path)


def vcf_to_parquet(df: DataFrame, path: str, partition_by: str | None = "variants_CHROM", overwrite: bool = False) -> None:
    """The columnar sink: one folder a chromosome; names that differ in case only are refused."""
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise ValueError("field names clash when case is ignored")
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_vcf(df: DataFrame, path: str, description: Mapping[str, str] | None = None, number: Mapping[str, str | int] | None = None, fill: int | None = -1, write_header: bool = True) -> None:
    """Sites-only VCF 4.1 from columns CHROM, POS, ID, REF, ALT, QUAL, FILTER_*, and others as INFO."""
    description, number = description or {}, number or {}
    cols = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in ("vidx", "samples") and not f.name.startswith("calldata_")}
    cols = {k.removeprefix("variants_"): (k, t) for k, t in cols.items()}
    filters = sorted(c[7:] for c in cols if c.startswith("FILTER_") and c != "FILTER_PASS")
    has_filters = any(c.startswith("FILTER_") for c in cols)
    infos = sorted(c for c in cols if c not in _FIXED and not c.startswith("FILTER_") and c not in _COMPUTED)
    head = ["##fileformat=VCFv4.1", "##source=varispark"]
    for i in infos:
        _, t = cols[i]
        inner = t.removeprefix("array<").rstrip(">")
        kind = "Flag" if inner == "boolean" else "Integer" if inner in ("int", "bigint", "smallint", "tinyint") else "Float" if inner in ("float", "double") else "String"
        n = number.get(i, 0 if kind == "Flag" else "." if t.startswith("array") else 1)
        head.append(f'##INFO=<ID={i},Number={n},Type={kind},Description="{description.get(i, "")}">')
    head += [f'##FILTER=<ID={f},Description="{description.get("FILTER_" + f, "")}">' for f in filters]
    head.append("#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]))

    def text(name: str) -> Column:
        if name not in cols:
            return F.lit(".")
        column, t = cols[name]
        c = F.col(column)
        if t.startswith("array"):
            bad = (lambda x: x != "") if "string" in t else (lambda x: ~F.isnan(x)) if "float" in t or "double" in t else (lambda x: x != fill) if fill is not None else (lambda x: x.isNotNull())
            c = F.array_join(F.transform(F.filter(c, bad), lambda x: x.cast("string")), ",")
        elif t in ("float", "double"):
            c = F.when(~F.isnan(c), c.cast("string"))
        elif t != "string" and fill is not None and name != "POS":
            c = F.when(c != fill, c.cast("string"))
        return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("."))

    if not has_filters:
        filter_text = F.lit(".")
    else:
        names = F.array_compact(F.array(*[F.when(F.col(cols[f"FILTER_{f}"][0]), F.lit(f)) for f in filters])) if filters else F.array().cast("array<string>")
        filter_text = F.when(F.size(names) > 0, F.array_join(names, ";")).otherwise("PASS")
    entries = [F.when(F.col(cols[i][0]), F.lit(i)) if cols[i][1] == "boolean" else F.when(text(i) != ".", F.concat(F.lit(i + "="), text(i))) for i in infos]
    info = F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*entries)), ";"), F.lit("")), F.lit(".")) if entries else F.lit(".")
    line = F.concat_ws("\t", *[text(n) for n in _FIXED], filter_text, info)
    body = df.orderBy("vidx") if "vidx" in df.columns else df
    rows = body.select(line.alias("value"))
    if write_header:
        rows = df.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1).union(rows)
    rows.write.text(path)


#: Columns of a functional annotation.
ANN_FIELDS = ("Allele", "Annotation", "Annotation_Impact", "Gene_Name", "Gene_ID", "Feature_Type", "Feature_ID", "Transcript_BioType", "Rank", "HGVS_c", "HGVS_p", "cDNA_pos", "cDNA_length", "CDS_pos", "CDS_length", "AA_pos", "AA_length", "Distance")


def split_annotation(ann: Column) -> list[Column]:
    """The first annotation of an ANN value, as typed columns ANN_X."""
    p = F.split(F.get(F.split(ann, ","), F.lit(0)), "\\|")
    at = lambda i: F.get(p, F.lit(i))
    part = lambda i, j: F.coalesce(F.get(F.split(at(i), "/"), F.lit(j)).try_cast("int"), F.lit(-1))
    values = [*(at(i) for i in range(8)), part(8, 0), F.regexp_replace(at(9), "^[a-z]\\.", ""), F.regexp_replace(at(10), "^[a-z]\\.", "")]
    for i in (11, 12, 13):
        values += [part(i, 0), part(i, 1)]
    values.append(F.coalesce(at(14).try_cast("int"), F.lit(-1)))
    return [v.alias(f"ANN_{n}") for n, v in zip(ANN_FIELDS, values, strict=True)]
