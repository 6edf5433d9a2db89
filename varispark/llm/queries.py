"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varispark.llm.ann import search
from varispark.llm.bpe import digest_documents
from varispark.llm.ftrl import held_out
from varispark.llm.hmm_lm import score_documents
from varispark.llm.minhash import near_duplicates
from varispark.llm.packing import pack
from varispark.llm.quality import score_quality, train_quality
from varispark.llm.substring_dedup import dedup_substrings
from varispark.llm.suffix_dedup import dedup_suffixes
from varispark.llm.toxicity import score_toxicity, train_toxicity, training_labels
from varispark.llm.weak_rules import rate_documents


#: Tokenizer files; a parameter of the operators.
PACKING_TOKENIZER = "word_bpe_49k.json"
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, training_labels(_table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path(PACKING_TOKENIZER), with_ids=False).drop("ids")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), modulus=7, remainder=2)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, training_labels(_table(spark, sf_dir, "labels")))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rate_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_suffixes(docs, length=400).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_hmm_lm": op4_hmm_lm,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_ivf_pq": op7_ivf_pq,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Only where SQL can express the whole result and is fast enough on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""
with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} ws from documents),
g as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') k from w, unnest(range(1, len(ws) - 11)) t(i)),
f as (select k, min(doc_id) m from g group by k),
hit as (select doc_id, i from g join f using (k) where m < doc_id),
gone as (select distinct doc_id, i + o p from hit, range(0, 13) r(o)),
every as (select doc_id, p, ws[p] x from w, unnest(range(1, len(ws) + 1)) t(p)),
kept as (select doc_id, string_agg(x, ' ' order by p) t from every anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from w left join (select doc_id, count(*) n from gone group by doc_id) using (doc_id) left join kept using (doc_id)
""",
    "op5_minhash_near_dedup": f"""
with recursive w as (select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ws from documents),
s as (select distinct doc_id, ws[i] || ' ' || ws[i + 1] sh from w, unnest(range(1, len(ws))) t(i) union all select doc_id, ws[1] from w where len(ws) = 1),
n as (select doc_id, count(*) c from s group by doc_id),
link as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
edge as (select x, y from link join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 80 * (p.c + q.c - k)),
pairs as (select x, y from edge union all select y, x from edge),
reach as (select x, y from pairs union select r.x, b.y from reach r join pairs b on r.y = b.x)
select doc_id, coalesce(c, 0)::bigint n_shingles, coalesce(least(doc_id, m), doc_id) component_id, coalesce(least(doc_id, m), doc_id) = doc_id kept
from documents left join n using (doc_id) left join (select x doc_id, min(y) m from reach group by x) using (doc_id)
""",
    # texts as hexadecimal digits, in pieces of 512 starts, so that every slice is near the front of a short string
    "op10_suffix_array_dedup": """
with d as (select doc_id, row_number() over () r, hex(encode(coalesce(text, ''))) x from documents),
p as (select r, j * 512 o, x[1024 * j + 1:1024 * j + 1822] y from (select r, x, unnest(range(0, (len(x) // 2 - 400) // 512 + 1)) j from d where len(x) >= 800)),
g as (select r, o + i i, hash(y[2 * i + 1:2 * i + 800]) k, hash(y[2 * i + 1:2 * i + 800] || 'a') m from (select r, o, y, unnest(range(0, least(512, len(y) // 2 - 399))) i from p)),
k as (select k, m from g group by k, m having count(*) > 1),
hit as (select r, i from g semi join k using (k, m)),
edge as (select r, i, case when i - lag(i) over (partition by r order by i) <= 400 then 0 else 1 end new from hit),
run as (select r, min(i) a, max(i) + 400 b from (select r, i, sum(new) over (partition by r order by i) n from edge) group by r, n),
rest as (select r, list(a order by a) aa, list(b order by a) bb, sum(b - a) n, count(*) c from run group by r),
kept as (select r, list_aggregate(list_transform(range(0, len(aa) + 1), lambda j: x[2 * (case when j = 0 then 0 else bb[j] end) + 1:2 * (case when j = len(aa) then len(x) // 2 else aa[j + 1] end)]), 'string_agg', '') h from d join rest using (r))
select doc_id, (len(x) // 2)::bigint n_bytes, coalesce(n, 0)::bigint n_removed, coalesce(c, 0)::bigint n_spans, sha256(from_hex(coalesce(h, x))) kept_sha256
from d left join rest using (r) left join kept using (r)
""",
}
