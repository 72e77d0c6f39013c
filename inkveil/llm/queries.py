"""The queries of this folder's operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import bpe, decontam, hmm, near_dup, pii, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filter
from inkveil.llm.common import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.length_histogram(table(spark, sf_dir, "documents"), RANKS, PATTERN))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return judged.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_prob")


#: The key of surrogates; a deployment passes its own secret.
PII_KEY = "inkveil"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities")


#: (verdict, host, path) of the rules that come before the templates.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.components(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# Parts of operators that SQL can express, as queries of their own: the features of 5, the rules of 7, the base score of 3.


def quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = quality_rules.features(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = url_filter.rule_of(F.col("host"), F.col("path"), URL_RULES)
    return pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def unigram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hmm.score(table(spark, sf_dir, "documents"), rounds=1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FEATURES_SQL = rf"""with d as materialized (select doc_id, coalesce(text, '') as t, {_WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
    g as materialized (select doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) as x from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
    twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, x) as n from g) where n > 1),
    covered as (select doc_id, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by doc_id)
    select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(n, 0)::bigint as n_repeat_words, len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed from d left join covered c on c.doc_id = d.doc_id"""


def _rules_sql() -> str:
    """The longest rule that fits, by cases from the longest on."""
    order = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda of: "case " + " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{of(v, h, p)}'" for v, h, p in order) + " end"
    rest = "substr(url, strpos(url, '://') + 3)"
    return f"""select page_id, host, path, {case(lambda v, h, p: h + p)} as rule, {case(lambda v, h, p: v)} as verdict from (select page_id,
        case when strpos(coalesce(url, ''), '://') > 0 then translate(regexp_extract({rest}, '^([^/?#]*)', 1), {_LOWER}) else '' end as host,
        case when strpos(coalesce(url, ''), '://') > 0 then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) else '' end as path from pages)"""


# The remainder by 10 of the CRC-32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: ascii(c)::bigint)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)), 4294967295)"
_UNIGRAM_SQL = rf"""with d as materialized (select doc_id, {_CRC} % 10 = 0 as held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+'), chr(10)) as w from documents),
    t as materialized (select doc_id, held_out, unnest(w) as x from d), c as materialized (select x, count(*) as c from t where not held_out group by x), s as (select sum(c) as n, count(*) as v from c)
    select doc_id, any_value(held_out) as held_out, count(*)::bigint as n_tokens, count(c)::bigint as n_known, any_value(n)::bigint as train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 4) as base_score from t left join c using (x), s group by doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_bpe, op3_lm_score, op4_token_counts, op5_quality_rules, op6_pii, op7_url_filter, op8_decontamination, op9_simhash, op10_suffix_dedup, quality_features, url_rules, unigram_base)}


def oracle_sql() -> dict[str, str]:
    return {"op8_decontamination": decontam.oracle(), "quality_features": _FEATURES_SQL, "url_rules": _rules_sql(), "unigram_base": _UNIGRAM_SQL}
