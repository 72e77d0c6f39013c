"""The queries of the library: name, builder over (spark, folder of tables), and DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import masks, text, validators
from inkveil.functions.rules import RULES, select
from inkveil.operators import spans
from inkveil.plans import oracle
from inkveil.plans.seed import corpus
from inkveil.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return spans.match(corpus(spark, sf_dir), **options)


def span_rows(df: DataFrame, key: str = "doc_id", column: str = "matches") -> DataFrame:
    return spans.rows(df, [key], column).withColumnsRenamed({"start": "s", "end": "e"})


# --- rules and matching -------------------------------------------------------------------------------------------------


@query("rule_catalog", "select * from (values " + ", ".join(f"('{r.name}', {r.priority}, {r.case_sensitive}, {r.whole_word})" for r in RULES.values()) + ") t(name, priority, case_sensitive, whole_word)")
def rule_catalog(spark, sf_dir):
    return spark.createDataFrame([(r.name, r.priority, r.case_sensitive, r.whole_word) for r in select()], "name string, priority int, case_sensitive boolean, whole_word boolean")


def _match_query(name: str, rule: str, table: str, key: str, column: str) -> None:
    def build(spark, sf_dir):
        df = read(spark, sf_dir, table).select(key, column).withColumn("found", spans.find(F.col(column), RULES[rule].java, rule))
        return df.select(key, F.inline("found")).select(key, "rule", F.col("start").alias("s"), F.col("end").alias("e"), "value")

    query(name, f"select {key}, rule, s, e, value from ({oracle.found(rule, table, key, column)})")(build)


for _rule, _short in (("email", "email"), ("card", "card"), ("phone_mobile", "mobile"), ("phone_city", "city"), ("passport", "passport"), ("rrn", "rrn"), ("fgn", "fgn"), ("driver_license", "driver")):
    _match_query(f"match_{_short}_docs", _rule, "documents", "doc_id", "text")
_match_query("match_email_pages", "email", "pages", "page_id", "html")


@query("match_email_conversations", "select conv_id, turn, v as value, count(*) as n from (select conv_id, turn, unnest(regexp_extract_all(text, '(?i)" + oracle.PLAIN["email"] + "')) as v from conversations) group by all")
def match_email_conversations(spark, sf_dir):
    df = read(spark, sf_dir, "conversations").withColumn("value", F.explode(F.regexp_extract_all("text", F.lit(RULES["email"].java), F.lit(0))))
    return df.groupBy("conv_id", "turn", "value").agg(F.count("*").alias("n"))


for _rule in RULES:

    def _seed_query(spark, sf_dir, rule=_rule):
        df = corpus(spark, sf_dir).withColumn("found", spans.find(F.col("text"), RULES[rule].java, rule))
        return df.select("doc_id", F.inline("found")).select("doc_id", "rule", F.col("start").alias("s"), F.col("end").alias("e"), "value")

    query(f"match_{_rule}_seed", oracle.seeded(oracle.found(_rule), False))(_seed_query)


@query("match_all_seed", oracle.seeded("select doc_id, rule, s, e, value, valid, reason as fail_reason from cand"))
def match_all_seed(spark, sf_dir):
    return span_rows(spans.annotated(corpus(spark, sf_dir)), column="spans").drop("context")


@query("match_context", oracle.seeded("select doc_id, rule, s, e, value, context, valid, reason as fail_reason from kept"))
def match_context(spark, sf_dir):
    return span_rows(seeded(spark, sf_dir))


@query("match_case_sensitive", "select doc_id, rule, s, e, value from (" + " union all ".join(oracle.found(r, "documents", sensitive=True) for r in ("passport", "email")) + ")")
def match_case_sensitive(spark, sf_dir):
    df = read(spark, sf_dir, "documents").withColumn("found", F.concat(*[spans.find(F.col("text"), RULES[r].pattern, r) for r in ("passport", "email")]))
    return df.select("doc_id", F.inline("found")).select("doc_id", "rule", F.col("start").alias("s"), F.col("end").alias("e"), "value")


@query("match_documents", "with " + oracle.matches("documents") + " select doc_id, rule, s, e, value, valid, reason as fail_reason from kept")
def match_documents(spark, sf_dir):
    df = spans.match(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return span_rows(df).drop("context")


@query("overlap_filter", oracle.seeded("select doc_id, count(*) as n_kept, count(*) filter (where valid) as n_valid, sum(s * 31 + e) as places from kept group by doc_id"))
def overlap_filter(spark, sf_dir):
    return span_rows(seeded(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.count_if("valid").alias("n_valid"), F.sum(F.col("s") * 31 + F.col("e")).cast("decimal(38,0)").alias("places"))


@query("overlap_forbidden", oracle.seeded("select doc_id, rule, s, e from cand a where valid and not exists (select 1 from cand f where f.doc_id = a.doc_id and not f.valid and f.s < a.e and a.s < f.e)"))
def overlap_forbidden(spark, sf_dir):
    df = spans.annotated(corpus(spark, sf_dir))
    allowed, forbidden = spans.collect(F.col("spans"))
    return span_rows(df.withColumn("k", spans.without_forbidden(allowed, forbidden)), column="k").select("doc_id", "rule", "s", "e")


# --- validators and reasons ---------------------------------------------------------------------------------------------

_CHECKS = {
    "rrn": ("idno", "rrn"), "fgn": ("idno", "fgn"), "mobile": ("mobile", "phone_mobile"), "city": ("city", "phone_city"),
    "card": ("card_text", "card"), "driver": ("licence", "driver_license"),
}
for _name, (_column, _rule) in _CHECKS.items():
    # a foreigner's number needs its seventh digit; the rule's expression sees to that, the check alone does too
    _extra = f" and substr({oracle.digits(_column)}, 7, 1) in ('5', '6', '7', '8')" if _rule == "fgn" else ""

    def _validate(spark, sf_dir, column=_column, rule=_rule):
        return corpus(spark, sf_dir).select("doc_id", F.col(column).alias("value"), validators.of_rule(rule, F.col(column)).alias("valid"))

    query(f"validate_{_name}", oracle.seeded(f"select doc_id, {_column} as value, {oracle.valid(repr(_rule), _column)}{_extra} as valid from seed", False))(_validate)

    if _rule != "fgn":

        def _reason(spark, sf_dir, column=_column, rule=_rule):
            failed = corpus(spark, sf_dir).where(~validators.of_rule(rule, F.col(column)))
            return failed.select("doc_id", validators.fail_reason(F.lit(rule), F.col(column)).alias("fail_reason"))

        query(f"fail_reason_{_name}", oracle.seeded(f"select doc_id, {oracle.reason(repr(_rule), _column)} as fail_reason from seed where not {oracle.valid(repr(_rule), _column)}", False))(_reason)


@query("fail_reason_fgn", oracle.seeded("select doc_id, value, reason as fail_reason from cand where rule = 'fgn' and not valid"))
def fail_reason_fgn(spark, sf_dir):
    df = corpus(spark, sf_dir).select("doc_id", F.inline(spans.find(F.col("text"), RULES["fgn"].java, "fgn")))
    return df.where(~validators.is_fgn(F.col("value"))).select("doc_id", "value", validators.fail_reason(F.col("rule"), F.col("value")).alias("fail_reason"))


@query("validate_date6", oracle.seeded(f"select doc_id, substr(idno, 1, 6) as d6, coalesce({oracle.born('idno')} <= {oracle.AS_OF}, false) as valid from seed", False))
def validate_date6(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.substring("idno", 1, 6).alias("d6"), validators.is_date6(F.substring("idno", 1, 6)).alias("valid"))


@query("validate_luhn", oracle.seeded(f"select doc_id, card, {oracle.luhn('card')} as valid from seed", False))
def validate_luhn(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "card", validators.is_luhn(F.col("card")).alias("valid"))


@query("validate_email", oracle.seeded("select doc_id, regexp_full_match(mail, '" + oracle.PLAIN["email"] + "') as whole, regexp_full_match(concat(mail, '.'), '" + oracle.PLAIN["email"] + "') as dotted from seed", False))
def validate_email(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", validators.is_email(F.col("mail")).alias("whole"), validators.is_email(F.concat("mail", F.lit("."))).alias("dotted"))


@query("checksums", oracle.seeded(f"select doc_id, {oracle.check(oracle.digits('idno'))} = cast(substr({oracle.digits('idno')}, 13, 1) as int) as rrn, ({oracle.check(oracle.digits('idno'))} + 2) % 10 = cast(substr({oracle.digits('idno')}, 13, 1) as int) as fgn from seed", False))
def checksums(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", validators.is_rrn_checksum(F.col("idno")).alias("rrn"), validators.is_fgn_checksum(F.col("idno")).alias("fgn"))


# --- masks and policies -------------------------------------------------------------------------------------------------

_ALNUM = "'[\\p{L}\\p{N}._]', '*', 'g'"


def _char_fold(v: str, masked: str) -> str:
    """SQL: digits of v for which the condition on r (rank), p (place from 0) and n (digits) holds become asterisks."""
    digit = f"regexp_matches(substr({v}, p, 1), '[0-9]')"
    rank = f"length(regexp_replace(substr({v}, 1, p), '[^0-9]', '', 'g'))"
    total = f"length(regexp_replace({v}, '[^0-9]', '', 'g'))"
    cond = masked.replace("#r", rank).replace("#p", "(p - 1)").replace("#n", total)
    return f"array_to_string([case when {digit} and {cond} then '*' else substr({v}, p, 1) end for p in range(1, length({v}) + 1)], '')"


_GROUP = "length(regexp_extract({v}, '^[^0-9]*[0-9]+'))"
_PLAIN_CUT = "case when regexp_full_match({v}, '[0-9]+') and substr({v}, 1, 2) = '02' then 2 when regexp_full_match({v}, '[0-9]+') and substr({v}, 1, 1) = '0' then 3 else " + _GROUP + " end"
_NAME = "case when regexp_matches({v}, '[가-힣]') then concat(regexp_extract({v}, '^[^가-힣]*[가-힣]'), regexp_replace(substr({v}, length(regexp_extract({v}, '^[^가-힣]*[가-힣]')) + 1), '[가-힣]', '*', 'g')) else {v} end"
MASK_SQL = {
    "keep_rules": (masks.keep_rules, "card_text", f"regexp_replace(card_text, {_ALNUM})"),
    "email": (masks.email, "mail", f"regexp_replace(mail, {_ALNUM})"),
    "doc_email": (masks.document_email, "mail", "regexp_replace(mail, '[^@-]', '*', 'g')"),
    "except_hyphen": (masks.except_hyphen, "licence", "regexp_replace(licence, '[^-]', '*', 'g')"),
    "birth6": (masks.first_digits, "idno", _char_fold("idno", "#r > 6")),
    "last_n": (masks.last_digits, "card_text", _char_fold("card_text", "#r <= #n - 4")),
    "phone_group": (masks.phone_group, "city", _char_fold("city", f"#p >= {_GROUP.format(v='city')}")),
    "phone_plain": (masks.phone_plain, "mobile", _char_fold("mobile", f"#p >= {_PLAIN_CUT.format(v='mobile')}")),
    "card_4_4": (masks.card_ends, "card_text", _char_fold("card_text", "#n > 8 and #r > 4 and #r <= #n - 4")),
    "name_first": (masks.name_first, "person", _NAME.format(v="person")),
}
for _name, (_mask, _column, _sql) in MASK_SQL.items():

    def _masked(spark, sf_dir, mask=_mask, column=_column):
        return corpus(spark, sf_dir).select("doc_id", F.col(column).alias("value"), mask(F.col(column)).alias("masked"))

    query(f"mask_{_name}", oracle.seeded(f"select doc_id, {_column} as value, {_sql} as masked from seed", False))(_masked)


@query("mask_entities", "select p_partkey, array_to_string([case when regexp_matches(x, '^&') then x else regexp_replace(x, " + _ALNUM + ") end for x in regexp_extract_all(concat(p_name, '&amp;', p_brand, '&#39;x& y'), '&(?:#[0-9]+|[a-z]+);|[^&]+|&')], '') as masked from part")
def mask_entities(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", masks.keep_rules(F.concat("p_name", F.lit("&amp;"), "p_brand", F.lit("&#39;x& y"))).alias("masked"))


POLICY = {"ps": "keep_first_char", "rrn": "keep_birth6", "fgn": "keep_birth6", "phone": "keep_first_group", "card": "keep_first4_last4"}


def _policy_sql(phone: str, fallback: str, email: str, card: str) -> str:
    return f"""case rule when 'email' then {email} when 'rrn' then {_char_fold('value', '#r > 6')} when 'fgn' then {_char_fold('value', '#r > 6')}
        when 'phone_mobile' then {phone} when 'phone_city' then {phone} when 'card' then {card} else {fallback} end"""


_CARD = _char_fold("value", "#n > 8 and #r > 4 and #r <= #n - 4")
_TEXT_POLICY = _policy_sql(_char_fold("value", f"#p >= {_GROUP.format(v='value')}"), f"regexp_replace(value, {_ALNUM})", f"regexp_replace(value, {_ALNUM})", _CARD)
_BINARY_POLICY = _policy_sql(_char_fold("value", f"#p >= {_PLAIN_CUT.format(v='value')}"), "null", "null", _CARD)


@query("policy_text", oracle.seeded(f"select doc_id, rule, s, value, {_TEXT_POLICY} as masked from cand where valid"))
def policy_text(spark, sf_dir):
    rows = span_rows(seeded(spark, sf_dir)).where("valid")
    return rows.select("doc_id", "rule", "s", "value", masks.text_policy(F.col("rule"), F.col("value"), POLICY).alias("masked"))


@query("policy_ole", oracle.seeded(f"select doc_id, rule, s, value, {_BINARY_POLICY} as masked, coalesce({_BINARY_POLICY}, regexp_replace(value, '[^-]', '*', 'g')) as written from cand where valid"))
def policy_ole(spark, sf_dir):
    rows = span_rows(seeded(spark, sf_dir)).where("valid")
    return rows.select("doc_id", "rule", "s", "value", masks.binary_policy(F.col("rule"), F.col("value"), POLICY).alias("masked"), masks.binary_mask(F.col("rule"), F.col("value"), POLICY).alias("written"))


@query("policy_pdf", oracle.seeded(f"select doc_id, rule, s, array_to_string([p - 1 for p in range(1, length(value) + 1) if m is null or m = value or substr(m, p, 1) <> substr(value, p, 1)], ',') as covered from (select doc_id, rule, s, value, {_BINARY_POLICY} as m from cand where valid)"))
def policy_pdf(spark, sf_dir):
    rows = span_rows(seeded(spark, sf_dir)).where("valid")
    return rows.select("doc_id", "rule", "s", F.array_join(masks.masked_places(F.col("rule"), F.col("value"), POLICY).cast("array<string>"), ",").alias("covered"))


@query("replace_text_guard", oracle.seeded("select doc_id, case when length(card) = 16 then regexp_replace(card, '[0-9]', '*', 'g') end as replace_text from seed", False))
def replace_text_guard(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", masks.same_length(F.col("card"), F.regexp_replace(F.rpad("card", 16, "0"), "[0-9]", "*")).alias("replace_text"))
