"""Queries over reports, span algebra, entities, geometry, tables and text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkveil.functions import masks, text
from inkveil.operators import chunks, entities, geometry, report, spans, tables
from inkveil.plans import oracle
from inkveil.plans.queries import _ALNUM, POLICY, SQL, _char_fold, query, read, seeded, span_rows
from inkveil.plans.seed import corpus
from inkveil.session import spread

# --- reports --------------------------------------------------------------------------------------------------------------


def _rows(spark, sf_dir):
    return span_rows(seeded(spark, sf_dir))


_KIND = "case " + " ".join(f"when rule like '%{p}%' then '{k}'" for p, k in report.KINDS) + " else 'other' end"
_LABEL = "case when rule = 'rrn' then '주민등록번호' when rule = 'fgn' then '외국인등록번호' when rule = 'card' then '카드번호' when rule = 'email' then '이메일' when rule = 'passport' then '여권번호' when rule = 'driver_license' then '운전면허번호' when rule like 'phone%' then '전화번호' end"


@query("counts_all", oracle.seeded("select rule, count(*) as n, count(*) filter (where valid) as n_ok, count(*) filter (where not valid) as n_fail from kept group by rule"))
def counts_all(spark, sf_dir):
    return report.rule_counts(_rows(spark, sf_dir))


@query("counts_valid", oracle.seeded("select rule, count(*) as n from kept where valid group by rule"))
def counts_valid(spark, sf_dir):
    return _rows(spark, sf_dir).where("valid").groupBy("rule").agg(F.count("*").alias("n"))


@query("by_kind", oracle.seeded(f"select {_KIND} as kind, {_LABEL} as label, count(*) as n, count(*) filter (where valid) as n_ok from kept group by 1, 2"))
def by_kind(spark, sf_dir):
    return report.kind_counts(_rows(spark, sf_dir))


@query("fail_reason_counts", oracle.seeded(f"select concat({_KIND}, ': ', reason) as reason, count(*) as n from kept where not valid group by 1"))
def fail_reason_counts(spark, sf_dir):
    return report.reason_counts(_rows(spark, sf_dir))


@query("report_totals", oracle.seeded("select count(*) as n, count(*) filter (where valid) as n_ok, count(*) filter (where not valid) as n_fail from kept"))
def report_totals(spark, sf_dir):
    return report.totals(_rows(spark, sf_dir))


_ISLANDS = """steps as (select *, case when s <= max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from {source}),
    isles as (select doc_id, min(s) as s, max(e) as e, count(*) as n_spans from (select *, sum(new) over (partition by doc_id order by s, e rows unbounded preceding) as isle from steps) group by doc_id, isle)"""


@query("span_union_islands", oracle.seeded("select doc_id, s, e, n_spans from isles").replace("\nselect", ", " + _ISLANDS.format(source="cand") + "\nselect"))
def span_union_islands(spark, sf_dir):
    rows = span_rows(spans.annotated(corpus(spark, sf_dir)), column="spans")
    return spans.union_ranges(rows.select("doc_id", "s", "e"), ["doc_id"], "s", "e")


@query("exposure_ratio", oracle.seeded("""select t.doc_id, coalesce(length(text), 0) as total_chars, coalesce(sum(least(e, length(text)) - s), 0)::bigint as exposed_chars,
    round(case when coalesce(length(text), 0) = 0 then 0.0 else coalesce(sum(least(e, length(text)) - s), 0) * 100.0 / length(text) end, 6) as exposure from seed t left join isles i on t.doc_id = i.doc_id group by t.doc_id, text""").replace("\nselect", ", " + _ISLANDS.format(source="(select * from kept where valid)") + "\nselect", 1))
def exposure_ratio(spark, sf_dir):
    return report.exposure_of(seeded(spark, sf_dir), ["doc_id"])


@query("exposure_by_rows", SQL["exposure_ratio"])
def exposure_by_rows(spark, sf_dir):
    return report.exposure(corpus(spark, sf_dir), span_rows(seeded(spark, sf_dir)))


@query("overlap_rate", oracle.seeded("select doc_id, sum(n_spans)::bigint as n_raw, count(*) as n_merged, round((sum(n_spans) - count(*)) * 100.0 / sum(n_spans), 6) as overlap_rate from isles group by doc_id").replace("\nselect", ", " + _ISLANDS.format(source="cand") + "\nselect"))
def overlap_rate(spark, sf_dir):
    return report.overlap_rate(span_rows(spans.annotated(corpus(spark, sf_dir)), column="spans"))


@query("detect_report", oracle.seeded("select count(*) filter (where valid) as regex, 0::bigint as ner, count(*) filter (where valid) as final from kept"))
def detect_report(spark, sf_dir):
    return _rows(spark, sf_dir).agg(F.count_if("valid").alias("regex"), F.lit(0).cast("long").alias("ner"), F.count_if(F.col("valid") & spans.is_final(F.col("rule"), F.col("value"))).alias("final"))


@query("rollup_report", oracle.seeded("select rule, valid, count(*) as n from kept group by rollup (rule, valid)"))
def rollup_report(spark, sf_dir):
    return _rows(spark, sf_dir).rollup("rule", "valid").agg(F.count("*").alias("n"))


# --- redaction ------------------------------------------------------------------------------------------------------------


def _blanket_sql(text: str) -> str:
    """Rule by rule in the order of priority; where a rule looks at the digits around, these are kept, and it runs twice, as a
    match takes the character behind it."""
    for rule in ("card", "email", "rrn", "fgn", "phone_mobile", "phone_city", "driver_license", "passport"):
        if rule in oracle.PLAIN:
            text = f"regexp_replace({text}, '(?i){oracle.PLAIN[rule]}', '***', 'g')"
        else:
            for _ in range(2):
                text = f"regexp_replace({text}, '(^|[^0-9])(?:{oracle.GUARDED[rule][0]})([^0-9]|$)', '\\1***\\2', 'g')"
    return text


@query("redact_blanket", oracle.seeded(f"select doc_id, {_blanket_sql('text')} as redacted from seed", False))
def redact_blanket(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", spans.blanket(F.col("text")).alias("redacted"))


_FREE = "(select * from cand a where valid and not exists (select 1 from cand f where f.doc_id = a.doc_id and not f.valid and f.s < a.e and a.s < f.e))"
# spans may overlap: a character is masked by the one furthest left that covers it, which is written last
_REDACT = f"""select t.doc_id, coalesce(string_agg(case when m.value is null then ch when regexp_matches(ch, '[\\p{{L}}\\p{{N}}._]') then '*' else ch end, '' order by p), '') as redacted, max(hits)::int as hits from
    (select doc_id, text, case when text is null then 0 else p end as p, coalesce(substr(text, p, 1), '') as ch, (select count(*) from free x where x.doc_id = seed.doc_id) as hits from seed, (select unnest(range(1, 401)) as p) where p <= greatest(coalesce(length(text), 0), 1)) t
    left join (select distinct doc_id, unnest(range(s + 1, e + 1)) as q, '' as value from free) m on m.doc_id = t.doc_id and m.q = t.p group by t.doc_id"""


@query("redact_text", oracle.seeded(_REDACT).replace("\nselect", f", free as materialized (select * from {_FREE})\nselect", 1))
def redact_text(spark, sf_dir):
    return spans.redact(corpus(spark, sf_dir).select("doc_id", "text")).select("doc_id", "redacted", "hits")


@query("redact_literals", oracle.seeded("select doc_id, replace(replace(text, mail, regexp_replace(mail, " + _ALNUM + ")), idno, regexp_replace(idno, " + _ALNUM + ")) as redacted from seed where text is not null", False))
def redact_literals(spark, sf_dir):
    df = corpus(spark, sf_dir).where("text is not null")
    return df.select("doc_id", spans.replace_literals(F.col("text"), F.array("mail", "idno", "mail"), masks.keep_rules).alias("redacted"))


@query("redact_xml_nodes", "select page_id, array_to_string([case when regexp_full_match(x, '<[^<>]*>') then x else regexp_replace(x, '[0-9]', '*', 'g') end for x in regexp_extract_all(concat('<p>', replace(replace(url, '<', ''), '>', ''), '</p><b>12</b>'), '<[^<>]*>|[^<>]+')], '') as redacted from pages")
def redact_xml_nodes(spark, sf_dir):
    xml = F.concat(F.lit("<p>"), F.translate("url", "<>", ""), F.lit("</p><b>12</b>"))
    return read(spark, sf_dir, "pages").select("page_id", spans.xml_nodes(xml, lambda g: F.regexp_replace(g, "[0-9]", "*")).alias("redacted"))


@query("partial_subspans", oracle.seeded(f"""select doc_id, rule, s + min(p) - 1 as s, s + max(p) as e from (
    select doc_id, rule, s, value, p, p - row_number() over (partition by doc_id, rule, s order by p) as run from (
    select doc_id, rule, s, value, unnest(range(1, length(value) + 1)) as p from cand where valid and rule in ('rrn', 'card')) where case rule when 'rrn' then length(regexp_replace(substr(value, 1, p), '[^0-9]', '', 'g')) > 6
    else length(regexp_replace(substr(value, 1, p), '[^0-9]', '', 'g')) > 4 and length(regexp_replace(substr(value, 1, p), '[^0-9]', '', 'g')) <= length(regexp_replace(value, '[^0-9]', '', 'g')) - 4 end and regexp_matches(substr(value, p, 1), '[0-9]')) group by doc_id, rule, s, run"""))
def partial_subspans(spark, sf_dir):
    rows = span_rows(spans.annotated(corpus(spark, sf_dir)), column="spans").where("valid and rule in ('rrn', 'card')")
    return spans.subspans(rows.withColumnRenamed("s", "start"), ["doc_id"], POLICY).select("doc_id", "rule", F.col("start").alias("s"), F.col("end").alias("e"))


@query("masked_runs", oracle.seeded("select doc_id, s, s + length(v) as e from (select doc_id, v[i] as v, list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in v[1:i-1]]), 0) as s from (select doc_id, v, g, unnest(range(1, len(v) + 1)) as i from (select doc_id, regexp_extract_all(m, '\\*+') as v, string_split_regex(m, '\\*+') as g from (select doc_id, " + _char_fold("card_text", "#n > 8 and #r > 4 and #r <= #n - 4") + " as m from seed))))", False))
def masked_runs(spark, sf_dir):
    df = corpus(spark, sf_dir).withColumn("m", masks.card_ends(F.col("card_text")))
    return df.select("doc_id", F.inline(spans.masked_runs(F.col("m")))).select("doc_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))


@query("exclude_spans", oracle.seeded("select doc_id, mode, count(*) as n from (select doc_id, unnest(['valid', 'email_like', 'email_rule']) as mode, valid, value, rule from cand) where valid or (mode = 'email_like' and value like '%@%.%') or (mode = 'email_rule' and rule = 'email') group by all"))
def exclude_spans(spark, sf_dir):
    df = spans.annotated(corpus(spark, sf_dir))
    each = [df.select("doc_id", F.lit(mode).alias("mode"), F.explode(spans.exclusions(F.col("spans"), mode))) for mode in spans.EXCLUDE]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("doc_id", "mode").agg(F.count("*").alias("n"))


@query("blank_ranges", oracle.seeded("select doc_id, concat(regexp_replace(substr(text, 1, 10), '[^\\n]', ' ', 'g'), substr(text, 11, 5), regexp_replace(substr(text, 16), '[^\\n]', ' ', 'g')) as blanked from seed where text is not null", False))
def blank_ranges(spark, sf_dir):
    r = F.array(F.struct(F.lit(0).alias("start"), F.lit(10).alias("end")), F.struct(F.lit(15).alias("start"), F.length("text").alias("end")))
    return corpus(spark, sf_dir).where("text is not null").select("doc_id", spans.blank_ranges(F.col("text"), r).alias("blanked"))


@query("split_blank_lines", oracle.seeded("""select doc_id, s, s + length(value) as e, value from (select doc_id, v[i] as value, (coalesce(list_sum([length(x) + 2 for x in v[1:i-1]]), 0))::int as s, len(v) as n
    from (select doc_id, v, unnest(range(1, len(v) + 1)) as i from (select doc_id, string_split_regex(text, '[\\r\\n]{2,}') as v from seed where text is not null))) where n = 1 or trim(value) <> ''""", False))
def split_blank_lines(spark, sf_dir):
    df = corpus(spark, sf_dir).where("text is not null").select("doc_id", F.lit(0).alias("start"), F.col("text").alias("value"))
    return spans.split_at_blank_lines(df, ["doc_id"]).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "value")


@query("clip_no_overlap", oracle.seeded("""select doc_id, rule, greatest(s, coalesce(before, 0)) as s, e from (select *, max(e) over (partition by doc_id order by s, e desc, prio desc, rule rows between unbounded preceding and 1 preceding) as before from cand) where e > greatest(s, coalesce(before, 0))"""))
def clip_no_overlap(spark, sf_dir):
    df = spans.annotated(corpus(spark, sf_dir)).withColumn("c", spans.clip(F.col("spans"), F.length(F.coalesce("text", F.lit("")))))
    return span_rows(df, column="c").select("doc_id", "rule", "s", "e")


@query("distinct_literals", oracle.seeded("select doc_id, value, row_number() over (partition by doc_id order by length(value) desc, value) as place from (select distinct doc_id, value from cand)"))
def distinct_literals(spark, sf_dir):
    df = spans.annotated(corpus(spark, sf_dir)).withColumn("v", spans.literals(F.transform("spans", lambda x: x["value"])))
    return df.select("doc_id", F.posexplode("v").alias("place", "value")).withColumn("place", (F.col("place") + 1).cast("long"))


@query("final_span_filter", oracle.seeded("select doc_id, x as value from (select doc_id, unnest(['  ', '--', '서울', '서울시 강남구', person, card_text]) as x from seed) where trim(x) <> '' and not regexp_full_match(trim(x), '[^\\p{L}\\p{N}_]+') and length(trim(x)) >= 5", False))
def final_span_filter(spark, sf_dir):
    values = F.array(F.lit("  "), F.lit("--"), F.lit("서울"), F.lit("서울시 강남구"), "person", "card_text")
    return corpus(spark, sf_dir).select("doc_id", F.explode(values).alias("value")).where(spans.is_final(F.lit("lc"), F.col("value")))


@query("label_filter", oracle.seeded("select doc_id, rule, count(*) as n from kept where rule in ('email', 'card') and valid group by all"))
def label_filter(spark, sf_dir):
    return span_rows(seeded(spark, sf_dir, rules=None)).where(F.lower("rule").isin("email", "card") & F.col("valid")).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("span_to_page", oracle.seeded("select doc_id, rule, s, s // 40 as page from kept"))
def span_to_page(spark, sf_dir):
    n = F.length(F.coalesce("text", F.lit("")))
    pages = corpus(spark, sf_dir).select("doc_id", F.posexplode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(40))).alias("page", "first"))
    return chunks.page_of(_rows(spark, sf_dir).withColumnRenamed("s", "start"), pages, ["doc_id"]).select("doc_id", "rule", F.col("start").alias("s"), "page")


@query("needle_to_page", oracle.seeded("""select doc_id, needle, min(case when instr(part, needle) > 0 then page end) as page_whole, coalesce(min(case when instr(part, needle) > 0 then page end), min(case when instr(regexp_replace(part, '\\s+', '', 'g'), regexp_replace(needle, '\\s+', '', 'g')) > 0 then page end)) as page
    from (select doc_id, unnest([licence, concat('; t', 'el'), concat(mail, ' ; id'), 'nowhere']) as needle, page, substr(text, page * 60 + 1, 60) as part from (select *, unnest(range(0, (length(text) - 1) // 60 + 1)) as page from seed where text is not null)) group by doc_id, needle""", False))
def needle_to_page(spark, sf_dir):
    df = corpus(spark, sf_dir).where("text is not null")
    pages = df.select("doc_id", F.explode(F.sequence(F.lit(0), ((F.length("text") - 1) / 60).cast("int"))).alias("page"), "text").withColumn("text", F.substring("text", F.col("page") * 60 + 1, F.lit(60)))
    wanted = df.select("doc_id", F.explode(F.array("licence", F.lit("; tel"), F.concat("mail", F.lit(" ; id")), F.lit("nowhere"))).alias("needle"))
    out = chunks.needle_page(wanted, pages, ["doc_id"])
    whole = out.join(pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("_p")), "doc_id").withColumn("page_whole", F.get(F.filter("_p", lambda p: F.contains(p["text"], F.col("needle"))), F.lit(0))["page"])
    return whole.select("doc_id", "needle", F.col("page_whole").cast("long").alias("page_whole"), F.col("page").cast("long").alias("page"))


# --- text -------------------------------------------------------------------------------------------------------------------


@query("digits_only", "select doc_id, regexp_replace(text, '[^0-9]', '', 'g') as digits from documents")
def digits_only(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.digits_only(F.col("text")).alias("digits"))


_INVISIBLE = "concat(c_name, chr(8203), ' ', chr(160), c_mktsegment, chr(8239), chr(65279), '--', chr(8211), chr(9), 'x  ', chr(13), chr(10), chr(13), 'y')"


@query("strip_invisible", f"select c_custkey, replace(replace(replace(replace({_INVISIBLE}, chr(8203), ''), chr(65279), ''), chr(160), ' '), chr(8239), ' ') as t from customer")
def strip_invisible(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.strip_invisible(F.expr(_INVISIBLE.replace("chr(8203)", "'​'").replace("chr(160)", "' '").replace("chr(8239)", "' '").replace("chr(65279)", "'﻿'").replace("chr(8211)", "'–'"))).alias("t"))


@query("cleanup_text", r"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(concat(text, chr(13), chr(10), chr(10), chr(10), '  x ', chr(9), ' y  ', chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g') as t from documents")
def cleanup_text(spark, sf_dir):
    t = F.concat("text", F.lit("\r\n\n\n  x \t y  \n"))
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.cleanup_text(t).alias("t"))


@query("normalize_basic", r"select doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(concat(text, chr(13), chr(10), 'a', chr(9), 'b—c  ', chr(13), 'd'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '—', '-'), chr(9), ' '), '[ \f\x0B]+', ' ', 'g'), '(?m)[ ]+$', '', 'g') as t from documents")
def normalize_basic(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize(F.concat("text", F.lit("\r\na\tb—c  \rd"))).alias("t"))


@query("ocr_char_map", "select c_custkey, concat('@.,.', '/', c_name) as t from customer")
def ocr_char_map(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.ocr_normalize(F.concat(F.lit("＠。，·／"), "c_name")).alias("t"))


@query("mask_md_noise", "select doc_id, translate(text, '|`*_#><', '       ') as t from documents")
def mask_md_noise(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.markdown_noise(F.col("text")).alias("t"))


@query("mask_md_tables", r"select doc_id, array_to_string([case when regexp_full_match(x, '\s*\|.*\|\s*') then repeat(' ', length(x)) else x end for x in string_split(concat('| a | b |', chr(10), text, chr(10), '  |--|'), chr(10))], chr(10)) as t from documents")
def mask_md_tables(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.blank_tables(F.concat(F.lit("| a | b |\n"), "text", F.lit("\n  |--|"))).alias("t"))


@query("escape_html", "select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as t from pages")
def escape_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("html")).alias("t"))


@query("truncate_text", "select doc_id, case when length(text) > 100 then concat(substr(text, 1, 100), chr(10), '...(truncated)') else text end as t from documents")
def truncate_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 100).alias("t"))


@query("match_key", r"select p_partkey, regexp_replace(lower(concat(p_name, ' - ', p_brand, '.')), '[\s[:punct:]]+', '', 'g') as t from part")
def match_key(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.match_key(F.concat("p_name", F.lit(" - "), "p_brand", F.lit("."))).alias("t"))


@query("data_uri", "select doc_id, concat('data:text/plain;base64,', to_base64(encode(text))) as uri from documents")
def data_uri(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(text.data_uri(F.lit("text/plain"), F.col("text").cast("binary")), "[\r\n]", "").alias("uri"))


@query("emailish", oracle.seeded("select doc_id, mail, regexp_full_match(mail, '.*@[^@]*\\.[^@]*') as a, false as b from seed", False))
def emailish(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "mail", text.is_emailish(F.col("mail")).alias("a"), text.is_emailish(F.replace("mail", F.lit("@"), F.lit(""))).alias("b"))


@query("compact_digits", oracle.seeded("select doc_id, regexp_replace(card_text, '[^0-9]', '', 'g') as kept, [p - 1 for p in range(1, length(card_text) + 1) if regexp_matches(substr(card_text, p, 1), '[0-9]')][5]::int as fifth from seed", False))
def compact_digits(spark, sf_dir):
    kept, places = text.compact(F.col("card_text"), "[0-9]")
    return corpus(spark, sf_dir).select("doc_id", kept.alias("kept"), F.get(places, F.lit(4)).alias("fifth"))


# --- tables -----------------------------------------------------------------------------------------------------------------


@query("a1_reference", "select p_partkey, p_size as r, p_partkey % 700 + 1 as c from part")
def a1_reference(spark, sf_dir):
    ref = F.expr("concat(case when p_partkey % 700 >= 26 then char(64 + cast((p_partkey % 700) div 26 as int)) else '' end, char(65 + cast((p_partkey % 700) % 26 as int)), cast(p_size as string))")
    r, c = tables.cell_reference(ref)
    return read(spark, sf_dir, "part").select("p_partkey", r.alias("r"), c.cast("long").alias("c"))


_CELLS = "select l_orderkey as sheet, l_linenumber as row, (l_partkey % 4 + 1)::int as col, cast(max(l_suppkey) as varchar) as value from lineitem group by all"
_GRID = f"""cells as materialized ({_CELLS}), size as (select sheet, max(row) as r, max(col) as c from cells group by sheet),
    full_cells as (select s.sheet, row, col, r, c from (select *, unnest(range(1, r + 1)) as row from size) s, (select unnest(range(1, 5)) as col) where col <= c),
    grid as (select f.sheet, f.row, string_agg(coalesce(value, ''), '|' order by f.col) as line, string_agg(concat('<td>', coalesce(value, ''), '</td>'), '' order by f.col) as html from full_cells f left join cells x on x.sheet = f.sheet and x.row = f.row and x.col = f.col group by f.sheet, f.row)"""


def _cells(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return df.groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 4 + 1).cast("int").alias("col")).agg(F.max("l_suppkey").cast("string").alias("value"))


@query("grid_dense", f"with {_GRID} select sheet, row, line from grid")
def grid_dense(spark, sf_dir):
    return tables.dense(_cells(spark, sf_dir), ["sheet"]).select("sheet", "row", F.array_join("values", "|").alias("line"))


@query("html_table", f"with {_GRID} select sheet, concat('<table>', string_agg(concat('<tr>', html, '</tr>'), '' order by row), '</table>') as html from grid group by sheet")
def html_table(spark, sf_dir):
    return tables.html_table(tables.dense(_cells(spark, sf_dir), ["sheet"]), ["sheet"])


@query("clean_chart_text", r"select p_partkey, concat(p_name, chr(10), p_brand, chr(10), chr(10), ' 12') as t from part")
def clean_chart_text(spark, sf_dir):
    raw = F.concat(F.lit("<c:v>"), "p_name", F.lit("</c:v>\n\n"), "p_brand", F.lit("\nSheet1!$A$1:$B$2\nGeneral 12\n a > b"))
    return read(spark, sf_dir, "part").select("p_partkey", text.clean_extracted(raw).alias("t"))


@query("drop_noise_lines", "select p_partkey, concat(p_name, chr(10), p_brand) as t from part")
def drop_noise_lines(spark, sf_dir):
    raw = F.concat("p_name", F.lit("\n마스터 텍스트 스타일을 편집합니다\n둘째 수준\n•\n\n‹#›\n  "), "p_brand", F.lit("  "))
    return read(spark, sf_dir, "part").select("p_partkey", text.drop_noise_lines(raw).alias("t"))


# --- words and boxes --------------------------------------------------------------------------------------------------------

_WORDS = "select l_orderkey as page, l_linenumber as id, (l_partkey % 500)::double as x0, (l_suppkey % 7 * 12)::double as y0, (l_partkey % 500 + 40)::double as x1, (l_suppkey % 7 * 12 + 10)::double as y1, concat('w', cast(l_linenumber as varchar)) as text from lineitem"


def _words(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "l_linenumber as id", "double(l_partkey % 500) as x0", "double(l_suppkey % 7 * 12) as y0", "double(l_partkey % 500 + 40) as x1", "double(l_suppkey % 7 * 12 + 10) as y1", "concat('w', cast(l_linenumber as string)) as text")


@query("row_grouping", f"""select page, id, sum(new) over (partition by page order by y0, x0, id rows unbounded preceding)::bigint as row from (
    select *, case when y0 - lag(y0) over (partition by page order by y0, x0, id) <= 14 then 0 else 1 end as new from ({_WORDS}))""")
def row_grouping(spark, sf_dir):
    return geometry.group_rows(_words(spark, sf_dir), ["page"], 14.0).select("page", "id", F.col("row").cast("long").alias("row"))


@query("page_text", f"""select page, string_agg(line, chr(10) order by row) as text from (select page, row, string_agg(text, ' ' order by x0, y0, id) as line from (
    select *, sum(new) over (partition by page order by y0, x0, id rows unbounded preceding) as row from (select *, case when y0 - lag(y0) over (partition by page order by y0, x0, id) <= 8 then 0 else 1 end as new from ({_WORDS}))) group by page, row) group by page""")
def page_text(spark, sf_dir):
    words = _words(spark, sf_dir).withColumn("x0", F.col("x0") + F.col("id") / 1000)
    return geometry.page_text(words, ["page"])


@query("bbox_slice", "select p_partkey, round(10 + 90 * ((2 * 0.68) / (2 * 0.68 + 0.28 + 3 * 0.62)), 6) as x0, round(10.0 + 90, 6) as x1 from part")
def bbox_slice(spark, sf_dir):
    a, b = geometry.slice_box(F.lit("ab-123"), F.lit(2), F.lit(99), F.lit(10.0), F.lit(100.0))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(a, 6).alias("x0"), F.round(b, 6).alias("x1"))


@query("bbox_tighten", "select p_partkey, round(case when w > m then 50 - m / 2 else 50.0 - w / 2 end, 6) as x0, round(case when w > m then 50 + m / 2 else 50.0 + w / 2 end, 6) as x1 from (select p_partkey, p_size * 2.0 as w, greatest(8.0, 10 * 0.55 * length(p_brand) * 0.68) * 1.3 as m from (select p_partkey, p_size, regexp_replace(p_brand, '[^A-Za-z]', '', 'g') as p_brand from part))")
def bbox_tighten(spark, sf_dir):
    half = F.col("p_size").cast("double")
    a, b = geometry.tighten_box(F.regexp_replace("p_brand", "[^A-Za-z]", ""), 50 - half, F.lit(0.0), 50 + half, F.lit(10.0))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(a, 6).alias("x0"), F.round(b, 6).alias("x1"))


@query("px_to_page", f"select page, id, round(greatest(10.0, 10 + x0 * 0.5 - 2), 6) as x0, round(least(260.0, 10 + x1 * 0.5 + 2), 6) as x1 from ({_WORDS})")
def px_to_page(spark, sf_dir):
    out = geometry.pixels_to_page(_words(spark, sf_dir), F.lit(500.0), F.lit(100.0), (F.lit(10.0), F.lit(0.0), F.lit(260.0), F.lit(50.0)), 2.0)
    return out.select("page", "id", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query("text_layer_antijoin", f"with w as materialized ({_WORDS}) select page, id from w b where id > 3 and not exists (select 1 from w t where t.page = b.page and t.id <= 3 and b.x0 < t.x1 and t.x0 < b.x1 and b.y0 < t.y1 and t.y0 < b.y1)")
def text_layer_antijoin(spark, sf_dir):
    w = _words(spark, sf_dir)
    return geometry.beside_text(w.where("id > 3"), w.where("id <= 3"), ["page"]).select("page", "id")


@query("char_boxes_merge", f"""select page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n_chars from (select *, sum(new) over (partition by page order by id rows unbounded preceding) as run from (
    select *, case when abs(y0 - lag(y0) over o) <= 1.2 and x0 - lag(x1) over o <= 0.9 then 0 else 1 end as new from ({_WORDS}) window o as (partition by page order by id))) group by page, run""".replace(f"({_WORDS})", f"(select page, id, max(x0) as x0, max(x1) as x1, max(y0) as y0, max(y1) as y1 from ({_WORDS}) group by page, id)"))
def char_boxes_merge(spark, sf_dir):
    once = _words(spark, sf_dir).groupBy("page", F.col("id").alias("pos")).agg(*[F.max(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return geometry.char_boxes(once, ["page"])


@query("bbox_union", f"select page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from ({_WORDS}) group by page")
def bbox_union(spark, sf_dir):
    return geometry.union_box(_words(spark, sf_dir), ["page"])


@query("value_like", "select w, count(*) as n from (select unnest(string_split_regex(text, '\\s+')) as w from documents) where w <> '' and (w like '%@%' or length(regexp_replace(w, '[^0-9]', '', 'g')) >= 2 or ((w like '%-%' or w like '%.%') and regexp_matches(w, '[0-9]')) or (w not like '%-%' and w not like '%.%' and regexp_full_match(w, '\\p{L}{2,4}'))) group by w")
def value_like(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\s]+")).alias("w"))
    return words.where((F.col("w") != "") & geometry.is_value_like(F.col("w"))).groupBy("w").agg(F.count("*").alias("n"))


@query("llm_candidates_topk", "select doc_id, w, place from (select doc_id, w, row_number() over (partition by doc_id order by r desc, w) as place from (select distinct doc_id, w, length(regexp_replace(w, '[^0-9]', '', 'g')) / length(w) as r from (select doc_id, unnest(string_split_regex(text, '\\s+')) as w from documents) where length(w) between 4 and 40 and (length(regexp_replace(w, '[^0-9]', '', 'g')) >= 2 or w like '%@%' or w like '%-%'))) where place <= 40")
def llm_candidates_topk(spark, sf_dir):
    from pyspark.sql.window import Window as W

    n = F.length(F.regexp_replace("w", "[^0-9]", ""))
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[\s]+")).alias("w")).where(F.length("w").between(4, 40) & ((n >= 2) | F.col("w").contains("@") | F.col("w").contains("-"))).distinct()
    place = F.row_number().over(W.partitionBy("doc_id").orderBy((n / F.length("w")).desc(), "w"))
    return words.withColumn("place", place.cast("long")).where("place <= 40")


# --- entities ---------------------------------------------------------------------------------------------------------------

_TOKENS = "select l_orderkey as doc_id, l_linenumber as tok, case l_suppkey % 4 when 0 then 'B-LC' when 1 then 'PS' when 2 then 'LC' else 'O' end as label, (l_linenumber * 6)::int as start, (l_linenumber * 6 + 4 + l_partkey % 3)::int as \"end\", l_discount * 5 as score from lineitem"


def _tokens(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "l_linenumber as tok", "case l_suppkey % 4 when 0 then 'B-LC' when 1 then 'PS' when 2 then 'LC' else 'O' end as label", "int(l_linenumber * 6) as start", "int(l_linenumber * 6 + 4 + l_partkey % 3) as end", "l_discount * 5 as score")


@query("token_spans", f"""select doc_id, label, min(start) as s, max(e) as e, round(avg(score), 9) as score from (
    select *, sum(new) over (partition by doc_id order by tok rows unbounded preceding) as run from (
    select *, case when label = 'O' or label <> coalesce(lag(label) over o, '') or not (start <= coalesce(lag(e) over o, -1) or (label = 'LC' and start - lag(e) over o <= 8)) then 1 else 0 end as new
    from (select doc_id, tok, case when label = 'B-LC' then 'LC' else label end as label, start, "end" as e, score from (select doc_id, tok, max(label) as label, max(start) as start, max("end") as "end", max(score) as score from ({_TOKENS}) group by doc_id, tok)) window o as (partition by doc_id order by tok))) where label <> 'O' group by doc_id, run, label""")
def token_spans(spark, sf_dir):
    t = _tokens(spark, sf_dir).groupBy("doc_id", "tok").agg(*[F.max(c).alias(c) for c in ("label", "start", "end", "score")]).withColumn("text", F.repeat(F.lit(" "), F.lit(80)))
    return entities.token_spans(t, ["doc_id"]).select("doc_id", "label", F.col("start").alias("s"), F.col("end").alias("e"), F.round("score", 9).alias("score"))


@query("entity_merge", f"""with recursive t as materialized (select *, row_number() over (partition by doc_id, label order by start, "end", score) as i from ({_TOKENS})),
    walk as (select doc_id, label, i, 1 as isle, start as s, "end" as e, score from t where i = 1
        union all select t.doc_id, t.label, t.i, case when t.start <= w.e + 2 then w.isle else w.isle + 1 end, case when t.start <= w.e + 2 then w.s else t.start end, case when t.start <= w.e + 2 then greatest(w.e, t."end") else t."end" end,
        case when t.start <= w.e + 2 then (w.score * greatest(1, w.e - w.s) + t.score * greatest(1, t."end" - t.start)) / (greatest(1, w.e - w.s) + greatest(1, t."end" - t.start)) else t.score end
        from walk w join t on t.doc_id = w.doc_id and t.label = w.label and t.i = w.i + 1)
    select doc_id, label, s, e, round(score, 9) as score from (select *, row_number() over (partition by doc_id, label, isle order by i desc) as last from walk) where last = 1""")
def entity_merge(spark, sf_dir):
    lists = _tokens(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("label", "start", "end", "score")).alias("x"))
    merged = lists.select("doc_id", F.inline(entities.merge(F.col("x"), 2)))
    return merged.select("doc_id", "label", F.col("start").alias("s"), F.col("end").alias("e"), F.round("score", 9).alias("score"))


@query("ps_split", oracle.seeded("select doc_id, v as name, 'PS' as label from (select doc_id, unnest(regexp_extract_all(concat(person, ', 12 ', person), '[^\\s,]+')) as v from seed) where not regexp_full_match(v, '[0-9]+')", False))
def ps_split(spark, sf_dir):
    df = corpus(spark, sf_dir).select("doc_id", F.concat("person", F.lit(", 12 "), "person").alias("text")).withColumn("label", F.lit("PS")).withColumn("start", F.lit(0)).withColumn("end", F.length("text")).withColumn("score", F.lit(1.0))
    parts = entities.split_persons(df, ["doc_id", "text"])
    return parts.select("doc_id", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("name"), "label")


@query("lc_paren_merge", "select p_partkey, 'LC' as label, 0 as s, (6 + length(p_brand))::int as e, round((0.5 * 4 + 0.8 * length(p_brand)) / (4 + length(p_brand)), 9) as score from part")
def lc_paren_merge(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Seou("), "p_brand", F.lit(") x")).alias("text"), "p_brand")
    two = df.select("p_partkey", "text", F.inline(F.array(F.struct(F.lit("LC").alias("label"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(0.5).alias("score")), F.struct(F.lit("LC").alias("label"), F.lit(5).alias("start"), (F.length("p_brand") + 5).alias("end"), F.lit(0.8).alias("score")))))
    out = entities.merge_parentheses(two, ["p_partkey"])
    return out.select("p_partkey", "label", F.col("start").alias("s"), F.col("end").alias("e"), F.round("score", 9).alias("score"))


@query("ps_widen", oracle.seeded("select doc_id, 0 as s, 3 as e from seed where person = '김철수' union all select doc_id, 4 as s, 8 as e from seed where person like 'Kim%'", False))
def ps_widen(spark, sf_dir):
    df = corpus(spark, sf_dir).where("person = '김철수' or person like 'Kim%'").select("doc_id", F.col("person").alias("text")).withColumn("label", F.lit("PS"))
    df = df.withColumn("start", F.when(F.col("text").startswith("Kim"), F.lit(5)).otherwise(F.lit(1))).withColumn("end", F.col("start") + 1)
    out = entities.widen_persons(df)
    return out.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))


_GOLD, _PRED = f'select distinct doc_id, label, start, "end" from ({_TOKENS} where l_partkey % 5 <> 0)', f'select distinct doc_id, label, start, "end" from ({_TOKENS} where l_partkey % 7 <> 0)'


@query("ner_metrics", f"""select label, tp, fp, fn, case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0.0 end as "precision", case when tp + fn > 0 then round(tp / (tp + fn), 6) else 0.0 end as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from (
    select label, count(*) filter (where g and p) as tp, count(*) filter (where p and not g) as fp, count(*) filter (where g and not p) as fn from (
    select doc_id, label, start, "end", bool_or(src = 'g') as g, bool_or(src = 'p') as p from (select *, 'g' as src from ({_GOLD}) union all select *, 'p' as src from ({_PRED})) group by all) group by label)""")
def ner_metrics(spark, sf_dir):
    base = read(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_orderkey as doc_id", "case l_suppkey % 4 when 0 then 'B-LC' when 1 then 'PS' when 2 then 'LC' else 'O' end as label", "int(l_linenumber * 6) as start", "int(l_linenumber * 6 + 4 + l_partkey % 3) as end")
    return entities.metrics(base.where("l_partkey % 5 <> 0"), base.where("l_partkey % 7 <> 0"))


@query("regex_priority_merge", oracle.seeded("""select doc_id, label, s, e from walk where kept""").replace("\nselect", """,
    ents as materialized (select doc_id, 'PS' as label, p as s, p + 8 as e, row_number() over (partition by doc_id order by p) as i from
        (select doc_id, unnest(range(0, greatest(coalesce(length(text), 0) - 8, 0) + 1, 5))::int as p from seed) x where not exists (select 1 from cand m where m.doc_id = x.doc_id and m.valid and x.p < m.e and m.s < x.p + 8)),
    walk as (select doc_id, label, i, s, e, true as kept, e as reach from ents where i = 1
        union all select n.doc_id, n.label, n.i, n.s, n.e, n.s >= w.reach, case when n.s >= w.reach then n.e else w.reach end from walk w join ents n on n.doc_id = w.doc_id and n.i = w.i + 1)
select""", 1).replace("with ", "with recursive ", 1))
def regex_priority_merge(spark, sf_dir):
    found = spans.annotated(corpus(spark, sf_dir)).withColumn("m", F.filter("spans", lambda x: x["valid"]))
    own = found.withColumn("ents", F.transform(F.sequence(F.lit(0), F.greatest(F.length(F.coalesce("text", F.lit(""))) - 8, F.lit(0)), F.lit(5)), lambda i: F.struct(F.lit("PS").alias("label"), i.alias("start"), (i + 8).alias("end"), F.lit(1.0).alias("score"))))
    return own.select("doc_id", F.inline(entities.beside_matches(F.col("ents"), F.col("m")))).select("doc_id", "label", F.col("start").alias("s"), F.col("end").alias("e"))
