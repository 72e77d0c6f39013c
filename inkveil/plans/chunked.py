"""Queries over chunks, pages, the viewer and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkveil.operators import chunks, entities, spans
from inkveil.plans import oracle
from inkveil.plans.queries import query, read, span_rows
from inkveil.plans.seed import corpus
from inkveil.sources.packages import xml_text


def _chunk_end(s: str) -> str:
    """SQL: where the chunk that begins at s ends, in a text t of n characters."""
    last = lambda sign: f"list_max([i for i in range(1, 81) if substr(substr(t, {s} + 1421, 80), i, 1) = {sign}])"
    return f"case when {s} + 1500 >= n then n else coalesce({s} + 1420 + {last('chr(10)')}, {s} + 1420 + {last(repr(' '))}, {s} + 1500) end"


@query("chunk_windows", f"""with recursive d as materialized (select doc_id, text as t, length(text) as n from documents where length(text) > 0),
    c as (select doc_id, 0 as chunk, 0 as s, {_chunk_end('0')} as e, t, n from d
        union all select doc_id, chunk, s, {_chunk_end('s')}, t, n from (select doc_id, chunk + 1 as chunk, greatest(s + 1, e - 200) as s, t, n from c where e < n))
    select doc_id, chunk, s::int as start, e::int as "end", substr(t, (s + 1)::int, (e - s)::int) as text from c""")
def chunk_windows(spark, sf_dir):
    return chunks.chunk_windows(read(spark, sf_dir, "documents"), ["doc_id"])


def _page_cut(s: str) -> str:
    """SQL: where the page that begins at s is cut."""
    window = lambda least, sign: f"substr(t, {s} + {least} + 1, {3200 - least} + {len(sign) // 2})"
    last = lambda least, sign: f"case when regexp_matches({window(least, sign)}, '{sign}') then {s} + {least} + length(regexp_extract({window(least, sign)}, '(?s)^(.*){sign}', 1)) end"
    one = chr(92) + "n"
    return f"coalesce({last(600, one * 2)}, {last(300, one)}, {s} + 3200)"


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


@query("page_split", f"""with recursive d as materialized (select doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) as t, length(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) as n from documents),
    c as (select doc_id, 0 as s, case when n > 3200 then {_page_cut('0')} else n end as e, t, n from d
        union all select doc_id, e, case when n - e > 3200 then {_page_cut('e')} else n end, t, n from c where e < n),
    p as (select doc_id, s, t, n, case when e < n then rtrim(substr(t, (s + 1)::int, (e - s)::int), {_WHITE}) else substr(t, (s + 1)::int, (e - s)::int) end as text from c),
    k as (select *, row_number() over (partition by doc_id order by s) as place from p where (n <= 3200 and trim(t, {_WHITE}) <> '') or trim(text, {_WHITE}) <> '')
    select doc_id, (place - 1)::int as page, text from k union all select doc_id, 0, '' from d where trim(t, {_WHITE}) = ''""")
def page_split(spark, sf_dir):
    return chunks.pages(read(spark, sf_dir, "documents"), ["doc_id"])


_ALL = "select doc_id, 'regex' as source, s, e, value, valid from cand union all select doc_id, 'ner' as source, p * 7 as s, p * 7 + 5 as e, substr(text, p * 7 + 1, 5) as value, true as valid from (select *, unnest(range(0, 20)) as p from seed where text is not null)"


@query("viewer_dedup", oracle.seeded(f"""select doc_id, source, s, e, value, valid from (select *, max(e) over (partition by doc_id, source order by s, e desc, value rows between unbounded preceding and 1 preceding) as reach from every d
    where source = 'regex' or not exists (select 1 from every m where m.doc_id = d.doc_id and m.source = 'regex' and m.valid and m.s < d.e and d.s < m.e)) where reach is null or reach < e""").replace("\nselect", f", every as materialized (select distinct on (doc_id, source, s, e, value) * from ({_ALL}) order by valid desc)\nselect", 1))
def viewer_dedup(spark, sf_dir):
    found = span_rows(spans.annotated(corpus(spark, sf_dir)), column="spans").select("doc_id", F.lit("regex").alias("source"), "s", "e", "value", "valid")
    # one of the duplicates of several rules: a valid one if there is any
    found = found.groupBy("doc_id", "source", "s", "e", "value").agg(F.max("valid").alias("valid"))
    own = corpus(spark, sf_dir).where("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("p"))
    own = own.select("doc_id", F.lit("ner").alias("source"), (F.col("p") * 7).alias("s"), (F.col("p") * 7 + 5).alias("e"), F.substring("text", F.col("p") * 7 + 1, F.lit(5)).alias("value"), F.lit(True).alias("valid"))
    return chunks.viewer(found.unionByName(own), ["doc_id"]).select("doc_id", "source", "s", "e", "value", "valid")


@query("xml_encoding", "select p_partkey, case when p_partkey % 3 = 1 then 'ISO-8859-1' else 'UTF-8' end as encoding, concat(case when p_partkey % 3 = 1 then '<?xml encoding=\"ISO-8859-1\"?>' else '' end, p_name) as t from part")
def xml_encoding(spark, sf_dir):
    declared = F.encode(F.concat(F.lit('<?xml encoding="ISO-8859-1"?>'), "p_name"), "ISO-8859-1")
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("p_name", "UTF-8"))
    raw = F.when(F.col("p_partkey") % 3 == 1, declared).when(F.col("p_partkey") % 3 == 2, marked).otherwise(F.encode("p_name", "UTF-8"))
    name, t = xml_text(F.col("raw"))
    return read(spark, sf_dir, "part").withColumn("raw", raw).select("p_partkey", name.alias("encoding"), t.alias("t"))


@query("first_wins_entities", """with recursive t as materialized (select distinct l_orderkey as doc_id, l_linenumber * 4 as s, l_linenumber * 4 + 6 as e from lineitem), n as materialized (select *, row_number() over (partition by doc_id order by s) as i from t),
    walk as (select doc_id, i, s, e, true as kept, e as reach from n where i = 1 union all select n.doc_id, n.i, n.s, n.e, n.s >= w.reach, case when n.s >= w.reach then n.e else w.reach end from walk w join n on n.doc_id = w.doc_id and n.i = w.i + 1)
    select doc_id, s, e from walk where kept""")
def first_wins_entities(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("n"))
    ents = F.transform("n", lambda i: F.struct(F.lit("PS").alias("label"), (i * 4).alias("start"), (i * 4 + 6).alias("end"), F.lit(1.0).alias("score")))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.inline(entities.first_wins(ents))).select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))


@query("rule_selection", oracle.seeded("select rule, count(*) as n from cand where rule in ('card', 'email') group by rule"))
def rule_selection(spark, sf_dir):
    return span_rows(spans.annotated(corpus(spark, sf_dir), rules=["Card", "EMAIL", "none"]), column="spans").groupBy("rule").agg(F.count("*").alias("n"))
