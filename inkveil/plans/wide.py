"""Queries over text maps, targets, recognised blocks, entities by chunks, and packages, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from inkveil.functions import masks, text
from inkveil.operators import chunks, entities, geometry, inference, ocr, report, tables
from inkveil.plans import oracle
from inkveil.plans.more import _WORDS, _words
from inkveil.plans.queries import query, read, seeded, span_rows
from inkveil.plans.seed import corpus
from inkveil.session import spread
from inkveil.sources import packages, pictures, xml

# --- texts and their raw places -------------------------------------------------------------------------------------------

_RAW = "concat(c_name, '  ', chr(9), 'x ', chr(13), chr(10), 'y  ')"


@query("normalize_indexed", "select c_custkey, concat(c_name, ' x', chr(10), 'y') as t, array_to_string(list_concat(range(0, length(c_name) + 1), [length(c_name) + 3, length(c_name) + 5, length(c_name) + 7]), ',') as at from customer")
def normalize_indexed(spark, sf_dir):
    own = read(spark, sf_dir, "customer").select("c_custkey", text.normalize_indexed(F.expr(_RAW)).alias("x"))
    return own.select("c_custkey", F.col("x.text").alias("t"), F.array_join(F.col("x.at").cast("array<string>"), ",").alias("at"))


@query("raw_runs", "select c_custkey, unnest([0, n + 3, n + 5, n + 7])::int as s, unnest([n + 1, n + 4, n + 6, n + 8])::int as e from (select c_custkey, length(c_name) as n from customer)")
def raw_runs(spark, sf_dir):
    own = read(spark, sf_dir, "customer").select("c_custkey", text.normalize_indexed(F.expr(_RAW)).alias("x"))
    return own.select("c_custkey", F.inline(text.raw_runs(F.col("x.at"), F.lit(0), F.length("x.text")))).select("c_custkey", F.col("start").alias("s"), F.col("end").alias("e"))


@query("nearest_raw", "select p_partkey, place, case when place < 1 then 10 when place < 3 then 10 + place else 13 end::int as raw from (select p_partkey, unnest(range(-2, 8)) as place from part)")
def nearest_raw(spark, sf_dir):
    at = F.expr("array(null, 11, null, 13, null)")
    at = F.transform(at, lambda x, i: F.when(i == 0, F.lit(10)).when(i == 2, F.lit(12)).otherwise(x))
    own = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(-2), F.lit(7))).alias("place"))
    return own.select("p_partkey", F.col("place").cast("long").alias("place"), text.nearest_raw(at, F.col("place")).alias("raw"))


@query("clean_hwp", "select p_partkey, concat(p_name, ' a', chr(10), chr(10), p_brand) as t, true as same from part")
def clean_hwp(spark, sf_dir):
    raw = F.concat(F.lit("  "), "p_name", F.lit("漢  \u0001a  \r\n -- \n…\n\r\n\t "), "p_brand", F.lit(" \n*\n"))
    indexed = text.clean_hwp_indexed(raw)
    own = read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), text.clean_hwp(raw).alias("t"), indexed.alias("x"))
    # each character's raw place holds it, or what became it
    back = F.array_join(F.transform("x.at", lambda i: F.substring("raw", i + 1, F.lit(1))), "")
    return own.select("p_partkey", "t", ((F.col("x.text") == F.col("t")) & (F.translate(back, "漢…\r", "  \n") == F.col("t"))).alias("same"))


@query("find_target", "select p_partkey, how, case how when 'none' then null when 'short' then null else length(p_name) + 3 end::int as s, case how when 'none' then null when 'short' then null else length(p_name) + 3 + length(p_brand) end::int as e from part, (select unnest(['as', 'case', 'blanks', 'none', 'short']) as how)")
def find_target(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" - "), "p_brand", F.lit(" !"))
    spaced = F.concat(F.left("p_brand", F.lit(3)), F.lit(" "), F.substring("p_brand", F.lit(4), F.lit(99)))
    of = {"as": F.concat(F.lit(" "), "p_brand"), "case": F.upper("p_brand"), "blanks": spaced, "none": F.lit("zzz"), "short": F.lit("!")}
    rows = F.array(*[F.struct(F.lit(k).alias("how"), v.alias("want")) for k, v in of.items()])
    own = read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), F.inline(rows))
    return own.withColumn("x", text.find_target(F.col("raw"), F.col("want"))).select("p_partkey", "how", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query("markdown_tables", "select p_partkey, concat(p_name, chr(10), chr(10), '| ', p_brand, ' | b\\| |', chr(10), '| --- | --- |', chr(10), '| 1 | 2 |', chr(10), chr(10), 'x|', p_size, chr(10), '```', chr(10), 'a', chr(9), 'b', chr(10), 'c', chr(9), 'd', chr(10), '```') as t from part")
def markdown_tables(spark, sf_dir):
    raw = F.concat("p_name", F.lit("\n"), "p_brand", F.lit("\tb|\n1\t2\nx|"), "p_size", F.lit("\n```\na\tb\nc\td\n```"))
    return read(spark, sf_dir, "part").select("p_partkey", text.tables_to_markdown(raw).alias("t"))


@query("xml_content", "select p_partkey, concat(p_name, 'a<b', p_brand) as t, concat('<table>', chr(10), '<tbody>', chr(10), '<tr>', chr(10), '<td>', p_name, '</td>', chr(10), '<td>a&lt;b</td>', chr(10), '</tr>', chr(10), '<tr>', chr(10), '<td>', p_brand, '</td>', chr(10), '<td></td>', chr(10), '</tr>', chr(10), '</tbody>', chr(10), '</table>') as markdown from part")
def xml_content(spark, sf_dir):
    raw = F.concat(F.lit("<r><table><tr><td>"), "p_name", F.lit("</td><th>a&lt;b</th></tr><tr><td>"), "p_brand", F.lit("</td></tr></table></r>"))
    own = read(spark, sf_dir, "part").select("p_partkey", xml.xml_content(F.encode(raw, "UTF-8")).alias("x"))
    return own.select("p_partkey", F.col("x.text").alias("t"), "x.markdown")


@query("place_needles", oracle.seeded("select doc_id, 0 as needle, instr(text, mail) - 1 as s, instr(text, mail) - 1 + length(mail) as e from seed where text is not null union all select doc_id, 2, instr(text, licence) - 1, instr(text, licence) - 1 + length(licence) from seed where text is not null", False))
def place_needles(spark, sf_dir):
    needle = lambda value, source, label: F.struct(value.alias("value"), F.lit(source).alias("source"), F.lit(label).cast("string").alias("label"), F.lit(True).alias("valid"))
    df = corpus(spark, sf_dir).where("text is not null").select("doc_id", F.concat(F.lit("<p>"), "text").alias("text"), F.array(needle(F.col("mail"), "regex", None), needle(F.substring("mail", 2, 9), "ner", "PS"), needle(F.col("licence"), "regex", None)).alias("needles"))
    # the second one lies within the first, so it has no place of its own
    return chunks.needles(df, ["doc_id"]).select("doc_id", "needle", (F.col("start") - 3).cast("long").alias("s"), (F.col("end") - 3).cast("long").alias("e"))


# --- recognised blocks ------------------------------------------------------------------------------------------------------


@query("line_grouping", f"select page, id, dense_rank() over (partition by page order by y0)::int as line, row_number() over (partition by page, y0 order by x0, id)::int as place from ({_WORDS})")
def line_grouping(spark, sf_dir):
    return ocr.group_lines(_words(spark, sf_dir), ["page"]).select("page", "id", "line", "place")


def _blocks(spark, sf_dir, *parts):
    """Blocks of an image for each customer, ten units wide, on a line."""
    pieces = F.array(*[F.struct(F.lit(k).alias("id"), p.alias("text")) for k, p in enumerate(parts)])
    each = corpus(spark, sf_dir).select("doc_id", F.inline(pieces))
    return each.select("doc_id", "id", "text", (F.col("id") * 10.0).alias("x0"), F.lit(5.0).alias("y0"), (F.col("id") * 10.0 + 9).alias("x1"), F.lit(9.0).alias("y1"))


@query("joined_emails", oracle.seeded("select doc_id, mail as value, 10.0 as x0, 29.0 as x1 from seed", False))
def joined_emails(spark, sf_dir):
    b = _blocks(spark, sf_dir, F.lit("보내는"), F.concat(F.substring_index("mail", "@", 1), F.lit("＠")), F.replace(F.substring_index("mail", "@", -1), F.lit("."), F.lit(" .")))
    return ocr.joined_emails(ocr.group_lines(b, ["doc_id"]), ["doc_id"]).select("doc_id", "value", "x0", "x1")


@query("joined_phones", oracle.seeded(f"select doc_id, mobile as value, 10.0 as x0, 29.0 as x1 from seed where {oracle.valid(repr('phone_mobile'), 'mobile')}", False))
def joined_phones(spark, sf_dir):
    b = _blocks(spark, sf_dir, F.lit("tel:"), F.left("mobile", F.lit(4)), F.substring("mobile", F.lit(5), F.lit(99)), F.lit("끝"))
    return ocr.joined_phones(ocr.group_lines(b, ["doc_id"]), ["doc_id"]).where("kind = 'phone_mobile'").select("doc_id", "value", "x0", "x1")


@query("joined_cards", oracle.seeded(f"select doc_id, card as value, 10.0 as x0, 49.0 as x1, 2 as ways from seed where {oracle.valid(repr('card'), 'card')}", False))
def joined_cards(spark, sf_dir):
    four = [F.substring("card", F.lit(4 * k + 1), F.lit(4)) for k in range(4)]
    found = ocr.joined_cards(ocr.group_lines(_blocks(spark, sf_dir, F.lit("card"), *four), ["doc_id"]), ["doc_id"])
    # by the whole line, and by neighbours of the first group
    return found.groupBy("doc_id", "value", "x0", "x1").agg(F.count("*").cast("int").alias("ways"))


@query("first_rule", oracle.seeded("select doc_id, 'email' as rule, mail as value from seed union all select doc_id, 'passport', upper(passport) from seed where doc_id % 2 = 0", False))
def first_rule(spark, sf_dir):
    a = corpus(spark, sf_dir).select("doc_id", F.concat(F.lit("메일："), F.replace("mail", F.lit("@"), F.lit(" ＠ "))).alias("t"))
    b = corpus(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("여권 ["), F.lower("passport"), F.lit("] x")).alias("t"))
    found = a.unionByName(b).withColumn("x", ocr.first_rule(ocr.candidate_texts(F.col("t"))))
    return found.select("doc_id", F.col("x.rule").alias("rule"), F.when(F.col("x.rule") == "passport", F.upper("x.value")).otherwise(F.col("x.value")).alias("value"))


@query("entities_on_blocks", f"select page, text, x0, y0 from (select *, row_number() over (partition by page, x0, y0 order by id) as k from (select page, id, text, min(x0) as x0, min(y0) as y0 from ({_WORDS}) group by all)) where k = 1")
def entities_on_blocks(spark, sf_dir):
    words = _words(spark, sf_dir).groupBy("page", "id", "text").agg(*[F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    placed = ocr.block_text(words, ["page"])
    ents = placed.select("page", F.lit("ps").alias("label"), "start", "end", "text")
    return ocr.entities_on_blocks(ents, words, ["page"]).select("page", "text", "x0", "y0")


@query("ocr_confidence", "select case when l_returnflag = 'A' then 'none' else l_returnflag end as kind, count(*) as n from lineitem where l_discount >= 0.05 group by 1")
def ocr_confidence(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("kind"), F.col("l_discount").alias("conf"))
    return ocr.kind_counts(ocr.confident(rows, 0.05), [])


@query("page_annotations", f"select page, place, x0, y0 from (select page, row_number() over (partition by page order by y0, x0, y1, x1)::int as place, x0, y0 from (select page, round(x0 / 400, 4) as x0, round(y0 / 84, 4) as y0, round(least(1.0, x1 / 400), 4) as x1, round(y1 / 84, 4) as y1 from ({_WORDS}) where x0 < 400)) where place <= 3")
def page_annotations(spark, sf_dir):
    return ocr.annotations(_words(spark, sf_dir), ["page"], F.lit(400.0), F.lit(84.0), 3).select("page", "place", "x0", "y0")


@query("incomplete_values", oracle.seeded("select doc_id, true as card, true as mail, false as whole from seed", False))
def incomplete_values(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", geometry.is_incomplete(F.lit("card"), F.left("card", F.lit(12))).alias("card"), geometry.is_incomplete(F.lit("email"), F.substring_index("mail", ".", 2)).alias("mail"), geometry.is_incomplete(F.lit("email"), F.concat("mail", F.lit(""))).alias("whole"))


@query("continued_values", oracle.seeded("select doc_id, 0 as from_id, 2 as to_id from seed", False))
def continued_values(spark, sf_dir):
    part = lambda i, row, x, t: F.struct(F.lit(i).alias("id"), F.lit(row).alias("row"), F.lit(x).alias("x0"), F.lit(row * 20.0).alias("y0"), F.lit(x + 50.0).alias("x1"), F.lit(row * 20.0 + 10).alias("y1"), t.alias("text"), F.lit("card").alias("kind"))
    words = corpus(spark, sf_dir).select("doc_id", F.inline(F.array(part(0, 1, 10.0, F.left("card", F.lit(12))), part(1, 2, 100.0, F.lit("12")), part(2, 2, 15.0, F.right("card", F.lit(4))), part(3, 3, 10.0, F.lit("99")))))
    return geometry.best_continuations(words, ["doc_id"]).select("doc_id", "from_id", "to_id")


# --- entities ---------------------------------------------------------------------------------------------------------------


@query("recognise", oracle.seeded("select doc_id, label, s, s + 3 as e from (select doc_id, 'LC' as label, instr(text, 'tel') - 1 as s, text from seed where text is not null)", False))
def recognise(spark, sf_dir):
    # an address that is left out holds the second word; chunks of 60 characters overlap by 20, so words are found twice
    df = corpus(spark, sf_dir).where("text is not null").withColumn("text", F.regexp_replace("text", "[Tt][Ee][Ll](?!\\b)", "xyz"))
    at = F.instr("text", F.col("mail"))
    df = df.withColumn("out", F.array(F.struct((at - 1).alias("start"), (at - 1 + F.length("mail")).alias("end"))))
    found = entities.recognise(df, entities.dictionary({"tel": "B-LC", "mail5": "PS", "card": "OG"}), exclude="out", size=60, overlap=20, labels=["LC", "PS"])
    return found.select("doc_id", F.inline("entities")).select("doc_id", "label", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))


@query("token_windows", """select l_orderkey as doc_id, t as tok, k as "window" from (select *, case when n <= 4 then 1 else ((n - 4 + 2) // 3) + 1 end as last from (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as t, count(*) over (partition by l_orderkey) as n from lineitem)), (select unnest(range(0, 9)) as k) where k < last and k * 3 <= t and t < k * 3 + 4""")
def token_windows(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), F.col("l_partkey").alias("end"))
    return inference.windows(t, ["doc_id"], 6, 1).select("doc_id", F.col("tok").cast("long").alias("tok"), F.col("window").cast("long").alias("window"))


@query("token_labels", """select l_orderkey, l_linenumber, l_partkey, case when a >= b and a >= c then 'O' when b >= c then 'B-PS' else 'LC' end as label, round(exp(greatest(a, b, c) / 3) / (exp(a / 3) + exp(b / 3) + exp(c / 3)), 6) as score from (select distinct l_orderkey, l_linenumber, l_partkey, l_discount * 30 as a, l_tax * 40 as b, l_quantity / 10 as c from lineitem)""")
def token_labels(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array(F.col("l_discount") * 30, F.col("l_tax") * 40, F.col("l_quantity") / 10).alias("x")).distinct()
    t = t.withColumn("y", inference.likeliest(F.col("x"), ["O", "B-PS", "LC"]))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "y.label", F.round("y.score", 6).alias("score"))


@query("label_distribution", "select label, n from (select p_brand as label, count(*) as n from part group by 1) order by n desc, label limit 12")
def label_distribution(spark, sf_dir):
    return entities.label_distribution(read(spark, sf_dir, "part").select(F.col("p_brand").alias("label")))


@query("entities_in_text", "select p_partkey, length(p_name) - 2 as s, length(p_name) as e from part")
def entities_in_text(spark, sf_dir):
    one = lambda a, b: F.struct(F.lit("PS").alias("label"), a.alias("start"), b.alias("end"), F.lit(1.0).alias("score"))
    n = F.length("p_name")
    df = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name").alias("t"), F.array(one(n - 2, n + 9), one(n + 1, n + 2), one(n, n)).alias("x"))
    return df.select("p_partkey", F.inline(entities.within_text(F.col("x"), F.col("t")))).select("p_partkey", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))


# --- packages ---------------------------------------------------------------------------------------------------------------

_CARD = "4111 1111 1111 1111"


def _packages(spark, sf_dir):
    """Of each nation a document with a table, a chart and a workbook inside, a presentation, an HWPX file with a workbook, and
    files that can't be read whole."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, name in zip(batch["n_nationkey"], batch["n_name"], strict=True):
                book = packages.package({"xl/sharedStrings.xml": f"<sst><si><t>{_CARD}</t></si></sst>", "xl/worksheets/sheet1.xml": '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData>', "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="A &amp; B" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'})
                word = f'<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>{name}</w:t><w:br w:type="page"/><w:sym w:char="0041"/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
                chart = "<c:chart><a:t>Title</a:t><c:v>12.5</c:v><c:v>Q1</c:v></c:chart>"
                rels = '<Relationships><Relationship Id="a" Target="https://x.y/z" TargetMode="External"/><Relationship Id="b" Target="../embeddings/x.xlsx"/></Relationships>'
                rows.append((f"/{k}.docx", "docx", packages.package({"word/document.xml": word, "word/charts/chart1.xml": chart, "word/charts/_rels/chart1.xml.rels": rels, "word/embeddings/x.xlsx": book})))
                rows.append((f"/{k}.pptx", "pptx", packages.package({"ppt/slides/slide2.xml": "<p><a:t>two</a:t></p>", "ppt/slides/slide1.xml": f"<p><a:t> {name} </a:t><a:t>a&amp;b</a:t></p>", "ppt/charts/chart1.xml": chart})))
                rows.append((f"/{k}.hwpx", "hwpx", packages.package({"Contents/section0.xml": f"<s><t>{name}</t><t>(^1) {_CARD}</t></s>", "Chart/c.xml": "<c:v>77</c:v>", "BinData/o.ole": book, "Preview/PrvImage.png": b"png", "settings.xml": '<a usePreview="true"><cache>9</cache></a>'})))
                rows.append((f"/{k}.xlsx", "xlsx", book[: len(book) // 2]))
            yield pd.DataFrame(rows, columns=["path", "ext", "content"])

    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(make, "path string, ext string, content binary")


@query("zip_docx_layout", f"select concat('/', n_nationkey, '.docx') as path, concat(n_name, chr(10), '[PAGE_BREAK]', chr(10), 'A', chr(10), '| a | b |', chr(10), 'Title', chr(10), 'Q1', chr(10), '{_CARD}', chr(10), '0') as text from nation")
def zip_docx_layout(spark, sf_dir):
    return packages.texts(packages.members(_packages(spark, sf_dir))).where("ext = 'docx'").select("path", "text")


@query("zip_pptx_text", "select concat('/', n_nationkey, '.pptx') as path, concat(n_name, chr(10), 'a&b', chr(10), 'two', chr(10), 'Title', chr(10), '12.5', chr(10), 'Q1') as text from nation")
def zip_pptx_text(spark, sf_dir):
    return packages.texts(packages.members(_packages(spark, sf_dir))).where("ext = 'pptx'").select("path", "text")


@query("zip_hwpx_text", f"select concat('/', n_nationkey, '.hwpx') as path, concat(n_name, chr(10), ' {_CARD}', chr(10), '77', chr(10), '{_CARD}', chr(10), '0') as text from nation")
def zip_hwpx_text(spark, sf_dir):
    return packages.texts(packages.members(_packages(spark, sf_dir))).where("ext = 'hwpx'").select("path", "text")


@query("package_scan", f"select concat('/', n_nationkey, '.hwpx') as path, 'card' as rule, '{_CARD}' as value, true as valid, '*merged_text*' as part, s, s + 19 as e from (select n_nationkey, unnest([length(n_name) + 2, length(n_name) + 25]) as s from nation)")
def package_scan(spark, sf_dir):
    found = packages.scan(packages.members(_packages(spark, sf_dir).where("ext = 'hwpx'"))).where("rule = 'card'")
    return found.select("path", "rule", "value", "valid", "location.part", F.col("location.start").cast("long").alias("s"), F.col("location.end").cast("long").alias("e"))


@query("embedded_xlsx", "select concat('/', n_nationkey, '.', ext) as path, n_members, hits, kept, modified, errors, inside from nation, (select 'docx' as ext, 4 as n_members, 1 as hits, 2 as kept, 2 as modified, 0 as errors, '**** **** **** ****' as inside union all select 'hwpx', 5, 2, 1, 4, 0, '**** **** **** ****')")
def embedded_xlsx(spark, sf_dir):
    files = _packages(spark, sf_dir).where("ext in ('docx', 'hwpx')")
    done = packages.redact_packages(files).withColumn("ext", F.regexp_extract("path", r"([a-z]+)$", 1))
    strings = packages.embedded(packages.members(done)).where("member = 'xl/sharedStrings.xml'").select(F.regexp_extract("path", "^(.*)!", 1).alias("path"), packages.shared_strings(F.col("xml"))[0].alias("inside"))
    return done.join(strings, "path").select("path", "n_members", "hits", F.col("kept").cast("int").alias("kept"), F.col("modified").cast("int").alias("modified"), F.col("errors").cast("int").alias("errors"), "inside")


@query("broken_packages", "select concat('/', n_nationkey, '.xlsx') as path, true as broken, true as no_member from nation")
def broken_packages(spark, sf_dir):
    found = packages.members(_packages(spark, sf_dir)).where("ext = 'xlsx'")
    return found.select("path", F.col("error").startswith("BadZipFile").alias("broken"), F.col("member").isNull().alias("no_member"))


@query("sheet_names", "select concat('/', n_nationkey, '.docx!word/embeddings/x.xlsx') as path, 'sheet1' as sheet, 'A & B' as name from nation")
def sheet_names(spark, sf_dir):
    return packages.sheet_names(packages.embedded(packages.members(_packages(spark, sf_dir).where("ext = 'docx'"))))


@query("external_links", "select concat('/', n_nationkey, '.docx') as path, 1 as n_links from nation")
def external_links(spark, sf_dir):
    found = packages.members(_packages(spark, sf_dir)).where(F.col("member").endswith(".rels") & F.col("member").startswith("word/charts"))
    return found.select("path", F.regexp_count(packages.without_external(F.col("xml")), F.lit("<Relationship ")).alias("n_links"))


@query("package_secrets", f"select concat('/', n_nationkey, '.hwpx') as path, '{_CARD}' as value from nation")
def package_secrets(spark, sf_dir):
    return packages.secrets(packages.members(_packages(spark, sf_dir).where("ext = 'hwpx'"))).select("path", F.explode("values").alias("value"))


@query("xlsx_html", "select concat('/', n_nationkey, '.docx!word/embeddings/x.xlsx') as path, 'A & B' as name, concat('<table><tr><td>', '" + _CARD + "', '</td></tr></table>') as html from nation")
def xlsx_html(spark, sf_dir):
    found = packages.embedded(packages.members(_packages(spark, sf_dir).where("ext = 'docx'")))
    grid = tables.dense(packages.cells(found), ["path", "sheet"])
    return tables.html_table(grid, ["path", "sheet"]).join(packages.sheet_names(found), ["path", "sheet"]).select("path", "name", "html")


@query("preview_caps", "select sheet, max(row)::int as n_rows, max(col)::int as n_cols from (select l_orderkey as sheet, l_linenumber as row, (l_partkey % 4 + 1)::int as col from lineitem where l_linenumber <= 3 and l_partkey % 4 + 1 <= 2) group by sheet")
def preview_caps(spark, sf_dir):
    cells = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 4 + 1).cast("int").alias("col"), F.lit("x").alias("value")).distinct()
    return tables.dense(cells, ["sheet"], 3, 2).groupBy("sheet").agg(F.max("row").alias("n_rows"), F.max(F.size("values")).alias("n_cols"))


# --- small parts ------------------------------------------------------------------------------------------------------------


@query("cleanup_keep_tabs", r"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(concat(coalesce(text, ''), chr(13), chr(10), chr(10), chr(10), '  x ', chr(9), ' y  ', chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ ]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ ]{2,}', ' ', 'g'), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g') as t from documents")
def cleanup_keep_tabs(spark, sf_dir):
    t = F.concat(F.coalesce("text", F.lit("")), F.lit("\r\n\n\n  x \t y  \n"))
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.cleanup_text(t, keep_tabs=True).alias("t"))


@query("replace_overlays", "select c_custkey, replace(replace(replace(c_name, 'Customer', 'C'), 'C#', 'X'), '0', 'o') as t from customer")
def replace_overlays(spark, sf_dir):
    pair = lambda a, b: F.struct(F.lit(a).alias("literal"), F.lit(b).alias("replacement"))
    return read(spark, sf_dir, "customer").select("c_custkey", chunks.replace_overlays(F.col("c_name"), F.array(pair("Customer", "C"), pair("C#", "X"), pair("0", "o"))).alias("t"))


@query("mean_score", oracle.seeded("select count(*) as n, count(*) filter (where valid) as n_ok, count(*) filter (where not valid) as n_fail, (select round(avg(l_discount), 2) from lineitem) as mean_score from kept"))
def mean_score(spark, sf_dir):
    return report.totals(span_rows(seeded(spark, sf_dir)), read(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("score")))


@query("leading_spaces", "select p_partkey, concat(repeat('&nbsp;', (p_size % 4)::int), p_name, '  x') as t from part")
def leading_spaces(spark, sf_dir):
    raw = F.concat(F.repeat(F.lit(" "), F.col("p_size") % 4), "p_name", F.lit("  x"))
    return read(spark, sf_dir, "part").select("p_partkey", text.leading_spaces(raw).alias("t"))


@query("mask_except_hyphen_at", oracle.seeded("select doc_id, mail as value, regexp_replace(concat(mail, '-x'), '[^@-]', '*', 'g') as masked from seed", False))
def mask_except_hyphen_at(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.col("mail").alias("value"), masks.except_hyphen_at(F.concat("mail", F.lit("-x"))).alias("masked"))


@query("pipe_rows", "select p_partkey, concat('| ', p_name, ' | ', p_brand, ' |  |') as t from part")
def pipe_rows(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", tables.pipe_row(F.array("p_name", "p_brand", F.lit(""))).alias("t"))


@query("pages_in_order", "select l_orderkey as doc_id, string_agg(concat('page ', l_linenumber), chr(10) || chr(10) order by l_linenumber) as text from (select distinct l_orderkey, l_linenumber from lineitem) group by 1")
def pages_in_order(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page")).distinct()
    return chunks.in_page_order(own.withColumn("text", F.concat(F.lit("page "), "page")), ["doc_id"])


@query("shown_pictures", "select concat('/', n_nationkey) as path, place::int as place, concat('p', place, '.png') as name, case when place = 2 then 'jpg' else 'gif' end as kind, concat('data:image/', case when place = 2 then 'jpeg' else 'gif' end, ';base64,', to_base64(encode(case when place = 2 then 'abc' else 'GIF89a' end))) as uri, case when place = 2 then null else 'gif' end as told from nation, (select unnest([1, 2]) as place)")
def shown_pictures(spark, sf_dir):
    one = lambda k, kind, data: F.struct(F.lit(f"p{k}.png").alias("name"), F.lit(kind).alias("kind"), F.lit(data).cast("binary").alias("content"))
    own = read(spark, sf_dir, "nation").select(F.concat(F.lit("/"), "n_nationkey").alias("path"), F.inline(F.array(one(3, "png", "x"), one(1, "gif", "GIF89a"), one(2, "jpg", "abc"))))
    own = own.withColumn("size", F.length("content")).withColumn("digest", F.sha1("content"))
    first = pictures.shown(own, 2)
    return first.join(own.select("path", "name", pictures.type_of(F.col("content")).alias("told")), ["path", "name"]).select("path", "place", "name", "kind", "uri", "told")
