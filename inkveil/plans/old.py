"""Queries over the older office formats: texts, grids, redaction in place, and what can't be read."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkveil.operators import ocr, tables
from inkveil.plans import samples
from inkveil.plans.queries import query, read
from inkveil.plans.samples import CARD, MAIL, PHONE
from inkveil.sources import files, legacy, packages, pdf, pictures, raster
from inkveil.sources.compound import compound


def _files(spark, sf_dir):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"/{k}.{ext}", ext, content) for k, name in zip(batch["n_nationkey"], batch["n_name"], strict=True) for ext, content in samples.of_name(name).items()]
            yield pd.DataFrame(rows, columns=["path", "ext", "content"])

    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(make, "path string, ext string, content binary")


def _texts_sql(card: str, mail: str, phone: str, head: str, series: str) -> str:
    line = "' || chr(10) || '"
    # a card's match takes the blank behind it along
    of = {
        "doc": f"n_name || ' a{line}한글 {card}{line}mail {mail}{line}{series}'",
        "xls": f"n_name || '{line}한글 {mail}{line}no {card}{' ' if card == CARD else '*'}x{line}no {card}{' ' if card == CARD else '*'}x{line}&C{head}{line}box {mail}'",
        # a line of asterisks alone is noise of the master, so a masked card leaves none
        "ppt": f"n_name || '{line}{card}{line}한글 {phone}'" if card == CARD else f"n_name || '{line}한글 {phone}'",
        "hwp": f"n_name || ' a{line}카드 {card}{line}{mail} 끝'",
    }
    return " union all ".join(f"select concat('/', n_nationkey, '.{ext}') as path, '{ext}' as ext, {sql} as text from nation" for ext, sql in of.items())


@query("legacy_text", _texts_sql(CARD, MAIL, PHONE, PHONE, f"Title {PHONE}"))
def legacy_text(spark, sf_dir):
    return legacy.texts(legacy.runs(_files(spark, sf_dir)))


@query("legacy_redact", f"select path, ext, hits, same, text from ({_texts_sql('*' * 19, '***@****', '***-****-****', '***-****-****', '*' * 19)}) join (select unnest(['doc', 'xls', 'ppt', 'hwp']) as ext, unnest([3, 4, 2, 2]) as hits, unnest([true, true, true, true]) as same) using (ext)")
def legacy_redact(spark, sf_dir):
    files = _files(spark, sf_dir)
    done = legacy.redact(files).persist()
    sizes = files.select("path", F.length("content").alias("n"))
    again = legacy.texts(legacy.runs(done))
    return done.join(sizes, "path").join(again, ["path", "ext"]).select("path", "ext", "hits", (F.length("content") == F.col("n")).alias("same"), "text")


@query("legacy_grid", f"""select concat('/', n_nationkey, '.xls') as path, 'Sheet' as sheet, row, line from nation, (select unnest(range(1, 11)) as row) r, lateral (select case row when 1 then concat(n_name, '|||12') when 2 then '||한글 {MAIL}|' when 3 then '|no {CARD} x||' when 4 then '|no {CARD} x||' when 5 then '0.5|||' when 10 then '7|1.5||' else '|||' end as line)""")
def legacy_grid(spark, sf_dir):
    grid = tables.dense(legacy.cells(legacy.runs(_files(spark, sf_dir))), ["path", "sheet"])
    return grid.select("path", "sheet", F.col("row").cast("long").alias("row"), F.array_join("values", "|").alias("line"))


@query("legacy_broken", "select concat('/', n_nationkey, '.', ext) as path, true as has_error, true as no_content from nation, (select unnest(['doc', 'xls', 'ppt', 'hwp']) as ext)")
def legacy_broken(spark, sf_dir):
    cut = _files(spark, sf_dir).withColumn("content", F.substring("content", 1, 700))
    return legacy.redact(cut).select("path", F.col("error").isNotNull().alias("has_error"), F.col("content").isNull().alias("no_content"))


# --- PDF --------------------------------------------------------------------------------------------------------------------


def _pdfs(spark, sf_dir):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"/{k}.pdf", "pdf", samples.pdf_of_name(name)) for k, name in zip(batch["n_nationkey"], batch["n_name"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "ext", "content"])

    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(make, "path string, ext string, content binary")


@query("pdf_pages", f"select concat('/', n_nationkey, '.pdf') as path, 1 as page, concat(n_name, ' (a)', chr(10), 'card {CARD}', chr(10), '한글 123') as text from nation union all select concat('/', n_nationkey, '.pdf'), 2, concat('mail {MAIL} end', chr(10), 'tel {PHONE} 끝') from nation")
def pdf_pages(spark, sf_dir):
    return pdf.pages(pdf.words(_pdfs(spark, sf_dir)))


@query("pdf_boxes", f"""select concat('/', n_nationkey, '.pdf') as path, page, rule, value, x0, x1 from nation, (select unnest([1, 1, 1, 1, 2, 2]) as page, unnest(['card', 'card', 'card', 'card', 'email', 'phone_mobile']) as rule, unnest(['{CARD}', '{CARD}', '{CARD}', '{CARD}', '{MAIL}', '{PHONE}']) as value,
    unnest([75.0, 100.0, 125.0, 150.0, 75.0, 70.0]) as x0, unnest([95.0, 120.0, 145.0, 170.0, 115.0, 135.0]) as x1)""")
def pdf_boxes(spark, sf_dir):
    found = pdf.boxes(pdf.words(_pdfs(spark, sf_dir)))
    return found.select("path", "page", "rule", "value", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


@query("pdf_redact", "select concat('/', n_nationkey, '.pdf') as path, 3 as hits, concat(n_name, ' (a)', chr(10), 'card', chr(10), '한글 123') as first_page, concat('mail end', chr(10), 'tel 끝') as second_page, false as leaks from nation")
def pdf_redact(spark, sf_dir):
    done = pdf.redact(_pdfs(spark, sf_dir))
    again = pdf.pages(pdf.words(done)).groupBy("path").agg(F.max(F.when(F.col("page") == 1, F.col("text"))).alias("first_page"), F.max(F.when(F.col("page") == 2, F.col("text"))).alias("second_page"))
    raw = F.decode("content", "ISO-8859-1")
    return done.join(again, "path").select("path", "hits", "first_page", "second_page", (raw.contains("4111") | raw.contains("1234")).alias("leaks"))


# --- any file ---------------------------------------------------------------------------------------------------------------


def _any(spark, sf_dir):
    """One nation's file of each kind, an XML file, one of an unknown kind and an empty one."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, name in zip(batch["n_nationkey"], batch["n_name"], strict=True):
                xml_ = f'<?xml version="1.0" encoding="UTF-8"?><r><a>{name}</a><b>{CARD}</b></r>'
                docx = packages.package({"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{name} x {CARD}</w:t></w:r></w:p></w:body></w:document>'})
                of = {"doc": samples.doc([("cp1252", f"{name} x {CARD}")]), "docx": docx, "pdf": samples.pdf([[(50, 700, name), (50, 600, CARD)]]), "xml": xml_.encode(), "exe": b"MZ", "hwp": b""}
                rows += [(f"/{k}.{ext}", ext, content) for ext, content in of.items()]
            yield pd.DataFrame(rows, columns=["path", "ext", "content"])

    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(make, "path string, ext string, content binary")


@query("file_text", f"select concat('/', n_nationkey, '.', ext) as path, ext, case when ext in ('exe', 'hwp') then null when ext = 'xml' then concat(n_name, '{CARD}') when ext = 'pdf' then concat(n_name, chr(10), '{CARD}') else concat(n_name, ' x {CARD}') end as text, ext in ('exe', 'hwp') as failed from nation, (select unnest(['doc', 'docx', 'pdf', 'xml', 'exe', 'hwp']) as ext)")
def file_text(spark, sf_dir):
    return files.texts(_any(spark, sf_dir)).select("path", "ext", "text", F.col("error").isNotNull().alias("failed"))


@query("file_redact", "select concat('/', n_nationkey, '.', ext) as path, ext, case when ext in ('exe', 'hwp') then 0 else 1 end as hits, case ext when 'pdf' then n_name when 'doc' then concat(n_name, ' x ', repeat('*', 19)) when 'docx' then concat(n_name, ' x **** **** **** ****') when 'xml' then concat(n_name, '**** **** **** ****') end as text from nation, (select unnest(['doc', 'docx', 'pdf', 'xml', 'exe', 'hwp']) as ext)")
def file_redact(spark, sf_dir):
    done = files.redact(_any(spark, sf_dir)).persist()  # each reader below reads the redacted files again
    again = files.texts(done).select("path", F.col("text"))
    return done.join(again, "path").select("path", "ext", "hits", F.when(F.col("error").isNull(), F.col("text")).alias("text"))


@query("picture_list", "select concat('/', n_nationkey, '.', ext) as path, kind, n::bigint as n from nation, (select unnest(['pptx', 'pptx', 'ppt', 'ppt']) as ext, unnest(['png', 'jpg', 'png', 'bmp']) as kind, unnest([1, 1, 2, 1]) as n)")
def picture_list(spark, sf_dir):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        png = packages.blank_png()
        other = png[:-12] + struct.pack(">I", 4) + b"tEXt" + b"abcd" + bytes(4) + png[-12:]
        bmp = b"BM" + struct.pack("<IIII", 60, 0, 54, 40) + struct.pack("<II", 1, 1) + struct.pack("<HH", 1, 24) + bytes(30)
        for batch in batches:
            rows = []
            for k in batch["n_nationkey"]:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("ppt/media/a.png", png)
                    z.writestr("ppt/media/b.bin", png)
                    z.writestr("ppt/media/c.jpeg", b"\xff\xd8\xff\xe0abc\xff\xd9")
                rows.append((f"/{k}.pptx", "pptx", out.getvalue()))
                rows.append((f"/{k}.ppt", "ppt", compound({"Pictures": b"xx" + png + b"BM" + other + bmp + png, "PowerPoint Document": bytes(9)})))
            yield pd.DataFrame(rows, columns=["path", "ext", "content"])

    own = read(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(make, "path string, ext string, content binary")
    found = pictures.of_members(packages.members(own)).unionByName(pictures.of_compound(own.where("ext = 'ppt'")))
    return pictures.summary(found).select("path", "kind", "n")


@query("pdf_targets", f"select concat('/', n_nationkey, '.pdf') as path, page, value, x0, x1 from (select n_nationkey, 1 as page, n_name as value, 50.0 as x0, 50.0 + 5 * length(n_name) as x1 from nation union all select n_nationkey, 2, 'Tel {PHONE}', 50.0, 65.0 from nation union all select n_nationkey, 2, 'Tel {PHONE}', 70.0, 135.0 from nation union all select n_nationkey, 1, '한 글123', 50.0, 60.0 from nation union all select n_nationkey, 1, '한 글123', 65.0, 80.0 from nation)")
def pdf_targets(spark, sf_dir):
    own = read(spark, sf_dir, "nation").select(F.concat(F.lit("/"), "n_nationkey", F.lit(".pdf")).alias("path"), F.explode(F.array("n_name", F.lit(f"Tel {PHONE}"), F.lit("한 글123"), F.lit("zz"))).alias("value"))
    return pdf.target_boxes(pdf.words(_pdfs(spark, sf_dir)), own).select("path", "page", "value", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


def _drawn(spark, sf_dir):
    """A picture of 40 by 20 grey points for each nation."""
    points = np.full((20, 40, 3), 128, np.uint8)
    content = raster.write(points, {"kind": "png", "chunks": [], "colour": 2})
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("/"), "n_nationkey").alias("path"), F.lit("a.png").alias("name"), F.lit(content).alias("content"))


def _points(content):
    """The number of black points of a picture, and how many it has."""
    @F.pandas_udf("struct<black: long, n: long>")
    def count(batch: pd.Series) -> pd.DataFrame:
        read_ = [raster.read(c)[0] for c in batch]
        return pd.DataFrame({"black": [int((p == 0).all(axis=2).sum()) for p in read_], "n": [p.shape[0] * p.shape[1] for p in read_]})

    return count(content)


@query("picture_redact", "select concat('/', n_nationkey) as path, 1 as hits, 200::bigint as black, 800::bigint as n from nation")
def picture_redact(spark, sf_dir):
    own = _drawn(spark, sf_dir)
    block = lambda i, t, x: F.struct(F.lit(i).alias("id"), F.lit(t).alias("text"), F.lit(x).alias("x0"), F.lit(5.0).alias("y0"), F.lit(x + 10).alias("x1"), F.lit(15.0).alias("y1"))
    blocks = own.select("path", "name", F.inline(F.array(block(0, "010-1234-", 0.0), block(1, "5678", 10.0), block(2, "words", 30.0))))
    done = pictures.redact(own, blocks)
    return done.withColumn("p", _points(F.col("content"))).select("path", "hits", "p.black", "p.n")


@query("picture_preview", "select concat('/', n_nationkey) as path, 50::bigint as n, true as same from nation")
def picture_preview(spark, sf_dir):
    own = _drawn(spark, sf_dir)
    small, same = raster.shrink(F.col("content"), 10)["content"], raster.shrink(F.col("content"), 40)["content"]
    return own.select("path", _points(small)["n"].alias("n"), (same == F.col("content")).alias("same"))


@query("pdf_markdown", "select concat('/', n_nationkey, '.pdf') as path, 1 as page, concat(n_name, chr(10), chr(10), '| a b | 1 |', chr(10), '| --- | --- |', chr(10), '| c | 2 |', chr(10), '| d | 3 |', chr(10)) as text from nation")
def pdf_markdown(spark, sf_dir):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            page = lambda name: [(50, 700, name), (50, 680, "a b"), (150, 680, "1"), (50, 660, "c"), (150, 660, "2"), (50, 640, "d"), (150, 640, "3")]
            yield pd.DataFrame([(f"/{k}.pdf", "pdf", samples.pdf([page(name)])) for k, name in zip(batch["n_nationkey"], batch["n_name"], strict=True)], columns=["path", "ext", "content"])

    own = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(make, "path string, ext string, content binary")
    return pdf.markdown(pdf.words(own))


@query("picture_text", "select concat('/', n_nationkey) as path, case n_nationkey % 3 when 0 then concat('name ', n_name, chr(10), 'low') when 1 then 'low' end as text, case n_nationkey % 3 when 0 then 3 when 1 then 1 else 1 end::bigint as n from nation where n_nationkey % 4 <> 3")
def picture_text(spark, sf_dir):
    # what a provider might read: three blocks well, one badly, or one very badly
    def provider(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, name in zip(batch["path"], batch["content"], strict=True):
                k = int(path[1:])
                block = lambda i, t, x, y, conf: (path, "a.png", i, t, x, y, x + 9, y + 9, conf)  # noqa: E731, B023
                of = {0: [block(0, bytes(name).decode(), 20.0, 1.0, 0.9), block(1, "name", 0.0, 5.0, 0.4), block(2, "low", 0.0, 60.0, 0.3), block(3, "noise", 0.0, 90.0, 0.1)], 1: [block(0, "low", 0.0, 0.0, 0.26)], 2: [block(0, "noise", 0.0, 0.0, 0.02)]}
                rows += of[k % 3] if k % 4 != 3 else []
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ocr.BLOCK.split(", ")])

    own = read(spark, sf_dir, "nation").select(F.concat(F.lit("/"), "n_nationkey").alias("path"), F.lit("a.png").alias("name"), F.col("n_name").cast("binary").alias("content"))
    blocks = ocr.recognise(own, provider)
    counts = blocks.groupBy("path").agg(F.count("*").alias("n"))
    return counts.join(ocr.reading_text(blocks, ["path"]), "path", "left").select("path", "text", "n")
