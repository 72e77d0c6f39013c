"""Queries over office packages that are made from the tables' rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from inkveil.plans.queries import query, read
from inkveil.sources import packages


def _files(spark, sf_dir):
    """A document, a workbook and a presentation of each nation."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, name in zip(batch["n_nationkey"], batch["n_name"], strict=True):
                card = "4111 1111 1111 1111"
                rows.append((f"/{k}.docx", "docx", packages.package({"word/document.xml": f"<w:document xmlns:w=\"w\"><w:body><w:p><w:r><w:t>{name}</w:t><w:tab/><w:t>a&amp;b</w:t></w:r></w:p><w:p><w:r><w:t>{card}</w:t></w:r></w:p></w:body></w:document>", "word/media/x.bin": "raw"})))
                rows.append((f"/{k}.xlsx", "xlsx", packages.package({"xl/sharedStrings.xml": f"<sst><si><t>{name}</t></si><si><t>second</t></si></sst>", "xl/worksheets/sheet1.xml": f'<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>{k}</v></c></row><row r="2"><c r="AB2" t="inlineStr"><is><t>in</t></is></c></row></sheetData>'})))
                rows.append((f"/{k}.pptx", "pptx", packages.package({"ppt/slides/slide2.xml": "<p><a:t>two</a:t></p>", "ppt/slides/slide1.xml": f"<p><a:t>{name}</a:t></p>", "ppt/slides/slide10.xml": "<p><a:t>ten</a:t></p>"})))
            yield pd.DataFrame(rows, columns=["path", "ext", "content"])

    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(make, "path string, ext string, content binary")


@query("package_text", """select concat('/', n_nationkey, '.docx') as path, 'docx' as ext, concat(n_name, chr(9), 'a&b', chr(10), '4111 1111 1111 1111') as text from nation
    union all select concat('/', n_nationkey, '.xlsx'), 'xlsx', concat(n_name, chr(10), 'second', chr(10), '0', chr(10), n_nationkey, chr(10), 'in') from nation
    union all select concat('/', n_nationkey, '.pptx'), 'pptx', concat(n_name, chr(10), 'ten', chr(10), 'two') from nation""")
def package_text(spark, sf_dir):
    return packages.texts(packages.members(_files(spark, sf_dir)))


@query("zip_xlsx_grid", """select concat('/', n_nationkey, '.xlsx') as path, 'sheet1' as sheet, 1 as row, 1 as col, n_name as value from nation
    union all select concat('/', n_nationkey, '.xlsx'), 'sheet1', 1, 3, cast(n_nationkey as varchar) from nation union all select concat('/', n_nationkey, '.xlsx'), 'sheet1', 2, 28, 'in' from nation""")
def zip_xlsx_grid(spark, sf_dir):
    return packages.cells(packages.members(_files(spark, sf_dir)))


@query("zip_docx_roundtrip", "select concat('/', n_nationkey, '.docx') as path, 2 as n_members, 1 as hits, concat(n_name, chr(9), 'a&b', chr(10), '**** **** **** ****') as text from nation")
def zip_docx_roundtrip(spark, sf_dir):
    files = _files(spark, sf_dir).where("ext = 'docx'")
    packed = packages.pack(packages.redact_members(packages.members(files)))
    again = packages.texts(packages.members(packed.withColumn("ext", F.lit("docx"))))
    return packed.join(again, "path").select("path", "n_members", "hits", "text")
