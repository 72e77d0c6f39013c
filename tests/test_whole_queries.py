"""Queries over all of lineitem against brute force in Python; their SQL takes part of the rows only."""

from collections import defaultdict

import pytest

from inkveil.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def lines(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()


def grids(lines):
    cells = defaultdict(dict)
    for sheet, row, part, supp in lines:
        at = row, part % 4 + 1
        cells[sheet][at] = max(supp, cells[sheet].get(at, supp))
    for sheet, own in cells.items():
        n, m = max(r for r, _ in own), max(c for _, c in own)
        yield sheet, [[str(own.get((r, c), "")) for c in range(1, m + 1)] for r in range(1, n + 1)]


def test_grid_dense_has_every_sheet(spark, sf, lines):
    want = sorted((sheet, r, "|".join(v)) for sheet, rows in grids(lines) for r, v in enumerate(rows, 1))
    assert sorted(map(tuple, QUERIES["grid_dense"](spark, sf).collect())) == want


def test_html_table_has_every_sheet(spark, sf, lines):
    html = lambda rows: "".join("<tr>" + "".join(f"<td>{x}</td>" for x in v) + "</tr>" for v in rows)
    want = sorted((sheet, f"<table>{html(rows)}</table>") for sheet, rows in grids(lines))
    assert sorted(map(tuple, QUERIES["html_table"](spark, sf).collect())) == want


def test_page_text_has_every_word(spark, sf, lines):
    assert any(part % 500 == 7 for _, _, part, _ in lines)
    pages = defaultdict(list)
    for page, word, part, supp in lines:
        pages[page].append((supp % 7 * 12, part % 500 + word / 1000, word))
    want = []
    for page, words in pages.items():
        rows, before = [], None
        for y, x, word in sorted(words):
            if before is None or y - before > 8:
                rows.append([])
            rows[-1].append((x, y, word))
            before = y
        want.append((page, "\n".join(" ".join(f"w{word}" for _, _, word in sorted(row)) for row in rows)))
    assert sorted(map(tuple, QUERIES["page_text"](spark, sf).collect())) == sorted(want)
