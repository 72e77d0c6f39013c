"""Grids of cells, as rows (sheet, row, col, value), to HTML and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.text import escape_html
from inkveil.operators.spans import let


def column_index(letters: Column) -> Column:
    """A is 1, Z 26, AA 27; null if not letters."""
    return F.when(letters.rlike("^[A-Za-z]+$"), F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64))


def cell_reference(ref: Column) -> tuple[Column, Column]:
    """(row, column) of a reference such as B12, counted from 1; null if it is none."""
    ok = ref.rlike(r"^\$?[A-Za-z]+\$?[0-9]+$")
    return F.when(ok, F.regexp_extract(ref, "([0-9]+)$", 1).try_cast("int")), F.when(ok, column_index(F.regexp_extract(ref, r"^\$?([A-Za-z]+)", 1)))


def dense(cells: DataFrame, sheet: list[str], max_rows: int = 200, max_cols: int = 50) -> DataFrame:
    """(sheet, row, values): every row and column up to the last one used, within the caps of a preview; empty cells ''. A sheet's
    cells, as many as the caps allow, meet once; its rows keep their partition."""
    used = cells.where(F.col("row").between(1, max_rows) & F.col("col").between(1, max_cols))
    own = used.groupBy(*sheet).agg(F.sort_array(F.collect_list(F.struct("row", "col", "value"))).alias("_w"), F.max("row").alias("_r"), F.max("col").alias("_c"))
    begins = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.get("_w", i)["row"] != F.get("_w", i - 1)["row"]))
    part = lambda at, b, k: F.slice("_w", b + 1, F.coalesce(F.get(at, k + 1), F.size("_w")) - b)
    by_col = lambda x: F.map_from_entries(F.transform(x, lambda c: F.struct(c["col"], c["value"])))
    by_row = let(begins, lambda at: F.map_from_entries(F.transform(at, lambda b, k: F.struct(F.get("_w", b)["row"], by_col(part(at, b, k))))))
    row = lambda m: F.transform(F.sequence(F.lit(1), F.col("_c")), lambda c: F.coalesce(F.try_element_at(m, c), F.lit("")))
    grid = let(by_row, lambda m: F.transform(F.sequence(F.lit(1), F.col("_r")), lambda r: let(F.try_element_at(m, r), row)))
    return own.select(*sheet, F.posexplode(grid).alias("row", "values")).withColumn("row", F.col("row") + 1)


def html_row(values: Column, n: Column | None = None) -> Column:
    """A table row; cells escaped, line feeds as breaks, filled up to n cells."""
    filled = values if n is None else F.concat(values, F.array_repeat(F.lit(""), F.greatest(n - F.size(values), F.lit(0))))
    cell = lambda v: F.concat(F.lit("<td>"), F.replace(escape_html(F.coalesce(v, F.lit(""))), F.lit("\n"), F.lit("<br/>")), F.lit("</td>"))
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(filled, cell), ""), F.lit("</tr>"))


def html_table(rows: DataFrame, keys: list[str], order: str = "row", values: str = "values") -> DataFrame:
    """(keys, html): a table of each group's rows, made rectangular."""
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, values))).alias("_r"), F.max(F.size(values)).alias("_n"))
    return g.select(*keys, F.concat(F.lit("<table>"), F.array_join(F.transform("_r", lambda x: html_row(x[values], F.col("_n"))), ""), F.lit("</table>")).alias("html"))


def pipe_row(values: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
