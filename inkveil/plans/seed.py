"""A corpus of candidates, valid and not, made from ``customer`` by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.session import spread


def _pad(number: str, n: int) -> str:
    return f"lpad(cast({number} as string), {n}, '0')"


def _digit(s: str, i: int) -> str:
    return f"cast(substr({s}, {i}, 1) as int)"


_total = " + ".join(f"{w} * {_digit('d12', i + 1)}" for i, w in enumerate([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]))
_luhn = " + ".join(f"({_digit('b15', i)} * 2 - case when {_digit('b15', i)} > 4 then 9 else 0 end)" if i % 2 else _digit("b15", i) for i in range(1, 16))

#: Steps: name and expression of the columns that each adds.
STEPS = [
    [
        ("d6", f"concat({_pad('k * 7 % 100', 2)}, {_pad('k % 13', 2)}, {_pad('k % 31 + 1', 2)})"),
        ("body", f"substr(concat(case k % 8 when 0 then '4' when 1 then '51' when 2 then '2221' when 3 then '6' when 4 then '9' when 5 then '35' when 6 then '1' else '37' end, {_pad('k * 104729 % 100000000000', 11)}, '0000'), 1, case when k % 8 = 7 then 14 else 15 end)"),
        ("mobile", f"concat(case when k % 7 = 0 then '011' else '010' end, case when k % 4 = 0 then '' else '-' end, {_pad('k * 37 % 10000', 4)}, case when k % 4 in (0, 3) then '' else '-' end, {_pad('k * 73 % 10000', 4)})"),
        ("city", f"concat(case k % 5 when 0 then '02' when 1 then '031' when 2 then '044' when 3 then '064' else '02' end, case when k % 6 = 0 then '' else '-' end, {_pad('k * 41 % 1000', 3)}, case when k % 6 in (0, 5) then '' else '-' end, {_pad('k * 43 % 10000', 4)})"),
        ("mail", "concat('u', cast(k as string), '.x+', cast(k % 9 as string), '@mail', cast(k % 5 as string), '-a.example.co.kr')"),
        ("passport", f"case when k % 2 = 0 then concat('M', {_pad('k * 97 % 100000000', 8)}) else concat('s', {_pad('k % 1000', 3)}, 'A', {_pad('k * 13 % 10000', 4)}) end"),
        ("licence", f"concat(cast(11 + k % 18 as string), '-', {_pad('k * 3 % 100', 2)}, '-', {_pad('k * 77 % 1000000', 6)}, '-', {_pad('k % 100', 2)})"),
        ("person", "case k % 4 when 0 then '김철수' when 1 then '이영' when 2 then '박' else 'Kim 남궁민수' end"),
    ],
    [("d12", f"concat(d6, cast(k % 10 as string), {_pad('k * 7919 % 100000', 5)})"), ("b15", "lpad(body, 15, '0')")],
    [("total", _total), ("luhn", _luhn)],
    [("chk", "case when k % 10 between 5 and 8 then ((11 - total % 11) % 10 + 2) % 10 else (11 - total % 11) % 10 end"), ("last", "(10 - luhn % 10) % 10")],
    [
        ("d13", "concat(d12, cast(case when k % 3 = 0 then (chk + 1) % 10 else chk end as string))"),
        ("card", "concat(body, cast(case when k % 5 = 0 then (last + 1) % 10 else last end as string))"),
    ],
    [
        ("idno", "concat(substr(d13, 1, 6), case k % 3 when 0 then '-' when 1 then '' else ' ' end, substr(d13, 7, 7))"),
        ("card_text", "case when k % 2 = 0 then concat(substr(card, 1, 4), '-', substr(card, 5, 4), '-', substr(card, 9, 4), '-', substr(card, 13, 4)) else card end"),
    ],
    [
        ("text", "case when k % 97 = 0 then null else concat('no ', idno, case when k % 6 = 0 then ' 12' else '' end, '; card ', card_text, case when k % 10 = 0 then '99' else '' end, '; tel ', mobile, ' / ', city, '; mail ', mail, '; id ', passport, ', ', licence, case when k % 9 = 0 then concat('x', chr(10), chr(10), chr(10), chr(10), 'y') else '' end, ' ', person, ' <b>A&amp;B</b>') end"),
    ],
]
COLUMNS = ["doc_id", "text", "idno", "card", "card_text", "mobile", "city", "mail", "passport", "licence", "person"]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as k"))
    for step in STEPS:
        df = df.selectExpr("*", *[f"{expression} as {name}" for name, expression in step])
    # a generator of one row: filters on the columns don't take their long expressions with them to the scan
    return df.withColumnRenamed("k", "doc_id").select(F.inline(F.array(F.struct(*COLUMNS))))


def corpus_sql() -> str:
    """The same as common table expressions, the last of them ``seed``."""
    out, before = ["s0 as materialized (select c_custkey as k from customer)"], "s0"
    for n, step in enumerate(STEPS, 1):
        columns = ", ".join(f"{expression} as {name}" for name, expression in step).replace(" as string)", " as varchar)")
        out.append(f"s{n} as materialized (select *, {columns} from {before})")
        before = f"s{n}"
    return ",\n".join([*out, f"seed as materialized (select k as doc_id, {', '.join(COLUMNS[1:])} from {before})"])
