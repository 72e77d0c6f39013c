"""The library's queries against their SQL, the span operators against Python's expressions, masks and checks by hand."""

import decimal
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from inkveil.functions import masks, validators
from inkveil.functions.rules import RULES
from inkveil.operators import entities, spans
from inkveil.plans.catalog import QUERIES, SQL

#: Over texts that a rule's guard rarely passes there is little to compare: these are run by name where they matter.
EMPTY = {"match_rrn_docs", "match_fgn_docs", "match_driver_docs", "match_email_conversations"}
NAMES = sorted(set(SQL) - EMPTY)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf}/{file}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    key = lambda r: [str(v) for v in r]
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=key)
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=key)
    assert got == want


def test_names_have_queries():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 90


def test_find_is_finditer(spark):
    texts = ["a 4111 1111 1111 1111 b", "", None, "900101-1234567, 9001011234567", "x@y.de z@w.co.kr", "010-1234-5678 011-123-4567 가나 02-123-4567", "M12345678 m123a4567", "11-95-123456-78"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for rule in RULES.values():
        rx = re.compile(rule.pattern, re.IGNORECASE | re.ASCII)
        for r in df.select("id", spans.find(F.col("text"), rule.java, rule.name).alias("m")).collect():
            assert [(x.start, x.end, x.value) for x in r.m] == [(m.start(), m.end(), m.group()) for m in rx.finditer(texts[r.id] or "")]


def test_checks(spark):
    def check(f, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").select("i", f(F.col("v")).alias("ok")).collect()
        return [r.ok for r in sorted(rows)]

    assert check(validators.is_luhn, "4111111111111111", "4111111111111112") == [True, False]
    assert check(validators.is_card, "4111-1111-1111-1111", "1111111111111117", "378282246310005") == [True, False, True]
    assert check(validators.is_date6, "690101", "680101", "990229", "000229", "9913", "261301") == [True, False, False, True, False, False]
    assert check(validators.is_phone_mobile, "010-1234-5678", "011-1234-5678", "0101234-5678", "01012345678") == [True, False, False, True]
    assert check(validators.is_phone_city, "02-123-4567", "0311234567", "021234567", "099-123-4567") == [True, True, True, False]
    assert check(validators.is_driver_license, "11-95-123456-78", "27-95-123456-78", "11-94-123456-78") == [True, False, False]


def test_masks_keep_lengths(spark):
    values = ["900101-1234567", "a.b+c@d-e.co", "4111 1111 1111 1111", "김철수", "", "02-123-4567", "A&amp;B"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for f in (masks.keep_rules, masks.email, masks.document_email, masks.except_hyphen, masks.first_digits, masks.last_digits, masks.phone_group, masks.phone_plain, masks.card_ends, masks.name_first):
        assert all(len(r.v) == len(r.m) for r in df.select("v", f(F.col("v")).alias("m")).collect())
    got = {r.v: r.m for r in df.select("v", masks.keep_rules(F.col("v")).alias("m")).collect()}
    assert got["A&amp;B"] == "*&amp;*" and got["a.b+c@d-e.co"] == "***+*@*-****"


def test_valid_spans_survive(spark):
    df = spark.createDataFrame([(1, "4111 1111 1111 1111 and 900101-1234567 12 and x@y.de")], "doc_id long, text string")
    r = spans.annotated(df).withColumn("kept", spans.filter_overlapping(F.col("spans"))).first()
    assert {(x.rule, x.start) for x in r.spans if x.valid} <= {(x.rule, x.start) for x in r.kept}


def test_dictionary_provider(spark):
    df = spark.createDataFrame([(1, "Lena in Seoul"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, entities.run(df, entities.dictionary({"Lena": "PS", "Seoul": "LC"})).collect())) == [(1, "LC", 8, 13, 1.0), (1, "PS", 0, 4, 1.0)]
    assert entities.run(df).collect() == []
