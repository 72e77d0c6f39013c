"""Operators against their stated rules, written plainly in Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkveil.functions import text, validators
from inkveil.functions.rules import GUARDS, RULES
from inkveil.operators import chunks, entities, ocr, report, spans


@pytest.fixture(scope="module")
def rng():
    return random.Random(13)


def random_text(rng, n, letters="ab \n"):
    return "".join(rng.choice(letters) for _ in range(n))


# --- chunks and pages -----------------------------------------------------------------------------------------------------


def test_chunks_by_their_rules(rng):
    for _ in range(400):
        t, size, overlap = random_text(rng, rng.randint(0, 600), rng.choice(["ab \n", "abcdefghijklmnop\n", "abcdefgh "])), rng.choice([1, 90, 150]), rng.choice([0, 20, 200])
        out = chunks.chunk_bounds(t, size, overlap)
        if not t:
            assert out == []
            continue
        assert out[0][0] == 0 and out[-1][1] == len(t)
        for (a, b), (c, _) in zip(out, out[1:]):
            limit = a + size
            behind = [max((p + 1 for p in range(max(a, limit - 80), limit) if t[p] == sign), default=None) for sign in "\n "]
            assert b == next((x for x in behind if x is not None), limit)
            assert c == max(a + 1, b - overlap)
        assert out[-1][0] + size >= len(t)


def test_pages_by_their_rules(rng):
    for _ in range(300):
        t = random_text(rng, rng.randint(0, 4000), rng.choice(["a\n", "abcdefghijklmnopqrstuvw\n", "abc"]))
        out = chunks.page_bounds(t, 800)
        assert out[0][0] == 0 and out[-1][1] == len(t) and all(b == c for (_, b), (c, _) in zip(out, out[1:]))
        for a, b in out[:-1]:
            empty = max((p for p in range(a + 600, a + 801) if t[p : p + 2] == "\n\n"), default=None)
            line = max((p for p in range(a + 300, a + 801) if t[p] == "\n"), default=None)
            assert b == (empty if empty is not None else line if line is not None else a + 800)


def test_needles():
    page = 'a <b>x y z</b> 4111\n1111 Kim Kim, <i class="q">010-12</i>34'
    needle = lambda value, source="regex", label=None, valid=True: {"value": value, "source": source, "label": label, "valid": valid}
    wanted = [needle("Kim", "ner", "PS"), needle("41111111"), needle("Kim", "ner", "PS"), needle("Kim", "ner", "PS"), needle("4111"), needle("x"), needle("y", "ner", "PS"), needle("class")]
    got = {k: page[a:b] for k, a, b in chunks.place_needles(page, wanted)}
    # the long number goes over the line end; the short one has no free place, the third name neither; single letters and tags don't count
    assert got == {1: "4111\n1111", 0: "Kim", 2: "Kim"}


def test_detections_of_pages(spark):
    pages = spark.createDataFrame([(1, 0, 0), (1, 1, 40), (1, 2, 80), (2, 0, 0)], "doc_id long, page int, first int")
    found = spark.createDataFrame([(1, 0), (1, 39), (1, 40), (1, 500), (2, 3), (3, 1)], "doc_id long, start int")
    assert sorted((r.doc_id, r.start, r.page) for r in chunks.page_of(found, pages, ["doc_id"]).collect()) == [(1, 0, 0), (1, 39, 0), (1, 40, 1), (1, 500, 2), (2, 3, 0)]


# --- texts ----------------------------------------------------------------------------------------------------------------


def test_normalized_places(spark, rng):
    letters = ["a", "b", " ", " ", "\t", "\n", "\r", "\r\n", "​", " ", "—", "①", "é", "ﬁ", "\f"]
    raws = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, "a  b  ", "x\r\ny"]
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string").select("id", "raw", text.normalize_indexed("raw").alias("x"), text.normalize(F.col("raw")).alias("n"))
    for r in df.collect():
        raw = r.raw or ""
        assert len(r.x.text) == len(r.x["at"])
        # characters are composed one by one, so only texts whose whole form is no other agree with the plain function
        if unicodedata.normalize("NFKC", raw) == "".join(unicodedata.normalize("NFKC", c) for c in raw):
            assert r.x.text == r.n
        assert all(a <= b for a, b in zip(r.x["at"], r.x["at"][1:]))
        for c, at in zip(r.x.text, r.x["at"]):
            own = raw[at]
            assert c in unicodedata.normalize("NFKC", own) or (c == " " and own in "\t\f ") or (c == "-" and own == "—") or (c == "\n" and own == "\r")
    last = {r.raw: r.x for r in df.where("id >= 302").collect()}
    assert last["a  b  "].text == "a b" and last["x\r\ny"]["at"] == [0, 1, 3]


def test_raw_runs(spark):
    df = spark.createDataFrame([([0, 1, 1, 2, 5, 6], 0, 6), ([0, 1, 1, 2, 5, 6], 2, 4), ([3], 0, 9), ([], 0, 1), ([0, 1], 1, 1), ([0, 1], -1, 1)], "at array<int>, s int, e int")
    got = [[tuple(x) for x in r.r] for r in df.select(text.raw_runs(F.col("at"), F.col("s"), F.col("e")).alias("r")).collect()]
    assert got == [[(0, 2, 0, 2), (1, 3, 2, 4), (5, 7, 4, 6)], [(1, 3, 2, 4)], [(3, 4, 0, 1)], [], [], []]


def test_find_target(spark):
    rows = [("a Foo bar", "Foo"), ("a ＦＯＯ bar", "foo"), ("a F o\no b", "Foo"), ("abc", "z"), ("abc", "a"), ("", "ab"), (None, "ab"), ("abc", None), ("a b", " a b ")]
    out = spark.createDataFrame(rows, "raw string, want string").select(text.find_target(F.col("raw"), F.col("want")).alias("x")).collect()
    assert [None if r.x is None else tuple(r.x) for r in out] == [(2, 5), (2, 5), (2, 7), None, None, None, None, None, (0, 3)]


def test_tables_to_markdown():
    assert text.markdown_tables("a\tb\nc") == "a\tb\nc"
    assert text.markdown_tables("a\tb\nc\td\te") == "\n| a | b |  |\n| --- | --- | --- |\n| c | d | e |\n"
    assert text.markdown_tables("|a|b|\n|---|---|\n|c|d|") == "|a|b|\n|---|---|\n|c|d|"
    assert text.markdown_tables("x  y\nz  w") == "x  y\nz  w"  # two rows by blanks are no table
    assert text.markdown_tables("```\na\tb\nc\td\n```\n<table") == "```\na\tb\nc\td\n```\n<table"
    assert text.markdown_tables("Column 2\tb\n\t\n1\t2|3").startswith("Column 2\tb\n\t\n")


# --- spans ----------------------------------------------------------------------------------------------------------------


def test_guards_pass_every_match(rng):
    digits = "0123456789"
    made = ["4111 1111 1111 1111", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "a@b.co", "900101-1234567", "900101 5234567", "010-123-4567", "02-123-4567", "11-95-123456-78", "M12345678", "m123a4567"]
    made += ["".join(rng.choice(digits + "- ") for _ in range(30)) for _ in range(3000)]
    for t in made:
        for name, rule in RULES.items():
            if re.search(rule.pattern, t, re.IGNORECASE | re.ASCII):
                assert re.search(GUARDS[name], t), (name, t)


def brute_filter(own):
    cut = lambda a, b: a["start"] < b["end"] and b["start"] < a["end"]
    strong = lambda x: x["rule"] in ("rrn", "fgn")
    kept = [m for m in own if m["valid"] or not any(v["valid"] and cut(m, v) for v in own) and (strong(m) or not any(strong(h) and cut(m, h) for h in own))]
    return [(x["start"], x["end"]) for x in sorted(kept, key=lambda x: (x["start"], -x["end"]))]


def test_span_algebra(spark, rng):
    rows = []
    for k in range(300):
        own = []
        for _ in range(rng.choice([0, 1, 5, 30, 80])):
            a = rng.randint(0, 200)
            own.append({"rule": rng.choice(["rrn", "card", "email"]), "start": a, "end": a + rng.randint(1, 12), "valid": rng.random() < 0.4})
        rows.append((k, own))
    df = spark.createDataFrame(rows, "k long, s array<struct<rule:string,start:int,end:int,valid:boolean>>")
    ok, bad = spans.collect(F.col("s"))
    out = df.select("k", spans.filter_overlapping(F.col("s")).alias("f"), spans.without_forbidden(ok, bad).alias("w"), spans.covered(F.col("s"), F.lit(150)).alias("c")).collect()
    for r in out:
        own = rows[r.k][1]
        assert [(x.start, x.end) for x in r.f] == brute_filter(own)
        free = [x for x in own if x["valid"] and not any(not y["valid"] and x["start"] < y["end"] and y["start"] < x["end"] for y in own)]
        assert sorted((x.start, x.end) for x in r.w) == sorted((x["start"], x["end"]) for x in free)
        assert r.c == len({p for x in own for p in range(x["start"], x["end"]) if p < 150})


def test_running(spark, rng):
    rows = [(k, [rng.randint(-5, 50) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 15, 16, 17, 300, 1000])]
    out = spark.createDataFrame(rows, "k long, v array<int>").select("k", spans.sums_before(F.col("v")).alias("s"), spans.greatest_before(F.col("v")).alias("g")).collect()
    for r in out:
        v = rows[r.k][1]
        assert r.s == [sum(v[:i]) for i in range(len(v))] and r.g == [max([-1, *v[:i]]) for i in range(len(v))]


def test_long_document(spark):
    """Twenty thousand matches in one text, with the text around each, in seconds."""
    import time

    one = "é a.b@c.kr; "
    df = spark.createDataFrame([(1, one * 20_000)], "doc_id long, text string")
    start = time.time()
    out = spans.match(df).select(F.size("matches").alias("n"), F.element_at("matches", -1).alias("last"), F.get("matches", F.lit(9999)).alias("m")).first()
    assert out.n == 20_000 and out.m.start == 9999 * len(one) + 2 and out.m.context == (one * 6)[18:66]
    assert time.time() - start < 90


def test_exposure_both_ways(spark):
    df = spark.createDataFrame([(1, "a.b@c.kr and 010-1234-5678"), (2, ""), (3, None), (4, "nothing")], "doc_id long, text string")
    found = spans.match(df)
    rows = spans.rows(found, ["doc_id"]).withColumnsRenamed({"start": "s", "end": "e"})
    a = {r.doc_id: (r.total_chars, r.exposed_chars, r.exposure) for r in report.exposure_of(found, ["doc_id"]).collect()}
    b = {r.doc_id: (r.total_chars, r.exposed_chars, r.exposure) for r in report.exposure(df, rows).collect()}
    assert a == b and a[1][1] == 21 and a[2] == a[3] == (0, 0, 0.0)


# --- entities and blocks ----------------------------------------------------------------------------------------------------


def test_merge_entities(spark, rng):
    rows = []
    for k in range(200):
        own = []
        for _ in range(rng.choice([0, 1, 4, 20])):
            a = rng.randint(0, 60)
            own.append((rng.choice(["PS", "LC"]), a, a + rng.randint(0, 8), rng.random()))
        rows.append((k, own))
    out = spark.createDataFrame(rows, "k long, x array<struct<label:string,start:int,end:int,score:double>>").select("k", entities.merge(F.col("x"), 2).alias("m")).collect()
    for r in out:
        want = []
        for label, a, b, score in sorted(rows[r.k][1]):
            if want and want[-1][0] == label and a <= want[-1][2] + 2:
                _, s, e, old = want[-1]
                n, m = max(1, e - s), max(1, b - a)
                want[-1] = (label, s, max(e, b), (old * n + score * m) / (n + m))
            else:
                want.append((label, a, b, score))
        assert [(x.label, x.start, x.end, round(x.score, 9)) for x in r.m] == [(x[0], x[1], x[2], round(x[3], 9)) for x in want]


def test_recognise_over_chunks(spark):
    t = "tel " * 100
    df = spark.createDataFrame([(7, t), (8, None), (9, "| a | tel |\nBtel")], "doc_id long, text string")
    provider = entities.dictionary({"tel": "I-LC"})
    out = {r.doc_id: [(e.label, e.start, e.end) for e in r.entities] for r in entities.recognise(df, provider, size=50, overlap=20, without_tables=True).collect()}
    assert out == {7: [("LC", 4 * i, 4 * i + 3) for i in range(100)], 9: [("LC", 13, 16)]}
    assert entities.recognise(df).collect() == []


def test_lines_follow_their_mean(spark, rng):
    blocks, want = [], {}
    for image in range(40):
        own = [(image, k, f"t{k}", float(rng.randint(0, 300)), float(y := rng.randint(0, 120)), 0.0, float(y + 10)) for k in range(rng.randint(1, 25))]
        blocks += own
        lines = []
        for b in sorted(own, key=lambda b: ((b[4] + b[6]) / 2, (b[3] + b[5]) / 2, b[1])):
            y = (b[4] + b[6]) / 2
            line = next((line for line in lines if abs(y - sum(line["y"]) / len(line["y"])) <= 10), None)
            if line is None:
                lines.append(line := {"y": [], "b": []})
            line["y"].append(y)
            line["b"].append(b)
        for n, line in enumerate(lines, 1):
            for b in line["b"]:
                want[image, b[1]] = n
    df = spark.createDataFrame(blocks, "image long, id long, text string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.image, r.id): r.line for r in ocr.group_lines(df, ["image"]).collect()} == want


def test_first_rule_readings(spark):
    rows = ["TEL: 010-1234-5678", "여권 M12345678 x", "a.b＠c。kr", "nothing", "", None, "I0I0-1234-5678", "카드=4111111111111111|x"]
    out = spark.createDataFrame([(t,) for t in rows], "t string").select(ocr.first_rule(ocr.candidate_texts(F.col("t"))).alias("x")).collect()
    assert [None if r.x is None else r.x.rule for r in out] == ["phone_mobile", "passport", "email", None, None, None, "phone_mobile", "card"]


def test_cards_over_lines(spark):
    block = lambda i, t, x, y: (1, i, t, x, y, x + 9.0, y + 9.0)
    df = spark.createDataFrame([block(0, "4111", 0.0, 0.0), block(1, "1111 1111", 10.0, 0.0), block(2, "1111", 0.0, 40.0), block(3, "x", 20.0, 40.0)], "image long, id long, text string, x0 double, y0 double, x1 double, y1 double")
    out = ocr.joined_cards(ocr.group_lines(df, ["image"]), ["image"]).collect()
    assert [(r.value, r.x0, r.x1, r.y1) for r in out] == [("4111111111111111", 0.0, 19.0, 49.0)]


def test_stream_of_documents(spark, tmp_path):
    """Matches and counts by window of a stream agree with those of the table."""
    from inkveil.streaming import exposure

    rows = [(k, f"2026-01-01 0{k % 3}:00:00", "a.b@c.kr and x") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, at string, text string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = exposure.counts_by_window(exposure.match_stream(stream), "at").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.rule, r.n, r.n_ok) for r in spark.table("counts").collect()) == [("email", 4, 4)] * 3


def test_ocr_cards_are_checked(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("41111",)], "v string")
    assert [r.x for r in df.select(validators.is_ocr_card(F.col("v")).alias("x")).collect()] == [True, False, False]


def test_inference(spark):
    """Tokens in windows that overlap give each entity once, with the mean of its scores; the rest as the rules say."""
    from inkveil.operators import inference

    t = "Kim Lee, in Seoul (Gangnam) and\nBusan"
    names = ["O", "B-PS", "I-PS", "LC"]
    import re as expressions

    words = [(m.start(), m.end()) for m in expressions.finditer(r"\w+", t)]
    kind = {"Kim": 1, "Lee": 2, "Seoul": 3, "Gangnam": 3, "Busan": 3}
    rows = [(1, a, b, [9.0 if k == kind.get(t[a:b], 0) else 0.0 for k in range(4)], t, [(0, 1)] if a < 0 else []) for a, b in words]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, logits array<double>, text string, out array<struct<start:int,end:int>>")
    for length in (100, 6, 5):
        found = inference.infer(df, ["doc_id"], names, settings=inference.Settings(max_length=length, stride=1)).collect()
        assert sorted((r.label, t[r.start : r.end]) for r in found) == [("LC", "Busan"), ("LC", "Seoul (Gangnam)"), ("PS", "Kim"), ("PS", "Lee")]
        assert all(0.8 < r.score < 0.9 for r in found)
    left = inference.infer(df.withColumn("out", F.expr("array(named_struct('start', 12, 'end', 13))")), ["doc_id"], names, exclude="out", wanted=["LC"]).collect()
    assert sorted(t[r.start : r.end] for r in left) == ["Busan", "Gangnam"]
    assert inference.Settings.of({"NER_STRIDE": "3", "NER_FORCE_CPU": "1", "NER_TEMPERATURE": "2.5", "X": "y"}) == inference.Settings(stride=3, force_cpu=True, temperature=2.5)
